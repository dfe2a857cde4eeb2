"""Exact, reproducible, partition-independent sampling (RND1-RND10).

The selection rule is always "the k rows with the smallest ``md5(seed:tag:row_key)``".
Finding the k-th smallest hash of each group never sorts the table: a round counts the groups' rows by
the next hex digits of the hash (map-side combined), and a window along each group's counts finds
the digits at which the k-th row lies; the next round looks only there, until a few thousand rows are
left, which are ranked.  On uniformly distributed md5 values two rounds suffice even at 10^12
rows, and groups of few rows need none.  Thresholds are a table, one row a group, of which only the
number of open groups reaches the driver; for up to 64 groups they become literals, so the choice is
a plain filter ``h <= T``: a narrow projection, no join back, no shuffle of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtaint.functions.rng import hash_hex, py_hash
from tabtaint.session import cut_lineage

ALL = "g"   # sorts after every hex digest: selects everything
NONE = ""   # sorts before every hex digest: selects nothing
_SMALL = 20_000
#: Groups whose thresholds are literals, and those whose threshold rows (some 60 bytes each) are broadcast.
LITERAL_GROUPS, BROADCAST_GROUPS = 64, 100_000
#: Offsets that are broadcast (some 40 bytes each), and rows of a bucket that is ranked in one task.
BROADCAST_OFFSET_ROWS, BUCKET_ROWS = 500_000, 200_000


def _width(n_groups: int) -> int:
    if n_groups <= 16:
        return 4
    if n_groups <= 4096:
        return 3
    return 2


def _along(table: DataFrame, rows: int) -> DataFrame:
    """A table of one short row a group, to be joined with all rows: broadcast under a checked bound."""
    return F.broadcast(table) if rows <= BROADCAST_GROUPS else table


def threshold_table(base: DataFrame, quotas: DataFrame) -> DataFrame:
    """``_g, _t``: the threshold at which exactly ``_k`` of the group's ``_n`` rows have ``_h <= _t``.

    ``base`` has a row's group ``_g`` (text) and hash ``_h`` (hex), ``quotas`` has ``_g, _n, _k``.  Any
    number of groups will do: each round is one aggregation and a window along each group's counts."""
    quotas = cut_lineage(quotas.select("_g", "_n", "_k"))
    closed = quotas.where((F.col("_k") <= 0) | (F.col("_k") >= F.col("_n"))) \
        .select("_g", F.when(F.col("_k") <= 0, F.lit(NONE)).otherwise(F.lit(ALL)).alias("_t"))
    # in ``_at``, the digits found so far, ``_n`` rows of the group are left, of which the ``_k``-th is wanted
    open_ = quotas.where((F.col("_k") > 0) & (F.col("_k") < F.col("_n"))).select("_g", F.lit("").alias("_at"), "_n", "_k")
    groups = open_.count()
    inside = F.col("_h").startswith(F.col("_at"))
    while large := open_.where((F.col("_n") > _SMALL) & (F.length("_at") < 32)).count():
        width = _width(large)
        big = open_.where((F.col("_n") > _SMALL) & (F.length("_at") < 32))
        digits = F.substr(F.col("_h"), F.length("_at") + 1, F.lit(width))
        counts = base.join(_along(big.select("_g", "_at"), large), "_g").where(inside) \
            .groupBy("_g", digits.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = counts.withColumn("_s", F.sum("_c").over(upto)).join(big, "_g") \
            .where((F.col("_s") >= F.col("_k")) & (F.col("_s") - F.col("_c") < F.col("_k"))) \
            .select("_g", F.concat("_at", "_d").alias("_at"), F.col("_c").alias("_n"), (F.col("_k") - F.col("_s") + F.col("_c")).alias("_k"))
        rest = open_.where((F.col("_n") <= _SMALL) | (F.length("_at") >= 32))
        open_ = cut_lineage(rest.unionByName(found))
    ranked = base.join(_along(open_.select("_g", "_at", "_k"), groups), "_g").where(inside) \
        .withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h"))).where(F.col("_r") == F.col("_k"))
    return cut_lineage(closed.unionByName(ranked.select("_g", F.col("_h").alias("_t"))))


def group_sizes(df: DataFrame, group: Column) -> DataFrame:
    """``_g, _v, _n``: each group as text (null apart), its value and its number of rows."""
    return cut_lineage(df.groupBy(_group_text(group).alias("_g")).agg(F.first(group).alias("_v"), F.count(F.lit(1)).alias("_n")))


def hash_thresholds(df: DataFrame, h: Column, k: int | Callable[[Mapping], Mapping] | Mapping,
                    group: Column | None = None) -> tuple[dict, dict]:
    """Per-group threshold T such that exactly ``k[g]`` rows of group g have ``h <= T``, for few groups.

    ``k`` is an int (one group), a mapping group -> k, or a function ``{group: count} -> {group: k}``.
    Returns ``(thresholds, counts)``.  More than ``LITERAL_GROUPS`` groups are an error: their
    thresholds stay a table (:func:`threshold_table`).
    """
    spark = df.sparkSession
    # groups travel as text ("n": null), so that a null is a group like any other
    base = df.select((_group_text(group) if group is not None else F.lit("v0")).alias("_g"),
                     (group if group is not None else F.lit(0)).alias("_v"), h.alias("_h"))
    sizes = base.groupBy("_g").agg(F.first("_v").alias("_v"), F.count(F.lit(1)).alias("n")).limit(LITERAL_GROUPS + 1).collect()
    if len(sizes) > LITERAL_GROUPS:
        raise ValueError(f"more than {LITERAL_GROUPS} groups: use threshold_table")
    value = {r["_g"]: r["_v"] for r in sizes}
    counts = {r["_g"]: r["n"] for r in sizes}
    if callable(k):
        want = _by_text(value, k({value[t]: n for t, n in counts.items()}))
    elif isinstance(k, Mapping):
        want = _by_text(value, k)
    else:
        want = {"v0": int(k)}
    rows = [(t, n, int(want.get(t, 0))) for t, n in counts.items()]
    table = threshold_table(base, spark.createDataFrame(rows, "_g string, _n bigint, _k bigint")) if rows else None
    found = {r["_g"]: r["_t"] for r in table.collect()} if rows else {}
    return {value[t]: x for t, x in found.items()}, {value[t]: n for t, n in counts.items()}


def _group_text(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), group.cast("string")), F.lit("n"))


def _by_text(value: Mapping, by_value: Mapping) -> dict:
    return {t: by_value[v] for t, v in value.items() if v in by_value}


def threshold_flag(h: Column, thresholds: Mapping, group: Column | None = None) -> Column:
    """Boolean column ``h <= T[group]`` (a literal map lookup: no join)."""
    if group is None:
        return h <= F.lit(thresholds.get(0, NONE))
    if not thresholds:
        return F.lit(False)
    at_null = h <= F.lit(thresholds.get(None, NONE))
    known = [x for gv, t in thresholds.items() if gv is not None for x in (F.lit(gv), F.lit(t))]
    if not known:
        return group.isNull() & at_null
    return F.when(group.isNull(), at_null).otherwise(F.coalesce(h <= F.element_at(F.create_map(*known), group), F.lit(False)))


def row_count_k(fraction: float) -> Callable[[Mapping], Mapping]:
    """``int(max(fraction * n, 1))`` — the reference's row-count rule."""
    return lambda counts: {g: int(max(fraction * n, 1)) for g, n in counts.items()}


def sample_flag(df: DataFrame, key: str, k, seed, tag: str) -> tuple[Column, int]:
    """RND2: flag the exactly-k rows with the smallest hash; returns (flag column, n)."""
    h = hash_hex(seed, tag, key)
    th, counts = hash_thresholds(df, h, k)
    return threshold_flag(h, th), sum(counts.values())


def sample_rows(df: DataFrame, key: str, how_many: int, seed, tag: str = "sample") -> DataFrame:
    """RND2 / RND7: exact-k sample without replacement (all rows when k >= n)."""
    flag, _ = sample_flag(df, key, how_many, seed, tag)
    return df.filter(flag)


def sample_with_replacement(df: DataFrame, key: str, how_many: int, seed, tag: str = "boot") -> DataFrame:
    """RND2 with replacement / GEN5: k independent draws, each picks row ``floor(u*n)``.

    Rows are numbered 0..n-1 by hash order (two-phase numbering, no global sort) and the
    draws are joined on that number.  Draw ids come from ``range(k)`` (distributed).
    """
    spark = df.sparkSession
    numbered, n = number_by_hash(df, key, seed, tag + ":order")
    if n == 0 or how_many <= 0:
        return df.limit(0).withColumn("draw_id", F.lit(0).cast("bigint"))
    from tabtaint.functions.rng import uniform
    draws = (spark.range(how_many).withColumnRenamed("id", "draw_id")
             .withColumn("_pos", F.floor(uniform(seed, tag + ":draw", F.col("draw_id")) * F.lit(n)).cast("bigint")))
    out = draws.join(numbered, "_pos").drop("_pos")
    return out


def number_by_hash(df: DataFrame, key: str, seed, tag: str, group: str | None = None):
    """RND6: contiguous 0-based ``_pos`` in hash order (within ``group`` when given).

    Two-phase numbering: rows are bucketed by (group, first hex digits of the hash) — md5 makes
    the buckets even, so a hot group is spread over them, and the number of digits follows the number of
    rows.  Bucket counts are summed along by a window and joined back (broadcast under a checked
    bound); each bucket is ranked by a window partitioned by (group, bucket).  Returns ``(df, n)``;
    with a group, ``n`` is the dict of group sizes, or for very many groups a table ``_v, _n``.
    """
    h = hash_hex(seed, tag, key)
    g = _group_text(F.col(group)) if group else F.lit("v0")
    sizes = group_sizes(df, F.col(group) if group else F.lit(0))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    digits = 1
    while digits < 8 and total > BUCKET_ROWS * 16 ** digits:
        digits += 1
    x = df.withColumn("_h", h).withColumn("_bk", F.substring("_h", 1, digits)).withColumn("_g", g)
    hist = x.groupBy("_g", "_bk").count()
    before = Window.partitionBy("_g").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = cut_lineage(hist.select("_g", "_bk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off")))
    w = Window.partitionBy("_g", "_bk").orderBy("_h")
    offs = F.broadcast(offs) if offs.count() <= BROADCAST_OFFSET_ROWS else offs
    out = x.join(offs, ["_g", "_bk"]).withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1).drop("_bk", "_off", "_h", "_g")
    if not group:
        return out, total
    if sizes.count() > BROADCAST_GROUPS:
        return out, sizes.select("_v", "_n")
    return out, {r["_v"]: r["_n"] for r in sizes.collect()}


def py_derangement_order(values, seed, tag: str) -> dict:
    """RND5 on a small list: successor in hash order (a single cycle; n=1 unchanged)."""
    vals = sorted(set(values), key=lambda v: py_hash(seed, tag, v))
    if len(vals) < 2:
        return {v: v for v in vals}
    return {v: vals[(i + 1) % len(vals)] for i, v in enumerate(vals)}
