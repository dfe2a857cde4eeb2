"""Reproducible train/test splits (SPL1-SPL4).

Each row's side is decided by its rank in ``md5(seed:split:row_key)`` order within its
class, against a per-class quota.  The rank is never materialised: per-class hash
thresholds (see :mod:`tabtaint.operators.sampling`) turn the split into a filter, by literals for few
classes and by a table of thresholds for many, so a class holding a third of the table is handled by
every task, not by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.rng import hash_hex
from tabtaint.operators.profile import equal_width_bin
from tabtaint.operators.ordered import numbered
from tabtaint.operators.sampling import (BROADCAST_GROUPS, LITERAL_GROUPS, _group_text, group_sizes, hash_thresholds,
                                         threshold_flag, threshold_table)
from tabtaint.session import cut_lineage

SPLIT_COL = "split"


def largest_remainder(counts: dict, total: int) -> dict:
    """Allocate ``total`` across classes proportionally; leftover units go to the largest
    fractional parts (ties: smaller class value first)."""
    n = sum(counts.values())
    if n == 0:
        return {g: 0 for g in counts}
    exact = {g: total * c / n for g, c in counts.items()}
    base = {g: int(math.floor(v)) for g, v in exact.items()}
    left = total - sum(base.values())
    order = sorted(counts, key=lambda g: (-(exact[g] - base[g]), str(g)))
    for g in order[:left]:
        base[g] += 1
    return base


def _size(size, n, default=None):
    if size is None:
        return default
    return int(math.ceil(size * n)) if isinstance(size, float) and size <= 1.0 else int(size)


def stratified_split(df: DataFrame, key: str, label: str | Column, test_size=0.25, train_size=None,
                     seed=None, tag: str = "split") -> DataFrame:
    """SPL1 / SPL4: adds ``split`` in {train, test, unused}.

    ``test_size`` / ``train_size`` are fractions (<= 1.0) or absolute row counts.  Without
    ``train_size`` every non-test row is train.  A class with fewer than 2 rows is an error
    (as in the reference's splitter).
    """
    if seed is None:
        raise ValueError("a random seed is required (RND1)")
    g = F.col(label) if isinstance(label, str) else label
    h = hash_hex(seed, tag, key)
    sizes = group_sizes(df, g)
    small = [r["_v"] for r in sizes.where("_n < 2").limit(5).collect()]
    if small:
        raise ValueError(f"The least populated class has only 1 member: {small}")
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    wanted = [_size(test_size, n)]
    if train_size is not None:
        wanted.append(_size(train_size, n, n - wanted[0]))
    quotas = shares(sizes, n, wanted)
    base = df.select(_group_text(g).alias("_g"), h.alias("_h"))
    tables = [threshold_table(base, quotas.select("_g", "_n", sum((F.col(f"_q{j}") for j in range(i + 1)), F.lit(0)).alias("_k")))
              for i in range(len(wanted))]
    groups = sizes.count()
    if groups <= LITERAL_GROUPS:
        value = {r["_g"]: r["_v"] for r in sizes.collect()}
        flags = [threshold_flag(h, {value[r["_g"]]: r["_t"] for r in t.collect()}, g) for t in tables]
        out = df
    else:   # a threshold row for each class, joined by the class
        out = df.withColumn("_g", _group_text(g)).withColumn("_h", h)
        for i, t in enumerate(tables):
            t = t.withColumnRenamed("_t", f"_t{i}")
            out = out.join(F.broadcast(t) if groups <= BROADCAST_GROUPS else t, "_g")
        flags = [F.col("_h") <= F.col(f"_t{i}") for i in range(len(tables))]
    side = F.when(flags[0], F.lit("test"))
    side = side.otherwise(F.lit("train")) if train_size is None else side.when(flags[1], F.lit("train")).otherwise(F.lit("unused"))
    return out.withColumn(SPLIT_COL, side).select(*[F.col(f"`{c}`") for c in df.columns], SPLIT_COL)


def shares(sizes: DataFrame, n: int, wanted: list[int]) -> DataFrame:
    """``_g, _n, _q0, _q1..``: each of ``wanted`` rows allocated across classes in proportion; leftover
    units go to the largest fractional parts (ties: class value as text).  The units are given by place in
    that order, found without a window over all classes."""
    out = sizes
    for i, total in enumerate(wanted):
        exact = F.lit(total) * F.col("_n") / F.lit(float(n or 1))
        out = out.withColumn(f"_e{i}", exact).withColumn(f"_q{i}", F.floor(f"_e{i}").cast("bigint"))
    out = cut_lineage(out)
    floors = out.agg(*[F.sum(f"_q{i}").alias(f"s{i}") for i in range(len(wanted))]).first()
    for i, total in enumerate(wanted):
        left = total - (floors[f"s{i}"] or 0)
        order = F.struct((F.col(f"_q{i}") - F.col(f"_e{i}")).alias("r"), F.col("_v").cast("string").alias("t"), F.col("_g").alias("g"))
        out = numbered(out.withColumn("_o", order), "_o", "_place").drop("_o") \
            .withColumn(f"_q{i}", F.col(f"_q{i}") + (F.col("_place") < left).cast("bigint")).drop("_place")
    return out.drop("_v", *[f"_e{i}" for i in range(len(wanted))])


def random_split(df: DataFrame, key: str, test_size=0.25, seed=None, tag: str = "split") -> DataFrame:
    """SPL3: unstratified (one group)."""
    if seed is None:
        raise ValueError("a random seed is required (RND1)")
    h = hash_hex(seed, tag, key)
    holder = {}

    def quota(counts):
        n = sum(counts.values())
        holder["n"] = n
        return {g: _size(test_size, n) for g in counts}
    th, _ = hash_thresholds(df, h, quota)
    return df.withColumn(SPLIT_COL, F.when(threshold_flag(h, th), F.lit("test")).otherwise(F.lit("train")))


def choose_bin_count(df: DataFrame, target: str, max_bins: int = 10, min_bins: int = 2):
    """SPL2 probe: the largest N in [min_bins, max_bins] whose non-empty equal-width bins all
    hold >= 2 rows.  One histogram of lcm(2..N) cells, which every N's bins are made of, is counted
    once and folded for each N."""
    mm = df.agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return None, lo, hi
    lo_, hi_ = float(lo), float(hi)
    x = df.select(F.col(target).cast("double").alias("x")).where(F.col("x").isNotNull())
    if hi_ == lo_:
        n = x.count()
        return (max_bins if n >= 2 else None), lo, hi
    cells = math.lcm(*range(min_bins, max_bins + 1))
    place = (F.col("x") - F.lit(lo_)) / F.lit(hi_ - lo_) * F.lit(cells)
    edge = F.abs(place - F.round(place)) < F.lit(_EDGE * cells)      # may be on either side of a bin's edge
    fine = x.select(F.floor(place).cast("int").alias("c"), F.when(edge, F.col("x")).alias("v")).groupBy("c", "v").count()
    return _most_bins(fine.collect(), lo_, hi_, cells, min_bins, max_bins), lo, hi


#: Values nearer to a cell's edge than this share of the range are counted by value.
_EDGE = 1e-12


def _most_bins(fine, lo: float, hi: float, cells: int, min_bins: int, max_bins: int) -> int | None:
    """The largest number of bins that all hold 2 rows or none, from the counts of the fine cells (at most
    ``cells``) and of the values on their edges.  A cell lies within one bin, whatever their number."""
    width = (hi - lo) / cells
    points = [(lo + (r["c"] + 0.5) * width if r["v"] is None else r["v"], r["count"]) for r in fine]
    for nb in range(max_bins, min_bins - 1, -1):
        bins: dict[int, int] = {}
        for v, n in points:
            at = 0 if v <= lo else min(max(math.ceil((v - lo) / ((hi - lo) / nb)) - 1, 0), nb - 1)
            bins[at] = bins.get(at, 0) + n
        if min(bins.values()) >= 2:
            return nb
    return None


def regression_split(df: DataFrame, key: str, target: str, test_size=0.25, seed=None,
                     max_bins: int = 10) -> DataFrame:
    """SPL2: stratify on equal-width bins of the target (10 down to 2), else unstratified."""
    nb, lo, hi = choose_bin_count(df, target, max_bins)
    if nb is None:
        return random_split(df, key, test_size, seed)
    b = equal_width_bin(F.col(target).cast("double"), F.lit(float(lo)), F.lit(float(hi)), nb)
    return stratified_split(df, key, b, test_size, None, seed)
