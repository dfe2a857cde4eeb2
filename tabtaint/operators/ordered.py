"""Order statistics over a distinct-value table without a single-task global window.

The table is range-partitioned on the ordering column, each partition folds its own sorted
run in pandas (Arrow batches) into a few numbers, and the driver combines one small record
per partition.  A hot value is no problem: callers first aggregate to one row per value.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.session import cut_lineage


def _partitions(df: DataFrame) -> int:
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return max(int(n), 1)


def auc_from_counts(df: DataFrame, score_col: str, pos_col: str, neg_col: str) -> float:
    """Mann-Whitney AUC from per-score counts: ``sum pos_v * (neg_below_v + neg_v / 2) / (P * N)``."""
    parts = df.select(score_col, pos_col, neg_col).repartitionByRange(_partitions(df), score_col) \
        .sortWithinPartitions(score_col)

    def fold(it):
        first, below, positives, area = None, 0.0, 0.0, 0.0
        for pdf in it:
            if len(pdf) == 0:
                continue
            first = pdf[score_col].iloc[0] if first is None else first
            neg = pdf[neg_col].astype("float64")
            pos = pdf[pos_col].astype("float64")
            area += float((pos * (below + neg.cumsum() - neg / 2.0)).sum())
            below += float(neg.sum())
            positives += float(pos.sum())
        if first is not None:
            yield pd.DataFrame({"first": [first], "pos": [positives], "neg": [below], "part": [area]})
    schema = f"first {df.schema[score_col].dataType.simpleString()}, pos double, neg double, part double"
    rows = sorted(parts.mapInPandas(fold, schema).collect(), key=lambda r: r["first"])   # one record per partition
    acc, neg_before, P, N = 0.0, 0.0, 0.0, 0.0
    for r in rows:
        acc += r["part"] + neg_before * r["pos"]
        neg_before += r["neg"]
        P += r["pos"]
        N += r["neg"]
    return acc / (P * N) if P > 0 and N > 0 else float("nan")


def max_cdf_gap_by_group(df: DataFrame, group_col: str, order_col: str, a_col: str, b_col: str, totals: dict) -> dict:
    """``max_x |F_a(x) - F_b(x)|`` per group, from the counts ``a`` and ``b`` of each distinct value.

    ``totals`` maps a group to its two sums.  The two counts are summed apart and divided before
    they are compared, so no product of counts can overflow.  Each partition yields one record
    per group in it: at most partitions + groups records reach the driver, whatever the rows.
    """
    parts = df.select(group_col, order_col, a_col, b_col).repartitionByRange(_partitions(df), group_col, order_col) \
        .sortWithinPartitions(group_col, order_col)

    def fold(it):
        state: dict = {}
        for pdf in it:
            for g, sub in pdf.groupby(group_col, sort=False):
                n, m = totals[g]
                s = state.setdefault(g, [sub[order_col].iloc[0], 0, 0, -math.inf, math.inf])
                gap = (s[1] + sub[a_col].cumsum().astype("float64")) / n - (s[2] + sub[b_col].cumsum().astype("float64")) / m
                s[1] += int(sub[a_col].sum())
                s[2] += int(sub[b_col].sum())
                s[3], s[4] = max(s[3], float(gap.max())), min(s[4], float(gap.min()))
        yield pd.DataFrame([(g, *s) for g, s in state.items()], columns=["g", "first", "a", "b", "hi", "lo"])
    schema = (f"g {df.schema[group_col].dataType.simpleString()}, first {df.schema[order_col].dataType.simpleString()}, "
              "a long, b long, hi double, lo double")
    rows = parts.mapInPandas(fold, schema).collect()
    out: dict = {}
    for g, (n, m) in totals.items():
        best, a, b = 0.0, 0, 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["first"]):
            off = a / n - b / m
            best = max(best, abs(off + r["hi"]), abs(off + r["lo"]))
            a, b = a + r["a"], b + r["b"]
        out[g] = best
    return out


def numbered(df: DataFrame, order_col: str, name: str = "code") -> DataFrame:
    """``df`` with each row's 0-based place in the order of ``order_col`` (distinct values, nulls first).

    Rows are range-partitioned and counted along within their partition; only one count a
    partition is summed, so no task sees the whole order."""
    parts = df.repartitionByRange(_partitions(df), order_col).sortWithinPartitions(order_col)
    x = cut_lineage(parts.withColumn("_part", F.spark_partition_id())
                    .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in x.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for part, n in sizes:   # one row a partition
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _off long")
    return x.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_at")).drop("_part", "_at", "_off")


_BUCKETS = 4096
_SMALL_RANGE = 20_000


def kth_smallest(df: DataFrame, col: str, ks) -> dict:
    """Exact k-th smallest non-null values (1-based ranks ``ks``) without a global sort.

    Each round builds one histogram of the candidate value range (4,096 equal-width
    buckets, with per-bucket min/max, map-side combined), keeps only the bucket holding the
    wanted rank and recurses; once a range holds <= 20,000 rows they are ranked directly.
    Values equal to a bucket's min and max end the search at once (heavy duplicates).
    """
    x = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    out = {}
    for k in sorted(set(int(k) for k in ks)):
        cond = F.lit(True)
        lo_hi = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        lo, hi, n_in, below = lo_hi["lo"], lo_hi["hi"], lo_hi["n"], 0
        if not n_in or k < 1 or k > n_in:
            out[k] = None
            continue
        while True:
            if lo == hi:
                out[k] = lo
                break
            if n_in <= _SMALL_RANGE:
                vals = sorted(r[0] for r in x.where(cond).collect())   # <= 20,000 values
                out[k] = vals[k - below - 1]
                break
            w = (hi - lo) / _BUCKETS
            b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(_BUCKETS - 1))
            hist = sorted((r["b"], r["c"], r["mn"], r["mx"]) for r in x.where(cond).groupBy(b.alias("b")).agg(
                F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")).collect())
            cum = below
            for bi, c, mn, mx in hist:
                if cum + c >= k:
                    cond = cond & (b == F.lit(bi))
                    below, n_in, lo, hi = cum, c, mn, mx
                    break
                cum += c
    return out


def exact_quantile(df: DataFrame, col: str, q: float = 0.5):
    """Exact interpolated quantile (``lower + (upper - lower) * fraction`` at position
    ``(n - 1) q``), the definition of pandas, Spark ``percentile`` and DuckDB ``quantile_cont``.

    Small columns (<= 20,000 values) are collected once; otherwise the lower neighbour is
    found by histogram refinement and the upper one by a single aggregate."""
    x = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = x.count()
    if n == 0:
        return None
    h = (n - 1) * q
    lo_r = int(h) + 1
    frac = h - int(h)
    if n <= _SMALL_RANGE:
        vals = sorted(r[0] for r in x.collect())
        lo, hi = vals[lo_r - 1], vals[min(lo_r, n - 1)]
        return lo + (hi - lo) * frac
    lo = kth_smallest(x, "v", [lo_r])[lo_r]
    if frac == 0.0 or lo_r >= n:
        return lo
    r = x.agg(F.count_if(F.col("v") <= F.lit(lo)).alias("le"),
              F.min(F.when(F.col("v") > F.lit(lo), F.col("v"))).alias("nxt")).first()
    hi = lo if r["le"] > lo_r else r["nxt"]
    return lo + (hi - lo) * frac
