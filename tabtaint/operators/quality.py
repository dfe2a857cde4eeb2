"""Distribution quality of a synthetic table against the real one (QLT1-QLT5).

* column shape, numeric: KS complement ``1 - max|F_r - F_s|`` (exact, integer prefix sums)
* column shape, categorical: TV complement ``1 - 1/2 sum|p_r - p_s|``
* pair trend, numeric-numeric: ``1 - |rho_r - rho_s| / 2`` (Pearson)
* pair trend with a categorical: contingency similarity ``1 - 1/2 sum|p_r(a,b) - p_s(a,b)|``,
  numeric side cut into 10 equal-width bins on the real range
* overall: mean of the two property averages.
Every metric of a kind is computed for ALL columns / pairs in one job (exploded long form).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.operators.ordered import max_cdf_gap_by_group
from tabtaint.operators.profile import equal_width_bin

N_BINS = 10


def tv_complement(real: DataFrame, syn: DataFrame, columns) -> DataFrame:
    """QLT3 for several categorical columns in one aggregation: ``column, score``."""
    def long(df, tag):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                             for c in columns])).alias("x")) \
            .select("x.column", "x.value", F.lit(tag).alias("src"))
    u = long(real, "r").unionByName(long(syn, "s"))
    cnt = u.groupBy("column", "value").agg(F.count_if(F.col("src") == "r").alias("nr"),
                                           F.count_if(F.col("src") == "s").alias("ns"))
    tot = cnt.groupBy("column").agg(F.sum("nr").alias("tr"), F.sum("ns").alias("ts"))
    j = cnt.join(F.broadcast(tot), "column")   # one row per column
    return j.groupBy("column").agg(
        (F.lit(1.0) - F.lit(0.5) * F.sum(F.abs(F.col("nr") / F.col("tr") - F.col("ns") / F.col("ts")))).alias("score"))


def correlation_similarity(real: DataFrame, syn: DataFrame, numeric) -> DataFrame:
    """QLT4: ``col_a, col_b, score`` for every numeric pair; one aggregation per table."""
    pairs = list(combinations(numeric, 2))
    if not pairs:
        return real.sparkSession.createDataFrame([], "col_a string, col_b string, score double")
    rr = real.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    ss = syn.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    rows = [(a, b, None if rr[f"p{i}"] is None or ss[f"p{i}"] is None else 1.0 - abs(rr[f"p{i}"] - ss[f"p{i}"]) / 2.0)
            for i, (a, b) in enumerate(pairs)]
    return real.sparkSession.createDataFrame(rows, "col_a string, col_b string, score double")


def _discretise(real: DataFrame, df: DataFrame, numeric, bounds) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in numeric:
            lo, hi = bounds[c]
            cols.append(F.when(F.col(c).isNull(), F.lit(None)).otherwise(
                equal_width_bin(F.col(c).cast("double"), F.lit(lo), F.lit(hi), N_BINS)).cast("string").alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    return df.select(*cols)


def contingency_similarity(real: DataFrame, syn: DataFrame, numeric, categorical) -> DataFrame:
    """QLT5: ``col_a, col_b, score`` for every pair with at least one categorical column.

    All pairs in ONE exploded aggregation ``groupBy(pair, a, b)``; the numeric side is cut into
    10 equal-width bins on the real range (values outside it are clamped into the end bins).
    """
    cols = list(numeric) + list(categorical)
    pairs = [(a, b) for a, b in combinations(cols, 2) if a in categorical or b in categorical]
    if not pairs:
        return real.sparkSession.createDataFrame([], "col_a string, col_b string, score double")
    mm = real.agg(*[x for c in numeric for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() \
        if numeric else {}
    bounds = {c: (float(mm[f"lo_{c}"]), float(mm[f"hi_{c}"])) for c in numeric}
    rd, sd = _discretise(real, real.select(*cols), numeric, bounds), _discretise(real, syn.select(*cols), numeric, bounds)

    def long(df, tag):
        return df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                                      F.col(a).alias("va"), F.col(b).alias("vb")) for a, b in pairs])).alias("x")) \
            .select("x.*", F.lit(tag).alias("src"))
    u = long(rd, "r").unionByName(long(sd, "s"))
    cnt = u.groupBy("col_a", "col_b", "va", "vb").agg(F.count_if(F.col("src") == "r").alias("nr"),
                                                      F.count_if(F.col("src") == "s").alias("ns"))
    tot = cnt.groupBy("col_a", "col_b").agg(F.sum("nr").alias("tr"), F.sum("ns").alias("ts"))
    j = cnt.join(F.broadcast(tot), ["col_a", "col_b"])   # one row per pair: d^2 bounded
    return j.groupBy("col_a", "col_b").agg(
        (F.lit(1.0) - F.lit(0.5) * F.sum(F.abs(F.col("nr") / F.col("tr") - F.col("ns") / F.col("ts")))).alias("score"))


def ks_complements(real: DataFrame, syn: DataFrame, columns) -> dict:
    """QLT2 for several numeric columns: one count job and one range-partitioned fold."""
    columns = list(columns)
    if not columns:
        return {}
    def long(df, tag):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                             for c in columns])).alias("x")).select("x.*", F.lit(tag).alias("src")) \
            .where(F.col("v").isNotNull())
    u = long(real, "r").unionByName(long(syn, "s"))
    cnt = {r["column"]: (r["n"], r["m"]) for r in u.groupBy("column").agg(
        F.count_if(F.col("src") == "r").alias("n"), F.count_if(F.col("src") == "s").alias("m")).collect()}
    totals = {c: cnt[c] for c in columns if all(cnt.get(c, (0, 0)))}
    per = u.where(F.col("column").isin(list(totals))).groupBy("column", "v").agg(
        F.count_if(F.col("src") == "r").alias("a"), F.count_if(F.col("src") == "s").alias("b"))
    gap = max_cdf_gap_by_group(per, "column", "v", "a", "b", totals) if totals else {}
    return {c: 1.0 - gap[c] if c in gap else float("nan") for c in columns}


def column_shapes(real: DataFrame, syn: DataFrame, numeric, categorical) -> DataFrame:
    spark = real.sparkSession
    ks = ks_complements(real, syn, numeric)
    rows = [(c, "KSComplement", ks[c]) for c in numeric]
    num = spark.createDataFrame(rows, "column string, metric string, score double")
    if categorical:
        cat = tv_complement(real, syn, categorical).select("column", F.lit("TVComplement").alias("metric"), "score")
        return num.unionByName(cat)
    return num


def column_pair_trends(real: DataFrame, syn: DataFrame, numeric, categorical) -> DataFrame:
    corr = correlation_similarity(real, syn, numeric).withColumn("metric", F.lit("CorrelationSimilarity"))
    cont = contingency_similarity(real, syn, numeric, categorical).withColumn("metric", F.lit("ContingencySimilarity"))
    return corr.unionByName(cont)


def quality_report(real: DataFrame, syn: DataFrame, numeric, categorical) -> DataFrame:
    """QLT1: one row ``score, column_shapes, column_pair_trends``; details via the two helpers."""
    shapes = column_shapes(real, syn, numeric, categorical).agg(F.avg("score").alias("column_shapes"))
    trends = column_pair_trends(real, syn, numeric, categorical).agg(F.avg("score").alias("column_pair_trends"))
    a, b = shapes.first()[0], trends.first()[0]
    parts = [x for x in (a, b) if x is not None]
    score = sum(parts) / len(parts) if parts else None
    return real.sparkSession.createDataFrame([(score, a, b)], "score double, column_shapes double, column_pair_trends double")
