"""Synthetic-table generators that are Spark work (GEN1, GEN4, GEN5, GEN6; GEN2/GEN3 in bayes.py).

Contract: ``generate(df, columns, n_samples, seed) -> DataFrame(draw_id, columns...)``.
Draws are hash functions of ``(seed, column, draw_id)``; draw ids come from ``spark.range``
(distributed), so n_samples can be as large as the cluster allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.rng import hash_hex, py_hash, uniform
from tabtaint.operators.intervals import MISSING, along, join_intervals
from tabtaint.operators.ordered import numbered
from tabtaint.operators.sampling import number_by_hash, sample_with_replacement
from tabtaint.session import cut_lineage, stored
from tabtaint.spec import INTEGRAL_TYPES

SMALL_VOCAB = 10_000


def _values(df: DataFrame, columns, group: str | None = None) -> DataFrame:
    """``_g, _column, _value, _n``: how often each column (of each group) holds each value, as text, in
    one aggregation.  A null is a value."""
    g = _group(F.col(group)) if group else F.lit("")
    items = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value")) for c in columns]
    return df.select(g.alias("_g"), F.explode(F.array(*items)).alias("x")).groupBy("_g", "x._column", "x._value") \
        .agg(F.count(F.lit(1)).alias("_n"))


def _group(c):
    """A text for each group, null apart."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def _drawn(draws: DataFrame, df: DataFrame, columns, values: DataFrame, seed, tag: str, most: int, n_draws: int, keep=()) -> DataFrame:
    """A value of each column for each of ``n_draws`` draws (``draw_id, _g, _size``): the one whose interval of the
    running counts holds ``floor(u * _size)``.  ``values`` is a stored table."""
    points = [F.struct(F.lit(c).alias("_column"), F.floor(uniform(seed, f"{tag}:{c}", F.col("draw_id")) * F.col("_size"))
                       .cast("bigint").alias("_pos")) for c in columns]
    long = draws.select("draw_id", "_g", *keep, F.explode(F.array(*points)).alias("x")).select("draw_id", "_g", *keep, "x._column", "x._pos")
    intervals = along(values, ["_g", "_column"], "_value", "_n", seed, f"{tag}:order", long, n_draws * len(columns), most) \
        .select("_g", "_column", "_value", "_lo", "_hi")
    found = join_intervals(long, intervals, ["_g", "_column"], most)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return found.groupBy("draw_id", *keep).agg(
        *[F.max(F.when(F.col("_column") == c, F.col("_value"))).cast(kinds[c]).alias(c) for c in columns])


def marginal(df: DataFrame, columns, n_samples: int, seed, key: str = "row_key") -> DataFrame:
    """GEN1: each column drawn independently from its empirical distribution.

    All columns' value counts are one aggregation; running counts cut [0, n) into an interval a
    value, and a draw takes the value whose interval holds its position (inverse CDF, JN6)."""
    spark, columns = df.sparkSession, list(columns)
    values = stored(_values(df, columns), "values")
    n = values.where(F.col("_column") == columns[0]).agg(F.sum("_n").alias("n")).first()["n"] or 0
    out = spark.range(n_samples).select(F.col("id").alias("draw_id"), F.lit("").alias("_g"), F.lit(n).alias("_size"))
    if n == 0:
        return out.limit(0).select("draw_id", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns])
    return _drawn(out, df, columns, values, seed, "gen1", n, n_samples).select("draw_id", *columns)


def uniform_sampler(df: DataFrame, columns, n_samples: int, seed, categorical=()) -> DataFrame:
    """GEN4: numeric uniform on the observed [min, max] (integers: whole numbers in range);
    categorical uniform over the observed vocabulary."""
    spark = df.sparkSession
    schema = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in columns if c not in categorical]
    mm = df.agg(*[x for c in num for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() if num else {}
    out = spark.range(n_samples).withColumnRenamed("id", "draw_id")
    for c in columns:
        u = uniform(seed, f"gen4:{c}", F.col("draw_id"))
        if c in num:
            lo, hi = mm[f"lo_{c}"], mm[f"hi_{c}"]
            if isinstance(schema[c], INTEGRAL_TYPES):
                v = F.least(F.floor(F.lit(float(lo)) + u * F.lit(float(hi - lo + 1))), F.lit(hi)).cast(schema[c])
            else:
                v = (F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))).cast(schema[c])
            out = out.withColumn(c, v)
        else:
            vocab = df.select(c).where(F.col(c).isNotNull()).distinct()
            m = vocab.count()
            if m <= SMALL_VOCAB:
                vals = sorted((r[0] for r in vocab.collect()), key=lambda v: py_hash(seed, f"gen4:{c}:order", v))
                arr = F.array(*[F.lit(v) for v in vals])
                out = out.withColumn(c, F.element_at(arr, (F.floor(u * F.lit(m)) + 1).cast("int")))
            else:
                nv, m = number_by_hash(vocab, c, seed, f"gen4:{c}:order")
                out = (out.withColumn("_p", F.floor(u * F.lit(m)).cast("bigint"))
                       .join(nv.withColumnRenamed("_pos", "_p"), "_p").drop("_p"))
    return out.select("draw_id", *columns)


def bootstrap(df: DataFrame, columns, n_samples: int, seed, key: str = "row_key") -> DataFrame:
    """GEN5 (dummy sampler): rows drawn with replacement."""
    return sample_with_replacement(df.select(key, *columns), key, n_samples, seed, "boot").select("draw_id", *columns)


def per_class(df: DataFrame, columns, target: str, n_samples: int, seed, key: str = "row_key") -> DataFrame:
    """GEN6: ``max(2, n_samples // #classes)`` rows per class, each column drawn from its
    empirical distribution within the class, label re-attached.  A null label is no class: rows
    without a label generate nothing.

    Classes are a numbered table, joined to the draws by their number: any number of them will do."""
    spark, columns = df.sparkSession, list(columns)
    df = df.where(F.col(target).isNotNull())
    sizes = df.groupBy(F.col(target).alias("_label")).agg(F.count(F.lit(1)).alias("_size")) \
        .withColumn("_g", _group(F.col("_label"))) \
        .withColumn("_h", F.concat(hash_hex(seed, "gen6:classes", F.coalesce(F.col("_label").cast("string"), F.lit(MISSING))), "_g"))
    classes = cut_lineage(numbered(sizes, "_h", "_class").drop("_h"))
    r = classes.agg(F.count(F.lit(1)).alias("n"), F.max("_size").alias("most")).first()
    if not r["n"]:
        return spark.range(0).select(F.col("id").alias("draw_id"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in [*columns, target]])
    per = max(2, n_samples // r["n"])
    draws = spark.range(per * r["n"]).select(F.col("id").alias("draw_id"), F.expr(f"id div {per}").alias("_class")).join(classes, "_class")
    values = stored(_values(df, columns, target), "values")
    out = _drawn(draws.withColumnRenamed("_label", target), df, columns, values, seed, "gen6", r["most"], per * r["n"], keep=(target,))
    return out.select("draw_id", *columns, target)
