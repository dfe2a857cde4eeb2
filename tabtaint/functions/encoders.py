"""Categorical encoders (ENC1-ENC7).

Codes are tables that Spark numbers (:func:`code_table`) and joins (:func:`encode`), whatever
the number of values.  Only one-hot columns and the clipped decoder need the vocabulary as a
list in the driver (checked).  For model features the MLlib path
(:func:`mllib_features`) builds sparse vectors with StringIndexer + OneHotEncoder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtaint.operators.ordered import numbered
from tabtaint.operators.profile import equal_width_bin
from tabtaint.operators.profile import bounded_values

MAX_VOCAB = 100_000
BROADCAST_CODE_BYTES = 32 << 20
CODE_SALTS = 16


def vocabulary(*dfs_and_col) -> list:
    """Sorted distinct non-null values of a column over one or more tables (ENC5: union)."""
    *dfs, col = dfs_and_col
    u = None
    for d in dfs:
        s = d.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull())
        u = s if u is None else u.unionByName(s)
    vals = u.distinct()
    n = vals.count()
    if n > MAX_VOCAB:
        raise ValueError(f"vocabulary of {col} has {n} values; use mllib_features for high cardinality")
    return sorted(r[0] for r in vals.collect())


def one_hot(df: DataFrame, columns, vocabs: dict, keep=()) -> DataFrame:
    """ENC1: ``<col>_<value>`` 0/1 columns; an unknown value gives all zeros."""
    out = [F.col(c) for c in keep]
    for c in columns:
        for v in vocabs[c]:
            out.append(F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*out)


def code_table(*dfs_and_col) -> DataFrame:
    """The union vocabulary as a table ``value, code``: the text's place in sorted order, from 0.

    It is numbered in Spark, so its size is not bounded by the driver (ENC2, ENC5)."""
    *dfs, col = dfs_and_col
    texts = [d.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()) for d in dfs]
    return numbered(reduce(DataFrame.unionByName, texts).distinct(), "value")


def encode(df: DataFrame, column: str, codes: DataFrame, out: str, unknown: int | None = -1) -> DataFrame:
    """``df`` with the code of ``column`` as ``out``; unknown and null values get ``unknown``.

    A code table within ``BROADCAST_CODE_BYTES`` (measured) is broadcast; a larger one is joined on
    the value and a salt, so that a hot value's rows meet its code in many tasks."""
    size = codes.agg(F.sum(F.octet_length("value") + 24)).first()[0] or 0
    t = codes.select(F.col("value").alias("_value"), F.col("code").cast("int").alias("_code"))
    x = df.withColumn("_value", F.col(column).cast("string"))
    if size <= BROADCAST_CODE_BYTES:
        j = x.join(F.broadcast(t), "_value", "left")
    else:
        salts = F.sequence(F.lit(0), F.lit(CODE_SALTS - 1))
        j = x.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(CODE_SALTS)).cast("int")) \
            .join(t.withColumn("_salt", F.explode(salts)), ["_value", "_salt"], "left").drop("_salt")
    return j.withColumn(out, F.coalesce("_code", F.lit(unknown).cast("int"))).drop("_value", "_code")


def factorize(df: DataFrame, col: str, order_by: str) -> DataFrame:
    """ENC4: codes in first-seen order, where "first" is the smallest ``order_by`` value.

    Returns the code table ``(value, code)`` (one row per distinct value), numbered in Spark.
    """
    first = df.groupBy(col).agg(F.min(order_by).alias("_first"))
    return numbered(first, "_first").select(col, F.col("code").cast("int").alias("code"))


def decode_ordinal(x: Column, vocab: list) -> Column:
    """ENC6: round, clip into [0, n-1], map back to the category."""
    arr = F.array(*[F.lit(v) for v in vocab])
    idx = F.least(F.greatest(F.round(x).cast("int"), F.lit(0)), F.lit(len(vocab) - 1))
    return F.element_at(arr, idx + 1)


def discretise(df: DataFrame, columns, n_bins: int = 10, keep=()) -> DataFrame:
    """ENC7: strings -> ordinal codes; integers with <= n_bins distinct values -> codes of the
    sorted values; other numbers -> equal-width bins.  Probes are one aggregation."""
    from pyspark.sql import types as T
    schema = {f.name: f.dataType for f in df.schema.fields}
    probe = df.agg(*[x for c in columns for x in (F.count_distinct(c).alias(f"d_{c}"), F.min(c).alias(f"lo_{c}"),
                                                  F.max(c).alias(f"hi_{c}"))]).first()
    out = [F.col(c) for c in keep]
    coded = df
    for c in columns:
        dt = schema[c]
        if isinstance(dt, T.StringType) or isinstance(dt, T.BooleanType):
            coded = encode(coded, c, code_table(df, c), f"_code_{c}")
            out.append(F.col(f"_code_{c}").alias(c))
        elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and probe[f"d_{c}"] <= n_bins:
            vals = sorted(bounded_values(df, c))   # n_bins values at most
            mp = F.create_map(*[x for i, v in enumerate(vals) for x in (F.lit(v), F.lit(i))])
            out.append(F.element_at(mp, F.col(c)).alias(c))
        else:
            out.append(equal_width_bin(F.col(c).cast("double"), F.lit(float(probe[f"lo_{c}"])),
                                       F.lit(float(probe[f"hi_{c}"])), n_bins).alias(c))
    return coded.select(*out)


def mllib_features(df: DataFrame, numeric, categorical, output: str = "features", fit_on: DataFrame | None = None):
    """ENC1/ENC2 for models: StringIndexer(keep unknown) + OneHotEncoder + VectorAssembler.

    Returns ``(fitted PipelineModel, transformed df)``; categories are fitted on ``fit_on``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
    stages = []
    idx = [f"_{c}_idx" for c in categorical]
    ohe = [f"_{c}_ohe" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep", dropLast=True))
    num_out = [f"_{c}_num" for c in numeric]
    prepared = df
    for c, o in zip(numeric, num_out):
        prepared = prepared.withColumn(o, F.col(c).cast("double"))
    if numeric:
        stages.append(Imputer(inputCols=num_out, outputCols=num_out, strategy="median"))
    stages.append(VectorAssembler(inputCols=num_out + ohe, outputCol=output, handleInvalid="keep"))
    fit_src = prepared if fit_on is None else fit_on.select(
        "*", *[F.col(c).cast("double").alias(o) for c, o in zip(numeric, num_out)])
    for c in categorical:
        prepared = prepared.withColumn(c, F.col(c).cast("string"))
        fit_src = fit_src.withColumn(c, F.col(c).cast("string"))
    model = Pipeline(stages=stages).fit(fit_src)
    return model, model.transform(prepared)
