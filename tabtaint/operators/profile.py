"""Null / placeholder profiles and simple aggregates (AGG1-AGG12).

Every profile is ONE aggregation over the table with one expression per column (map-side
partial aggregation, one tiny shuffle), then an unpivot of the single result row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_TYPES = (T.FloatType, T.DoubleType)


MAX_DRIVER_VALUES = 100_000


def bounded_values(df: DataFrame, column, limit: int = MAX_DRIVER_VALUES) -> list:
    """Distinct non-null values of a column (or column expression) for a driver-side map.

    The count is checked first, so the driver never receives more than ``limit`` values;
    beyond it the caller must use a join-based path instead.
    """
    c = F.col(column) if isinstance(column, str) else column
    vals = df.select(c.alias("_v")).where(F.col("_v").isNotNull()).distinct()
    n = vals.count()
    if n > limit:
        raise ValueError(f"{n} distinct values exceed the driver-side bound of {limit}")
    return [r[0] for r in vals.collect()]


def is_missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN for float columns (pandas' ``isna``)."""
    dt = df.schema[c].dataType
    col = F.col(c)
    return (col.isNull() | F.isnan(col)) if isinstance(dt, FLOAT_TYPES) else col.isNull()


def null_profile(df: DataFrame, dataset: str, exclude=("row_key",)) -> DataFrame:
    """AGG1: one row ``dataset, n_rows, n_columns, n_cells, n_nulls, null_pct, rows_with_nulls, has_nulls``."""
    cols = [c for c in df.columns if c not in exclude]
    miss = [is_missing(df, c) for c in cols]
    any_null = reduce(lambda a, b: a | b, miss) if miss else F.lit(False)
    per = [F.sum(m.cast("bigint")) for m in miss]
    total = reduce(lambda a, b: a + b, per) if per else F.lit(0)
    r = df.agg(F.count(F.lit(1)).alias("n_rows"),
               F.coalesce(total, F.lit(0)).cast("bigint").alias("n_nulls"),
               F.coalesce(F.sum(any_null.cast("bigint")), F.lit(0)).cast("bigint").alias("rows_with_nulls"))
    ncol = len(cols)
    return r.select(
        F.lit(dataset).alias("dataset"), "n_rows", F.lit(ncol).cast("bigint").alias("n_columns"),
        (F.col("n_rows") * ncol).alias("n_cells"), "n_nulls",
        F.round(F.when(F.col("n_rows") * ncol > 0, F.col("n_nulls") * 100.0 / (F.col("n_rows") * ncol))
                .otherwise(0.0), 6).alias("null_pct"),
        "rows_with_nulls", (F.col("n_nulls") > 0).alias("has_nulls"))


def column_null_profile(df: DataFrame, only_with_nulls: bool = True, exclude=("row_key",)) -> DataFrame:
    """AGG2: ``column, dtype, null_count, null_pct`` (columns with nulls only by default)."""
    cols = [c for c in df.columns if c not in exclude]
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(is_missing(df, c).cast("bigint")).alias(f"_c{i}")
                                              for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stacked = one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.coalesce(F.col(f"_c{i}"), F.lit(0)).alias("null_count"))
        for i, c in enumerate(cols)])).alias("s"))
    out = stacked.select("s.column", "s.dtype", F.col("s.null_count").cast("bigint").alias("null_count"),
                         F.round(F.when(F.col("_n") > 0, F.col("s.null_count") * 100.0 / F.col("_n"))
                                 .otherwise(0.0), 6).alias("null_pct"))
    return out.where(F.col("null_count") > 0) if only_with_nulls else out


def placeholder_profile(df: DataFrame, numeric_value=-1, text_value="UNKNOWN", exclude=("row_key",)) -> DataFrame:
    """Per column: ``column, null_count, placeholder_count`` — one aggregation."""
    cols = [c for c in df.columns if c not in exclude]
    exprs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        ph = F.col(c) == F.lit(numeric_value) if isinstance(dt, T.NumericType) else \
            F.col(c).cast("string") == F.lit(text_value)
        exprs.append(F.sum(is_missing(df, c).cast("bigint")).alias(f"_z{i}"))
        exprs.append(F.sum(F.coalesce(ph, F.lit(False)).cast("bigint")).alias(f"_p{i}"))
    one = df.agg(*exprs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_z{i}"), F.lit(0)).cast("bigint").alias("null_count"),
                 F.coalesce(F.col(f"_p{i}"), F.lit(0)).cast("bigint").alias("placeholder_count"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def profile_many(tables: dict, only_with_nulls: bool = False, spark=None) -> DataFrame:
    """AGG3: AGG1 rows for many datasets.  Values are DataFrames or loader functions; a
    loader that fails gives an error row and the loop continues."""
    rows = None
    for name, loader in tables.items():
        try:
            df = loader() if callable(loader) else loader
            spark = spark or df.sparkSession
            p = null_profile(df, name).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:  # noqa: BLE001 — a failing dataset is reported, the loop continues
            if spark is None:
                raise
            p = spark.createDataFrame([(name, str(e)[:500])], "dataset string, error string")
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    if only_with_nulls and rows is not None:
        rows = rows.where(F.col("has_nulls"))
    return rows


def profile_summary(profiles: DataFrame) -> DataFrame:
    """AGG3 summary: datasets checked, with nulls, with errors."""
    return profiles.agg(F.count(F.lit(1)).alias("datasets_checked"),
                        F.count_if(F.col("has_nulls")).alias("datasets_with_nulls"),
                        F.count_if(F.col("error").isNotNull()).alias("datasets_with_errors"))


def value_counts(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """AGG4: frequency table, ties broken by value."""
    o = F.col("count").asc() if ascending else F.col("count").desc()
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(o, F.col(column).asc())


def minority_label(df: DataFrame, column: str) -> DataFrame:
    """AGG5: the least frequent label (ties -> smallest value), one row."""
    vc = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return vc.agg(F.min_by(F.col(column), F.struct("n", column)).alias("minority_label"),
                  F.min("n").alias("minority_count"))


def problem_kind(df: DataFrame, target: str) -> str:
    """AGG6: binary / multiclass by the number of distinct targets."""
    n = df.agg(F.count_distinct(target)).first()[0]
    return "binary" if n <= 2 else "multiclass"


def equal_width_bin(x: Column, lo: Column, hi: Column, n_bins: int) -> Column:
    """AGG9: ``pd.cut`` bins (right-closed, lowest value in the first bin), 0-based."""
    w = (hi - lo) / F.lit(n_bins)
    b = F.ceil((x - lo) / w).cast("int") - 1
    return F.when(hi == lo, F.lit(0)).when(x <= lo, F.lit(0)).otherwise(F.least(F.greatest(b, F.lit(0)), F.lit(n_bins - 1)))
