"""Curation, filtering and imputation (CUR1-CUR5, FLT1-FLT5, IMP1-IMP2).

Column decisions (which columns are sparse, which are 0/1) come from ONE aggregation over
all columns; the rows are then rewritten in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtaint.operators.profile import is_missing
from tabtaint.spec import NUMERIC_TYPES, TableSpec

MISSING_CATEGORY = "missing_value"   # fixed value: the category given to missing categoricals
SPARSE_COLUMN_SHARE = 0.5            # fixed value: columns with at least this null share are dropped


def date_to_epoch(c: Column, fmt_java: str = "yyyy-MM-dd") -> Column:
    """CUR1: ``yyyy-MM-dd`` text -> epoch seconds (UTC); unparseable -> 0.

    The text is parsed with an explicit +00:00 offset so the session time zone plays no role.
    """
    ts = F.try_to_timestamp(F.concat(c.cast("string"), F.lit(" +00:00")), F.lit(fmt_java + " XXX"))
    return F.coalesce(F.unix_seconds(ts), F.lit(0).cast("bigint"))


def round_column(c: Column, digits: int = 6) -> Column:
    """CUR2."""
    return F.round(c, digits)


def binary_columns(df: DataFrame, exclude=("row_key",)) -> list[str]:
    """CUR3 probe: numeric columns whose non-null values are all 0 or 1 (one aggregation)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]
    if not cols:
        return []
    r = df.agg(*[F.bool_and(F.col(c).isNull() | F.col(c).isin(0, 1)).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is None or r[c]]


def narrow_binary(df: DataFrame, exclude=("row_key",)) -> DataFrame:
    """CUR3: cast 0/1 columns to ``tinyint``."""
    bins = set(binary_columns(df, exclude))
    return df.select(*[F.col(c).cast("tinyint").alias(c) if c in bins else F.col(c) for c in df.columns])


def sparse_columns(df: DataFrame, share: float = SPARSE_COLUMN_SHARE, exclude=("row_key",)) -> list[str]:
    """FLT2 probe: columns whose null share is >= ``share`` (one aggregation)."""
    cols = [c for c in df.columns if c not in exclude]
    r = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is not None and r[c] >= share]


def drop_sparse_columns(df: DataFrame, spec: TableSpec | None = None, share: float = SPARSE_COLUMN_SHARE):
    """FLT2: drop sparse columns, also from the spec's categorical list."""
    drop = sparse_columns(df, share)
    out = df.drop(*drop)
    if spec is not None:
        spec = spec.with_(categorical=tuple(c for c in spec.categorical if c not in drop),
                          numeric=tuple(c for c in spec.numeric if c not in drop))
    return out, spec, drop


def drop_null_rows(df: DataFrame) -> DataFrame:
    """FLT1: drop rows with any null (NaN counts as null)."""
    cols = [c for c in df.columns]
    if not cols:
        return df
    return df.where(~reduce(lambda a, b: a | b, [is_missing(df, c) for c in cols]))


def _placeholder_hit(df: DataFrame, c: str, placeholders) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.NumericType):
        vals = [p for p in placeholders if isinstance(p, (int, float)) and not isinstance(p, bool)]
    else:
        vals = [str(p) for p in placeholders if isinstance(p, str)]
    if not vals:
        return F.lit(False)
    return F.coalesce(F.col(c).isin(*vals), F.lit(False))


def drop_placeholder_rows(df: DataFrame, placeholders, exclude=("row_key",)) -> DataFrame:
    """FLT3: drop rows holding any placeholder (numbers compared with numeric columns only)."""
    hits = [_placeholder_hit(df, c, placeholders) for c in df.columns if c not in exclude]
    return df.where(~reduce(lambda a, b: a | b, hits)) if hits else df


def placeholders_to_null(df: DataFrame, placeholders, exclude=("row_key",)) -> DataFrame:
    """FLT5: placeholder values become NULL."""
    return df.select(*[F.when(_placeholder_hit(df, c, placeholders), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c not in exclude else F.col(c) for c in df.columns])


def medians(df: DataFrame, cols) -> dict:
    """Exact medians (interpolated, as pandas) by histogram refinement — no reducer ever
    holds all distinct values of a column."""
    from tabtaint.operators.ordered import exact_quantile
    return {c: exact_quantile(df, c, 0.5) for c in cols}


def impute(train: DataFrame, other: DataFrame | None, numeric, categorical):
    """IMP1 + IMP2: numeric nulls <- median of ``train`` (applied to both tables);
    categorical nulls <- ``'missing_value'`` and the column becomes a string."""
    med = medians(train, numeric)

    def fill(df):
        out = []
        for c in df.columns:
            if c in med and med[c] is not None:
                out.append(F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))).alias(c))
            elif c in categorical:
                out.append(F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)
    return fill(train), (fill(other) if other is not None else None), med


# per-dataset curation hooks (fixed values: the two special datasets of the corpus)
CURATION_HOOKS: dict = {}


def curation_hook(dataset: str):
    """EXT1: register ``fn(df) -> df`` run by :func:`curate` for one dataset name."""
    def deco(fn):
        CURATION_HOOKS.setdefault(dataset, []).append(fn)
        return fn
    return deco


@curation_hook("Marketing_Campaign")
def _marketing_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("Dt_Customer", date_to_epoch(F.col("Dt_Customer"))) if "Dt_Customer" in df.columns else df


@curation_hook("QSAR-TID-11")
def _qsar_rounding(df: DataFrame) -> DataFrame:
    return df.withColumn("MEDIAN_PXC50", round_column(F.col("MEDIAN_PXC50"))) if "MEDIAN_PXC50" in df.columns else df


@dataclass
class CurationReport:
    name: str
    initial_rows: int
    initial_columns: int
    final_rows: int
    final_columns: int
    dropped_columns: list


def curate(df: DataFrame, spec: TableSpec, date_columns=(), round_columns=(), hooks=None):
    """CUR4: categoricals -> string, dates -> epoch, rounding hooks, 0/1 -> tinyint,
    sparse columns dropped, null rows dropped.  Returns (df, spec, report).

    ``hooks`` is a list of ``DataFrame -> DataFrame`` functions (the per-dataset registry).
    """
    cats = set(spec.categorical) | ({spec.target} if spec.target and spec.problem_type == "classification" else set())
    out = df.select(*[F.col(c).cast("string").alias(c) if c in cats and c in df.columns else F.col(c)
                      for c in df.columns])
    for c in date_columns:
        out = out.withColumn(c, date_to_epoch(F.col(c)))
    for c in round_columns:
        out = out.withColumn(c, round_column(F.col(c)))
    for h in list(CURATION_HOOKS.get(spec.name, [])) + list(hooks or []):
        out = h(out)
    out = narrow_binary(out, exclude=("row_key",) + tuple(cats))
    out, spec2, dropped = drop_sparse_columns(out, spec.with_(categorical=tuple(sorted(cats, key=list(df.columns).index))))
    out = drop_null_rows(out)
    return out, spec2, dropped


def curation_report(before: DataFrame, after: DataFrame, name: str, dropped) -> DataFrame:
    """CUR4 shape log as a one-row table (two row counts)."""
    spark = before.sparkSession
    row = (name, before.count(), len(before.columns), after.count(), len(after.columns), ",".join(dropped))
    return spark.createDataFrame([row], "dataset string, initial_rows long, initial_columns long, "
                                        "final_rows long, final_columns long, dropped_columns string")
