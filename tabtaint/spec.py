"""Table metadata (TableSpec) and explicit row identity (row_key).

pandas keeps an implicit index; Spark rows have no identity, so every operator works on an
explicit ``row_key`` string column: the declared primary key, or — for tables without a key —
``md5`` of the row content plus the ordinal of the row among its exact copies.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_KEY = "row_key"
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class TableSpec:
    """What the reference keeps in its per-dataset YAML, plus the row key.

    ``categorical`` is the declared list (it may contain the target, as after curation);
    ``numeric`` is derived: every other column that is not the target or the key.
    """

    name: str
    row_key: str = ROW_KEY
    target: str | None = None
    problem_type: str = "classification"
    categorical: tuple = field(default_factory=tuple)
    numeric: tuple = field(default_factory=tuple)

    def with_(self, **kw) -> "TableSpec":
        return replace(self, **kw)

    def feature_columns(self) -> list[str]:
        return [c for c in list(self.numeric) + list(self.categorical) if c != self.target]

    def to_sdtypes(self) -> dict:
        """PRJ7: column-role map ``{"columns": {col: {"sdtype": ...}}}``."""
        cols = {}
        for c in self.numeric:
            cols[c] = {"sdtype": "numerical"}
        for c in self.categorical:
            cols[c] = {"sdtype": "categorical"}
        if self.target:
            cols[self.target] = {"sdtype": "categorical" if self.problem_type == "classification" else "numerical"}
        return {"columns": cols}

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "problem_type": self.problem_type,
                           "target_feature": self.target, "categorical_features": list(self.categorical)})


def infer_spec(df: DataFrame, name: str, target: str | None = None, categorical=None,
               problem_type: str = "classification", row_key: str = ROW_KEY) -> TableSpec:
    """PRJ5: roles from declaration, else from the schema (strings/booleans categorical).

    Numeric = every column neither declared categorical nor the target nor the key
    (the reference's rule when a categorical list is given).
    """
    fields = [f for f in df.schema.fields if f.name != row_key]
    if categorical is None:
        cat = [f.name for f in fields if not isinstance(f.dataType, NUMERIC_TYPES) and f.name != target]
        num = [f.name for f in fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name != target]
    else:
        names = {f.name for f in fields}
        cat = [c for c in categorical if c in names]
        num = [f.name for f in fields if f.name not in categorical and f.name != target]
    if target and problem_type == "classification" and categorical is None:
        cat = cat + [target]
    return TableSpec(name=name, row_key=row_key, target=target, problem_type=problem_type,
                     categorical=tuple(cat), numeric=tuple(num))


def sdtype_table(spark, spec: TableSpec) -> DataFrame:
    """PRJ7 as a table ``(column, sdtype)``."""
    rows = [(c, v["sdtype"]) for c, v in spec.to_sdtypes()["columns"].items()]
    return spark.createDataFrame(rows, "column string, sdtype string")


def content_text(df: DataFrame, cols=None):
    """Canonical text of a row: every value behind its length, a null as ``n``, so that no two
    different rows share a text."""
    return F.concat(*[_part(F.col(c)) for c in cols or df.columns])


def _part(c):
    s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))


DUP_BROADCAST_LIMIT = 1_000_000


def with_row_key(df: DataFrame, key_cols=None, name: str = ROW_KEY) -> DataFrame:
    """Attach ``row_key``.

    With ``key_cols`` (declared unique key): the key's text (length-prefixed for several columns).
    Without: ``md5(row content) || '-' || ordinal among exact copies``.

    Only an 8-byte content hash is shuffled to find the hashes that occur more than once (all copies are
    among their rows).  When that set is bounded (checked) it is broadcast: other rows get
    ordinal 0 with no shuffle of the wide rows, and only these are numbered by content — per input
    split first and then offset per split, so a group of copies holding a third of the table
    is numbered by many tasks, not one.
    """
    if key_cols:
        key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
        key = F.col(key_cols[0]).cast("string") if len(key_cols) == 1 else F.concat(*[_part(F.col(c)) for c in key_cols])
        return df.withColumn(name, key)
    x = df.withColumn("_ch", F.md5(content_text(df))).withColumn("_xh", F.xxhash64(content_text(df)))
    dups = x.groupBy("_xh").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select("_xh")
    n_dups = dups.count()
    if n_dups == 0:
        return x.withColumn(name, F.concat(F.col("_ch"), F.lit("-0"))).select(*df.columns, name)
    if n_dups <= DUP_BROADCAST_LIMIT:
        flagged = x.join(F.broadcast(dups.withColumn("_dup", F.lit(True))), "_xh", "left")
        uniq = flagged.where(F.col("_dup").isNull()).withColumn(name, F.concat(F.col("_ch"), F.lit("-0")))
        copies = flagged.where(F.col("_dup").isNotNull())
        return uniq.select(*df.columns, name).unionByName(_number_copies(copies, df.columns, name))
    return _number_copies(x, df.columns, name)


def _number_copies(x: DataFrame, columns, name: str) -> DataFrame:
    x = x.withColumn("_sp", F.spark_partition_id()).withColumn("_mi", F.monotonically_increasing_id())
    local = x.withColumn("_lo", F.row_number().over(Window.partitionBy("_ch", "_sp").orderBy("_mi")) - 1)
    per_split = local.groupBy("_ch", "_sp").agg(F.count(F.lit(1)).alias("_n"))
    offs = per_split.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.partitionBy("_ch").orderBy("_sp")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = (local.join(offs.select("_ch", "_sp", "_off"), ["_ch", "_sp"])
           .withColumn(name, F.concat(F.col("_ch"), F.lit("-"), (F.col("_off") + F.col("_lo")).cast("string"))))
    return out.select(*columns, name)


def sql_content_key(cols) -> str:
    """DuckDB twin of ``with_row_key`` without key (ordinal by any order among copies)."""
    parts = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in cols)
    ch = f"md5({parts})"
    return f"({ch} || '-' || CAST(row_number() OVER (PARTITION BY {ch}) - 1 AS VARCHAR))"
