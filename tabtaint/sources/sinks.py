"""Writers (SNK1-SNK7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtaint.spec import TableSpec

MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite"):
    """SNK1."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, if_exists: str = "fail", batch_size: int = 1000):
    """SNK2: ``if_exists`` in replace / append / fail, inserts in batches of 1000."""
    w = df.write.mode(MODES[if_exists]).option("batchsize", batch_size)
    w.jdbc(url, table, properties=properties)


def write_json(df: DataFrame, path: str, mode: str = "overwrite"):
    """SNK3: one JSON record per row (tasks, results, reports)."""
    df.write.mode(mode).json(path)


def safe_table_name(name: Column) -> Column:
    """SNK6: SQL-safe table name (``-`` and space -> ``_``, lower case)."""
    return F.lower(F.translate(name, "- ", "__"))


def metadata_rows(spark, specs: dict) -> DataFrame:
    """SNK6: TableSpecs -> ``(dataset, key, value)`` rows, values as text (lists as JSON)."""
    import json
    rows = []
    for ds, s in specs.items():
        s: TableSpec
        rows += [(ds, "name", s.name), (ds, "problem_type", s.problem_type), (ds, "target_feature", s.target),
                 (ds, "categorical_features", json.dumps(list(s.categorical)))]
    return spark.createDataFrame(rows, "dataset string, key string, value string")


def object_path(*parts: Column, null_marker: str = "NULL") -> Column:
    """SNK7: ``a/b/c`` from id parts, NULL markers and nulls dropped."""
    return F.concat_ws("/", *[F.nullif(p.cast("string"), F.lit(null_marker)) for p in parts])
