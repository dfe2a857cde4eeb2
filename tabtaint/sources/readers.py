"""Readers (SRC1-SRC9).  Everything is a lazy DataFrame; only metadata is driver-side."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.spec import TableSpec

META_KEYS = ["name", "problem_type", "target_feature", "categorical_features"]


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """SRC1: CSV with header; explicit schema preferred (inference scans the data twice)."""
    r = spark.read.option("header", header)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_csv_named(spark: SparkSession, path: str, names_types, header: bool = True) -> DataFrame:
    """SRC2: supplied column names/types, leading spaces skipped; with ``header`` the first
    line is consumed (the reference's ``header=0`` + ``names``)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in names_types)
    return (spark.read.schema(schema).option("header", header).option("ignoreLeadingWhiteSpace", True)
            .option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path))


def read_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """SRC3: Parquet (object store paths work the same way); optional column pruning."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict, columns=None,
              partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """SRC4: SQL table scan, range-partitioned on ``partition_column`` when given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in properties.items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", partitions))
    df = r.load()
    return df.select(*columns) if columns else df


def metadata_table(meta: DataFrame) -> DataFrame:
    """SRC5: ``(dataset, key, value)`` rows -> one row per dataset (pivot on the known keys)."""
    return meta.groupBy("dataset").pivot("key", META_KEYS).agg(F.first("value"))


def specs_from_metadata(meta: DataFrame) -> dict:
    """SRC5: TableSpecs from the pivoted metadata (small: one row per dataset).

    List values may be JSON arrays or a scalar (normalised to a one-element list)."""
    out = {}
    for r in metadata_table(meta).collect():
        cats = r["categorical_features"]
        try:
            cats = json.loads(cats) if cats else []
        except (TypeError, ValueError):
            cats = [cats]
        if isinstance(cats, str):
            cats = [cats]
        target = r["target_feature"]
        out[r["dataset"]] = TableSpec(name=r["name"] or r["dataset"], target=target,
                                      problem_type=r["problem_type"] or "classification", categorical=tuple(cats))
    return out


def read_yaml_metadata(spark: SparkSession, path: str) -> dict:
    """SRC5 (YAML object): small text file read through Spark, parsed on the driver."""
    import yaml
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return yaml.safe_load(text) or {}


def discover_datasets(spark: SparkSession, root: str, extension: str = "parquet") -> DataFrame:
    """SRC6: ``(path, name)`` of files under ``root`` with the extension; contents never read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}")
             .option("recursiveFileLookup", True).load(root).select("path"))
    return files.select("path", F.regexp_extract("path", rf"([^/]+)\.{extension}$", 1).alias("name"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: dataset-name list; blank lines and ``#`` comments skipped."""
    t = spark.read.text(path).select(F.trim("value").alias("name"))
    return t.where((F.col("name") != "") & ~F.col("name").startswith("#"))


def read_json_records(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """SRC8: JSON objects with a declared schema."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_synthetic(spark: SparkSession, path: str, max_rows: int | None = None, key: str = "row_key", seed: int = 42):
    """SRC9: an earlier synthetic table, optionally capped at ``max_rows`` by exact hash
    sampling (RND7, fixed seed 42)."""
    from tabtaint.operators.sampling import sample_rows
    df = spark.read.parquet(path)
    return sample_rows(df, key, max_rows, seed, "cap") if max_rows else df
