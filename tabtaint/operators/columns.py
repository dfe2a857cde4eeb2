"""Column-level table operations (PRJ1-PRJ4, CUR5 pairing, JSN2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtaint.spec import INTEGRAL_TYPES


def split_x_y(df: DataFrame, target: str, key: str = "row_key"):
    """PRJ1: features (with the key) and target (with the key); error if the target is absent."""
    if target not in df.columns:
        raise ValueError(f"target column {target} is not in the table")
    return df.drop(target), df.select(key, target)


def concat_x_y(x: DataFrame, y: DataFrame, columns, key: str = "row_key") -> DataFrame:
    """PRJ2: re-attach the target by key (no positional zip) in the original column order."""
    return x.join(y, key).select(*columns)


def cast_categorical(df: DataFrame, categorical) -> DataFrame:
    """PRJ3: declared categorical columns that exist become strings."""
    cats = set(categorical)
    return df.select(*[F.col(c).cast("string").alias(c) if c in cats else F.col(c) for c in df.columns])


def restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """PRJ4: back to the original types; integers are rounded first, casts never fail (try_cast)."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, INTEGRAL_TYPES):
            c = F.round(c.cast("double")).try_cast(f.dataType)
        else:
            c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def pair_dataset_files(files: DataFrame, data_ext: str = "csv", meta_ext: str = "yaml") -> DataFrame:
    """CUR5: ``(path)`` listing -> ``stem, has_data, has_meta, complete`` per dataset stem."""
    x = files.select(F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1).alias("stem"),
                     F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"))
    g = x.groupBy("stem").agg(F.collect_set("ext").alias("exts"))
    return g.select("stem", F.array_contains("exts", data_ext).alias("has_data"),
                    F.array_contains("exts", meta_ext).alias("has_meta"),
                    (F.array_contains("exts", data_ext) & F.array_contains("exts", meta_ext)).alias("complete"))


FD_RECORD_SCHEMA = ("type string, determinant struct<columnIdentifiers: array<struct<columnIdentifier: string>>>, "
                    "dependant struct<columnIdentifier: string>")


def read_fd_records(spark, path: str, fd_type: str = "FunctionalDependency") -> DataFrame:
    """JSN2: JSON-lines FD records; malformed lines are dropped, other record types filtered."""
    raw = spark.read.schema(FD_RECORD_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    ok = raw.where(F.col("_corrupt_record").isNull() & (F.col("type") == fd_type))
    lhs = F.transform(F.col("determinant.columnIdentifiers"), lambda x: x["columnIdentifier"])
    return ok.select(F.array_join(lhs, ",").alias("lhs"), F.col("dependant.columnIdentifier").alias("rhs"))
