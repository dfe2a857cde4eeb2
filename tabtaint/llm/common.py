"""Shared helpers of the corpus operators: scratch tables, lambda bindings, word expressions."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.session import checkpoint_dir, ship_package

#: The white space that separates words, ASCII blanks 0x20 and 0x09-0x0D.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Everything but ASCII digits, ASCII letters and characters beyond ASCII.
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of those characters in a text that is not lower-cased yet.
ALNUM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """Session of ``df``, with the package shipped to the executors that run Python tasks."""
    ship_package(df.sparkSession)
    return df.sparkSession


def split_id() -> list[Column]:
    """The document id for Python tasks: ``doc_id`` without nulls, and ``no_id``.  (A nullable bigint
    would reach pandas as a float and lose digits.)"""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]


def join_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared store and reads it back: later jobs neither recompute
    it nor depend on an executor that may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need: tables of ids that are small beside the
    corpus aren't worth a task for every shuffle partition."""
    return df.coalesce(max(8, math.ceil(rows / per_task)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separator: str = BLANKS) -> Column:
    """Array of the words of ``text``; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def count_alnum_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(ALNUM)).cast("bigint")


def window_hashes(hashes: Column, width: int) -> Column:
    """64-bit hash of each run of ``width`` consecutive elements of an array of hashes; empty when
    the array is shorter."""
    def runs(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]))
        return F.slice(at, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0)))

    return let(hashes, runs)


def bounded(df: DataFrame, name: str, limit_bytes: int = 32 << 20) -> DataFrame:
    """``df`` written once, and marked for broadcast only if its measured size is within the
    limit; a larger one is joined by a shuffle."""
    kept = stored(df, name)
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(kept) if size <= limit_bytes else kept


def own_columns(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a filter ``f(docs, ..., text=...)`` that returns rows of ``docs``: whatever names the other columns
    have, they meet none of the filter's own."""
    @functools.wraps(f)
    def run(docs: DataFrame, *args, text: str = "text", **more) -> DataFrame:
        names = docs.columns
        inside = [c if c in ("doc_id", text) and names.index(c) == i else f"column_{i}" for i, c in enumerate(names)]
        return f(docs.toDF(*inside), *args, text=text, **more).toDF(*names)

    return run


def row_key(text: str = "text") -> Column:
    """With the document id, what tells rows apart: rows that share an id keep their own results."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.octet_length(t).alias("b"))
