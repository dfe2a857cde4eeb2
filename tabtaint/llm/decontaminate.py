"""Benchmark decontamination (operator 7) by a prefix-filtered set join: DataFrame functions only.

A benchmark item gives windows of ``WINDOW`` consecutive words (a shorter item one window of all
its words).  A window occurs in a document only if each of its words does, so the join needs one
word of it, its prefix under the order by corpus frequency: the rarest.  The corpus is read once
to count the items' words, and once to find the prefix words; there the positional and length
bounds cut what cannot fit, and the words around the match are compared exactly.

Defined cases: null and empty texts have no words and are clean; an item without words has no
window; repeated items count once by id, an item with a null id marks words but is not listed;
rows that share a ``doc_id`` are judged each by its own text; empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.common import NOT_ALNUM, bounded, count_alnum_words, lower_ascii, own_columns, row_key, split_words, stored

WINDOW = 10


def _words(text: str):
    return split_words(lower_ascii(F.col(f"`{text}`")), NOT_ALNUM)


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids of their items: ``window, size, items``."""
    w = items.select(F.col("item_id").cast("string").alias("item"), _words("text").alias("words")) \
        .withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - (width - 1), F.lit(1)))
    w = w.select("item", "words", F.explode(starts).alias("at")) \
        .select("item", F.slice("words", F.col("at"), F.lit(width)).alias("window"))
    return w.groupBy("window").agg(F.collect_set("item").alias("items"))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW, text: str = "text") -> DataFrame:
    """Verified occurrences: ``doc_id, row, at, size, items``."""
    windows = stored(item_windows(items, width), "item-windows")
    d = docs.select("doc_id", row_key(text).alias("row"), _words(text).alias("words"))
    vocabulary = bounded(windows.select(F.explode("window").alias("word")).distinct(), "item-words")
    frequency = stored(
        d.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").count(), "item-word-counts")
    ranked = windows.select("*", F.posexplode("window").alias("offset", "word")).join(frequency, "word") \
        .groupBy("window").agg(F.min(F.struct("count", "word", "offset")).alias("first"),
                               F.count("*").alias("known"), F.first("items").alias("items")) \
        .where(F.col("known") == F.size("window"))
    prefix = bounded(ranked.select(F.col("first.word").alias("word"), F.col("first.offset").alias("offset"),
                                   "window", F.size("window").alias("size"), "items"), "item-prefixes")
    found = d.select("doc_id", "row", "words", F.posexplode("words").alias("pos", "word")).join(prefix, "word")
    at = F.col("pos") - F.col("offset")
    return found.where((at >= 0) & (at + F.col("size") <= F.size("words"))) \
        .where(F.slice("words", F.greatest(at, F.lit(0)) + 1, F.col("size")) == F.col("window")) \
        .select("doc_id", "row", at.alias("at"), "size", "items")


def _hits(found: DataFrame) -> DataFrame:
    """Per row with occurrences: covered words and items."""
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end"))))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda a, x: F.struct(
        (a["n"] + F.greatest(x["end"] - F.greatest(x["at"], a["reach"]), F.lit(0))).alias("n"),
        F.greatest(a["reach"], x["end"]).alias("reach")))
    by_item = found.groupBy("doc_id", "row").agg(
        spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return by_item.select("doc_id", "row", covered["n"].cast("bigint").alias("n_hit"), "items")


def mark(docs: DataFrame, items: DataFrame, width: int = WINDOW, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items (ids), contaminated``."""
    d = docs.select("doc_id", row_key(text).alias("row"), count_alnum_words(text).alias("n_words"))
    h = _hits(occurrences(docs, items, width, text)).select(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row"),
                                                             "n_hit", "items")
    j = d.join(h, d.doc_id.eqNullSafe(F.col("h_id")) & (d.row == F.col("h_row")), "left")
    items_of = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return j.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.size(items_of).cast("bigint").alias("n_items"), items_of.alias("items"),
                    F.col("n_hit").isNotNull().alias("contaminated"))


@own_columns
def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their own columns only."""
    bad = occurrences(docs, items, width, text).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")) \
        .distinct()
    bad = bounded(bad, "contaminated")
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("__id")) & (row_key(text) == F.col("__row")), "left_anti")
