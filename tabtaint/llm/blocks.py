"""Blocks of documents that exchange short messages with shards of the hash space.

Facts about a whole corpus's windows or words are needed beside the texts they come from.  Texts
are dealt once into blocks of a few megabytes; a block sends each shard (a range of hashes) one
packed message, the shard answers each block with one message, and the answers are cogrouped with
the blocks.  Nothing grows in the driver, no task gets more than a block, or a shard's messages of
bounded mean size, and a hash that a third of all texts share reaches its shard once per block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.common import ready, split_id

BLOCK_BYTES = 2 << 20
BLOCKS_PER_PARTITION = 4
#: Words that a shard covers on average, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 4 << 20, 64


class Blocks:
    """``docs`` dealt into blocks; ``shards`` is a power of two that follows the corpus size."""

    def __init__(self, docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES):
        self.spark = ready(docs)
        t = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
        d = docs.select(*split_id(), t.alias("text"))
        total = d.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
        self.count = max(1, math.ceil(total / block_bytes))
        self.words = max(1, total // 6)
        self.shards = 1 << max(LEAST_SHARDS - 1, math.ceil(self.words / SHARD_WORDS) - 1).bit_length()
        self.partitions = max(1, math.ceil(self.count / BLOCKS_PER_PARTITION),
                              int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.docs = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "no_id", "text"), F.lit(self.count)).cast("int")) \
            .repartition(self.partitions, "block")

    def each(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return self.docs.groupBy("block").applyInPandas(f, schema)

    def with_answers(self, answers: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                     schema: str) -> DataFrame:
        """``f(block's documents, answers to the block)``; a block without answers gets an empty frame."""
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return f(left, right)

        return self.docs.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def ordered(docs: pd.DataFrame) -> pd.DataFrame:
    """The block's rows in a fixed order, whatever order the shuffle brought them in: by id (null
    last), then by text."""
    return docs.sort_values(["no_id", "doc_id", "text"], kind="stable").reset_index(drop=True)


def by_shard(sorted_cells: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """Bounds of each shard's part of sorted ``bits``-bit numbers: ``shards + 1`` positions."""
    shift = np.uint64(bits - (shards.bit_length() - 1))
    edges = np.arange(shards, dtype=np.uint64) << shift if shards > 1 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(sorted_cells, edges), len(sorted_cells))
