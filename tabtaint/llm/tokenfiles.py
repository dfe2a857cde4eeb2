"""Token-id files (operator 3): tokenizers ids, Re-Pair compressed per shard.

Documents are range-partitioned by id, sorted and encoded; every ``SHARD_IDS`` ids or so close a
shard.  In each round, until none is left, the shard's frequent pairs of neighbouring symbols get nonterminals
and are replaced from the left; a pair never reaches over a document's end, so each document is a
slice of symbols.  A shard's row holds the symbols, the rules (left, right), the expansion lengths, and
every document's first symbol and number of ids, so any document is decoded alone.  The rows
are Parquet files in the shared store, written by Spark's committer: a lost task is written again.

Defined cases: a null or empty text gives the end id alone; null ids come first in the order;
rows sharing an id are stored one after another, ordered by their text; an empty table gives no
shard and an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabtaint.llm.codes import Codes, Pieces, byte_level, numbered_pieces, sums_of
from tabtaint.llm.common import bounded, join_id, ready, scratch_path, split_id

END = 2
SHARD_IDS = 2 << 20
PARTITION_BYTES = 8 << 20
RULES_PER_ROUND, LEAST_COUNT = 4096, 32
HASH_BITS = 18
#: Characters after which a shard may close, and how many such steps are cut into pieces at once.
STEP_CHARS, CUT_STEPS = 1 << 20, 4
#: Pieces that a task remembers; beyond that it starts anew.
MEMORY = 1_000_000

SCHEMA = ("part int, chunk int, n_ids bigint, docs binary, no_id binary, counts binary, firsts binary, "
          "first_rule int, rules binary, lengths binary, width int, symbols binary")


# ---- tokenizer ----------------------------------------------------------------------------

class Encoder:
    """Ids of texts as one array; pieces already seen by the task are looked up."""

    def __init__(self, path: str):
        self.tokenizer, encode = byte_level(path)
        self.size = self.tokenizer.get_vocab_size()
        self.memory = Pieces(encode, limit=MEMORY)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by ``END``, and the number of ids of each text."""
        at, distinct, size = numbered_pieces(pa.array([t or "" for t in texts], pa.large_string()), runs=True)
        at, codes = self.memory.numbers(distinct)[at], self.memory.codes
        per_text = sums_of(codes.count[at], size)
        return np.insert(codes.of(at), np.cumsum(per_text), END), per_text + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- grammar ------------------------------------------------------------------------------

def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds, until no pair occurs ``LEAST_COUNT`` times.  ``ends``: positions of the documents' last ids.  Returns the symbols, the
    rules (left, right) of the symbols from ``first_rule`` on, and the symbols that end documents."""
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[ends] = True
    rules: list[np.ndarray] = []
    made, open_ = first_rule, np.ones(max(len(seq) - 1, 0), bool)  # where a pair may still be frequent: later, if it is new or was left over
    while len(seq) > 1:
        at = np.flatnonzero(open_ & ~last[:-1])
        pair = (seq[at] << 32) | seq[at + 1]
        bucket = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        often = np.flatnonzero((np.bincount(bucket, minlength=1 << HASH_BITS) >= LEAST_COUNT)[bucket])
        at, pair = at[often], pair[often]
        of, values = pd.factorize(pair)
        count = np.zeros(len(values), np.int64)
        np.add.at(count, of, 1)
        top = np.flatnonzero(count >= LEAST_COUNT)
        top = top[np.lexsort((values[top], -count[top]))][:RULES_PER_ROUND]
        top = top[np.argsort(values[top])]
        if not len(top):
            break
        chosen, place = values[top], np.full(len(values), -1)
        place[top] = np.arange(len(top))
        spot = place[of]
        left = at[(spot < 0) & (count >= LEAST_COUNT)[of]]
        hit = np.flatnonzero(spot >= 0)
        at, spot = at[hit], spot[hit]
        begins = np.concatenate([[True], np.diff(at) > 1])
        run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        take = np.flatnonzero((np.arange(len(at)) - run) & 1 == 0)
        at, spot = at[take], spot[take]
        used = np.zeros(len(chosen), bool)
        used[spot] = True
        chosen, spot = chosen[used], (np.cumsum(used) - 1)[spot]
        rules.append(chosen)
        seq[at] = made + spot
        last[at] |= last[at + 1]
        open_ = np.zeros(len(seq), bool)
        open_[left] = True
        open_[at] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seq, last, open_ = seq[keep], last[keep], open_[keep]
        open_ = open_[:-1] | (seq[1:] >= made)
        made += len(chosen)
    flat = np.concatenate(rules) if rules else np.empty(0, np.int64)
    return seq, np.stack([flat >> 32, flat & 0xFFFFFFFF], axis=1), np.flatnonzero(last)


def expansions(rules: np.ndarray, first_rule: int) -> list[np.ndarray]:
    """The ids that each rule's symbol stands for."""
    ids, out = np.arange(first_rule, dtype="<i4").tobytes(), []
    for left, right in rules.tolist():
        out.append(b"".join([ids[4 * x:4 * x + 4] if x < first_rule else out[x - first_rule] for x in (left, right)]))
    return [np.frombuffer(x, "<i4") for x in out]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    flat = np.concatenate([np.arange(first_rule, dtype=np.int32), *expansions(rules, first_rule)])
    return Codes(flat, np.concatenate([np.ones(first_rule, np.int64), lengths])).of(symbols)


def pack(symbols: np.ndarray, width: int) -> bytes:
    """Each symbol in ``width`` bytes."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u4").ravel()


def shard_row(part: int, chunk: int, docs: np.ndarray, no_id: np.ndarray, ids: np.ndarray, counts: np.ndarray, first_rule: int) -> dict:
    symbols, rules, ends = compress(ids, np.cumsum(counts) - 1, first_rule)
    lengths: list[int] = []
    for left, right in rules.tolist():
        lengths.append(sum(1 if x < first_rule else lengths[x - first_rule] for x in (left, right)))
    width = 2 if first_rule + len(rules) <= 1 << 16 else 3 if first_rule + len(rules) <= 1 << 24 else 4
    firsts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.empty(0, np.int64)
    return {"part": part, "chunk": chunk, "n_ids": len(ids), "docs": docs.astype("<i8").tobytes(),
            "no_id": np.packbits(no_id).tobytes(), "counts": counts.astype("<u4").tobytes(),
            "firsts": firsts.astype("<u4").tobytes(), "first_rule": first_rule, "rules": rules.astype("<u4").tobytes(),
            "lengths": np.array(lengths, "<u4").tobytes(), "width": width, "symbols": pack(symbols, width)}


class Shard:
    """A row of the files."""

    def __init__(self, row):
        self.first_rule = int(row["first_rule"])
        self.docs = np.frombuffer(row["docs"], "<i8")
        self.no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(self.docs)).astype(bool)
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.firsts = np.frombuffer(row["firsts"], "<u4").astype(np.int64)
        self.rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = unpack(row["symbols"], int(row["width"]))

    def ids(self) -> np.ndarray:
        return expand(self.symbols.astype(np.int64), self.rules, self.lengths, self.first_rule)

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's i-th document, without the rest of the shard."""
        end = self.firsts[i + 1] if i + 1 < len(self.firsts) else len(self.symbols)
        out, todo = [], self.symbols[self.firsts[i]:end].astype(np.int64).tolist()[::-1]
        while todo:
            x = todo.pop()
            if x < self.first_rule:
                out.append(x)
            else:
                todo += self.rules[x - self.first_rule].tolist()[::-1]
        return np.array(out, np.int32)


# ---- Spark --------------------------------------------------------------------------------

def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text") -> None:
    """Writes the shards of ``docs`` below ``path``."""
    spark = ready(docs)
    d = docs.select(*split_id(), F.col(f"`{text}`").cast("string").alias("text"))
    total = d.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    n = max(math.ceil(total / PARTITION_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = d.repartitionByRange(n, F.desc("no_id"), "doc_id").sortWithinPartitions(F.desc("no_id"), "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, chunk, size = encoder(tokenizer), 0, 0
        open_: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def closed() -> pd.DataFrame:
            return pd.DataFrame([shard_row(part, chunk, *map(np.concatenate, zip(*open_, strict=True)), e.size)])

        part = 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            step = batch["text"].map(lambda t: len(t or "") + 64).cumsum() // STEP_CHARS
            for _, some in batch.groupby(step // CUT_STEPS, sort=False):
                ids, counts = e.encode(list(some["text"]))
                cuts = np.flatnonzero(np.diff(step[some.index])) + 1
                parts = (some["doc_id"].to_numpy(), some["no_id"].to_numpy(bool), counts)
                for docs_, no_id, n, x in zip(*(np.split(p, cuts) for p in parts), np.split(ids, np.cumsum(counts)[cuts - 1]), strict=True):
                    open_.append((docs_, no_id, x, n))
                    size += len(x)
                    if size >= SHARD_IDS:
                        yield closed()
                        open_, size, chunk = [], 0, chunk + 1
        if open_:
            yield closed()

    dealt.withColumn("part", F.spark_partition_id()).mapInPandas(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``, decoded from the shards."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "chunk", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                s = Shard(row)
                ids = np.ascontiguousarray(s.ids().astype("<u4"))
                end = np.cumsum(s.counts)
                begin = end - s.counts
                yield pd.DataFrame({
                    "doc_id": s.docs, "no_id": s.no_id, "start": begin + int(row["shard_start"]), "n_tokens": s.counts,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]})

    joined = files.join(bounded(starts, "shard-starts"), ["part", "chunk"])
    return join_id(joined.mapInPandas(run, "doc_id bigint, no_id boolean, start bigint, n_tokens bigint, ids_crc32 bigint"))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    spark = ready(docs)
    path = scratch_path(spark, "token-files")
    write(docs, path, tokenizer, text)
    return read(spark, path)
