"""Best-fit packing (operator 13): bin completion over the corpus's histogram of piece lengths.

Documents are encoded once; only those longer than a sequence are cut, into whole sequences and one
shorter first piece.  What is packed are lengths, of which there are at most ``CAPACITY``, so the
plan is made from the histogram: a list of fillings (lengths and how often each) with the number
of sequences that use it.  Best-fit decreasing gives the first plan; unless it meets the lower
bound, branch and bound completes sequences around the largest length left, with undominated
fillings only, and drops branches whose waste rules out a better plan.  Pieces are numbered
among those of their length and find their place in the plan by that number, whatever the
corpus size.  The plan has at most one filling for each length used up, so its size doesn't depend
on the corpus.

Defined cases: a null or empty text is its end id alone; a null id and rows that share an id are
packed like others, row by row; texts of any length are encoded whole; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtaint.llm.codes import Memory, byte_level, cut, sums_of
from tabtaint.llm.common import bounded, join_id, ready, split_id, stored

CAPACITY, END = 2048, 0
#: Bounds of the search: nodes visited, and fillings tried at a node.
NODES, FILLINGS, STEPS = 200, 24, 5000
BATCH_BYTES = 8 << 20

Filling = tuple[tuple[int, int], ...]   # (length, copies)
Plan = list[tuple[Filling, int]]        # with the number of sequences


# ---- planning -----------------------------------------------------------------------------

def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound on pieces that can't share."""
    n = np.asarray(counts, np.int64)
    size = np.arange(capacity + 1)
    n_up, v_up = np.cumsum(n[::-1])[::-1], np.cumsum((n * size)[::-1])[::-1]   # of lengths >= i
    volume = -(-int((n * size).sum()) // capacity)
    half, k = capacity // 2 + 1, np.arange(1, capacity // 2 + 1)               # half: least length over the half
    alone = n_up[capacity - k + 1]
    large = n_up[half] - alone
    room = large * capacity - (v_up[half] - v_up[capacity - k + 1])
    small = v_up[k] - v_up[half]
    return max(volume, int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max(initial=0)))


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: equal sequences are filled together."""
    room: dict[int, list[tuple[Filling, int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        fits = sorted(r for r in room if r >= length)
        while left and fits:
            r = fits.pop(0)
            groups = room.pop(r)
            while groups:
                filling, bins = groups.pop()
                each = r // length
                full = min(bins, left // each)
                some = left - full * each if full < bins else 0
                left -= full * each + some
                if full:
                    room.setdefault(r - each * length, []).append((filling + ((length, each),), full))
                if some:
                    room.setdefault(r - some * length, []).append((filling + ((length, some),), 1))
                if rest := bins - full - bool(some):
                    room.setdefault(r, []).append((filling, rest))
                if not left:
                    if groups:
                        room.setdefault(r, []).extend(groups)
                    break
        if left:
            each = capacity // length
            if left // each:
                room.setdefault(capacity - each * length, []).append((((length, each),), left // each))
            if left % each:
                room.setdefault(capacity - (left % each) * length, []).append((((length, left % each),), 1))
    return [g for groups in room.values() for g in groups]


def dominated(filling: Filling, waste: int, counts: np.ndarray) -> bool:
    """Whether a piece outside the filling could take the place of one shorter piece, or of two that
    together aren't longer, within the waste."""
    left = counts.copy()
    for length, copies in filling:
        left[length] -= copies
    for i, (a, copies) in enumerate(filling):
        if left[a + 1:a + waste + 1].any():
            return True
        for b, more in filling[i:]:
            if (b != a or copies > 1) and more and left[a + b:a + b + waste + 1].any():
                return True
    return False


def fillings(counts: np.ndarray, capacity: int, waste: int, limit: int, steps: int) -> list[Filling]:
    """Undominated ways to complete a sequence around the largest length, fullest first, that waste
    ``waste`` at most.  ``limit`` fillings are given, found in ``steps`` steps."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    largest, found, todo = lengths[0], [], [(1, capacity - lengths[0], ((lengths[0], 1),))]
    while todo and steps and len(found) < 4 * limit:
        steps -= 1
        i, room, filling = todo.pop()
        while i < len(lengths) and lengths[i] > room:
            i += 1
        if i == 1 and largest <= room and counts[largest] > filling[0][1]:
            most = min(room // largest, int(counts[largest]) - 1)
            todo += [(2, room - k * largest, ((largest, 1 + k),)) for k in range(1, most + 1)]
        if i >= len(lengths):
            if room <= waste:
                found.append((room, filling))
            continue
        length = lengths[i]
        most = min(room // length, int(counts[length]))
        todo += [(i + 1, room - k * length, filling + ((length, k),) if k else filling) for k in range(most + 1)]
    if not found and waste >= 0:
        room, filling = capacity - largest, ((largest, 1),)
        for length in lengths:
            k = min(room // length, int(counts[length]) - (length == largest))
            if k > 0:
                filling = ((largest, 1 + k),) if length == largest else filling + ((length, k),)
                room -= k * length
        found = [(room, filling)] if room <= waste else []
    found.sort(key=lambda x: x[0])
    good = [f for room, f in found if not dominated(f, room, counts)]
    return good[:limit]


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, limit: int = FILLINGS) -> Plan:
    """A plan for ``counts[length]`` pieces of each length.  Optimal if it meets the lower bound or
    the search ends within ``nodes``; never worse than best-fit decreasing."""
    counts = np.asarray(counts, np.int64)
    alone: Plan = [(((capacity, 1),), int(counts[capacity]))] if counts[capacity] else []
    counts = np.where(np.arange(capacity + 1) == capacity, 0, counts)
    best = best_fit(counts, capacity)
    most, least = sum(n for _, n in best), lower_bound(counts, capacity)
    volume = int((counts * np.arange(capacity + 1)).sum())
    todo: list[tuple[np.ndarray, Plan, int, int]] = [(counts, [], 0, 0)]
    while todo and nodes and most > least:
        nodes -= 1
        left, done, bins, waste = todo.pop()
        allowed = (most - 1) * capacity - volume - waste
        if bins + lower_bound(left, capacity) >= most:
            continue
        rest = best_fit(left, capacity)
        if bins + (more := sum(n for _, n in rest)) < most:
            best, most = done + rest, bins + more
            continue
        branches = []
        for f in fillings(left, capacity, allowed, limit, STEPS):
            lost = capacity - sum(a * k for a, k in f)
            times = min(int(left[a]) // k for a, k in f)
            for q in {times, 1}:
                after = left.copy()
                for a, k in f:
                    after[a] -= q * k
                branches.append((after, [*done, (f, q)], bins + q, waste + q * lost))
        branches.sort(key=lambda x: (x[3] / max(x[2] - bins, 1), -x[2]))
        todo += branches[::-1]
    return alone + best


@dataclass
class Places:
    """The plan by length: the pieces of a length, numbered from 0, take its runs one after another."""
    key: np.ndarray        # length << 44 | first number of the run
    copies: np.ndarray
    sequence: np.ndarray   # first sequence of the run
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, made: Plan) -> Places:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for filling, bins in made:
            offset = 0
            for length, copies in filling:
                first = used.get(length, 0)
                rows.append((length << 44 | first, copies, sequence, offset))
                used[length] = first + bins * copies
                offset += length * copies
            sequence += bins
        rows.sort()
        return cls(*np.array(rows, np.int64).reshape(-1, 4).T.copy(), sequence)

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the ``number``-th piece of a length."""
        key = length << 44 | number
        at = np.searchsorted(self.key, key, "right") - 1
        along = key - self.key[at]
        return self.sequence[at] + along // self.copies[at], self.offset[at] + along % self.copies[at] * length


# ---- Spark --------------------------------------------------------------------------------

_MEMORIES: dict[str, Memory] = {}


def memory(path: str) -> Memory:
    if path not in _MEMORIES:
        _MEMORIES[path] = Memory(byte_level(path)[1])
    return _MEMORIES[path]


def _batches(frames: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The input in tables of at most about ``limit`` bytes, a single longer row aside, however Spark
    has batched it."""
    some, size = [], 0
    for b in frames:
        step = max(1, b.num_rows * limit // (4 * max(b.nbytes, 1)))
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            if some and size + part.nbytes > limit:
                yield pa.Table.from_batches(some).combine_chunks()
                some, size = [], 0
            some.append(part)
            size += part.nbytes
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    c = t[name].combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


PIECES = ("part int, doc_id bigint, no_id boolean, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint")


def encode(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents, written once: their place in the document, checksum, and ``nth``, their
    number among the pieces of this length that the same task has written."""
    ready(docs)
    d = docs.select(*split_id(), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                    F.spark_partition_id().alias("part"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        m = memory(tokenizer)
        for t in _batches(frames, BATCH_BYTES):
            at, distinct, size = cut(column(t, "text"), runs=True)
            at, codes = m.numbers(distinct)[at], m.codes[0]
            per_text = sums_of(codes.count[at], size)
            ids = np.insert(codes.of(at), np.cumsum(per_text), end).astype("<u4")
            n = per_text + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = n - (pieces - 1) * capacity
            start = np.where(piece > 0, short[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, short[doc])
            begin = (np.cumsum(n) - n)[doc] + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            found, first, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(first, many) + np.repeat(seen[found], many)
            seen[found] += many
            rows = {"part": column(t, "part").to_numpy()[doc], "doc_id": column(t, "doc_id").to_numpy()[doc],
                    "no_id": column(t, "no_id").to_numpy(zero_copy_only=False)[doc], "piece": piece.astype(np.int32),
                    "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "nth": nth}
            yield pa.RecordBatch.from_pydict(rows)

    return stored(d.mapInArrow(run, PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = ready(docs)
    found = encode(docs, tokenizer, text, capacity, end)
    by_part = stored(found.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length, capacity at most
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places.of(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = found.join(bounded(before, "earlier-parts"), ["length", "part"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy()
            b["sequence_id"], b["offset"] = places.value.find(length, b.pop("nth").to_numpy())
            yield b

    out = numbered.select("doc_id", "no_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))
    return join_id(out.mapInPandas(place, "doc_id bigint, no_id boolean, piece int, start bigint, length bigint, "
                                          "ids_crc32 bigint, sequence_id bigint, offset bigint"))
