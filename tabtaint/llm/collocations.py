"""Phrase collocation mining (operator 12) by Toivonen's method.

A sample of documents proposes frequent words and pairs.  One pass over all documents then counts,
exactly, every word, each pair of proposed words and each triple of two proposed pairs: the
proposals together with their negative border.  Where a border phrase turns out frequent, or the
sample has missed a phrase, what it gives rise to is counted by further passes, each of which skips
what earlier ones have counted, until no frequent phrase is left whose extensions weren't.  So the
sample decides how much work a pass does and how many there are, never the result.

The sets of words and pairs that a pass follows go to the tasks as bitmaps of at most ``2**MOST_BITS``
bits.  A bitmap may hold phrases too many (they are counted for nothing), but none too few.  Texts are
written once as chunks of numbered words, which all passes read; phrases are told apart by these
numbers and not by hashes.  A task sends a chunk's distinct phrases with their counts.

Defined cases: a null language is ``und``; null and empty texts have no words; rows that share an id
or a text count each; texts of any length are counted whole; a language without candidates has no
rows; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtaint.llm.common import ready, stored
from tabtaint.llm.packing import _batches, column
from tabtaint.llm.text import U64, mixed, word_hashes

SUPPORT, TOP, INSIDE_PERCENT = 10, 2000, 50
#: One document of so many is in the sample, which proposes what it holds so many times.
SAMPLE_SHARE, SAMPLE_LEAST = 8, 2
SLICE_BYTES, CHUNK_BYTES, ROWS = 2 << 20, 8 << 20, 1 << 16
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 28, 16
SALTS = 64
#: The signs that end a piece, and the blanks between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_BREAK = b"\xff"  # not in UTF-8
_TABLE = bytes(0xff if b in PIECE_ENDS else 0x20 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))

COUNTED = "lang string, phrase string, size int, n bigint"


# ---- words and sets -----------------------------------------------------------------------

def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return word_hashes(b"".join(words), starts, ends) if len(words) else np.empty(0, U64)


def _cells(lang: str, *hashes: np.ndarray) -> np.ndarray:
    out = _hashes([b"\x00" + lang.encode()])[0]
    for h in hashes:
        out = mixed(out + h, 7)
    return out


@dataclass
class Bits:
    """A set of hashes that may hold too many but none too few."""
    bits: int
    data: np.ndarray = field(repr=False)

    def holds(self, cells: np.ndarray) -> np.ndarray:
        at = cells >> U64(64 - self.bits)
        return (self.data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


def _phrase_cells(phrases: DataFrame, f, schema: str) -> DataFrame:
    """``f(cells)`` of batches of ``lang, phrase`` as a column."""
    name = schema.split()[0]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            lang, words = np.array(b["lang"].to_pylist(), object), [p.encode().split(b" ") for p in b["phrase"].to_pylist()]
            cells = np.empty(len(lang), U64)
            size = np.fromiter(map(len, words), np.int64, len(words))
            for code in sorted(set(lang.tolist())):
                for k in sorted(set(size[lang == code].tolist())):
                    at = np.flatnonzero((lang == code) & (size == k))
                    cells[at] = _cells(code, *(_hashes([words[i][j] for i in at]) for j in range(k)))
            yield pa.RecordBatch.from_pydict({name: pa.array(f(cells))})

    return phrases.select("lang", "phrase").mapInArrow(run, schema)


def bits_of(phrases: DataFrame) -> Bits:
    """The set of ``phrases`` as a bitmap that has about sixteen bits for each, up to the bound."""
    n = phrases.count()
    bits = min(max(LEAST_BITS, (n * BITS_EACH).bit_length()), MOST_BITS)
    cells = _phrase_cells(phrases, lambda c: (c >> U64(64 - bits)).astype(np.int64) + 1, "cell bigint")
    rows = cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("data")).collect()  # 2**bits / 32768 rows of 4 KB
    data = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        part = np.frombuffer(r["data"], np.uint8)
        at = (r["bucket"] - 1) * len(part)
        data[at:at + len(part)] = part[:len(data) - at]
    return Bits(bits, data)


def _outside(phrases: DataFrame, bits: Bits) -> bool:
    """Whether any of ``phrases`` isn't in the set."""
    sent = phrases.sparkSession.sparkContext.broadcast(bits)
    out = _phrase_cells(phrases, lambda c: ~sent.value.holds(c), "outside boolean").where("outside").limit(1).count()
    return out > 0


# ---- counting -----------------------------------------------------------------------------

class Chunk:
    """Words of many texts of a language, by number; 0 ends a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []

    def add(self, texts: list[str]) -> None:
        data = _BREAK.join([*(t.encode() for t in texts), b""]).translate(_TABLE).replace(_BREAK, b" \xff ").split()
        known = self.number
        for w in set(data).difference(known):
            known[w] = len(known)
        self.parts.append(np.fromiter(map(known.__getitem__, data), np.int32, len(data)))


def _joint(v: int, *parts: np.ndarray) -> np.ndarray:
    """One number for each combination of numbers below ``v``."""
    out = parts[0].astype(np.int64)
    for p in parts[1:]:
        out = out * v + p
    return out


def _counted_phrases(v: int, parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations of word numbers with their counts."""
    if v ** len(parts) < 1 << 63:
        key, n = np.unique(_joint(v, *parts), return_counts=True)
        out = []
        for _ in parts[1:]:
            out.append(key % v)
            key = key // v
        return [key, *out[::-1]], n
    pairs, of = np.unique(_joint(v, *parts[:2]), return_inverse=True)   # too many words for one number
    key, n = np.unique(_joint(v, of, parts[2]), return_counts=True)
    return [pairs[key // v] // v, pairs[key // v] % v, key % v], n


def count_chunk(lang: str, names: list[bytes], at: np.ndarray, passes: list[tuple[Bits | None, Bits | None]], words: bool,
                triples: bool) -> Iterator[pa.RecordBatch]:
    """Counts of what the last pass follows and no earlier one has counted, over the word numbers ``at``."""
    v, table = len(names), pa.array(names, pa.binary())
    if words:
        n = np.bincount(at, minlength=v)
        n[0] = len(at) - n[0]  # all words, in the row of the empty phrase
        yield from _rows(lang, pc.if_else(pc.equal(table, _BREAK), b"", table), [np.arange(v)], np.where(np.arange(v) > 0, 1, 0), n)
    hashes = _hashes(names)
    cells = _cells(lang, hashes)
    first = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    new = _new([p and p[0] for p in passes], lambda s: s.holds(cells), (at[first], at[first + 1]))
    parts, n = _counted_phrases(v, [at[first[new]], at[first[new] + 1]])
    yield from _rows(lang, table, parts, np.full(len(n), 2), n)
    if not triples:
        return
    begins = np.flatnonzero(np.diff(first) == 1)                 # pairs that the next pair overlaps
    pair_cells = _cells_at(lang, hashes, at, first)
    held = passes[-1][1].holds(pair_cells)
    begins = begins[held[begins] & held[begins + 1]]
    for _, earlier in passes[:-1]:
        begins = begins[~(earlier.holds(pair_cells[begins]) & earlier.holds(pair_cells[begins + 1]))]
    x = first[begins]
    parts, n = _counted_phrases(v, [at[x], at[x + 1], at[x + 2]])
    yield from _rows(lang, table, parts, np.full(len(n), 3), n)


def _cells_at(lang: str, hashes: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Cells of the pairs at some places, in steps that keep the arrays short."""
    out = np.empty(len(first), U64)
    head = _cells(lang, hashes)
    for k in range(0, len(first), 1 << 18):
        some = first[k:k + (1 << 18)]
        out[k:k + len(some)] = mixed(head[at[some]] + hashes[at[some + 1]], 7)
    return out


def _new(sets: list[Bits | None], cells, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether both parts are in the last set, and not both in an earlier one; no set holds all."""
    def both(s: Bits | None) -> np.ndarray:
        if s is None:
            return np.ones(len(parts[0]), bool)
        inside = cells(s)
        return inside[parts[0]] & inside[parts[1]]

    out = both(sets[-1])
    for s in sets[:-1]:
        out &= ~both(s)
    return out


def _rows(lang: str, words: pa.Array, at: list[np.ndarray], size: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases made of ``words`` at ``at``, with their counts, in short batches."""
    for k in range(0, len(n), ROWS):
        part = [words.take(pa.array(i[k:k + ROWS])) for i in at]
        phrase = pc.binary_join_element_wise(*part, pa.scalar(b" ", pa.binary())) if len(part) > 1 else part[0]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": phrase.cast(pa.string()),
                                          "size": size[k:k + ROWS].astype(np.int32), "n": n[k:k + ROWS].astype(np.int64)})


CHUNKS = "lang string, words binary, ends binary, numbers binary"


def _chunks(docs: DataFrame, name: str) -> DataFrame:
    """The texts as numbered words, written once: each row has a chunk's texts of a language."""
    def row(lang: str, c: Chunk) -> pa.RecordBatch:
        words = list(c.number)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))).astype("<i4")
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "words": pa.array([b"".join(words)], pa.binary()),
                                           "ends": pa.array([ends.tobytes()], pa.binary()),
                                           "numbers": pa.array([np.concatenate(c.parts).astype("<i4").tobytes()], pa.binary())})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, Chunk] = {}
        size = 0
        for t in _batches(frames, SLICE_BYTES):
            lang, text = column(t, "lang"), column(t, "text")
            for code in pc.unique(lang).to_pylist():
                chunks.setdefault(code, Chunk()).add(text.filter(pc.equal(lang, code)).to_pylist())
            size += t.nbytes
            if size >= CHUNK_BYTES:
                yield from map(row, chunks, chunks.values())
                chunks, size = {}, 0
        yield from map(row, chunks, chunks.values())

    return stored(docs.select("lang", "text").mapInArrow(run, CHUNKS), name)


def _counted(chunks: DataFrame, passes: list, words: bool, triples: bool = True) -> DataFrame:
    """Counts over all chunks; the words' total of a language is its row of size 0."""
    sent = chunks.sparkSession.sparkContext.broadcast(passes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for i in range(f.num_rows):
                lang, data, ends, numbers = (f[c][i].as_py() for c in ("lang", "words", "ends", "numbers"))
                bounds = [0, *np.frombuffer(ends, "<i4").tolist()]
                names = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield from count_chunk(lang, names, np.frombuffer(numbers, "<i4"), sent.value, words, triples)

    # dealt out before they are added up: a task's chunks have few phrases in common, so that adding them up on the
    # way would fill its memory for little
    return chunks.mapInArrow(run, COUNTED).repartition("lang", "phrase").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                     support: int = SUPPORT) -> DataFrame:
    """``lang, phrase, size, n``: all words, pairs and triples that occur ``support`` times, exactly
    counted, and per language a row of size 0 with the number of its words."""
    ready(docs)
    d = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                    F.col(f"`{doc_id}`").alias("id"))
    sample = _chunks(d.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE_SHARE)) == 0), "sample")
    d = _chunks(d, "chunks")
    proposed = stored(_counted(sample, [(None, None)], words=True, triples=False).where(F.col("n") >= SAMPLE_LEAST), "proposed")
    passes = [tuple(bits_of(proposed.where(F.col("size") == k)) for k in (1, 2))]
    found = stored(_counted(d, passes, words=True).where((F.col("n") >= support) | (F.col("size") == 0)), "phrases")
    while any(all(_outside(found.where(F.col("size") == k), p[k - 1]) for p in passes) for k in (1, 2)):
        passes.append(tuple(bits_of(found.where(F.col("size") == k)) for k in (1, 2)))
        more = stored(_counted(d, passes, words=False).where(F.col("n") >= support), "phrases")
        found = found.unionByName(more)
    return found


# ---- report -------------------------------------------------------------------------------

def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, length), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    found = frequent_phrases(docs, text, lang, doc_id, support)
    words = found.where("size = 0").select("lang", F.col("n").alias("words_of_lang"))
    long = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = long.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"),
                _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    parts = found.where("size > 0").select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]) \
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("CAST(CAST(a AS DECIMAL(16)) * CAST(a AS DECIMAL(16)) * 1000000BD DIV "
                   "(CAST(l AS DECIMAL(18)) * CAST(r AS DECIMAL(18))) AS BIGINT)")
    least = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("c"))
    longer = long.where("size > 2").select("lang", "a", F.explode(F.array(
        _part(F.lit(1), F.size("words") - 1), _part(F.lit(2), F.size("words") - 1))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("c.a"))) \
        .select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")) \
        .where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words_of_lang").alias("n"), "score")
