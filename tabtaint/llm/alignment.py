"""Cross-tokenizer alignment (operator 11): whitespace-token anchors.

Every text is tokenised whole by a byte-level BPE (A) and a sentencepiece model (B) of the same bytes.  A
shared token end before a token marked by a space on both sides is an anchor; anchors split a
document into windows of token ids, about one a word.  A window's alignment (groups between shared
ends, links between overlapping tokens) depends on its two id tuples alone and is remembered by
them.  Tasks write chunks: the documents as window numbers, and the chunk's distinct id pairs with
their counts.  The pairs are summed over the corpus, the highest count of each B id is found,
and both go back to the chunks that hold the pair, where they are added up by window and document.

Defined cases: texts that are null or empty, or whose tokens' bytes aren't those of a space and the
text (the model changes or loses characters), have no tokens: zeros and ''.  A null id is kept; rows
sharing an id are separate; texts of any length are tokenised whole; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.codes import Memory, byte_level, cut, spread, sums_of
from tabtaint.llm.common import join_id, ready, split_id, stored
from tabtaint.llm.packing import _batches, column
from tabtaint.llm.text import U64, mixed

BATCH_BYTES, CHUNK_BYTES = 3 << 19, 6 << 20
#: Pieces of text and windows that a task remembers; beyond that it starts anew.
PIECES_KEPT, WINDOWS_KEPT = 300_000, 150_000
SPACE = "▁"  # marks a space in a sentencepiece token


# ---- the two tokenizers -------------------------------------------------------------------

def sentence_pieces(path: str):
    """Encoder of pieces for :class:`Memory` (a piece's first character is the space that the model
    adds), byte lengths by id, and whether a token begins with a space.  A piece whose tokens don't
    give back its bytes gets the single id -1."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in n.lstrip(SPACE) for n in names):
        raise ValueError("the model has tokens that reach into the next word")
    token = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode([p[1:] for p in new], num_threads=1)
        found = [ids if b"".join(map(token.__getitem__, ids)) == p.encode() else [-1] for ids, p in zip(found, new, strict=True)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    return encode, np.array(list(map(len, token)), np.int64), np.array([t[:1] == b" " for t in token])


class Tokenizers:
    def __init__(self, a_path: str, b_path: str):
        a, encode_a = byte_level(a_path)
        size, space = a.get_vocab_size(), a.encode(" a", add_special_tokens=False).tokens[0][0]
        self.bytes_a, self.space_a = np.zeros(size, np.int64), np.zeros(size, bool)
        for t, i in a.get_vocab().items():
            self.bytes_a[i], self.space_a[i] = len(t), t[0] == space
        encode_b, self.bytes_b, self.space_b = sentence_pieces(b_path)
        self.pieces = Memory(encode_a, encode_b, limit=PIECES_KEPT)
        n = self.n_a, self.n_b = size, len(self.bytes_b)
        # an id as text with what follows it: A's within and at the end of a group, B's also at the end of a window
        self.written = [f"{i}{c}" for k, marks in zip(n, (",|", ",;\n"), strict=True) for c in marks for i in range(k)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all texts in a row, and how many each text has."""
        none, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        at, distinct, size = cut(pc.binary_join_element_wise(none, texts.cast(pa.large_string()), blank))
        number = self.pieces.numbers(distinct)
        if (whole := self._changed(number)[at]).any():  # such texts are encoded and compared whole
            for i in np.flatnonzero(sums_of(whole, size)):
                distinct.append(" " + texts[int(i)].as_py())
                first, last = int(size[:i].sum()), int(size[:i + 1].sum())
                at = np.concatenate([at[:first], [len(distinct) - 1], at[last:]])
                size[i] = 1
            number = self.pieces.numbers(distinct)
        bad = self._changed(number)
        bad |= np.fromiter((p == " " for p in distinct), bool, len(distinct))  # the empty text
        text = np.repeat(np.arange(len(size)), size)
        good = ~bad[at]
        at, size = number[at[good]], np.bincount(text[good], minlength=len(size))
        return tuple(x for c in self.pieces.codes for x in (c.of(at), sums_of(c.count[at], size)))

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple:
        """Of windows (``n_a`` and ``n_b`` ids each, of the same bytes): the groups as text, the numbers
        of groups and of links, and all links as ``a << 32 | b``."""
        end_a, end_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        ends = np.union1d(end_a, end_b)                        # a link for each stretch between two ends
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = a[of_a].astype(np.int64) << 32 | b[of_b]
        last_a = np.cumsum(n_a) - 1
        close = end_a[last_a]                                  # where windows end
        shared = (end_a[of_a] == ends) & (end_b[of_b] == ends)
        links = np.diff(np.searchsorted(ends, close), prepend=-1)
        groups = np.diff(np.cumsum(shared)[np.searchsorted(ends, close)], prepend=0)
        stops = ends[shared]
        closes_a, closes_b = np.isin(end_a, stops, assume_unique=True), np.isin(end_b, stops, assume_unique=True)
        code_a = a + self.n_a * closes_a
        code_b = 2 * self.n_a + b + self.n_b * closes_b
        code_b[np.cumsum(n_b) - 1] += self.n_b
        group = np.concatenate([2 * np.searchsorted(stops, end_a), 2 * np.searchsorted(stops, end_b) + 1])
        codes = np.concatenate([code_a, code_b])[np.argsort(group, kind="stable")]
        text = "".join(map(self.written.__getitem__, codes.tolist())).split("\n")
        return text[:-1], groups, links, pairs

    def _changed(self, number: np.ndarray) -> np.ndarray:
        b = self.pieces.codes[1]
        return b.ids[b.first[number]] < 0 if len(number) else np.zeros(0, bool)


# ---- windows ------------------------------------------------------------------------------

class Windows:
    """Alignments of windows, remembered by their id tuples."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.groups, self.links = np.empty(0, np.int64), np.empty(0, np.int64)
        self.first, self.pairs = np.empty(0, np.int64), np.empty(0, np.int64)

    def shrink(self) -> None:
        if len(self.number) > WINDOWS_KEPT:
            self.forget()

    def of(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of all texts in a row, and how many each text has."""
        if not len(a):
            return np.empty(0, np.int64), np.zeros(len(n_a), np.int64)
        ends_a, ends_b = np.cumsum(self.t.bytes_a[a]), np.cumsum(self.t.bytes_b[b])
        at = np.searchsorted(ends_b, ends_a)                       # the B token that holds A's last byte
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        next_a, next_b = np.append(a[1:], a[0]), b[np.minimum(at + 1, len(b) - 1)]
        anchor = (ends_b[at] == ends_a) & (last | self.t.space_a[next_a] & self.t.space_b[next_b])
        end_a = np.flatnonzero(anchor) + 1
        end_b = at[anchor] + 1
        begin_a, begin_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
        kind = self._numbers(a, begin_a, end_a - begin_a, b, begin_b, end_b - begin_b)
        return kind, sums_of(anchor.astype(np.int64), n_a)

    def _numbers(self, a, begin_a, size_a, b, begin_b, size_b) -> np.ndarray:
        def sums(ids, begin, size, salt):
            place = np.arange(len(ids)) - np.repeat(begin, size)
            return np.add.reduceat(mixed((ids.astype(U64) << U64(24)) + place.astype(U64), salt), begin)

        key = mixed(sums(a, begin_a, size_a, 1)) + sums(b, begin_b, size_b, 2)
        _, one, same = np.unique(key, return_index=True, return_inverse=True)
        like = one[same]                                            # a window of the same hash: the same ids?
        differs = (size_a != size_a[like]) | (size_b != size_b[like])
        for ids, begin, size in ((a, begin_a, size_a), (b, begin_b, size_b)):
            known = np.where(differs, 0, size)
            other = ids[spread(begin[like], known)] != ids[spread(begin, known)]
            differs |= sums_of(other.astype(np.int64), known) > 0
        if differs.any():
            own = np.flatnonzero(differs)
            same[own] = len(one) + np.arange(len(own))
            one = np.append(one, own)
        return self._learn(a, begin_a[one], size_a[one], b, begin_b[one], size_b[one])[same]

    def _learn(self, a, begin_a, size_a, b, begin_b, size_b) -> np.ndarray:
        """Numbers of distinct windows; new ones are aligned.  A window's key is A's ids, -1 and B's."""
        known, keys = self.number, list(_keys(a, begin_a, size_a, b, begin_b, size_b))
        number = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip(map(keys.__getitem__, new.tolist()), number[new].tolist(), strict=True))
            text, groups, links, pairs = self.t.align(a[spread(begin_a[new], size_a[new])], size_a[new],
                                                      b[spread(begin_b[new], size_b[new])], size_b[new])
            self.text += text
            self.groups = np.concatenate([self.groups, groups])
            self.links = np.concatenate([self.links, links])
            self.pairs = np.concatenate([self.pairs, pairs])
            self.first = np.cumsum(self.links) - self.links
        return number


def _keys(a: np.ndarray, begin_a, size_a, b: np.ndarray, begin_b, size_b) -> Iterator[bytes]:
    """Each window's ids as bytes, A's and B's with -1 between."""
    data_a, data_b = a.astype("<i4").tobytes(), b.astype("<i4").tobytes()
    for p, q, r, s in zip((4 * begin_a).tolist(), (4 * (begin_a + size_a)).tolist(), (4 * begin_b).tolist(),
                          (4 * (begin_b + size_b)).tolist(), strict=True):
        yield data_a[p:q] + b"\xff\xff\xff\xff" + data_b[r:s]


# ---- Spark --------------------------------------------------------------------------------

CHUNKS = ("part int, chunk int, doc_id bigint, no_id boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
          "groups_sha256 string, windows binary, pairs binary, counts binary, n_window binary, of_pair binary")
DOC = ["doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
RESULT = ("doc_id bigint, no_id boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
          "count_sum bigint, groups_sha256 string")

_WINDOWS: dict[tuple[str, str], Windows] = {}


def _windows(a_path: str, b_path: str) -> Windows:
    if (a_path, b_path) not in _WINDOWS:
        _WINDOWS[a_path, b_path] = Windows(Tokenizers(a_path, b_path))
    return _WINDOWS[a_path, b_path]


def _chunk(w: Windows, part: int, chunk: int, some: list[tuple]) -> pa.RecordBatch:
    """The documents of a chunk, and in its first row the chunk's windows and pairs."""
    doc_id, no_id, n_a, n_b, sha, kind, n = (np.concatenate(x) for x in zip(*some, strict=True))
    used, at, times = np.unique(kind, return_inverse=True, return_counts=True)
    links = w.links[used]
    flat = w.pairs[spread(w.first[used], links)]
    pairs, of_pair = np.unique(flat, return_inverse=True)
    counts = np.bincount(of_pair, weights=np.repeat(times, links), minlength=len(pairs))
    data, ends = at.astype("<u4").tobytes(), np.cumsum(n)
    rest = [None] * (len(n) - 1)
    return pa.RecordBatch.from_pydict({
        "part": np.full(len(n), part, np.int32), "chunk": np.full(len(n), chunk, np.int32), "doc_id": doc_id, "no_id": no_id,
        "n_a": n_a, "n_b": n_b, "n_groups": sums_of(w.groups[kind], n), "n_links": sums_of(w.links[kind], n),
        "groups_sha256": pa.array(sha, pa.string()),
        "windows": pa.array([data[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
        "pairs": pa.array([pairs.astype("<i8").tobytes(), *rest], pa.binary()),
        "counts": pa.array([counts.astype("<i8").tobytes(), *rest], pa.binary()),
        "n_window": pa.array([links.astype("<u4").tobytes(), *rest], pa.binary()),
        "of_pair": pa.array([of_pair.astype("<u4").tobytes(), *rest], pa.binary())})


def _align(docs: DataFrame, a_path: str, b_path: str, text: str) -> DataFrame:
    d = docs.select(*split_id(), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                    F.spark_partition_id().alias("part"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()   # nothing here makes cycles, and walking the remembered pieces takes long
        w, chunk, size, part, open_ = _windows(a_path, b_path), 0, 0, 0, []
        for t in _batches(frames, BATCH_BYTES):
            texts, part = column(t, "text"), t["part"][0].as_py()
            a, n_a, b, n_b = w.t.ids(texts)
            kind, n = w.of(a, n_a, b, n_b)
            of, ends, sha = list(map(w.text.__getitem__, kind.tolist())), np.cumsum(n).tolist(), []
            for e, k in zip(ends, n.tolist(), strict=True):
                sha.append(hashlib.sha256(";".join(of[e - k:e]).encode()).hexdigest() if k else "")
            open_.append((column(t, "doc_id").to_numpy(), column(t, "no_id").to_numpy(zero_copy_only=False), n_a, n_b,
                          np.array(sha, object), kind, n))
            size += t.nbytes
            if size >= CHUNK_BYTES:
                yield _chunk(w, part, chunk, open_)
                chunk, size, open_ = chunk + 1, 0, []
                w.shrink()
        if open_:
            yield _chunk(w, part, chunk, open_)
            w.shrink()

    return stored(d.mapInArrow(run, CHUNKS), "alignments")


def _unpacked(chunks: DataFrame) -> DataFrame:
    """A row for each distinct pair of each chunk."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for r in f.to_pylist():
                pairs = np.frombuffer(r["pairs"], "<i8")
                yield pa.RecordBatch.from_pydict({
                    "part": np.full(len(pairs), r["part"], np.int32), "chunk": np.full(len(pairs), r["chunk"], np.int32),
                    "pair": pairs, "n": np.frombuffer(r["counts"], "<i8")})

    return chunks.where("pairs IS NOT NULL").select("part", "chunk", "pairs", "counts") \
        .mapInArrow(run, "part int, chunk int, pair bigint, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links of the corpus hold a pair, and whether that is the highest
    count of its B id."""
    total = stored(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts") \
        .withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = total.groupBy("b").agg(F.max("count").alias("top"))
    return total.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _sum(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    head = chunk[chunk["pairs"].notna()].iloc[0]
    pairs, of_pair = np.frombuffer(head["pairs"], "<i8"), np.frombuffer(head["of_pair"], "<u4")
    links = np.frombuffer(head["n_window"], "<u4").astype(np.int64)
    order = np.argsort(answers["pair"].to_numpy())
    if not np.array_equal(answers["pair"].to_numpy()[order], pairs):
        raise ValueError("a chunk's pairs and their counts don't match")
    out = chunk[DOC].copy()
    windows = [np.frombuffer(x, "<u4") for x in chunk["windows"]]
    at, n = np.concatenate(windows).astype(np.int64), np.array(list(map(len, windows)), np.int64)
    for name, source in (("n_best", "best"), ("count_sum", "count")):
        value = answers[source].to_numpy().astype(np.int64)[order]
        out[name] = sums_of(sums_of(value[of_pair], links)[at], n)
    return out


def alignments(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    ready(docs)
    chunks = _align(docs, a_path, b_path, text)
    pairs = _unpacked(chunks)
    answers = pairs.select("part", "chunk", "pair").join(pair_counts(pairs), "pair")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _sum(left, right)

    names = [f.split()[0] for f in RESULT.split(", ")]
    return join_id(chunks.groupBy("part", "chunk").cogroup(answers.groupBy("part", "chunk")).applyInPandas(run, RESULT).select(*names))
