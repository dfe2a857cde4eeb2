"""Substring dedup (operator 5): windows of 20 words, count-min prefilter, exact second pass.

First pass: every block hashes its windows into the cells of a sketch that grows with the corpus
(64 cells a window) and sends each shard its cells, gap-coded, once per block.  The shards merge
these partition sketches by adding; a cell's count is never below the count of a window in it, so
a window in a cell of count one occurs once.  Second pass: only windows in cells of two or more
are grouped exactly, by 96 bits of hash, to find each one's first occurrence in the order of
(doc_id, position); the blocks have already removed what they hold an earlier copy of themselves.

Defined cases: null and empty texts have no words; texts under 20 words lose nothing; repeated
rows keep their first copy in (doc_id, text) order, null ids come last; an empty table gives an
empty result; long texts are processed whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tabtaint.llm.blocks import Blocks, by_shard, ordered
from tabtaint.llm.common import join_id
from tabtaint.llm.text import U64, Words

WINDOW = 20
CELLS_PER_WINDOW = 64
LAST_ID = np.iinfo(np.int64).max


# ---- gap coding of sorted cells -----------------------------------------------------------

def pack_gaps(sorted_values: np.ndarray) -> bytes:
    """Ascending numbers as gaps of two or four bytes, whichever is shorter on average."""
    gaps = np.diff(sorted_values, prepend=U64(0)).astype(np.uint64)
    if not len(gaps):
        return b"\x02"
    width = 2 if int(sorted_values[-1]) // len(gaps) < 30_000 else 4
    most = U64((1 << 8 * width) - 1)
    extra = (gaps // most).astype(np.int64)
    out = np.full(len(gaps) + int(extra.sum()), most, f"<u{width}")
    out[np.arange(len(gaps)) + np.cumsum(extra)] = gaps % most
    return bytes([width]) + out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    width = data[0]
    values = np.frombuffer(data, f"<u{width}", offset=1).astype(np.uint64)
    return np.cumsum(values)[values < U64((1 << 8 * width) - 1)]


# ---- passes -------------------------------------------------------------------------------

def _cells(w: Words, bits: int):
    """Windows of the block, its distinct cells in ascending order, and each window's cell number."""
    h, text, at = w.windows(WINDOW)
    cells, of = np.unique(h >> U64(64 - bits), return_inverse=True)
    return h, text, at, cells, of


def _sketch(docs: pd.DataFrame, shards: int, bits: int) -> pd.DataFrame:
    block = int(docs["block"].iloc[0])
    *_, cells, of = _cells(Words(list(docs["text"])), bits)
    many = np.bincount(of, minlength=len(cells)) > 1
    edges, rows = by_shard(cells, shards, bits), []
    low = U64(bits - (shards.bit_length() - 1))
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        rows.append((int(s), block, pack_gaps(cells[part] - (U64(s) << low)), np.packbits(many[part]).tobytes()))
    return pd.DataFrame(rows, columns=["shard", "block", "cells", "many"])


def _merge_sketches(messages: pd.DataFrame) -> pd.DataFrame:
    """Per block, one bit a cell it sent: whether the cell's count over all blocks exceeds one."""
    cells = [unpack_gaps(x) for x in messages["cells"]]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(c)) for m, c in zip(messages["many"], cells, strict=True)]
    _, of, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    again = (count > 1) | (np.bincount(of, weights=np.concatenate(many), minlength=len(count)) > 0)
    flags = np.split(again[of], np.cumsum([len(c) for c in cells])[:-1])
    return pd.DataFrame({"block": messages["block"], "shard": messages["shard"],
                         "flags": [np.packbits(f).tobytes() for f in flags]})


def _suspects(docs: pd.DataFrame, answers: pd.DataFrame, shards: int, bits: int) -> pd.DataFrame:
    """The first occurrence in the block of each window whose cell counts two or more."""
    docs = ordered(docs)
    w = Words(list(docs["text"]))
    h, text, at, cells, of = _cells(w, bits)
    edges, flag = by_shard(cells, shards, bits), np.zeros(len(cells), bool)
    for s, data in zip(answers["shard"], answers["flags"], strict=True):
        part = slice(edges[s], edges[s + 1])
        flag[part] = np.unpackbits(np.frombuffer(data, np.uint8), count=edges[s + 1] - edges[s])
    keep = np.flatnonzero(flag[of])
    other = w.windows(WINDOW, seed=2)[0][keep]
    h, text, at = h[keep], text[keep], at[keep]
    order = np.lexsort((at, other, h))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(h[order]) != 0) | (np.diff(other[order]) != 0)
    order = order[first]
    h, other, text, at = h[order], (other[order] >> U64(32)).astype("<u4"), text[order], at[order]
    ids = np.where(docs["no_id"], LAST_ID, docs["doc_id"])
    block, rows, edges = int(docs["block"].iloc[0]), [], by_shard(h, shards)
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        used, of = np.unique(text[part], return_inverse=True)
        rows.append((int(s), block, h[part].astype("<u8").tobytes(), other[part].tobytes(),
                     of.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes(), ids[used].astype("<i8").tobytes(),
                     at[part].astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["shard", "block", "hash", "more", "doc", "ids", "word"])


def _not_first(messages: pd.DataFrame) -> pd.DataFrame:
    """Per block, the first words of the windows of which another block holds an earlier copy."""
    h = [np.frombuffer(x, "<u8") for x in messages["hash"]]
    sizes = [len(x) for x in h]
    more = np.concatenate([np.frombuffer(x, "<u4") for x in messages["more"]])
    ids = np.concatenate([np.frombuffer(i, "<i8")[np.frombuffer(d, f"<u{len(d) // n}")]
                          for i, d, n in zip(messages["ids"], messages["doc"], sizes, strict=True)])
    block = np.repeat(messages["block"].to_numpy(), sizes)
    h = np.concatenate(h)
    order = np.lexsort((block, ids, more, h))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (np.diff(h[order]) == 0) & (np.diff(more[order].astype(np.int64)) == 0)
    rows, start = [], 0
    for b, n, words in zip(messages["block"], sizes, messages["word"], strict=True):
        mine = np.frombuffer(words, "<u4")[later[start:start + n]]
        if len(mine):
            rows.append((b, mine.tobytes()))
        start += n
    return pd.DataFrame(rows, columns=["block", "word"])


def _cut(docs: pd.DataFrame, answers: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    docs = ordered(docs)
    w = Words(list(docs["text"]))
    h, _, at = w.windows(WINDOW)
    order = np.argsort(h, kind="stable")
    run = np.zeros(len(h), bool)  # in a run of equal hashes, after its first
    run[1:] = np.diff(h[order]) == 0
    suspect = order[run | np.append(run[1:], False)[:len(run)]]
    repeated = np.empty(0, np.int64)
    if len(suspect):
        other = w.windows(WINDOW, seed=2)[0]
        s = suspect[np.lexsort((at[suspect], other[suspect], h[suspect]))]
        same = (np.diff(h[s]) == 0) & ((other[s[1:]] >> U64(32)) == (other[s[:-1]] >> U64(32)))
        repeated = at[s[1:][same]]
    starts = np.concatenate([repeated, *[np.frombuffer(x, "<u4").astype(np.int64) for x in answers["word"]]])
    change = np.bincount(starts, minlength=len(w.starts) + 1)[:len(w.starts) + 1] \
        - np.bincount(starts + WINDOW, minlength=len(w.starts) + 1)[:len(w.starts) + 1]
    gone = np.cumsum(change)[:len(w.starts)] > 0
    rows = []
    begin, end = w.starts.tolist(), w.ends.tolist()
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        left = (np.flatnonzero(~gone[a:b]) + a).tolist()
        kept = b" ".join([w.data[begin[k]:end[k]] for k in left])
        row = (docs["doc_id"][i], docs["no_id"][i], b - a, b - a - len(left), hashlib.sha256(kept).hexdigest())
        rows.append((*row, kept.decode("utf-8", "replace")) if with_text else row)
    return pd.DataFrame(rows, columns=["doc_id", "no_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])


def dedup_substrings(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept``, the
    text without the words that a window seen earlier covers."""
    b = Blocks(docs, text)
    shards = b.shards
    bits = max((CELLS_PER_WINDOW * b.words).bit_length(), shards.bit_length())
    sketches = b.each(lambda d: _sketch(d, shards, bits), "shard int, block int, cells binary, many binary")
    flags = sketches.groupBy("shard").applyInPandas(_merge_sketches, "block int, shard int, flags binary")
    suspects = b.with_answers(flags, lambda d, a: _suspects(d, a, shards, bits) if len(d) else _none(),
                              "shard int, block int, hash binary, more binary, doc binary, ids binary, word binary")
    later = suspects.groupBy("shard").applyInPandas(_not_first, "block int, word binary")
    schema = "doc_id bigint, no_id boolean, n_words bigint, n_removed bigint, kept_sha256 string" \
        + ", kept string" * with_text
    return join_id(b.with_answers(later, lambda d, a: _cut(d, a, with_text), schema))


def _none() -> pd.DataFrame:
    return pd.DataFrame(columns=["shard", "block", "hash", "more", "doc", "ids", "word"])
