"""Token ids of many texts at once: texts are cut into pieces that a tokenizer encodes independently
of each other, and a task remembers the ids of pieces it has met.

Pieces are cut and numbered by Arrow's string kernels, so only a batch's distinct pieces pass
through Python, and only new ones through the tokenizer.
"""

from __future__ import annotations

import os
import re
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tabtaint.llm.pieces import pieces
from tabtaint.llm.text import word_hashes

#: Texts that Arrow's kernels would cut otherwise than :func:`pieces` does.
_BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = rf"{_BLANK} | {_BLANK}| $|\x00"
#: A letter run of a byte-level tokenizer's pattern ends at such a sign, whatever surrounds it.
_RUN_END = re.compile(r"(?<=[A-Za-z])(?=[,.;:!?)\n])")
_IS_LETTER, _ENDS_RUN = np.zeros(256, bool), np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ENDS_RUN[list(b",.;:!?)\n")] = True
#: Pieces that may stand next to each other in a row: a space, and signs that begin and end without white space.
_SIGN = rf"[^\x0b{_BLANK[1:]}"
_WITHIN = rf"\A (?:{_SIGN}|{_SIGN}(?s:.)*{_SIGN})\z"


def places(texts: pa.LargeStringArray | pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Buffer]:
    """Where each text begins in the array's buffer, with the end of the last, and the buffer."""
    _, start, data = texts.buffers()
    start = np.frombuffer(start, np.int64)[texts.offset:texts.offset + len(texts) + 1] if start and start.size else np.zeros(1, np.int64)
    return start, data or pa.py_buffer(b"")


def _even_pieces(texts: pa.LargeStringArray, runs: bool) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pieces of all texts in a row, cut before each space, and how many each text has.  They are slices
    of the texts' own buffer, so nothing is copied."""
    start, data = places(texts)
    byte = np.frombuffer(data, np.uint8)[start[0]:start[-1]]
    cuts = byte == 32
    if runs:
        cuts[1:] |= _IS_LETTER[byte[:-1]] & _ENDS_RUN[byte[1:]]
    cuts[start[:-1][start[:-1] < start[1:]] - start[0]] = True
    begin = np.flatnonzero(cuts) + start[0]
    ends = np.searchsorted(begin, start)
    bounds = pa.py_buffer(np.append(begin, start[-1]))
    return pa.LargeStringArray.from_buffers(len(begin), bounds, data), np.diff(ends)


#: What an integer of 8 bytes keeps of a piece of 0 to 7 bytes.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def _numbered(found: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Each piece's number, and the distinct pieces.  Pieces of up to 7 bytes are told apart as integers
    of their bytes and length, which takes a fraction of the time that strings do."""
    start, data = places(found)
    size = np.diff(start)
    is_short = size < len(_FIRST_BYTES)
    short, long = np.flatnonzero(is_short), np.flatnonzero(~is_short)
    byte = np.append(np.frombuffer(data, np.uint8)[start[0]:start[-1]], np.zeros(8, np.uint8))
    eight = np.ndarray(len(byte) - 7, "<u8", byte, strides=(1,))[start[short] - start[0]]
    of, values = pd.factorize(eight & _FIRST_BYTES[size[short]] | size[short].astype(np.uint64) << np.uint64(56))
    example = np.empty(len(values), np.int64)
    example[of] = short
    numbered = pc.dictionary_encode(found.take(pa.array(long)))
    at = np.empty(len(found), np.int64)
    at[short], at[long] = of, len(values) + numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return at, pa.concat_arrays([found.take(pa.array(example)), numbered.dictionary])


def numbered_pieces(texts: pa.Array, runs: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each text's pieces as numbers into an array of distinct pieces: numbers of all texts in a row, the
    array, and how many pieces each text has.  With ``runs``, pieces also end with a run of letters
    before a punctuation mark, as byte-level tokenizers' patterns do."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    found, size = _even_pieces(texts, runs)
    if pc.any(uneven).as_py():
        rows = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        some = [pieces(texts[int(i)].as_py()) for i in rows]
        some = [list(chain.from_iterable(map(_RUN_END.split, x))) for x in some] if runs else some
        first = np.cumsum(size) - size
        size[rows] = [len(x) for x in some]
        first[rows] = len(found) + np.cumsum(size[rows]) - size[rows]
        found = pa.concat_arrays([found, pa.array(chain.from_iterable(some), pa.large_string())]).take(pa.array(spread(first, size)))
    at, distinct = _numbered(found)
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # of an empty text, or before a leading space
        kept = at != empty
        ends = np.cumsum(size)
        sums = np.concatenate([[0], np.cumsum(kept)])
        size = sums[ends] - sums[ends - size]
        at = at[kept]
        at -= at > empty
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1:]])
    return at, distinct, size


def cut(texts: pa.Array, runs: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """:func:`numbered_pieces` with the distinct pieces as a list."""
    at, distinct, size = numbered_pieces(texts, runs)
    return at, distinct.to_pylist(), size


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions ``first[i] .. first[i] + count[i] - 1`` of all i in a row."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(total)


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts[i]`` values; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Codes:
    """Id lists by number, one after another."""

    def __init__(self, ids=None, count=None):
        self.ids = np.empty(0, np.int32) if ids is None else ids
        self.count = np.empty(0, np.int64) if count is None else count
        self.first = np.cumsum(self.count) - self.count

    def grown(self, ids: np.ndarray, count: np.ndarray) -> Codes:
        return Codes(np.concatenate([self.ids, ids]), np.concatenate([self.count, count]))

    def of(self, at: np.ndarray) -> np.ndarray:
        """The ids of some numbers, all in a row."""
        return self.ids[spread(self.first[at], self.count[at])]


class Memory:
    """Pieces by number, with their ids from one or more tokenizers (``codes``)."""

    def __init__(self, *encoders, limit: int = 1_000_000):
        self.encoders, self.limit = encoders, limit
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.codes = [Codes() for _ in self.encoders]

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """The memory's number of each piece; new pieces are encoded first."""
        if len(self.number) > self.limit:
            self.forget()
        known = self.number
        new = [p for p in dict.fromkeys(distinct) if p not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.codes = [c.grown(*encode(new)) for c, encode in zip(self.codes, self.encoders, strict=True)]
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))


class Pieces:
    """:class:`Memory` of one encoder, for pieces in Arrow arrays: only the new ones' ids pass through Python.

    Known pieces are found by binary search for a 64-bit hash, and compared; no index of all of them is built
    for a lookup.  Of two pieces that share a hash one would be encoded anew each time."""

    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.codes = Codes()
        self.hashes, self.of_hash = np.empty(0, np.uint64), np.empty(0, np.int64)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The memory's number of each of some distinct pieces; new ones are encoded first."""
        if len(self.known) > self.limit:
            self.forget()
        start, data = places(distinct)
        hashes = word_hashes(data, start[:-1], start[1:])
        place = np.searchsorted(self.hashes, hashes)
        out = np.full(len(distinct), -1)
        maybe = np.flatnonzero(np.append(self.hashes, np.uint64(0))[place] == hashes)
        maybe = maybe[place[maybe] < len(self.hashes)]
        held = self.of_hash[place[maybe]]
        same = pc.equal(self.known.take(pa.array(held)), distinct.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        out[maybe[same]] = held[same]
        is_new = np.flatnonzero(out < 0)
        if len(is_new):
            new = distinct.take(pa.array(is_new))
            out[is_new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.codes = self.codes.grown(*self.encode(new))
            order = is_new[np.argsort(hashes[is_new])]
            self.hashes = np.insert(self.hashes, place[order], hashes[order])
            self.of_hash = np.insert(self.of_hash, place[order], out[order])
        return out


ROW_PIECES = 4096


def byte_level(path: str):
    """A tokenizers byte-level tokenizer, and its encoder of pieces for :class:`Memory`.

    Pieces between two words are encoded in long rows, as no token crosses from one to the next;
    the tokens' lengths tell where each piece ends."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    length = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        length[i] = len(token)  # a token's string has a character for each byte

    def joined(found) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int32), *(np.array(e.ids, np.int32) for e in found)])

    def encode(new: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        new = new if isinstance(new, pa.Array) else pa.array(new, pa.large_string())
        in_rows = pc.match_substring_regex(new, _WITHIN).to_numpy(zero_copy_only=False)
        plain, rest = new.filter(pa.array(in_rows)), new.filter(pa.array(~in_rows)).to_pylist()
        start, data = places(plain)
        cuts = [*start[:-1:ROW_PIECES].tolist(), int(start[-1])]
        rows = [str(data[a:b], "utf-8") for a, b in pairwise(cuts)]
        found = tokenizer.encode_batch_fast(rows + rest, add_special_tokens=False)
        row_ids, rest_ids = joined(found[:len(rows)]), joined(found[len(rows):])
        ends = np.cumsum(length[row_ids])
        want = start[1:] - start[0]
        at = np.searchsorted(ends, want)
        if len(plain) and (at[-1] != len(ends) - 1 or (ends[at] != want).any()):
            raise ValueError("a token crosses from one piece of text to the next")
        count = np.zeros(len(new), np.int64)
        count[in_rows] = np.diff(at, prepend=-1)
        count[~in_rows] = np.fromiter(map(len, found[len(rows):]), np.int64, len(rest))
        first = np.zeros(len(new), np.int64)
        first[in_rows] = np.cumsum(count[in_rows]) - count[in_rows]
        first[~in_rows] = len(row_ids) + np.cumsum(count[~in_rows]) - count[~in_rows]
        return np.concatenate([row_ids, rest_ids])[spread(first, count)], count

    return tokenizer, encode
