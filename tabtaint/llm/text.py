"""Words and word windows of many texts at once, as numpy arrays of 64-bit hashes.

A block of texts is hashed in one pass over its bytes: every byte gets a random 64-bit value, a
prefix sum of these values times powers of an odd base gives each word's polynomial, and
multiplying with the inverse power makes it independent of the word's place.  Words of more than
``LONG`` bytes are hashed with BLAKE2 instead, so the arrays stay small.
"""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK, LONG = 1 << 20, 1 << 16
#: The bytes that separate words.
BLANK_BYTES = b" \t\n\x0b\x0c\r"
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

U64 = np.uint64
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK_BYTES)] = True


class _Base:
    """Byte values and powers of one hash function."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.base = int(rng.integers(1 << 40, 1 << 61)) * 8 + 5
        self.step = U64(int(rng.integers(1 << 40, 1 << 61)) * 8 + 3)
        self.up = self.powers(self.base)
        self.down = self.powers(pow(self.base, -1, 1 << 64))

    @staticmethod
    def powers(base: int) -> np.ndarray:
        p = np.full(CHUNK + 1, U64(base))
        p[0] = 1
        return np.cumprod(p)


_BASES: dict[int, _Base] = {}


def _base(seed: int) -> _Base:
    if seed not in _BASES:
        _BASES[seed] = _Base(seed)
    return _BASES[seed]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers with well spread bits."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """The texts after one another with a blank between, and where each begins."""
    texts = [t or b"" for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return b"\n".join(texts), np.concatenate([[0], np.cumsum(lengths)])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_BLANK[np.frombuffer(data, np.uint8)]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[0::2], change[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    b = _base(seed)
    byte = np.frombuffer(data, np.uint8)
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + CHUNK, "right")), i + 1)
        first = int(starts[i])
        if ends[i] - first <= CHUNK:
            sums = np.zeros(int(ends[j - 1]) - first + 1, U64)
            part = b.value[byte[first:int(ends[j - 1])]]
            part *= b.up[:len(part)]
            np.cumsum(part, out=sums[1:])
            at = starts[i:j] - first
            out[i:j] = (sums[ends[i:j] - first] - sums[at]) * b.down[at]
        i = j
    out = mixed(out + (ends - starts).astype(U64), seed)
    for k in np.flatnonzero(ends - starts > LONG):
        word = data[int(starts[k]):int(ends[k])]
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` words (unmixed polynomial by doubling, then mixed)."""
    if len(words) < width:
        return np.empty(0, U64)
    n, step = len(words) - width + 1, int(_base(seed).step)
    out, have, runs, size = None, 0, words, 1
    while size <= width:
        if width & size:
            if out is None:
                out = runs
            else:
                factor = U64(pow(step, size, 1 << 64))
                m = min(len(out), len(runs) - have)
                out = out[:m] * factor + runs[have:have + m]
            have += size
        if 2 * size <= width:
            runs = runs[:-size] * U64(pow(step, size, 1 << 64)) + runs[size:]
        size *= 2
    return mixed(out[:n], seed + 100)


class Words:
    """The words of a block of texts: byte bounds, hashes and how many each text has."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, seed: int = 1):
        self.data, at = joined(texts)
        if lower:
            self.data = self.data.translate(LOWER_ASCII)
        self.starts, self.ends = word_bounds(self.data)
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.hashes = word_hashes(self.data, self.starts, self.ends, seed)

    def windows(self, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and first word of every window that lies within one text."""
        h = window_hashes(self.hashes, width, seed)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        whole = np.flatnonzero(text[:len(h)] == text[width - 1:]) if len(h) else np.empty(0, np.int64)
        return h[whole], text[whole], whole
