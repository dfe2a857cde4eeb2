"""LM scoring (operator 8): a hashed maximum-entropy model with class-factored softmax.

A token's class is a hash of its last bytes, its member a hash of the whole word, and
P(token | history) = P(class | history) * P(member | class, previous) * P(token | class, member),
mixed with the word's smoothed share of all tokens by n / (n + class features in use), n training tokens.
The first factor is a softmax over classes with features for the previous class, the skipped one
(two back) and a hash of both; the second a softmax over members with hashed (previous class, class)
features; the third begins with the smoothed share of the token's count, with one share kept for unknown
tokens.  The member's known words are dealt by hash into cells, whose number follows the corpus, and
within a cell a softmax with word features moves the shares: for the pair of previous word and token, the
pair of skipped word and token, and the triple, each with a weight of its own.  A history word is
told apart by ``CONTEXT_BITS`` bits of hash within a cell.

Every training document counts: blocks send their words' counts to shards of the hash space and
get the corpus counts back, so no vocabulary is broadcast, and they add up the feature events, whose
table has a fixed size.  Gradient steps run in Spark over the slices of that table; the weights (a
bounded array) go out by broadcast and the slices' gradients come back.  For the word features blocks send
their distinct triples to the shard that holds the token's cell; as a cell's softmax depends on no other,
the shard takes its gradient steps alone and answers each triple with what it adds to the token's log
share.  Texts are scored in numpy batches, one block at a time.

Every known word is in a cell.  Those that occur more than ``HOT`` times are all in their bucket's first cell,
and a cell with more than ``CELL_TOKENS`` tokens is dealt by history into parts, each with weights of its own:
by the previous word, and where that word occurs more than ``HOT`` times by the skipped word too.  So a
context lies in one part, and a task's triples stay bounded however often a word occurs.  The end token is the
only word of its bucket, so its share there is 1 whatever the features: it needs no triples.

Defined cases: null and empty texts have the end token alone; a null id counts as an empty text for
the fold, which is held out; repeated rows are counted and scored each; without training
tokens every base probability is 1 and the model's factors are uniform; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.blocks import Blocks, by_shard, ordered
from tabtaint.llm.codes import spread
from tabtaint.llm.common import join_id, stored
from tabtaint.llm.text import U64, Words, mixed

CLASSES, MEMBERS, JOINT = 64, 32, 1024
END_CLASS = CLASSES - 1  # also the class before a text begins
END = mixed(np.array([0], U64), 99)[0]
SUFFIX = 3
SMOOTH = 0.1
STEPS, EVENT_PRIOR = 16, 2.0
BUCKETS = CLASSES * MEMBERS
FOLDS = 10
#: Word features: hash bits of a history word, gradient steps, and the occurrences beyond which a word counts as hot.
CONTEXT_BITS, WORD_STEPS, HOT = 20, 6, 1 << 20
CONTEXT, PAIR, WORD_BITS = (1 << CONTEXT_BITS) - 1, (1 << 2 * CONTEXT_BITS) - 1, 24
#: Tokens of a cell on average, those of a part of a larger cell at most on average, triples that a task trains
#: at once, and candidate rivals that it looks up at once.
CELL_TOKENS, PART_TOKENS, AT_ONCE, CANDIDATES = 1 << 21, 1 << 20, 1 << 18, 1 << 21


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % FOLDS == 0


def joint_feature(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return (mixed((a * CLASSES + b).astype(U64), salt) % U64(JOINT)).astype(np.int64)


PREVIOUS, SKIPPED = np.meshgrid(np.arange(CLASSES), np.arange(CLASSES), indexing="ij")
BOTH = joint_feature(PREVIOUS, SKIPPED, 1)        # [previous, skipped]
IN_CLASS = joint_feature(PREVIOUS, SKIPPED, 2)    # [previous, class]


class Tokens:
    """The tokens of a block's texts: each text's words, then the end."""

    def __init__(self, docs: pd.DataFrame):
        w = Words(list(docs["text"]), lower=True)
        byte = np.frombuffer(w.data, np.uint8)
        suffix = np.zeros(len(w.starts), U64)
        for k in range(1, SUFFIX + 1):
            inside = w.ends - k >= w.starts
            suffix = suffix * U64(257) + np.where(inside, byte[np.maximum(w.ends - k, 0)].astype(U64) + U64(1), U64(0)) \
                if len(byte) else suffix
        kind = (mixed(suffix, 5) % U64(CLASSES - 1)).astype(np.int64)
        ends = w.first[1:]
        self.hash = np.insert(w.hashes, ends, END)
        self.kind = np.insert(kind, ends, END_CLASS)
        self.member = np.where(self.kind == END_CLASS, 0, (self.hash % U64(MEMBERS)).astype(np.int64))
        self.bucket = self.kind * MEMBERS + self.member
        self.counts = w.counts + 1
        begin = np.cumsum(self.counts) - self.counts
        self.previous = np.concatenate([[END_CLASS], self.kind[:-1]])
        self.skipped = np.concatenate([[END_CLASS, END_CLASS], self.kind[:-2]])[:len(self.kind)]
        self.skipped[begin] = END_CLASS
        self.held = np.array([held_out(None if m else i) for m, i in zip(docs["no_id"], docs["doc_id"], strict=True)], bool)
        self.training = np.repeat(~self.held, self.counts)
        self.vocabulary, self.word = np.unique(self.hash, return_inverse=True)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text."""
        return np.add.reduceat(values, np.cumsum(self.counts) - self.counts)


# ---- counting -----------------------------------------------------------------------------

def _count(docs: pd.DataFrame, shards: int) -> pd.DataFrame:
    docs = ordered(docs)
    t, block, rows = Tokens(docs), int(docs["block"].iloc[0]), []
    n = np.bincount(t.word[t.training], minlength=len(t.vocabulary))
    bucket = np.zeros(len(t.vocabulary), np.int64)
    bucket[t.word] = t.bucket
    edges = by_shard(t.vocabulary, shards)
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        rows.append((int(s), block, 0, t.vocabulary[part].astype("<u8").tobytes(), n[part].astype("<u4").tobytes(),
                     bucket[part].astype("<u2").tobytes()))
    a = t.training
    kinds = np.bincount((t.previous[a] * CLASSES + t.skipped[a]) * CLASSES + t.kind[a], minlength=CLASSES ** 3)
    members = np.bincount((t.previous[a] * CLASSES + t.kind[a]) * MEMBERS + t.member[a],
                          minlength=CLASSES * BUCKETS).reshape(CLASSES, -1)
    for c, events in enumerate(np.concatenate([kinds.reshape(CLASSES, -1), members], axis=1)):
        if events.any():
            rows.append((c % shards, block, 1 + c, zlib.compress(events.astype("<u4").tobytes(), 1), b"", b""))
    return pd.DataFrame(rows, columns=["shard", "block", "kind", "data", "n", "bucket"])


def _add(messages: pd.DataFrame) -> pd.DataFrame:
    """The shard's corpus counts for each block, its bucket totals (block -1), and the sums of the
    slices of feature events that it gets (block -2 - previous class)."""
    rows = []
    words = messages[messages["kind"] == 0].sort_values("block")
    if len(words):
        h = [np.frombuffer(x, "<u8") for x in words["data"]]
        n = np.concatenate([np.frombuffer(x, "<u4") for x in words["n"]]).astype(np.int64)
        bucket = np.concatenate([np.frombuffer(x, "<u2") for x in words["bucket"]])
        _, first, of = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
        total = np.bincount(of, weights=n).astype(np.int64)
        each = np.split(total[of], np.cumsum([len(x) for x in h])[:-1])
        shard = int(words["shard"].iloc[0])
        rows += [(int(b), shard, zlib.compress(c.astype("<u8").tobytes(), 1))
                 for b, c in zip(words["block"], each, strict=True)]
        at = bucket[first]
        rows.append((-1, shard, np.stack([np.bincount(at, weights=x, minlength=BUCKETS)
                                          for x in (total, total > 0, total * (total > HOT))]).astype("<i8").tobytes()))
    for kind, some in messages[messages["kind"] > 0].groupby("kind"):
        events = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in some["data"])
        rows.append((-1 - int(kind), int(some["shard"].iloc[0]), events.astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["block", "shard", "data"])


def _bucket_totals(counted: DataFrame) -> np.ndarray:
    """Tokens, distinct words, and tokens of words over ``HOT`` of each bucket."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, BUCKETS), np.int64)
        for b in batches:
            for x in b["data"]:
                total += np.frombuffer(x, "<i8").reshape(3, BUCKETS)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "n": total[0], "words": total[1], "hot": total[2]})

    rows = counted.where("block = -1").select("data").mapInPandas(add, "bucket int, n bigint, words bigint, hot bigint") \
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "words", "hot")]).collect()
    out = np.zeros((3, BUCKETS))
    for r in rows:
        out[:, r["bucket"]] = r["n"], r["words"], r["hot"]
    return out


# ---- training -----------------------------------------------------------------------------

@dataclass
class Weights:
    bias: np.ndarray       # [class]
    previous: np.ndarray   # [previous, class]
    skipped: np.ndarray    # [skipped, class]
    both: np.ndarray       # [joint, class]
    member: np.ndarray     # [class, member]
    in_class: np.ndarray   # [joint, member]
    used: int = 0          # features that occur in the training events

    def arrays(self) -> list[np.ndarray]:
        return [self.bias, self.previous, self.skipped, self.both, self.member, self.in_class]

    def kinds(self, previous) -> np.ndarray:
        """log P(class | previous, skipped): [.., skipped, class]."""
        x = self.bias + self.previous[previous][..., None, :] + self.skipped + self.both[BOTH[previous]]
        return x - _log_sum(x)

    def members(self, previous) -> np.ndarray:
        """log P(member | class, previous): [.., class, member]."""
        x = self.member + self.in_class[IN_CLASS[previous]]
        return x - _log_sum(x)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def _zero() -> Weights:
    return Weights(np.zeros(CLASSES), np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES)),
                   np.zeros((JOINT, CLASSES)), np.zeros((CLASSES, MEMBERS)), np.zeros((JOINT, MEMBERS)))


def slice_moments(w: Weights, previous: int, events: np.ndarray, out: Weights, expected: bool) -> None:
    """Adds a slice's events, or what the model expects of them, to every feature's sums."""
    kinds = events[:CLASSES ** 2].reshape(CLASSES, CLASSES).astype(float)
    members = events[CLASSES ** 2:].reshape(CLASSES, MEMBERS).astype(float)
    if expected:
        kinds = kinds.sum(axis=1, keepdims=True) * np.exp(w.kinds(previous))
        members = members.sum(axis=1, keepdims=True) * np.exp(w.members(previous))
    out.bias += kinds.sum(axis=0)
    out.previous[previous] += kinds.sum(axis=0)
    out.skipped += kinds
    np.add.at(out.both, BOTH[previous], kinds)
    out.member += members
    np.add.at(out.in_class, IN_CLASS[previous], members)


def train(counted: DataFrame, steps: int = STEPS) -> Weights:
    """Gradient steps, each scaled by its feature's events (the first-order form of iterative
    scaling), on the log-likelihood of all training events."""
    slices = stored(counted.where("block < -1").select((-2 - F.col("block")).alias("previous"), "data"), "events")
    sc = slices.sparkSession.sparkContext

    def moments(w: Weights, expected: bool) -> Weights:
        sent = sc.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = _zero()
            for b in batches:
                for p, data in zip(b["previous"], b["data"], strict=True):
                    slice_moments(sent.value, int(p), np.frombuffer(data, "<i8"), out, expected)
            yield pd.DataFrame({"sums": [np.concatenate([x.ravel() for x in out.arrays()]).tobytes()]})

        flat = np.zeros(sum(x.size for x in w.arrays()))
        for r in slices.coalesce(8).mapInPandas(run, "sums binary").collect():
            flat += np.frombuffer(r["sums"])
        sent.destroy()
        parts = np.split(flat, np.cumsum([x.size for x in w.arrays()])[:-1])
        return Weights(*[p.reshape(x.shape) for p, x in zip(parts, w.arrays(), strict=True)])

    w = _zero()
    seen = moments(w, expected=False)
    w.used = sum(int((x > 0).sum()) for x in seen.arrays())
    w.bias[:] = np.log((seen.bias + SMOOTH) / (seen.bias.sum() + SMOOTH * CLASSES))
    w.member[:] = np.log((seen.member + SMOOTH) / (seen.member.sum(axis=1, keepdims=True) + SMOOTH * MEMBERS))
    for _ in range(steps):
        wanted = moments(w, expected=True)
        for x, a, b, active in zip(w.arrays(), seen.arrays(), wanted.arrays(), (4, 4, 4, 4, 2, 2), strict=True):
            x += 2 * (a - b) / (a + b + EVENT_PRIOR) / active
    return w


# ---- word features ------------------------------------------------------------------------

def _packed(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<i8").ravel()


def _pack_history(x: np.ndarray) -> bytes:
    """Hashes of history words, two in 5 bytes."""
    x = np.append(x, 0) if len(x) % 2 else x
    return _packed(x[0::2] << CONTEXT_BITS | x[1::2], 5)


def _unpack_history(data: bytes, n: int) -> np.ndarray:
    two = _unpacked(data, 5)
    return np.stack([two >> CONTEXT_BITS, two & CONTEXT], axis=1).ravel()[:n]


def pack_contexts(context: np.ndarray, begin: np.ndarray) -> bytes:
    """Contexts that ascend within each word, whose first are at ``begin``: a mark where the previous word
    is another than before, the previous words at the marks, and all skipped words."""
    previous = context >> CONTEXT_BITS
    new = np.append(True, previous[1:] != previous[:-1])[:len(context)]
    new[begin] = True
    return np.packbits(new).tobytes() + _pack_history(previous[new]) + _pack_history(context & CONTEXT)


def unpack_contexts(data: bytes, n: int) -> np.ndarray:
    marks = -(-n // 8)
    new = np.unpackbits(np.frombuffer(data, np.uint8, marks), count=n).astype(bool)
    words = int(new.sum())
    end = marks + -(-words // 2) * 5
    previous = _unpack_history(data[marks:end], words)
    return previous[np.cumsum(new) - 1] << CONTEXT_BITS | _unpack_history(data[end:], n)


class Cells:
    """Cells of the buckets' words, and the parts that large ones are dealt into by history.  A part of a cell
    is a unit: the first parts are numbered like the cells, the others follow."""

    def __init__(self, tokens: np.ndarray, hot: np.ndarray, each: int):
        self.each = each
        self.other = self._parts((tokens - hot) / each)
        self.first = self._parts((tokens - hot) / each + hot)   # of a bucket's first cell, which has its hot words
        more = self.first - 1 + (each - 1) * (self.other - 1)
        self.begin = np.cumsum(more) - more

    @staticmethod
    def _parts(tokens: np.ndarray) -> np.ndarray:
        n = np.ceil(np.log2(np.maximum(tokens / PART_TOKENS, 1))).astype(np.int64)
        return np.where(tokens > CELL_TOKENS, 1 << n, 1)

    @property
    def count(self) -> int:
        return BUCKETS * self.each

    def parts(self, cell: np.ndarray) -> np.ndarray:
        return np.where(cell % self.each == 0, self.first[cell // self.each], self.other[cell // self.each])

    def unit(self, cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        bucket, place = cell // self.each, cell % self.each
        before = np.where(place == 0, 0, self.first[bucket] - 1 + (place - 1) * (self.other[bucket] - 1))
        return np.where(part == 0, cell, self.count + self.begin[bucket] + before + part - 1)

    def shard(self, unit: np.ndarray, shards: int) -> np.ndarray:
        """Neighbouring parts of a cell are in different shards."""
        return np.where(unit < self.count, unit * shards // self.count, unit % shards)


class Triples:
    """A block's distinct (token, previous word, skipped word) of known tokens, by shard, unit and word."""

    def __init__(self, t: Tokens, count: np.ndarray, cells: Cells, shards: int):
        v, words = t.vocabulary, len(t.vocabulary)
        with_end = np.append(v, END)
        hot = np.append(count, count[v == END].max(initial=0)) > HOT
        bucket = np.zeros(words, np.int64)
        bucket[t.word] = t.bucket
        cell = bucket * cells.each + np.where(hot[:-1], 0, (mixed(v, 7) % U64(cells.each)).astype(np.int64))
        place = (mixed(with_end, 11) >> U64(64 - CONTEXT_BITS)).astype(np.int64)
        previous = np.concatenate([[words], t.word[:-1]])
        skipped = np.concatenate([[words, words], t.word[:-2]])[:len(t.word)]
        skipped[np.cumsum(t.counts) - t.counts] = words
        self.token = np.flatnonzero(((count > 0) & (v != END))[t.word])
        previous, skipped = previous[self.token], skipped[self.token]

        # a word has a place in each unit that it is met in: its own number, or one after all words
        parts, at = cells.parts(cell), t.word[self.token]
        dealt = np.flatnonzero(parts[at] > 1)
        by = mixed(with_end, 13)[previous[dealt]] + np.where(hot[previous[dealt]], mixed(with_end, 17)[skipped[dealt]], U64(0))
        part = (by % parts[at[dealt]].astype(U64)).astype(np.int64)
        dealt_words, number = np.unique(at[dealt] << 32 | part, return_inverse=True)
        at[dealt] = words + number
        word = np.concatenate([np.arange(words), dealt_words >> 32])
        unit = cells.unit(cell[word], np.concatenate([np.zeros(words, np.int64), dealt_words & 0xFFFFFFFF]))
        shard = cells.shard(unit, shards)
        order = np.lexsort((unit, shard))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[at] << 2 * CONTEXT_BITS | place[previous] << CONTEXT_BITS | place[skipped]
        values, self.of = np.unique(key, return_inverse=True)
        self.n = np.bincount(self.of, weights=t.training[self.token], minlength=len(values)).astype(np.int64)
        self.context = values & PAIR
        used, self.per_word = np.unique(values >> 2 * CONTEXT_BITS, return_counts=True)
        used = order[used]
        self.unit, self.hash, self.count = unit[used], v[word[used]], count[word[used]].astype(np.int64)
        self.words = np.searchsorted(shard[used], np.arange(shards + 1))              # bounds of each shard's words
        self.triples = np.concatenate([[0], np.cumsum(self.per_word)])[self.words]    # and triples


def _ask(docs: pd.DataFrame, answers: pd.DataFrame, shards: int, cell_shards: int, cells: Cells) -> pd.DataFrame:
    docs = ordered(docs)
    t = Tokens(docs)
    x = Triples(t, _corpus_counts(t, answers, shards), cells, cell_shards)
    rows = []
    for s in np.flatnonzero(np.diff(x.words)):
        w, e = slice(x.words[s], x.words[s + 1]), slice(x.triples[s], x.triples[s + 1])
        per_word, count = x.per_word[w], x.count[w]
        numbers = np.concatenate([x.unit[w], count & 0xFFFFFFFF, count >> 32, per_word, x.n[e]])
        rows.append((int(s), int(docs["block"].iloc[0]), _packed(x.hash[w], 6), pack_contexts(x.context[e], np.cumsum(per_word) - per_word),
                     zlib.compress(numbers.astype("<u4").tobytes(), 1)))
    return pd.DataFrame(rows, columns=["shard", "block", "words", "contexts", "numbers"])


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """Trains the shard's units; per block, what word features add to the log share of each of its triples."""
    messages = messages.sort_values("block")
    hashes = [_unpacked(x, 6) for x in messages["words"]]
    numbers = [np.split(np.frombuffer(zlib.decompress(x), "<u4"), [len(h), 2 * len(h), 3 * len(h), 4 * len(h)])
               for x, h in zip(messages["numbers"], hashes, strict=True)]
    sizes = [len(x[-1]) for x in numbers]
    contexts = [unpack_contexts(x, k) for x, k in zip(messages["contexts"], sizes, strict=True)]
    unit, low, high, per_word, n = (np.concatenate(x) for x in zip(*numbers, strict=True))
    del numbers
    unit, count = np.unique(unit, return_inverse=True)[1], high.astype(np.int64) << 32 | low
    _, first, of = np.unique(unit << 48 | np.concatenate(hashes), return_index=True, return_inverse=True)
    unit, count, word, context = unit[first], count[first], np.repeat(of.astype(np.int32), per_word), np.concatenate(contexts)
    del contexts
    order = np.argsort(word, kind="stable")
    word = word[order]
    out, begin = np.empty(len(word), np.float16), 0
    unit_ends = np.append(np.flatnonzero(np.diff(unit)) + 1, len(unit))       # words
    triple_ends = np.searchsorted(word, unit_ends)
    for k, end in enumerate(triple_ends.tolist()):
        if end - begin < AT_ONCE and k < len(unit_ends) - 1:
            continue
        at, some = order[begin:end], slice(word[begin], unit_ends[k])
        out[at] = fit((word[begin:end] - word[begin]).astype(np.int64), context[at], n[at], count[some], unit[some])
        begin = end
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": messages["block"], "shard": messages["shard"], "data": [x.astype("<f2").tobytes() for x in parts]})


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: the distinct ones, where each begins, how often it comes, and each row's number."""
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    return keys[first], first, np.diff(np.append(first, len(keys))), np.cumsum(new) - 1


def fit(word: np.ndarray, context: np.ndarray, n: np.ndarray, count: np.ndarray, cell: np.ndarray,
        steps: int = WORD_STEPS) -> np.ndarray:
    """Trains some cells' softmaxes over their words.  Rows are triples: ``word``, ``context`` (previous and
    skipped word) and ``n`` training events; ``count`` and ``cell`` of the words, ascending by cell.  Gives
    each row's log of its probability over the word's share of the cell.

    A context's sum over the cell is 1 plus what the words with a pair feature add; only words that
    followed both the previous and the skipped word need to be visited for each context."""
    cell = np.cumsum(np.append(0, np.diff(cell) > 0))
    share = (count + SMOOTH) / np.bincount(cell, weights=count + SMOOTH)[cell]
    event, of = np.unique(word << 2 * CONTEXT_BITS | context, return_inverse=True)
    seen3 = np.bincount(of, weights=n)
    v, pair = event >> 2 * CONTEXT_BITS, event & PAIR
    own = cell[v]
    contexts, context_of = np.unique(own << 2 * CONTEXT_BITS | pair, return_inverse=True)
    total = np.bincount(context_of, weights=seen3)
    c_cell = contexts >> 2 * CONTEXT_BITS << CONTEXT_BITS
    sides = []
    for history, wanted in ((pair >> CONTEXT_BITS, contexts >> CONTEXT_BITS & CONTEXT), (pair & CONTEXT, contexts & CONTEXT)):
        keys, at = np.unique((own << CONTEXT_BITS | history) << WORD_BITS | v, return_inverse=True)
        groups, first, size, group = _numbered(keys >> WORD_BITS)
        sides.append((keys, at, np.bincount(at, weights=seen3), groups, first, size, group, np.searchsorted(groups, c_cell | wanted)))
    (keys1, at1, seen1, groups1, first1, size1, group1, c1), (keys2, at2, seen2, groups2, first2, size2, group2, c2) = sides

    rivals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []   # context, pair features: words that followed both
    least = np.minimum(size1[c1], size2[c2])
    for some in np.split(np.arange(len(contexts)), np.flatnonzero(np.diff(np.cumsum(least) // CANDIDATES)) + 1):
        by1 = size1[c1[some]] <= size2[c2[some]]
        for c, (first, size, ca), mine, (groups, other, cb) in (
                (some[by1], (first1, size1, c1), keys1, (groups2, keys2, c2)), (some[~by1], (first2, size2, c2), keys2, (groups1, keys1, c1))):
            i = np.repeat(c, size[ca[c]])
            f = spread(first[ca[c]], size[ca[c]])
            want = groups[cb[i]] << WORD_BITS | mine[f] & ((1 << WORD_BITS) - 1)
            g = np.minimum(np.searchsorted(other, want), len(other) - 1)
            same = np.flatnonzero(other[g] == want)
            i, f, g = (x[same].astype(np.int32) for x in (i, f, g))
            rivals.append((i, f, g) if mine is keys1 else (i, g, f))
    i, f1, f2 = (np.concatenate(x) for x in zip(*rivals, strict=True))
    w = keys1[f1] & ((1 << WORD_BITS) - 1)
    want = w << 2 * CONTEXT_BITS | contexts[i] & PAIR
    f3 = np.minimum(np.searchsorted(event, want), len(event) - 1)
    f3 = np.where(event[f3] == want, f3, len(event)).astype(np.int32)
    q, q1, q2 = share[w], share[keys1 & ((1 << WORD_BITS) - 1)], share[keys2 & ((1 << WORD_BITS) - 1)]

    x1, x2, x3 = np.zeros(len(keys1)), np.zeros(len(keys2)), np.zeros(len(event) + 1)
    seen3 = np.append(seen3, 0)

    def sums() -> tuple[np.ndarray, ...]:
        e1, e2 = np.exp(x1), np.exp(x2)
        a, b = e1[f1], e2[f2]
        both = a * b * np.exp(x3)[f3]
        z = 1 + np.bincount(group1, weights=q1 * (e1 - 1))[c1] + np.bincount(group2, weights=q2 * (e2 - 1))[c2] \
            + np.bincount(i, weights=q * (both - a - b + 1), minlength=len(contexts))
        return e1, e2, a, b, both, z

    for _ in range(steps):
        e1, e2, a, b, both, z = sums()
        rate = total / z
        each = rate[i] * q
        wanted1 = q1 * e1 * np.bincount(c1, weights=rate)[group1] + np.bincount(f1, weights=each * (both - a), minlength=len(keys1))
        wanted2 = q2 * e2 * np.bincount(c2, weights=rate)[group2] + np.bincount(f2, weights=each * (both - b), minlength=len(keys2))
        wanted3 = np.bincount(f3, weights=each * both, minlength=len(x3))
        for x, seen, wanted in ((x1, seen1, wanted1), (x2, seen2, wanted2), (x3, seen3, wanted3)):
            x += np.where(seen > 0, 2 * (seen - wanted) / (seen + wanted + EVENT_PRIOR) / 3, 0)
    z = sums()[-1]
    return (x1[at1] + x2[at2] + x3[:-1] - np.log(z)[context_of])[of]


# ---- scoring ------------------------------------------------------------------------------

def _corpus_counts(t: Tokens, answers: pd.DataFrame, shards: int) -> np.ndarray:
    edges, count = by_shard(t.vocabulary, shards), np.zeros(len(t.vocabulary))
    for s, data in zip(answers["shard"], answers["data"], strict=True):
        count[edges[s]:edges[s + 1]] = np.frombuffer(zlib.decompress(data), "<u8")
    return count


@dataclass
class Model:
    weights: Weights
    tokens: np.ndarray   # of each bucket
    words: np.ndarray

    def __post_init__(self):
        self.n, self.v = float(self.tokens.sum()), float(self.words.sum())
        self.trust = self.n / (self.n + self.weights.used) if self.n else 0.0
        self.log_kind = self.weights.kinds(np.arange(CLASSES))
        self.log_member = self.weights.members(np.arange(CLASSES))

    def score(self, docs: pd.DataFrame, answers: pd.DataFrame, shards: int, cell_shards: int, cells: Cells) -> pd.DataFrame:
        docs = ordered(docs)
        t = Tokens(docs)
        count = _corpus_counts(t, answers[~answers["words"]], shards)
        c = count[t.word]
        x = Triples(t, count, cells, cell_shards)
        added = np.zeros(len(x.n))
        for s, data in zip(*(answers.loc[answers["words"], k] for k in ("shard", "data")), strict=True):
            added[x.triples[s]:x.triples[s + 1]] = np.frombuffer(data, "<f2")
        base = np.log10((c + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))
        share = np.log((c + SMOOTH) / (self.tokens[t.bucket] + SMOOTH * (self.words[t.bucket] + 1)))
        share[x.token] += added[x.of]
        full = (self.log_kind[t.previous, t.skipped, t.kind] + self.log_member[t.previous, t.kind, t.member] + share)
        if self.trust < 1:   # with little evidence for the features, the word's plain share counts too
            full = np.logaddexp(np.log(self.trust) + full, np.log1p(-self.trust) + base * np.log(10)) if self.trust else base * np.log(10)
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "no_id": docs["no_id"], "held_out": t.held, "n_tokens": t.counts,
            "n_known": t.sums((c > 0).astype(np.int64)), "train_tokens": int(self.n),
            "base_score": t.sums(base), "score": t.sums(full) / np.log(10)})


SCHEMA = ("doc_id bigint, no_id boolean, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def score(docs: DataFrame, text: str = "text", steps: int = STEPS) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    b = Blocks(docs, text)
    shards = b.shards
    sent = b.each(lambda d: _count(d, shards), "shard int, block int, kind int, data binary, n binary, bucket binary")
    counted = stored(sent.groupBy("shard").applyInPandas(_add, "block int, shard int, data binary"), "corpus-counts")
    tokens, words, hot = _bucket_totals(counted)
    model = b.spark.sparkContext.broadcast(Model(train(counted, steps), tokens, words))
    counts = counted.where("block >= 0")
    cells = Cells(tokens, hot, 1 << max(0, math.ceil(b.words / BUCKETS / CELL_TOKENS) - 1).bit_length())
    cell_shards = min(4 * shards, cells.count)   # a triple takes more memory than a word's count
    asked = b.with_answers(counts, lambda d, a: _ask(d, a, shards, cell_shards, cells),
                           "shard int, block int, words binary, contexts binary, numbers binary")
    # not stored: in one query the blocks are dealt out once, for asking and for scoring
    added = asked.groupBy("shard").applyInPandas(_answer, "block int, shard int, data binary")
    answers = counts.withColumn("words", F.lit(False)).unionByName(added.withColumn("words", F.lit(True)))
    return join_id(b.with_answers(answers, lambda d, a: model.value.score(d, a, shards, cell_shards, cells), SCHEMA))
