"""Best-fit packing against an exact search on small instances and a plain encoder."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from test_operators import SCHEMA, SF, awkward, given, pairs, tokenizer
from tabtaint.llm import packing


def fewest(items, capacity):
    """The least number of bins, by exhaustive search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= items[i]}.values():
            room[j] -= items[i]
            go(i + 1, room)
            room[j] += items[i]
        go(i + 1, [*room, capacity - items[i]])

    go(0, [])
    return best[0]


def held(plan, capacity):
    counts = np.zeros(capacity + 1, np.int64)
    for filling, bins in plan:
        assert sum(a * k for a, k in filling) <= capacity
        for a, k in filling:
            counts[a] += k * bins
    return counts


def test_plans_are_optimal():
    r, better = random.Random(3), 0
    for _ in range(300):
        capacity = r.choice([10, 20, 50, 100])
        items = [r.randint(max(1, capacity // 8), r.choice([capacity // 2, capacity * 2 // 3, capacity])) for _ in range(r.randint(1, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        made = packing.plan(counts, capacity)
        bins = sum(n for _, n in made)
        assert (held(made, capacity) == counts).all()
        assert bins == fewest(items, capacity) >= packing.lower_bound(counts, capacity)
        better += bins < sum(n for _, n in packing.best_fit(counts, capacity))
    assert better > 0  # the search improves on best fit


def test_plans_of_many():
    x = np.minimum(2048, np.maximum(1, np.random.default_rng(1).lognormal(6, 1, 50_000).astype(int)))
    counts = np.bincount(x, minlength=2049)
    made = packing.plan(counts, nodes=3)
    assert (held(made, 2048) == counts).all()
    assert sum(n for _, n in made) <= packing.lower_bound(counts, 2048) * 1.001 + 1
    assert packing.plan(np.zeros(2049, np.int64)) == []


def encoded(rows, end=0):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]


def check(out, rows, capacity):
    want = Counter()
    for i, ids in encoded(rows):
        cut = len(ids) % capacity or capacity
        for k, (a, b) in enumerate([(0, cut), *((s, s + capacity) for s in range(cut, len(ids), capacity))]):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(k[3] * n for k, n in want.items())


def test_packing_query(spark):
    rows = given(spark)
    n, total = check(E.queries()["op13_best_fit_packing"](spark, SF), rows, 2048)
    assert n <= -(-total // 2048) + 1


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_awkward(spark, capacity):
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    check(packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=capacity), pairs(), capacity)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer("byte_bpe_50k.json")).count() == 0


def test_pieces_are_encoded_as_in_the_text(spark):
    texts = ["a,b. c;d\n\ne  f", " lead", "trail ", "x  y", "I'll don't (yes),no) 1.5,2 a\x00b c", "a　 b", "\x1c x", "word,\nnext.Word", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(packing.pack(docs, tokenizer("byte_bpe_50k.json")), list(enumerate(texts)), 2048)
