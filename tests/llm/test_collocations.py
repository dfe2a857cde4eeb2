"""Phrase collocations against a plain count, with small chunks, samples and supports."""

import random
import re
from collections import Counter, defaultdict

import pytest

from brute import LOWER
from test_operators import SCHEMA, awkward, got, wanted
from tabtaint.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
PIECE, WORD = re.compile(r"[.,;:!?\n\x0b\x0c\r]"), re.compile(r"[^ \t]+")


def expected(rows, support=10, top=2000):
    """``rows``: (text, lang)."""
    count, total, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                count[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, f in count.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        longer = Counter()
        for p, a in phrases.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        found = []
        for p, a in phrases.items():
            if 100 * longer[p] >= 50 * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return out


def prose(seed, n, words, langs):
    r, rows = random.Random(seed), []
    for _ in range(n):
        k = min(int(r.paretovariate(0.7)), 60)
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for _ in range(k))
        rows.append((r.choice([text, text, text * 3, "", None]), r.choice(langs)))
    return rows


def frame(spark, rows):
    data = [(i if i % 7 else None, t, lang) for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(5)


@pytest.mark.parametrize("support,top", [(2, 2000), (4, 5), (10, 2000)])
def test_small_vocabulary(spark, support, top):
    rows = prose(support, 500, ["A", "b", "c", "é", "漢", "de", "F\xa0g"], ["en", "und", None, "fr"])
    out = collocations.collocations(frame(spark, rows), support=support, top=top)
    assert got(out, *COLUMNS) == wanted(expected(rows, support, top))


def test_phrases_that_the_sample_misses(spark, monkeypatch):
    """Border failures: whatever the sample proposes, the passes go on until all is counted."""
    words = [f"w{k}" for k in range(60)]
    rows = prose(3, 1500, words, ["en"])
    want = wanted(expected(rows, 3))
    passes = []
    own = collocations._counted
    monkeypatch.setattr(collocations, "_counted", lambda *a, **k: passes.append(1) or own(*a, **k))
    for share, least in ((10**9, 1), (4, 2), (1, 1)):
        monkeypatch.setattr(collocations, "SAMPLE_SHARE", share)
        monkeypatch.setattr(collocations, "SAMPLE_LEAST", least)
        passes.append(0)
        assert got(collocations.collocations(frame(spark, rows), support=3), *COLUMNS) == want
    runs = "".join(map(str, passes)).split("0")[1:]
    assert len(runs[0]) == 4   # sample, all words, pairs, triples
    assert len(runs[2]) == 2   # the sample holds all


def test_chunks_and_full_bitmaps(spark, monkeypatch):
    rows = prose(5, 400, [f"w{k}" for k in range(40)], ["en", "de"])
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(collocations, "LEAST_BITS", 3)
    monkeypatch.setattr(collocations, "MOST_BITS", 3)
    assert got(collocations.collocations(frame(spark, rows), support=3), *COLUMNS) == wanted(expected(rows, 3))


def test_collocations_awkward(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = expected([(r[1], r[2]) for r in rows], 2)
    assert got(collocations.collocations(docs, support=2), *COLUMNS) == wanted(want)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts(spark, monkeypatch):
    """Products beyond 64 bits, and scores that tie after flooring go to the smallest cut."""
    big = 3_000_000_000
    rows = [("en", "", 0, 4 * big), ("en", "a", 1, big), ("en", "b", 1, big), ("en", "c", 1, big - 1), ("en", "a b", 2, big - 1),
            ("en", "b c", 2, big - 1), ("en", "a b c", 3, big - 2)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: spark.createDataFrame(rows, collocations.COUNTED))
    out = collocations.collocations(None)
    a = big - 2
    want = min((10**6 * a * a // (x * y), k, x, y) for k, x, y in ((1, big, big - 1), (2, big - 1, big - 1)))
    assert got(out, *COLUMNS) == [("en", 1, "a b c", a, want[2], want[3], 4 * big, want[0])]
