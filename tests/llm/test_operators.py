"""Every operator against brute force: the given tables, and a fixture of awkward rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import brute
from tabtaint.llm import (
    bpe,
    decontaminate,
    licenses,
    maxent,
    neardup,
    pii,
    quality,
    substrings,
    tokenfiles,
    urls,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, row int, block int"


def tokenizer(name):
    import public_tokenizers
    return public_tokenizers.path(name)


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, copies, odd white space, big ids."""
    r = random.Random(7)
    words = [f"w{k}é" if k % 7 == 0 else f"Wo{k}," for k in range(400)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    shared, base = prose(60), prose(80)
    rows = [(None, "no id " + prose(30)), (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "a b c d"), (5, "A B c D"),
            (6, base), (7, base), (8, base + " more words"), (9, shared + " " + prose(10)), (10, prose(10) + " " + shared),
            (11, prose(25000)), (12, "x" * 5000 + " y"), (13, "aé漢字\u2003\x1c \x00 z🎉 \n\n  tail  "), (14, prose(40) + "\n" + prose(3)),
            (15, "same line here\n" * 30), (16, "<|endoftext|> is text; don't we'll I'M"), (2**60 + 1, base.upper()),
            (2**60 + 3, shared), (17, "Licensed under the Apache License, Version 2.0."), (18, "tab\tnew\r\nline\x0bv\x0cf"),
            (19, prose(30)), (19, prose(30)), (20, "repeated " + base), (20, "repeated " + base)]
    return [(i, t, "en", "s", len(t or ""), "clash", 1, 2) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1]) for r in awkward()]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def wanted(rows):
    return sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows), key=repr)


def given(spark, table="documents", columns=("doc_id", "text")):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


BPE = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
NEAR = ["doc_id", "n_shingles", "component_id", "kept"]
FILES = ["doc_id", "start", "n_tokens", "ids_crc32"]
CUT = ["doc_id", "n_words", "n_removed", "kept_sha256"]
URL = ["page_id", "host", "path", "rule", "verdict"]
MARK = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
LM = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
QUALITY = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


# ---- 1 ------------------------------------------------------------------------------------

def codec_of(docs, **more):
    import public_tokenizers
    return bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **more)


def test_bpe_query(spark):
    assert got(E.queries()["op1_bpe_codec"](spark, SF), *BPE) == wanted(brute.bpe(given(spark)))


def test_bpe_awkward(docs, none):
    assert got(codec_of(docs), *BPE) == wanted(brute.bpe(pairs()))
    out = codec_of(docs, with_ids=True).where("doc_id = 6").first()
    assert bytes(out["decoded"]).decode() == pairs()[7][1] and len(out["ids"]) == out["n_tokens"]
    assert codec_of(none).count() == 0


def test_bpe_long_words(spark):
    r = random.Random(1)
    texts = ["a" * 3000, "=" * 999, "".join(r.choice("abcdefgh") for _ in range(700)), "ab" * 200 + "aba",
             "".join(r.choice("thereandit") for _ in range(1500)), "é" * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert got(codec_of(d), *BPE) == wanted(brute.bpe(list(enumerate(texts))))


def test_bpe_queries_agree():
    """The query for short words and the one for any length."""
    import public_tokenizers
    c = bpe.codec(tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    words = [b"a", b"aaaa aaaa", b"abababab", b"theretherethere", "éééé".encode(), bytes(range(200, 256))]
    assert c._encode(words, bpe.ANY) == c._encode(words, bpe.SHORT)


def test_bpe_memory_is_bounded(monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(bpe, "MEMORY", 5)
    c = bpe.Codec(tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for k in range(6):
        out = c.code({f" word{j}" for j in range(k, k + 4)} | {" same"})
        assert len(out) == 5 and len(c.new) <= 5 and len(c.old) <= 5
    assert b"".join(b for _, _, b in c.code({" same"}).values()) == b" same"


# ---- 2 ------------------------------------------------------------------------------------

def test_near_query(spark):
    assert got(E.queries()["op2_minhash_near_dedup"](spark, SF), *NEAR) == wanted(brute.near(given(spark)))


def test_near_awkward(docs, none):
    out = neardup.near_duplicates(docs)
    seen = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL AND doc_id <> 19").collect()}
    for i, n, component, kept in brute.near([p for p in pairs() if p[0] is not None and p[0] != 19]):
        assert (seen[i]["n_shingles"], seen[i]["component_id"], seen[i]["kept"]) == (n, component, kept)
    lost = out.where("doc_id IS NULL").first()
    assert lost["component_id"] is None and lost["kept"]
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_first_of_group(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (7, 8)").count() == 0


def test_near_shared_and_null_ids(spark):
    """Rows of one id are judged by their own texts, and one row of each group stays, whatever its id."""
    def prose(x):
        return " ".join(f"{x}{k}" for k in range(80))

    rows = [(1, prose("a")), (30, prose("a") + " more"), (30, prose("b")), (30, prose("c")), (31, prose("c") + " more"),
            (32, prose("d")), (32, prose("d")), (33, prose("e")), (33, prose("e") + " more"), (None, prose("f")),
            (None, prose("f")), (None, prose("f") + " more"), (None, prose("b") + " more"), (-5, prose("g")), (7, prose("g")),
            (34, ""), (34, ""), (None, None), (2**60 + 1, prose("h")), (2**60 + 3, prose("h") + " more")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1)).repartition(3)
    out = neardup.near_duplicates(d)
    assert out.count() == len(rows)
    groups = sorted((r["component_id"], r["kept"]) for r in out.where("n_shingles > 0 AND component_id IS NOT NULL").collect())
    assert groups == sorted([(1, True), (1, False), (30, True), (30, False), (30, True), (30, False), (32, True), (32, False),
                             (33, True), (33, False), (-5, True), (-5, False), (2**60 + 1, True), (2**60 + 1, False)])
    assert sorted(r["kept"] for r in out.where("n_shingles > 0 AND component_id IS NULL").collect()) == [False, False, True]
    kept = neardup.keep_first_of_group(d)
    assert kept.columns == d.columns
    topics = sorted((str(r["doc_id"]), (r["text"] or "")[:1]) for r in kept.collect())
    assert topics == sorted([("1", "a"), ("30", "b"), ("30", "c"), ("32", "d"), ("33", "e"), ("None", "f"), ("-5", "g"),
                             ("34", ""), ("34", ""), ("None", ""), (str(2**60 + 1), "h")])


def test_near_chain_and_shared_passages(spark):
    """A chain of links whose ends are not similar, beside many texts that share one long passage."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k:8 * k + 100])) for k in range(12)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(100 + k, passage + " " + " ".join(f"u{k}x{j}" for j in range(25 + k % 5))) for k in range(150)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(neardup.near_duplicates(d), *NEAR) == wanted(brute.near(rows))


@pytest.mark.parametrize("group", [2000, 3])
def test_near_crowded_buckets(spark, monkeypatch, group):
    """Compared by sketches, or split by second bands first."""
    monkeypatch.setattr(neardup, "DIRECT", 1)
    monkeypatch.setattr(neardup, "GROUP", group)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"u{k // 2}x{j}" for j in range(40)) + f" end{k}") for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(neardup.near_duplicates(d), *NEAR) == wanted(brute.near(rows))


def test_near_crowded_bucket_gives_links_only(spark, monkeypatch):
    """Sets that share most of a passage, but are no links, leave their bucket's task in no pairs."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(120)]
    rows = [(i, " ".join(passage + [f"x{r.randrange(10 ** 6)}" for _ in range(25)])) for i in range(160)]
    rows += [(1000 + i, t + " end") for i, (_, t) in enumerate(rows[:5])]
    seen, verified = [], neardup._verified

    def counted(pairs, sets, name):
        seen.append(pairs.count())
        return verified(pairs, sets, name)

    monkeypatch.setattr(neardup, "_verified", counted)
    d = spark.createDataFrame([(*x, None, None, 0, "", 0, 0) for x in rows], SCHEMA)
    assert got(neardup.near_duplicates(d), *NEAR) == wanted(brute.near(rows))
    assert sum(seen) < 20 * len(rows)


def test_sketch_estimates_similarity():
    import numpy as np
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 62, 900).astype(np.uint64)
    sets = [np.sort(x[:700]), np.sort(x[200:]), np.sort(x[:3])]
    s = neardup.sketches(sets)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 500 / 900) < 0.1


# ---- 3 ------------------------------------------------------------------------------------

def test_files_query(spark):
    assert got(E.queries()["op3_token_files"](spark, SF), *FILES) == wanted(brute.token_files(given(spark)))


def test_files_awkward(docs, none):
    path = tokenizer("byte_bpe_50k.json")
    assert got(tokenfiles.round_trip(docs, path), *FILES) == wanted(brute.token_files(pairs()))
    assert tokenfiles.round_trip(none, path).count() == 0


def test_grammar_round_trip_and_random_access():
    import numpy as np
    r = np.random.default_rng(5)
    phrase = r.integers(0, 500, 12)
    ids = np.concatenate([np.concatenate([r.integers(0, 500, 5), np.tile(phrase, 9), [2]]) for _ in range(300)]).astype(np.int32)
    counts = np.full(300, 5 + 12 * 9 + 1)
    s = tokenfiles.Shard(tokenfiles.shard_row(0, 0, np.arange(300), np.zeros(300, bool), ids, counts, 50257))
    assert len(s.symbols) < len(ids) / 3
    assert (s.ids() == ids).all()
    assert all((s.document(i) == ids[114 * i:114 * (i + 1)]).all() for i in range(300))
    assert (s.lengths == [len(x) for x in tokenfiles.expansions(s.rules, 50257)]).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    """Copies of one long document shrink to a few symbols, and no frequent pair is left."""
    import numpy as np
    r = np.random.default_rng(6)
    one = r.integers(0, 50000, 1000)
    ids = np.concatenate([np.concatenate([one, [2]]) for _ in range(64)] + [r.integers(0, 300, 200_000), [2]]).astype(np.int32)
    counts = np.array([1001] * 64 + [200_001])
    symbols, rules, ends = tokenfiles.compress(ids, np.cumsum(counts) - 1, 50257)
    assert ends[0] < 12
    inside = np.ones(len(symbols) - 1, bool)
    inside[ends[:-1]] = False
    pairs = np.stack([symbols[:-1], symbols[1:]], axis=1)[inside]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < tokenfiles.LEAST_COUNT
    s = tokenfiles.Shard(tokenfiles.shard_row(0, 0, np.arange(65), np.zeros(65, bool), ids, counts, 50257))
    assert (s.ids() == ids).all() and (s.document(63) == ids[:1001]).all()
    for width in (2, 3, 4):
        x = np.array([0, 1, 65535, (1 << 8 * width) - 1])
        assert (tokenfiles.unpack(tokenfiles.pack(x, width), width) == x).all()


# ---- 4 ------------------------------------------------------------------------------------

def test_licenses(spark, none):
    t = licenses.TEMPLATES
    rows = [(1, "some words before " + t["mit"] + " and after"), (2, None), (3, ""), (4, "Released under the MIT"),
            (5, "x " * 40 + t["mit-permission"].replace("Permission", "Leave") + " y" * 40), (6, "released UNDER the mit license"),
            (7, t["gpl-3.0"] + "\n" + t["cc-by-nc-4.0"]), (7, "nothing at all"), (8, "word " * 3000 + t["bsd"]), (None, t["mit"])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("template", F.lit("clash"))
    out = got(licenses.scan(d, licenses.default_templates(spark)), "doc_id", "licenses")
    assert out == sorted([(1, "mit"), (2, ""), (3, ""), (4, ""), (5, "mit-permission"), (6, "mit"), (7, "cc-by-nc-4.0,gpl-3.0"),
                          (7, ""), (8, "bsd"), (None, "mit")], key=repr)
    assert licenses.scan(none, licenses.default_templates(spark)).count() == 0
    empty = spark.createDataFrame([], "template string, text string")
    assert licenses.scan(d, empty).where("n_licenses > 0").count() == 0


def test_licenses_whole_texts_and_short_notices(spark):
    t = licenses.TEMPLATES
    for name in ("gpl-2.0", "gpl-3.0", "lgpl-3.0", "apache-2.0", "mit", "cc0-1.0", "cc-by-sa-4.0", "unlicense", "bsd-3-clause"):
        assert len(t[f"{name}-text"].split()) > 100
    rows = [(1, "some code\n" + t["mit-text"].replace("<year>", "2020") + "\nmore code"), (2, "word " * 500 + t["lgpl-3.0-text"]),
            (3, "some words. ALL rights, reserved!"), (4, "all rights are reserved"), (5, "All rights"), (6, None), (7, "the Proprietary one")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    more = spark.createDataFrame([("reserved", "All rights reserved."), ("proprietary", "Proprietary"), ("none", " . "), ("null", None)],
                                 "template string, text string")
    out = {r["doc_id"]: r for r in licenses.scan(d, licenses.default_templates(spark).unionByName(more)).collect()}
    assert {i: r["licenses"] for i, r in out.items()} == {
        1: "mit-permission,mit-text", 2: "lgpl-3.0-text", 3: "reserved", 4: "", 5: "", 6: "", 7: "proprietary"}
    assert out[3]["best_containment"] == 1.0


# ---- 5 ------------------------------------------------------------------------------------

def test_substrings_query(spark):
    assert got(E.queries()["op5_substring_dedup"](spark, SF), *CUT) == wanted(brute.substrings(given(spark)))


def test_substrings_awkward(docs, none):
    assert got(substrings.dedup_substrings(docs), *CUT) == wanted(brute.substrings(pairs()))
    assert substrings.dedup_substrings(none).count() == 0


def test_gap_coding():
    import numpy as np
    r = np.random.default_rng(2)
    for most in (5_000, 1 << 21, 1 << 40):
        x = np.unique(r.integers(0, most, 300).astype(np.uint64))
        assert (substrings.unpack_gaps(substrings.pack_gaps(x)) == x).all()


# ---- 6 ------------------------------------------------------------------------------------

def test_urls(spark):
    rules = [*urls.RULES, ("a.b.example.net/en/x/y/", "block"), ("b.example.net/", "allow")]
    pages = [(1, "http://A.Example.NET/en/x"), (2, "https://net/"), (3, "http://net"), (4, None), (5, "no scheme"), (6, "http://xnet/"),
             (7, "http://u.example.com/de/?q=http://z.net/"), (8, "http://q.org/fr/"), (9, "http://q.org/frx/"), (10, "http:///en/"),
             (11, "ftp://z.a.b.example.net/en/x/y/z#f"), (12, "http://b.example.net/en/"), (13, "http://b.example.net/de/"),
             (14, "http://example.net/EN/"), (14, "http://example.net/EN/"), (None, "http://x.net/a/b/c"), (2**60 + 1, "s://" + "a/" * 3000)]
    d = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("keys", F.lit(1)).withColumn("h", F.lit(1))
    r = spark.createDataFrame(rules, "rule string, verdict string")
    want = wanted(brute.urls(pages, rules))
    assert got(urls.judge(d, r), *URL) == want
    assert urls.judge(d.limit(0), r).count() == 0
    assert got(urls.judge(d, r.limit(0)), "rule") == [(None,)] * len(pages)
    with pytest.raises(ValueError):
        urls.judge(d, spark.createDataFrame([("net/x", "block")], "rule string, verdict string"))


def test_urls_too_many_rules_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BYTES", 0)
    pages = given(spark, "pages", ("page_id", "url"))
    out = urls.judge(spark.read.parquet(f"{SF}/pages.parquet"), urls.default_rules(spark))
    assert got(out, *URL) == wanted(brute.urls(pages, urls.RULES))


def test_cascade_is_exact(spark):
    d = spark.range(40_000).select(F.xxhash64("id").alias("h"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.build(d)
    import numpy as np
    rows = d.toPandas()
    assert len(cascade.levels) > 1
    assert (cascade.listed(rows["h"].to_numpy().astype(np.uint64)) == rows["listed"]).all()


# ---- 7 ------------------------------------------------------------------------------------

def test_decontamination_query(spark):
    want = brute.decontaminate(given(spark), given(spark, "benchmark", ("item_id", "text")))
    assert got(E.queries()["op7_benchmark_decontamination"](spark, SF), *MARK) == wanted(want)


def test_decontamination_awkward(spark, docs, none):
    text = dict(pairs())[6]
    items = [(1, text), (2, "a B c"), (3, None), (4, ""), (5, " ".join(text.split()[:12])), (5, "repeated item"), (None, "tab new line"),
             (6, "never seen anywhere else"), (7, "one")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.mark(docs, b).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    assert got(out, *MARK) == wanted(brute.decontaminate(pairs(), items))
    assert decontaminate.mark(none, b).count() == 0
    assert decontaminate.mark(docs, b.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, b)
    clean = sorted(i for i, *_, bad in brute.decontaminate(pairs(), items) if not bad and i is not None)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == clean


# ---- 8 ------------------------------------------------------------------------------------

def check_lm(out, rows):
    want = brute.lm(rows)
    assert got(out, *LM) == wanted([r[:5] for r in want])
    assert sorted(round(r["base_score"], 6) for r in out.collect()) == pytest.approx(sorted(r[5] for r in want), rel=1e-9, abs=1e-5)


def test_rounds_look_again_only_where_a_pair_is_new(monkeypatch):
    """The same rules and symbols as by counting all pairs each round, looking at few of them."""
    import numpy as np
    r = np.random.default_rng(3)
    phrases = [r.integers(0, 300, r.integers(2, 9)) for _ in range(400)]
    ids = np.concatenate([phrases[min(int(k), 399)] for k in r.zipf(1.3, 12000)] + [np.full(500, 7)])
    ends = np.unique(np.append(np.flatnonzero(r.random(len(ids)) < 0.01), len(ids) - 1))
    looked, bincount = [], np.bincount

    def counted(x, *a, **k):
        looked.append(len(x))
        return bincount(x, *a, **k)

    monkeypatch.setattr(np, "bincount", counted)
    seq, rules, last = tokenfiles.compress(ids, ends, 300)
    monkeypatch.undo()
    wanted_, marks, want_rules = ids.astype(np.int64), np.isin(np.arange(len(ids)), ends), []
    while True:
        pairs_ = list(zip(wanted_[:-1].tolist(), wanted_[1:].tolist(), strict=True))
        count = Counter(p for p, m in zip(pairs_, marks, strict=False) if not m)
        top = sorted(sorted(p for p in count if count[p] >= tokenfiles.LEAST_COUNT), key=lambda p: -count[p])[:tokenfiles.RULES_PER_ROUND]
        out, out_marks, k, used = [], [], 0, set()
        chosen = set(top)
        while k < len(wanted_):
            if k < len(pairs_) and not marks[k] and pairs_[k] in chosen:
                used.add(pairs_[k])
                out.append(pairs_[k])
                out_marks.append(bool(marks[k + 1]))
                k += 2
            else:
                out.append(int(wanted_[k]))
                out_marks.append(bool(marks[k]))
                k += 1
        if not top:
            break
        number = {p: 300 + len(want_rules) + j for j, p in enumerate(sorted(used))}
        want_rules += sorted(used)
        wanted_ = np.array([number[x] if isinstance(x, tuple) else x for x in out])
        marks = np.array(out_marks)
    assert seq.tolist() == wanted_.tolist() and [tuple(x) for x in rules.tolist()] == want_rules
    assert last.tolist() == np.flatnonzero(marks).tolist()
    assert sum(looked) < 2 * len(ids)


def test_known_pieces_stay_in_arrow():
    """A task's known pieces never become Python strings, and new ones are encoded once."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    e = tokenfiles.Encoder(tokenizer("byte_bpe_50k.json"))
    plain, handed = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), []
    plain.encode_special_tokens = True
    encode = e.memory.encode
    e.memory.encode = lambda new: (handed.append(new), encode(new))[1]
    texts = ["so, so. so; don't", None, "", " a\x0b b \x0b", "a\u00a0b \u00a0c  d ", "x\n y\tz <|endoftext|> é è,\x00", " \n", "Œuvre 12 345"]
    for again in range(3):
        ids, counts = e.encode(texts)
        want = [plain.encode(t or "", add_special_tokens=False).ids + [tokenfiles.END] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        texts.append(texts[again] or "new")
    assert all(isinstance(new, pa.Array) for new in handed)
    assert [len(new) for new in handed[1:]] == [1]
    small = tokenfiles.Pieces(encode, limit=2)
    for x in (["a", "b", "c"], ["c", " d"], ["a", "c"]):
        at = small.numbers(pa.array(x, pa.large_string()))
        assert small.codes.of(at).tolist() == [i for p in x for i in plain.encode(p, add_special_tokens=False).ids]


def test_rounds_sort_only_frequent_pairs(monkeypatch):
    """Re-Pair counts pairs without sorting them all each round."""
    import numpy as np
    ids, sorted_, lexsort, argsort, unique = np.random.default_rng(1).integers(0, 20, 50_000), [], np.lexsort, np.argsort, np.unique
    monkeypatch.setattr(np, "lexsort", lambda x, *a, **k: (sorted_.append(len(x[0])), lexsort(x, *a, **k))[1])
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (sorted_.append(len(x)), argsort(x, *a, **k))[1])
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (sorted_.append(len(x)), unique(x, *a, **k))[1])
    seq, rules, _ = tokenfiles.compress(ids, np.array([len(ids) - 1]), 20)
    monkeypatch.undo()
    lengths = np.array([len(x) for x in tokenfiles.expansions(rules, 20)])
    assert tokenfiles.expand(seq, rules, lengths, 20).tolist() == ids.tolist()
    assert len(rules) and max(sorted_) <= 10_000


def test_pieces_end_with_a_run_of_letters():
    """A word before different marks is one piece, so it is split and remembered once."""
    import pyarrow as pa
    at, distinct, size = bpe.cut(pa.array(["so, so. so; so! so", ""], pa.large_string()), runs=True)
    assert sorted(distinct) == [" so", "!", ",", ".", ";", "so"]
    assert size.tolist() == [9, 0] and "".join(distinct[k] for k in at) == "so, so. so; so! so"


def test_lm_query(spark):
    out = E.queries()["op8_maxent_scores"](spark, SF).cache()
    check_lm(out, given(spark))
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_awkward(docs, none):
    check_lm(maxent.score(docs, steps=2).cache(), pairs())
    assert maxent.score(none, steps=1).count() == 0


def test_lm_factors_are_distributions(spark):
    import numpy as np
    w = maxent._zero()
    w.previous[:] = np.random.default_rng(1).normal(size=w.previous.shape)
    w.in_class[:] = np.random.default_rng(2).normal(size=w.in_class.shape)
    assert np.allclose(np.exp(w.kinds(np.arange(maxent.CLASSES))).sum(axis=-1), 1)
    assert np.allclose(np.exp(w.members(np.arange(maxent.CLASSES))).sum(axis=-1), 1)


def test_lm_word_features_against_a_dense_model():
    """Gradient steps and sums over whole cells, context by context."""
    import numpy as np
    r, words, rows = np.random.default_rng(4), 14, 500
    cell, count = np.sort(r.integers(0, 3, words)), r.integers(1, 30, words)
    word, one, two, n = r.integers(0, words, rows), r.integers(0, 5, rows), r.integers(0, 5, rows), r.integers(0, 3, rows)
    q = [(count[w] + 0.1) / sum(count[u] + 0.1 for u in range(words) if cell[u] == cell[w]) for w in range(words)]
    seen, total, weight = Counter(), Counter(), Counter()
    events = list(zip(word.tolist(), one.tolist(), two.tolist(), n.tolist(), strict=True))

    def features(w, a, b):
        return (1, a, w), (2, b, w), (a, b, w, 3)

    def share(a, b, c):
        x = {w: q[w] * np.exp(sum(weight[f] for f in features(w, a, b))) for w in range(words) if cell[w] == c}
        return {w: y / sum(x.values()) for w, y in x.items()}

    for w, a, b, k in events:
        total[a, b, cell[w]] += k
        for f in features(w, a, b):
            seen[f] += k
    for _ in range(4):
        wanted = Counter()
        for (a, b, c), k in total.items():
            for w, p in share(a, b, c).items():
                for f in features(w, a, b):
                    wanted[f] += k * p
        for f in seen:
            weight[f] += 2 * (seen[f] - wanted[f]) / (seen[f] + wanted[f] + maxent.EVENT_PRIOR) / 3 if seen[f] else 0
    want = [np.log(share(a, b, cell[w])[w] / q[w]) for w, a, b, _ in events]
    assert maxent.fit(word, one << maxent.CONTEXT_BITS | two, n, count, cell, steps=4) == pytest.approx(want, abs=1e-9)


def test_lm_sees_words_behind_their_classes(spark):
    """Histories of one class, and rivals of one class, member and count: only the words tell them apart."""
    import numpy as np
    import pandas as pd

    def bucket(words):
        t = maxent.Tokens(pd.DataFrame({"text": [" ".join(words).encode()], "doc_id": 1, "no_id": False}))
        return dict(zip(words, t.bucket[:-1].tolist(), strict=True))

    at = bucket([f"{k}xyz" for k in range(200)])
    c, d = next((a, b) for a in at for b in at if a < b and at[a] == at[b])
    train = [k for k in range(1, 400) if not maxent.held_out(k)]
    held = [k for k in range(1, 400) if maxent.held_out(k)][:6]
    rows = [(k, f"oneing {c}" if k % 2 else f"twoing {d}") for k in train] + [(k + 1000, f"thr{k % 9} by {c}" if k % 2 else f"fou{k % 9} by {d}") for k in train]
    asked = [f"oneing {c}", f"oneing {d}", f"twoing {d}", f"twoing {c}"]
    out = maxent.score(spark.createDataFrame(rows + list(zip(held, asked, strict=False)), "doc_id bigint, text string"))
    score = {r["doc_id"]: r["score"] for r in out.collect()}
    assert score[held[0]] > score[held[1]] + 0.1 and score[held[2]] > score[held[3]] + 0.1
    assert np.isfinite(list(score.values())).all()


def test_lm_frequent_words_are_in_cells_dealt_by_history():
    """Every known word asks for its features; a large cell's contexts go whole to one part, in any block (F4)."""
    import numpy as np
    import pandas as pd

    hot, seen = maxent.HOT + 1, {}
    tokens = np.full(maxent.BUCKETS, 3.0 * maxent.CELL_TOKENS)
    for each in (1, 4):
        cells = maxent.Cells(tokens, np.full(maxent.BUCKETS, float(hot)), each)
        units = [cells.unit(np.array([c]), np.array([p]))[0] for c in range(2 * each) for p in range(cells.parts(np.array([c]))[0])]
        assert len(set(units)) == len(units) and cells.parts(np.array([0]))[0] > 1
        for texts in (["the cat of the hat", "of a the cat"], ["a the cat sat of the mat"]):
            t = maxent.Tokens(pd.DataFrame({"text": [x.encode() for x in texts], "doc_id": 1, "no_id": False}))
            x = maxent.Triples(t, np.full(len(t.vocabulary), hot), cells, 64)
            assert np.array_equal(x.token, np.flatnonzero(t.hash != maxent.END))
            assert np.diff(x.triples).sum() == len(x.context) == x.per_word.sum()
            assert (np.repeat(np.arange(64), np.diff(x.words)) == cells.shard(x.unit, 64)).all()
            for h, unit, context in zip(np.repeat(x.hash, x.per_word), np.repeat(x.unit, x.per_word), x.context, strict=True):
                assert seen.setdefault((each, h, context), unit) == unit
    assert len({u for (each, _, _), u in seen.items() if each == 1}) > 5


def test_lm_packed_contexts():
    import numpy as np
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 9, 400):
        word = np.sort(r.integers(0, 5, n))
        context = r.integers(0, 4, n) << maxent.CONTEXT_BITS | r.integers(0, maxent.CONTEXT + 1, n)
        context = context[np.lexsort((context, word))]
        begin = np.unique(word, return_index=True)[1]
        assert np.array_equal(maxent.unpack_contexts(maxent.pack_contexts(context, begin), n), context)


def test_lm_sees_histories_of_frequent_words(spark):
    """Rivals that occur over 2^20 times each, of one class and member: only the word before tells which (F4)."""
    import pandas as pd

    def bucket(words):
        t = maxent.Tokens(pd.DataFrame({"text": [" ".join(words).encode()], "doc_id": 1, "no_id": False}))
        return dict(zip(words, t.bucket[:-1].tolist(), strict=True))

    at = bucket([f"{k}xyz" for k in range(200)])
    c, d = next((a, b) for a in at for b in at if a < b and at[a] == at[b])
    train = [k for k in range(1, 400) if not maxent.held_out(k)]
    held = [k for k in range(1, 400) if maxent.held_out(k)][:4]
    times = 2 * maxent.HOT // len(train) + 20
    rows = [(k, f"oneing {c} " * times if k % 2 else f"twoing {d} " * times) for k in train]
    asked = [f"oneing {c}", f"oneing {d}", f"twoing {d}", f"twoing {c}"]
    out = maxent.score(spark.createDataFrame(rows + list(zip(held, asked, strict=False)), "doc_id bigint, text string"), steps=4)
    score = {r["doc_id"]: r["score"] for r in out.where(F.col("doc_id").isin(held)).collect()}
    assert score[held[0]] > score[held[1]] + 0.5 and score[held[2]] > score[held[3]] + 0.5


# ---- 9 ------------------------------------------------------------------------------------

def test_quality_query(spark):
    assert got(E.queries()["op9_quality_votes"](spark, SF), *QUALITY) == wanted(brute.quality(given(spark)))


def test_quality_awkward(docs, none):
    out = quality.judge(docs)
    assert got(out, *QUALITY) == wanted(brute.quality(pairs()))
    assert out.where("base_failed AND kept").count() == 0
    assert quality.judge(none).count() == 0
    kept = quality.keep_quality(docs.withColumn("__q", F.lit(1)))
    assert kept.columns == [*docs.columns, "__q"]
    assert kept.count() == out.where("kept").count()


def test_quality_follows_labels(spark):
    """Held against the labels, which the rules never see."""
    sf = "/root/testdata/sf0.01"
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.95 and share[0] < 0.15


def test_quality_windows_in_long_repeats(spark):
    r = random.Random(4)
    some = [f"w{r.randrange(60)}" for _ in range(4000)]
    texts = [" ".join(some + some[100:2100]), " ".join(["again"] * 5000), " ".join(some[:8] * 2), " ".join(some[:8])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert got(quality.judge(d), *QUALITY) == wanted(brute.quality(list(enumerate(texts))))


# ---- 10 -----------------------------------------------------------------------------------

PERSONAL = ("card 4111 1111 1111 1111, mail jo.x7@mail.example.com, call +1 (743) 555-3824 or 555-123-4567, born 1987-02-28 and "
            "28/02/1987, from 192.168.0.17, IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, "
            'token = "11acdfb36bb72224148e6160f674b4be45601bff"!')


def test_pii_formats_and_links():
    p = pii.Pseudonyms("k")
    new, found = p.text(PERSONAL)
    assert dict(found) == {"card": 1, "email": 1, "phone": 2, "date": 2, "ip": 1, "iban": 1, "ssn": 1, "secret": 1}
    for value in ("4111 1111", "jo.x7@", "(743) 555-3824", "1987-02-28", "192.168.0.17", "5698", "123-45-6789", "11acdfb"):
        assert value not in new
    again, f2 = p.text(new)
    assert f2 == found and again != new
    assert pii.Pseudonyms("k", undo=True).text(new)[0] == PERSONAL
    assert pii.Pseudonyms("other").text(PERSONAL)[0] != new
    assert p.text("x 4111111111111111 y")[0].split()[1] == "".join(c for c in new[5:24] if c.isdigit())


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("4111 1111 1111 1111 12/25", "card", "4111 1111 1111 1111"), ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"),
    ("2024 4111 1111 1111 1111", "card", "4111 1111 1111 1111"), ("4111-1111-1111-1111-12345", "card", "4111-1111-1111-1111"),
    ("7 378282246310005 99", "card", "378282246310005"), ("BE68 5390 0754 7034 AND", "iban", "BE68 5390 0754 7034"),
    ("AB12 BE68 5390 0754 7034 FROM HOME", "iban", "BE68 5390 0754 7034"), ("at 2020-01-15T10:00:00Z", "date", "2020-01-15"),
    ("on 01/25/2020.", "date", "01/25/2020"), ("to élodie.ü@mail.example.com", "email", "élodie.ü"), ("ж@example.com", "email", "ж")])
def test_pii_beside_other_characters(text, kind, value):
    p = pii.Pseudonyms("k")
    new, found = p.text(text)
    before, after = text.split(value)
    assert dict(found) == {kind: 1} and value not in new and new.startswith(before) and new.endswith(after)
    if kind != "email":
        assert p.text(value)[0] == new[len(before):len(new) - len(after)]
    assert pii.Pseudonyms("k", undo=True).text(new)[0] == text


def test_pii_one_form_of_a_phone_number_and_of_a_date():
    p = pii.Pseudonyms("k")

    def plain(text):
        return "".join(c for c in p.text(text)[0] if c.isdigit())

    forms = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1555 123 4567", "+1-555-123-4567"]
    assert len({plain(f) for f in forms}) == 1 and plain(forms[0])[1:] == plain("(555) 123-4567")
    assert plain("+442071234567") == plain("+44 20 7123 4567")
    undo = pii.Pseudonyms("k", undo=True)
    for k in range(1, 28):
        for text in (f"02/{k:02d}/2021", f"{k:02d}/02/2021", f"2021-02-{k:02d}", f"{k:02d}.02.2021", f"02.{k:02d}.2021"):
            new, found = p.text(text)
            assert found["date"] == 1 and new != text and undo.text(new)[0] == text
    y, m, d = p.text("2021-02-25")[0].split("-")
    assert p.text("02/25/2021")[0] == f"{m}/{d}/{y}" and p.text("25/02/2021")[0] == f"{d}/{m}/{y}"


def test_pii_leaves_the_rest():
    text = "1234567890123456, 999.1.1.1, 31/02/2000, 000-12-3456, 12 eggs, version 2.0, a@b, price 1,299.00 in 2021"
    assert pii.Pseudonyms().text(text) == (text, {})


def test_permutation_is_a_derangement():
    for n in (2, 3, 10, 97, 1000):
        p = pii.Permutation("k", "t", n)
        image = [p.apply(x) for x in range(n)]
        assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))
        assert [p.undo(y) for y in image] == list(range(n))


def test_pii_frames(spark, docs, none):
    out = pii.pseudonymise(docs)
    assert out.columns == docs.columns
    assert got(out, *docs.columns) == got(docs, *docs.columns)
    d = spark.createDataFrame([(1, PERSONAL), (2, PERSONAL), (3, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in pii.report(d).collect()}
    assert rows[1]["text"] == rows[2]["text"] != PERSONAL and rows[1]["n_replaced"] == 10 and rows[3]["text"] is None
    assert pii.report(none).count() == 0
    assert got(pii.pseudonymise(pii.pseudonymise(d), undo=True), "doc_id", "text") == got(d, "doc_id", "text")


def test_pii_query_whole_table(spark):
    p = pii.Pseudonyms()
    rows = E.queries()["op10_pii_pseudonyms"](spark, SF).collect()
    texts = dict(given(spark))
    assert len(rows) == len(texts)
    for r in rows:
        new, found = p.text(texts[r["doc_id"]])
        assert (r["text"], r["n_replaced"], r["text_sha256"]) == (new, sum(found.values()), brute.sha(new))


def test_coded_pieces_are_small(monkeypatch):
    """A worker that waits beside the JVM holds no Python objects for each piece it remembers."""
    import public_tokenizers
    import pyarrow as pa
    c = bpe.Codec(tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "BATCH_PIECES", 700)
    pieces = [f" word{k}é" for k in range(2000)] + ["\x00", "  "]
    out = c.coded(pa.array(pieces, pa.large_string()))
    assert out["piece"].to_pylist() == pieces and [x.decode() for x in out["decoded"].to_pylist()] == pieces
    assert out["n"].to_pylist() == [len(x.split()) for x in out["ids"].to_pylist()]
    assert isinstance(c.new, pa.Table) and len(c.new) == 2002 and c.new.nbytes < 100 * len(c.new)


def test_pieces_are_slices_of_the_texts(monkeypatch):
    """Rows that are cut on the texts' bytes and those that :func:`pieces` cuts, of short and long pieces."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from tabtaint.llm import codes
    texts = [None, "", " ", "a", " so, so.\nSo; éé, über-abcdefgh abcdefgh abcdefg a\x00", "a  b, c\t d ", "seven77 seven77\x00",
             "seven77", "seven77 ", "1,2 c.d", "zz zz.zz", " , x!"]
    for runs in (False, True):
        at, distinct, size = codes.numbered_pieces(pa.array(texts).slice(1, 10), runs)
        own = [[distinct[int(k)].as_py() for k in x] for x in np.split(at, np.cumsum(size)[:-1])]
        assert len(set(distinct.to_pylist())) == len(distinct) and "" not in distinct.to_pylist()
        for text, got_ in zip(texts[1:11], own, strict=True):
            some = [y for x in codes.pieces(text) for y in (codes._RUN_END.split(x) if runs else [x])]
            assert got_ == [x for x in some if x]
    monkeypatch.setattr(pc, "replace_substring_regex", None)  # no text is copied with marks in it
    monkeypatch.setattr(pc, "split_pattern", None)
    assert codes.numbered_pieces(pa.array(["a b.", None]), True)[2].tolist() == [3, 0]


def test_known_pieces_are_found_without_an_index_of_all(monkeypatch):
    """Also when pieces share a hash, and after the memory was cleared."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from tabtaint.llm import codes
    asked = []

    def encode(new):
        asked.append(new.to_pylist())
        return np.array([len(x) for x in asked[-1]], np.int32), np.ones(len(new), np.int64)

    monkeypatch.setattr(pc, "index_in", None)
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(codes, "word_hashes", lambda data, a, b: (b - a).astype(np.uint64) // np.uint64(2))
        memory = codes.Pieces(encode, limit=12)
        for some in (["a", "bb", "ccc"], ["bb", "d" * 9, "a"], [], ["ccc", "e" * 5], [str(k) * 3 for k in range(9)], ["bb", "a"]):
            at = memory.numbers(pa.array(some, pa.large_string()))
            assert memory.codes.of(at).tolist() == [len(x) for x in some]
            assert memory.known.take(pa.array(at)).to_pylist() == some
            assert (np.diff(memory.hashes.astype(np.int64)) >= 0).all() or not collide
        if not collide:
            assert [len(x) for x in asked] == [3, 1, 1, 9, 2]
