"""URL filters (operator 6): exact membership by a cascade of Bloom filters, without joins.

A rule is a host and a path that ends in ``/``.  The keys of a URL are its host's suffixes times
its path's prefixes, in the shapes (labels, slashes) that rules have.  Over the corpus's complete
universe of keys, level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets pass,
level 3 the listed ones that level 2 lets pass, and so on until none is left; a key is listed if the
first level that rejects it is an even one, or if it passes all levels and their number is odd.  So
every key of the corpus is decided exactly.  There is one cascade for the rules that block and one
for those that allow, and a URL's longest listed key is its rule.

The filters are broadcast only within ``MOST_BYTES``; a larger list is joined with the keys instead.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the default
verdict, as does a URL without a path; repeated rows are judged row by row; rules listed twice with
different verdicts are an error; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.llm.common import lower_ascii, ready, stored
from tabtaint.llm.text import U64, mixed

BITS_PER_KEY, PROBES = 10, 5
MOST_BYTES = 64 << 20
SLICE = 1 << 16
MOST_SHAPES = 1024

#: The rules of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    def part(i: int) -> Column:
        return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\A.*?://([^/?#]*)([^?#]*)", i)

    return lower_ascii(part(1)), part(2)


def keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's keys in the given shapes, as an array without nulls."""
    labels = F.size(F.split(host, "\\."))
    slashes = F.length(path) - F.length(F.translate(path, "/", ""))
    each = [F.when((labels >= k) & (slashes >= s) & (host != ""),
                   F.concat(F.substring_index(host, ".", -k), F.substring_index(path, "/", s), F.lit("/")))
            for k, s in shapes]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    host = F.substring_index("rule", "/", 1)
    rows = rules.select(F.size(F.split(host, "\\.")).alias("k"),
                        (F.length("rule") - F.length(F.translate("rule", "/", ""))).alias("s"),
                        F.col("rule").rlike("(?s)\\A[^/]+/(.*/)?\\z").alias("good")).distinct().limit(MOST_SHAPES + 1).collect()
    if not all(r["good"] for r in rows):
        raise ValueError("a rule is a host and a path that ends in '/'")
    if len(rows) > MOST_SHAPES:
        raise ValueError(f"rules have more than {MOST_SHAPES} shapes")
    return sorted((r["k"], r["s"]) for r in rows)


# ---- filters ------------------------------------------------------------------------------

def key_hashes(texts) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))


def probes(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit numbers of each hash in a level's filter: one row a key."""
    a, b = mixed(h, 2 * level), mixed(h, 2 * level + 1) | U64(1)
    return (a[:, None] + np.arange(PROBES, dtype=U64) * b[:, None]) % U64(bits)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[np.ndarray, ...]

    def passes(self, h: np.ndarray, level: int) -> np.ndarray:
        return passes(self.levels[level], h, level)

    def listed(self, h: np.ndarray) -> np.ndarray:
        out, undecided = np.zeros(len(h), bool), np.arange(len(h))
        for i in range(len(self.levels)):
            ok = self.passes(h[undecided], i)
            out[undecided[~ok]] = i % 2 == 1
            undecided = undecided[ok]
        out[undecided] = len(self.levels) % 2 == 1
        return out


def passes(bits: np.ndarray, h: np.ndarray, level: int) -> np.ndarray:
    at = probes(h, level, 8 * len(bits))
    return ((bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1).all(axis=1)


def _filter_of(members: DataFrame, n: int, level: int) -> np.ndarray:
    """The level's bits, set in slices by every task and merged by slice."""
    size = max(64, math.ceil(n * BITS_PER_KEY / 8))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = probes(b["h"].to_numpy(np.int64).astype(U64), level, 8 * size).ravel()
            np.bitwise_or.at(bits, (at >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8))
        part = [(k, bits[k * SLICE:(k + 1) * SLICE]) for k in range(math.ceil(size / SLICE))]
        yield pd.DataFrame([(k, x.tobytes()) for k, x in part if x.any()], columns=["slice", "bits"])

    def merge(d: pd.DataFrame) -> pd.DataFrame:
        x = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in d["bits"]])
        return pd.DataFrame({"slice": [int(d["slice"].iloc[0])], "bits": [x.tobytes()]})

    rows = members.mapInPandas(set_bits, "slice int, bits binary").groupBy("slice") \
        .applyInPandas(merge, "slice int, bits binary").collect()
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r["slice"] * SLICE:r["slice"] * SLICE + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def build(universe: DataFrame) -> Cascade | None:
    """Cascade of a universe (``h`` bigint, ``listed`` boolean); None if it would exceed ``MOST_BYTES``."""
    levels: list[np.ndarray] = []
    members, others = universe.where("listed").select("h"), universe.where("NOT listed").select("h")
    while True:
        n = members.count()
        if n * BITS_PER_KEY / 8 + sum(map(len, levels)) > MOST_BYTES:
            return None
        if n == 0 and levels:
            return Cascade(tuple(levels))
        if len(levels) > 60:
            raise ValueError("two keys share a hash; the cascade can't tell them apart")
        level, bits = len(levels), _filter_of(members, n, len(levels))
        levels.append(bits)

        def wrong(batches: Iterator[pd.DataFrame], bits=bits, level=level) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[passes(bits, b["h"].to_numpy(np.int64).astype(U64), level)]

        members, others = stored(others.mapInPandas(wrong, "h bigint"), "cascade-level"), members


def universe(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """All keys of the corpus: ``h, verdict`` (null: not listed)."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": key_hashes(list(b["key"])).astype(np.int64), "verdict": b["verdict"]})

    corpus = urls.select(F.explode("keys").alias("key")).distinct().withColumn("verdict", F.lit(None).cast("string"))
    both = corpus.withColumn("seen", F.lit(1)).unionByName(
        rules.select(F.col("rule").alias("key"), "verdict").distinct().withColumn("seen", F.lit(0)))
    one = both.groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("seen").alias("seen")).where("seen = 1")
    return stored(one.select("key", "verdict").mapInPandas(hashed, "h bigint, verdict string"), "url-keys")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each URL's longest rule by a join of its keys, for lists that are too large to broadcast."""
    u = urls.withColumn("row", F.monotonically_increasing_id())
    u = stored(u, "urls")
    best = u.select("row", F.explode("keys").alias("rule")).join(rules, "rule").groupBy("row").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return u.join(best, "row", "left").select("page_id", "no_id", "host", "path", F.col("best.rule").alias("rule"),
                                              F.col("best.verdict").alias("ruled"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``."""
    ready(pages)
    rules = rules.select("rule", "verdict").distinct()
    if rules.groupBy("rule").count().where("count > 1").limit(1).collect():
        raise ValueError("a rule is listed with both verdicts")
    host, path = host_and_path(F.col("url"))
    ids = [F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("no_id")]
    urls = pages.select(*ids, host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", keys(F.col("host"), F.col("path"), shapes_of(rules)))
    known = universe(urls, rules)
    made = {v: build(known.select("h", (F.coalesce("verdict", F.lit("")) == v).alias("listed"))) for v in ("block", "allow")}
    if any(c is None for c in made.values()):
        out = _by_join(urls, rules)
    else:
        shared = pages.sparkSession.sparkContext.broadcast(made)

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                flat = [k for ks in b["keys"] for k in ks]
                h = key_hashes(flat)
                verdicts = {v: c.listed(h) for v, c in shared.value.items()}
                rule, ruled, i = [], [], 0
                for ks in b["keys"]:
                    best, verdict = None, None
                    for k in ks:
                        for v, found in verdicts.items():
                            if found[i] and (best is None or (len(k), k) > (len(best), best)):
                                best, verdict = k, v
                        i += 1
                    rule.append(best)
                    ruled.append(verdict)
                yield pd.DataFrame({"page_id": b["page_id"], "no_id": b["no_id"], "host": b["host"], "path": b["path"],
                                    "rule": rule, "ruled": ruled})

        out = urls.mapInPandas(look_up, "page_id bigint, no_id boolean, host string, path string, rule string, ruled string")
    return out.select(F.when(~F.col("no_id"), F.col("page_id")).alias("page_id"), "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
