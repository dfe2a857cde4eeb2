"""Radix selection, largest remainders, folded bin counts and the interval join against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tabtaint.operators import bayes as BN
from tabtaint.operators import generate as G
from tabtaint.operators import intervals as IV
from tabtaint.operators import sampling as SA
from tabtaint.operators import split as SP


def digest(seed, tag, key):
    return hashlib.md5(f"{seed}:{tag}:{key}".encode()).hexdigest()


def test_thresholds_of_many_groups(spark, monkeypatch):
    """A hot group that takes several rounds, many small ones, a null one, quotas of none and all."""
    monkeypatch.setattr(SA, "_SMALL", 5)
    monkeypatch.setattr(SA, "_width", lambda n: 1)
    r = random.Random(1)
    rows = [(f"k{i}", None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{r.randrange(60)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, g string").repartition(4)
    h = SA.hash_hex(7, "t", "key")
    sizes = SA.group_sizes(df, F.col("g"))
    base = df.select(SA._group_text(F.col("g")).alias("_g"), h.alias("_h"))
    quotas = sizes.withColumn("_k", F.expr("CASE WHEN _g = 'vg1' THEN 0 WHEN _g = 'vg2' THEN _n + 5 ELSE (_n + 2) div 3 END"))
    got = {x["_g"]: x["_t"] for x in SA.threshold_table(base, quotas).collect()}
    groups = {}
    for k, g in rows:
        groups.setdefault("n" if g is None else "v" + g, []).append(digest(7, "t", k))
    assert set(got) == set(groups)
    for g, hs in groups.items():
        k = 0 if g == "vg1" else len(hs) if g == "vg2" else (len(hs) + 2) // 3
        assert sum(x <= got[g] for x in hs) == k, g


def test_split_of_very_many_classes(spark):
    """More classes than the old limit of 100,000, each of two rows."""
    n = 100_500
    df = spark.range(2 * n).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % n).alias("label"))
    out = SP.stratified_split(df, "row_key", "label", 0.25, seed=3)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": n // 2, "train": 2 * n - n // 2}
    assert out.where("split = 'test'").groupBy("label").count().where("count > 1").count() == 0


def test_shares_are_largest_remainders(spark):
    r = random.Random(2)
    counts = {f"c{i}": r.randint(1, 40) for i in range(90)} | {None: 7}
    df = spark.createDataFrame([(g,) for g, n in counts.items() for _ in range(n)], "g string")
    n = sum(counts.values())
    for total in (0, 1, n // 3, n // 2 + 1, n):
        rows = SP.shares(SA.group_sizes(df, F.col("g")), n, [total]).collect()
        want = SP.largest_remainder({g: c for g, c in counts.items() if g is not None} | {None: 7}, total)
        assert sum(x["_q0"] for x in rows) == total
        got = {None if x["_g"] == "n" else x["_g"][1:]: x["_q0"] for x in rows}
        assert sorted(got.values()) == sorted(want.values())
        assert all(abs(got[g] - total * c / n) < 1 for g, c in counts.items())


def most_bins(values, most=10):
    lo, hi = min(values), max(values)
    for nb in range(most, 1, -1):
        bins = {}
        for v in values:
            b = 0 if hi == lo or v <= lo else min(max(math.ceil((v - lo) / ((hi - lo) / nb)) - 1, 0), nb - 1)
            bins[b] = bins.get(b, 0) + 1
        if min(bins.values()) >= 2:
            return nb
    return None


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_folded(spark, seed):
    r = random.Random(seed)
    values = [[float(r.randint(0, 20)) for _ in range(60)], [r.gauss(0, 1) for _ in range(40)],
              [r.choice([0.0, 0.1, 0.2, 0.3, 0.7, 1.0]) for _ in range(30)], [5.0, 5.0, 5.0]][seed]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert SP.choose_bin_count(df, "x")[0] == most_bins(values)


def test_interval_join(spark):
    """Intervals of any length, each position in one of them or none."""
    r, rows, points, top = random.Random(4), [], [], 0
    for g in ("a", "b"):
        at = 0
        for i in range(120):
            at += r.choice([0, 0, 3])
            end = at + r.choice([1, 1, 2, 17, 300, 5000])
            rows.append((g, i, at, end))
            at = end
        top = max(top, at)
        points += [(g, p) for p in r.sample(range(at + 10), 800)]
    df = spark.createDataFrame(rows, "g string, i int, _lo bigint, _hi bigint")
    got = {tuple(x) for x in IV.join_intervals(spark.createDataFrame(points, "g string, _pos bigint"), df, ["g"], top + 10)
           .select("g", "_pos", "i").collect()}
    assert got == {(g, p, i) for g, p in points for h, i, lo, hi in rows if g == h and lo <= p < hi}


def test_along_in_parts(spark, monkeypatch):
    monkeypatch.setattr(IV, "WINDOW_VALUES", 3)
    rows = [(g, f"v{i}" if i else None, i % 5 + 1) for g in ("a", "b") for i in range(200)]
    out = IV.along(spark.createDataFrame(rows, "g string, v string, w int"), ["g"], "v", "w", 5, "t").collect()
    for g in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: digest(5, "t", "∅" if r[1] is None else r[1]))
        at, want = 0, {}
        for _, v, w in mine:
            want[v] = (at, at + w)
            at += w
        assert {r["v"]: (r["_lo"], r["_hi"]) for r in out if r["g"] == g} == want


def test_generators_keep_nulls_and_types(spark):
    rows = [(f"k{i}", None if i % 4 == 0 else i / 8, i % 3 if i % 5 else None, "a" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "row_key string, x double, k int, label string")
    m = G.marginal(df, ["x", "k"], 2000, 1)
    assert m.count() == 2000 and m.dtypes == [("draw_id", "bigint"), ("x", "double"), ("k", "int")]
    assert 350 < m.where("x IS NULL").count() < 650
    c = G.per_class(df, ["x", "k"], "label", 100, 1)
    assert {r["label"]: r["count"] for r in c.groupBy("label").count().collect()} == {"a": 100}   # no label, no class
    assert {r["x"] for r in c.collect()} <= {r[1] for r in rows if r[3] == "a"}
    assert G.marginal(df.limit(0), ["x"], 10, 1).count() == 0 and G.per_class(df.limit(0), ["x"], "label", 10, 1).count() == 0


def test_network_follows_the_data(spark):
    """A child that is a function of two parents is found by a network of degree two, and kept with little noise."""
    rows = [(i % 2, i // 2 % 2, (i + i // 2) % 2) for i in range(40_000)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert BN.degree(40_000, 3, 1.0) == 2
    out = BN.privbayes(df, [], ["a", "b", "c"], 500, 3, epsilon=50.0)
    assert out.count() == 500
    assert out.where("(CAST(a AS INT) + CAST(b AS INT)) % 2 <> CAST(c AS INT)").count() < 25
    d, _ = BN.discretise(df, [], ["a", "b", "c"])
    one, two = BN.information(d, [(("a",), "c"), (("a", "b"), "c")])
    assert abs(one) < 1e-9 and abs(two - math.log(2)) < 1e-9


def test_noise_covers_the_domain(spark):
    rows = [("x", "u")] * 500 + [("y", "v")] * 500
    d = spark.createDataFrame(rows, "a string, b string")
    t = BN.noisy_tables(d, [((), "a"), (("a",), "b")], 1, 0.5).collect()
    cells = {(r["s"], r["a"], r["b"]): r["w"] for r in t}
    assert abs(cells[1, "1:x", "u"] / BN.WEIGHT_PARTS - 500) < 10 and {k[2] for k in cells if k[0] == 0} == {"x", "y"}
