"""Boosted stumps against a plain version over the same bins."""

import math
import random

from pyspark.sql import functions as F

from tabtaint.operators import boost


def plain(bins, y, sizes, n_numeric, rounds):
    w, out = [1.0] * len(y), []
    for _ in range(rounds):
        best, total = None, sum(w)
        for c, size in enumerate(sizes):
            for s in range(size - 1):
                side = [b[c] <= s if c < n_numeric else b[c] == s for b in bins]
                weight = {(k, v): sum(x for x, t, z in zip(w, side, y) if t == k and z == v) for k in (True, False) for v in (0, 1)}
                yes, no = (float(weight[k, 1] > weight[k, 0]) for k in (True, False))
                e = sum(min(weight[k, 0], weight[k, 1]) for k in (True, False)) / total
                if best is None or round(e, 10) < round(best[0], 10):
                    best = (e, c, s, yes, no, side)
        e, c, s, yes, no, side = best
        if e >= 0.5:
            break
        alpha = math.log((1 - e) / e) if e > 0 else 1.0
        out.append((c, s, yes, no, round(e, 9), round(alpha, 9)))
        if e <= 0:
            break
        w = [x * math.exp(alpha) if (yes if t else no) != z else x for x, t, z in zip(w, side, y)]
    return out


def table(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, k = r.choice([None, r.gauss(0, 1), float("nan"), float(r.randint(0, 3))]), r.choice(["a", "b", None, "c"])
        rows.append((x, k, float((x or 0) > 0.5) if r.random() < 0.8 else float(k == "a")))
    return rows


def test_stumps_against_plain(spark):
    df = spark.createDataFrame(table(400, 1), "x double, k string, label double").repartition(3)
    binned, stumps = boost.fit(df, ["x"], ["k"], 6)
    rows = df.select(binned.column().alias("bins"), "label").collect()
    want = plain([r["bins"] for r in rows], [r["label"] for r in rows], binned.sizes, 1, 6)
    assert [(s.column, s.split, s.yes, s.no, round(s.error, 9), round(s.alpha, 9)) for s in stumps] == want
    out = boost.predict(df, binned, stumps).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert out > 0.75


def test_edges(spark):
    sure = spark.createDataFrame([(float(i), "a", float(i > 5)) for i in range(10)], "x double, k string, label double")
    binned, stumps = boost.fit(sure, ["x"], ["k"], 5)
    assert len(stumps) == 1 and stumps[0].error == 0.0 and stumps[0].alpha == 1.0
    assert boost.predict(sure, binned, stumps).where("prediction <> label").count() == 0
    unseen = spark.createDataFrame([(99.0, "zz"), (None, None)], "x double, k string")
    assert [r["prediction"] for r in boost.predict(unseen, binned, stumps).collect()] == [1.0, 0.0]
    none, no_stumps = boost.fit(sure.limit(0), ["x"], ["k"], 5)
    assert boost.predict(sure, none, [s for s in no_stumps if s.alpha]).where("prediction > 0").count() == 0
