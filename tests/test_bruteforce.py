"""(d) brute-force numpy / pandas checks for kNN, LOF, FD and the forest on small inputs."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from tabtaint.operators import fd as FD
from tabtaint.operators import iforest as IF
from tabtaint.operators import neighbors as NB
from tabtaint.plans.tables import keyed, load


def _emb(spark):
    return load(spark, SF001, "embeddings").select(F.col("vec_id").cast("string").alias("row_key"),
                                                   F.col("embedding").cast("array<double>").alias("_f"))


def test_knn_blocks_equal_single_block(spark):
    e = _emb(spark).where("CAST(row_key AS INT) < 200")
    one = NB.knn(e, e, 5, exclude_self=True).select("qkey", "nkey", "rank")
    many = NB.knn(e, e, 5, exclude_self=True, max_block_bytes=64 * 65 * 8 // 8 * 3).select("qkey", "nkey", "rank")
    assert one.count() == 200 * 5
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_knn_matches_numpy(spark):
    e = _emb(spark).where("CAST(row_key AS INT) < 120")
    rows = e.collect()
    keys = np.array([r[0] for r in rows], dtype=object)
    X = np.array([r[1] for r in rows])
    got = {(r["qkey"], r["rank"]): r["nkey"] for r in NB.knn(e, e, 3, exclude_self=True).collect()}
    for i in range(len(keys)):
        d = np.sqrt(((X - X[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        order = sorted(range(len(keys)), key=lambda j: (d[j], keys[j]))[:3]
        for r, j in enumerate(order, 1):
            assert got[(keys[i], r)] == keys[j]


def test_lof_uniform_grid_is_one(spark):
    pts = [(f"{i}-{j}", float(i), float(j)) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(pts, "row_key string, x double, y double")
    out = NB.lof(df, ["x", "y"], [], k=4).where("row_key = '6-6'").first()
    assert abs(out["lof"] - 1.0) < 1e-6


def test_fd_matches_pandas(spark):
    df = load(spark, SF001, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    pdf = df.toPandas()
    cols = list(pdf.columns)
    found = set(FD.discover(df, cols, max_lhs=2))

    def holds(X, A):
        if not X:
            return pdf[A].nunique(dropna=False) <= 1
        return pdf.groupby(list(X), dropna=False)[A].nunique(dropna=False).max() <= 1
    brute = set()
    for level in range(0, 3):
        for X in combinations(cols, level):
            for A in cols:
                if A in X or not holds(X, A):
                    continue
                if any(holds(Y, A) for k in range(level) for Y in combinations(X, k)):
                    continue
                brute.add((X, A))
    assert found == brute


def test_iforest_flags_planted_outlier(spark):
    ev = keyed(spark, SF001, "events").select("row_key", "value", "user_id")
    planted = spark.createDataFrame([("planted", 1e6, 10 ** 6)], "row_key string, value double, user_id long")
    df = ev.unionByName(planted)
    out = IF.isolation_forest(df, ["value", "user_id"], [], 50, 128, seed=3)
    # a point beyond the training range follows the extreme branch of every tree: it must be
    # flagged and rank among the top 1% of scores (points at the range edge isolate as fast)
    p = out.where("row_key = 'planted'").first()
    q99 = out.approxQuantile("score", [0.99], 0.0)[0]
    assert p["is_outlier"] and p["score"] >= q99
