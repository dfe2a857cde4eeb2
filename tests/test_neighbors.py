"""Pivot cells against all pairs: ties, copies, missing values, one hot group, small tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabtaint.operators import neighbors as NB

SF = "/root/testdata/sf0.01"


def rows(n, seed, categories=("a", "b", None)):
    r, out = random.Random(seed), []
    for i in range(n):
        x = r.choice([0.0, 0.0, r.gauss(0, 1), r.gauss(50, 10), float(round(r.gauss(0, 3))), None])
        out.append((f"k{i}", x, r.choice([1.0, 1.0, r.random(), None]), r.choice(categories)))
    return out


def plain(x, y, metric):
    out = []
    for a, b in zip(x[1:3], y[1:3]):
        if metric == "euclidean":
            out.append((a - b) ** 2)
        else:
            out.append(0.0 if a is None and b is None else 1.0 if a is None or b is None else min(abs(a - b), 1.0))
    a, b = x[3], y[3]
    if metric == "euclidean":
        out.append(0.0 if a == b else 1.0 if a is None or b is None else 2.0)
        return sum(out) ** 0.5
    return (sum(out) + (a != b)) / 3


def expected(query, ref, k, metric, exclude_self):
    out = set()
    for x in query:
        near = sorted((round(plain(x, y, metric), 9), y[0]) for y in ref if not (exclude_self and x[0] == y[0]))[:k]
        out |= {(x[0], name, d, i) for i, (d, name) in enumerate(near, 1)}
    return out


def frame(spark, data, metric):
    df = spark.createDataFrame(data, "row_key string, x double, y double, c string").repartition(3)
    if metric == "euclidean":
        df = df.fillna(0.0, ["x", "y"])
    return NB.plain_features(df, ["x", "y"], ["c"])


@pytest.mark.parametrize("metric", ["euclidean", "mixed"])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_against_all_pairs(spark, metric, exclude_self):
    ref = rows(400, 1)
    query = ref if exclude_self else rows(150, 2)
    clean = (lambda d: [(a, x or 0.0, y or 0.0, c) for a, x, y, c in d]) if metric == "euclidean" else (lambda d: d)
    out = NB.knn(frame(spark, query, metric), frame(spark, ref, metric), 5, metric=metric, kinds=[0, 0], exclude_self=exclude_self,
                 categories="_c", max_block_bytes=3000)
    got = {(r["qkey"], r["nkey"], round(r["dist"], 9), r["rank"]) for r in out.collect()}
    assert got == expected(clean(query), clean(ref), 5, metric, exclude_self)


def test_hot_point_and_few_rows(spark):
    """A third of the rows are one point; more neighbours are asked for than there are rows."""
    ref = [(f"a{i:04}", 1.0, 1.0, "z") for i in range(300)] + rows(200, 3, ("z",))
    ref = [(a, x or 0.0, y or 0.0, c) for a, x, y, c in ref]
    f = frame(spark, ref, "euclidean")
    out = NB.knn(f, f, 3, exclude_self=True, categories="_c")
    assert {(r["qkey"], r["nkey"], round(r["dist"], 9), r["rank"]) for r in out.collect()} == expected(ref, ref, 3, "euclidean", True)
    few = f.limit(4)
    assert NB.knn(few, few, 10, exclude_self=True).count() == 12
    assert NB.knn(few, few.limit(0), 10).count() == 0 and NB.knn(few.limit(0), few, 10).count() == 0


def test_candidates_are_few(spark):
    """Of the reference rows, a query row meets less than a tenth."""
    for table, key, num, cat in (("customer", "c_custkey", "c_acctbal", "c_nationkey"), ("orders", "o_orderkey", "o_totalprice", "o_orderpriority")):
        seen: dict = {}
        df = spark.read.parquet(f"{SF}/{table}.parquet").withColumn("row_key", F.col(key).cast("string"))
        NB.lof(df, [num], [cat], 20, report=seen).count()
        assert seen["candidates_per_row"] < seen["reference_rows"] / 10, (table, seen)


def test_nearest_takes_the_first_of_equals():
    d = np.array([[3.0, 1, 1, 1, np.inf], [2, 2, 2, 2, 2], [np.inf] * 5])
    i, j = NB.nearest(d, 2)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 1)]


def test_search_within_a_task_meets_few_rows(monkeypatch):
    """Rows of a task have cells of their own: distances computed grow far slower than rows times visitors (F3, F5, F6)."""
    r = np.random.default_rng(1)
    n = 4000
    points = NB.Points(r.uniform(0, 1e5, (n, 1)), [np.array(["a", "b", None], object)[r.integers(0, 3, n)]])
    names = np.array([f"{i:05}" for i in range(n)], object)
    made, plainly = [], NB._coded_distances
    monkeypatch.setattr(NB, "_coded_distances", lambda a, b, *x: made.append(len(a) * len(b)) or plainly(a, b, *x))
    i, j, d = NB._local(points, names, np.full(n, np.inf), points, names, 5, True, "euclidean", None)
    assert sum(made) < n * n / 5
    all_pairs = NB.distances(points, points, "euclidean")
    np.fill_diagonal(all_pairs, np.inf)
    x, y = NB.nearest(all_pairs, 5)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(x.tolist(), y.tolist()))


def test_visits_go_to_groups_of_cells():
    """Small cells travel together, so a visitor of many cells is sent to few tasks (F2)."""
    p = NB.Points(np.arange(100.0)[:, None], [])
    cells = NB.Cells(p, "euclidean", None, NB.distances(p, p, "euclidean"), np.full(100, 50))
    cells.deal(1000)
    assert len(set(cells.groups.tolist())) == 5


def test_repeated_and_null_keys_in_a_task():
    """Rows that share the visitor's key aren't its neighbours, however many there are."""
    r = np.random.default_rng(2)
    n = 300
    points = NB.Points(r.normal(0, 1, (n, 1)).repeat(3, axis=0), [])
    names = np.array([None if i % 7 == 0 else f"{i:04}" for i in range(n)], object).repeat(3)
    i, j, d = NB._local(points, names, np.full(len(names), np.inf), points, names, 4, True, "euclidean", None)
    plain = NB.distances(points, points, "euclidean")
    plain[names[:, None] == names[None, :]] = np.inf
    x, y = NB.nearest(plain, 4)
    assert sorted(zip(i.tolist(), d.tolist())) == sorted(zip(x.tolist(), plain[x, y].tolist()))


@pytest.mark.parametrize("exclude_self", [True, False])
def test_many_columns_by_matrix_products(monkeypatch, exclude_self):
    """Far from 0, with ties, copies, repeated keys and categories: the same as all pairs, with few pairs compared one by one (F2)."""
    monkeypatch.setattr(NB, "_DENSE_ROWS", 70)
    r = np.random.default_rng(6)
    n = 600
    numbers = np.concatenate([r.normal(1e4, 1, (n // 3, 12)), r.integers(0, 2, (n // 3, 12)).astype(float)])
    points = NB.Points(np.concatenate([numbers, numbers[::2]]), [np.array(["a", "b", None], object)[r.integers(0, 3, n)]])
    names = np.array([None if i % 50 == 0 else f"{i % 590:04}" for i in range(n)], object)
    made, plainly = [], NB._pair_distances
    monkeypatch.setattr(NB, "_pair_distances", lambda q, i, s, j: made.append(len(i)) or plainly(q, i, s, j))
    bound = np.where(np.arange(n) % 3 == 0, 2.5, np.inf)
    i, j, d = NB._local(points, names, bound, points, names, 5, exclude_self, "euclidean", None)
    every = NB.distances(points, points, "euclidean")
    if exclude_self:
        every[names[:, None] == names[None, :]] = np.inf
    x, y = NB.nearest(every, 5)
    far = every[x, y] > bound[x]
    want = set(zip(x[~far].tolist(), y[~far].tolist(), every[x, y][~far].tolist()))
    got = set(zip(i.tolist(), j.tolist(), d.tolist()))
    assert want <= got and all(every[a, b] > bound[a] for a, b, _ in got - want) and sum(made) < n * n / 2


@pytest.mark.parametrize("copies", [1, 30])
def test_lof_of_points_in_many_units(spark, monkeypatch, copies):
    """Searching three times in small units gives what joined neighbour lists give, for ties, copies and null categories;
    no list of neighbours leaves a task for rows whose neighbours are all at home (F3)."""
    data = [(f"{a}-{i}", x or 0.0, y or 0.0, c) for i in range(copies if copies > 1 else 1) for a, x, y, c in rows(400 if copies == 1 else 40, 5)]
    data += [(f"z{i}", float(i), 1.0, "a") for i in range(60)]
    df = spark.createDataFrame(data, "row_key string, x double, y double, c string").repartition(3)
    f = NB.plain_features(df, ["x", "y"], ["c"])
    want = {r["row_key"]: r["lof"] for r in NB.lof_of_neighbours(NB.knn(f, f, 7, exclude_self=True, categories="_c").cache(), 7).collect()}
    monkeypatch.setattr(NB, "knn", None)   # not by joined lists
    got = {r["row_key"]: r["lof"] for r in NB.lof(df, ["x", "y"], ["c"], 7, max_block_bytes=4000).collect()}
    assert got.keys() == want.keys() and len(got) == len(data)
    assert all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want)
