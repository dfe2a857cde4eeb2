"""Both dependency searches against exhaustive search on small tables, and against each other."""

import random
from itertools import combinations

import pytest

from tabtaint.operators import fd as FD


def minimal(rows, cols):
    """All minimal dependencies by comparing groups of rows."""
    def holds(lhs, a):
        seen = {}
        return all(seen.setdefault(tuple(r[i] for i in lhs), r[a]) == r[a] for r in rows)

    out = set()
    for a in range(len(cols)):
        least = []
        for k in range(len(cols)):
            for lhs in combinations([i for i in range(len(cols)) if i != a], k):
                if not any(set(m) <= set(lhs) for m in least) and holds(lhs, a):
                    least.append(lhs)
        out |= {(tuple(cols[i] for i in lhs), cols[a]) for lhs in least}
    return out


def table(seed, n, width):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        row = [r.choice([None, *range(r.choice([1, 2, 3]) + 1)]) for _ in range(width)]
        if width > 3:
            row[-1] = None if row[0] is None else (row[0] * 2 + (row[1] or 0)) % 3
            row[-2] = i if seed % 2 else i // 2
        rows.append(row)
    return rows


@pytest.mark.parametrize("seed,n,width", [(1, 12, 3), (2, 40, 5), (3, 40, 5), (4, 6, 6), (5, 1, 3), (6, 300, 6)])
def test_against_exhaustive_search(spark, seed, n, width, monkeypatch):
    monkeypatch.setattr(FD, "CHUNK_ROWS", 7)
    cols = [f"c{i}" for i in range(width)]
    rows = table(seed, n, width)
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols)).repartition(3)
    want = minimal(rows, cols)
    assert set(FD.discover(df, cols)) == want
    for s in (0, 1):
        assert set(FD.walk(df, cols, seed=s)) == want


def test_without_agreement_sets(spark, monkeypatch):
    """All refutations come from the validation then."""
    monkeypatch.setattr(FD.Hashed, "agreement_sets", lambda self: [])
    cols = [f"c{i}" for i in range(5)]
    rows = table(2, 60, 5)
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols)).repartition(4)
    want = minimal(rows, cols)
    assert set(FD.discover(df, cols)) == want == set(FD.walk(df, cols))


def test_edges(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert set(FD.discover(df)) == {((), "a"), ((), "b")} == set(FD.walk(df))
    one = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    assert set(FD.discover(one)) == {((), "a"), ((), "b")} == set(FD.walk(one))
    alone = spark.createDataFrame([(1,), (2,)], "a int")
    assert FD.discover(alone) == [] == FD.walk(alone)
    with pytest.raises(ValueError):
        FD.discover(df, max_columns=2)
    assert all(len(lhs) <= 1 for lhs, _ in FD.discover(spark.createDataFrame(table(2, 40, 5), "a int, b int, c int, d int, e int"), max_lhs=1))


def test_wide_table(spark):
    """Both searches agree on twelve columns; a column that nearly is a key stays out of most work."""
    r = random.Random(9)
    rows = []
    for i in range(3000):
        x = [r.randrange(k) for k in (2, 3, 5, 8, 20, 50, 200)]
        rows.append((i, *x, x[0] * 3 + x[1], x[5] % 7, (x[2] + x[3]) % 4, i // 3))
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    got = FD.discover(df, cols)
    assert got == FD.walk(df, cols)
    assert {(("c0",), "c11"), (("c1", "c2"), "c8"), (("c6",), "c9"), (("c3", "c4"), "c10")} <= set(got)
