"""(c) the same result for 1 and 7 partitions and after a row shuffle."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabtaint.operators import corrupt as C
from tabtaint.operators import split as SP
from tabtaint.operators import generate as G
from tabtaint.plans.tables import SPECS, keyed


def _same(a, b, key="row_key", tol=1e-6):
    """Equal row sets by key; doubles within ``tol`` (aggregates such as stddev sum in
    partition order, which moves the last bits — floating-point addition is not associative)."""
    if a.count() != b.count():
        return False
    j = a.alias("a").join(b.alias("b"), key, "full")
    bad = None
    for c, t in a.dtypes:
        if c == key:
            continue
        if t == "double":
            e = ~(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tol) & ~(F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull())
        else:
            e = ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        bad = e if bad is None else bad | e
    return j.where(bad).count() == 0


@pytest.mark.parametrize("kind", ["NOI", "SFT", "INC", "DUP", "OUT"])
def test_corruption_partition_invariant(spark, kind):
    df = keyed(spark, SF001, "part")
    spec = SPECS["part"]
    a = C.corrupt(df.repartition(1), spec, kind, 0.2, 0.6, seed=9, audit=False).df
    b = C.corrupt(df.repartition(7).orderBy(F.rand(1)), spec, kind, 0.2, 0.6, seed=9, audit=False).df
    assert _same(a, b)


def test_split_partition_invariant(spark):
    df = keyed(spark, SF001, "orders")
    a = SP.regression_split(df.repartition(1), "row_key", "o_totalprice", 0.25, seed=4).select("row_key", "split")
    b = SP.regression_split(df.repartition(7), "row_key", "o_totalprice", 0.25, seed=4).select("row_key", "split")
    assert _same(a, b)


def test_generator_partition_invariant(spark):
    df = keyed(spark, SF001, "customer")
    cols = ["c_nationkey", "c_acctbal", "c_mktsegment"]
    a = G.per_class(df.repartition(1), cols[:2], "c_mktsegment", 300, 5)
    b = G.per_class(df.repartition(7), cols[:2], "c_mktsegment", 300, 5)
    assert _same(a, b, key="draw_id")
