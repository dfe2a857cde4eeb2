"""(b) properties and (c) partition invariance of the core operators."""

from pyspark.sql import functions as F

from conftest import SF001
from tabtaint.operators import corrupt as C
from tabtaint.operators import sampling as SA
from tabtaint.operators import split as SP
from tabtaint.plans.tables import SPECS, keyed


def test_exactly_k_rows_changed(spark):
    df = keyed(spark, SF001, "customer")
    res = C.corrupt(df, SPECS["customer"], "PLC", 0.1, 0.5, seed=7)
    n = df.count()
    assert res.rows.count() == int(max(0.1 * n, 1))
    changed = res.changes.select("row_key").distinct().count()
    assert changed <= res.rows.count()
    # untouched cells identical
    j = df.alias("a").join(res.df.alias("b"), "row_key").join(res.rows.alias("r"), "row_key", "left_anti")
    for c in ["c_name", "c_acctbal", "c_nationkey", "c_mktsegment"]:
        assert j.where(~F.col(f"a.{c}").cast("string").eqNullSafe(F.col(f"b.{c}").cast("string"))).count() == 0


def test_derangement_has_no_fixed_point(spark):
    df = keyed(spark, SF001, "part")
    kind, mp = C.derangement_map(df, "p_brand", 3, "t")
    assert kind == "literal" and all(k != v for k, v in mp.items())
    assert sorted(mp.values()) == sorted(mp.keys())


def test_split_disjoint_complete_quota(spark):
    df = keyed(spark, SF001, "customer")
    s = SP.stratified_split(df, "row_key", "c_mktsegment", 0.25, seed=11)
    assert s.count() == df.count()
    t = s.where("split = 'test'").count()
    assert t == -(-df.count() * 25 // 100)


def test_sampling_partition_invariant(spark):
    df = keyed(spark, SF001, "orders")
    a = SA.sample_rows(df.repartition(1), "row_key", 500, 5).select("row_key")
    b = SA.sample_rows(df.repartition(7), "row_key", 500, 5).select("row_key")
    assert a.count() == 500 and a.exceptAll(b).count() == 0


def test_row_key_content_hash_unique(spark):
    df = keyed(spark, SF001, "lineitem")
    assert df.select("row_key").distinct().count() == df.count()


def test_row_key_numbers_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")], "x int, y string").repartition(3)
    from tabtaint.spec import with_row_key
    keys = sorted(r["row_key"].split("-")[1] for r in with_row_key(df).collect() if r["x"] == 1)
    assert keys == ["0", "1", "2", "3", "4"]


def test_seed_required(spark):
    df = keyed(spark, SF001, "customer")
    import pytest
    with pytest.raises(ValueError):
        C.corrupt(df, SPECS["customer"], "PLC", 0.1, seed=None)
    with pytest.raises(ValueError):
        C.corrupt(df, SPECS["customer"], "PLC", 1.5, seed=1)


def test_large_vocabulary_path_equals_literal_map(spark, monkeypatch):
    """The join path for big value maps gives the same table as the literal-map path."""
    from tabtaint.spec import TableSpec
    df = keyed(spark, SF001, "part")
    spec = TableSpec("part", categorical=("p_name",), numeric=())
    lit = C.corrupt(df, spec, "SFT", 0.3, 1.0, seed=5, audit=False).df
    monkeypatch.setattr(C, "SMALL_MAP", 10)
    kind, mp = C.derangement_map(df, "p_name", 5, "sft:p_name")
    assert kind == "table" and mp.where("old = new").count() == 0
    big = C.corrupt(df, spec, "SFT", 0.3, 1.0, seed=5, audit=False).df
    assert lit.exceptAll(big).count() == 0 and big.exceptAll(lit).count() == 0


def test_numbering_without_broadcast_matches(spark, monkeypatch):
    """Above the offset-table bound the numbering joins without a broadcast: same numbers."""
    df = keyed(spark, SF001, "orders")
    a, n = SA.number_by_hash(df, "row_key", 3, "t", group="o_orderstatus")
    monkeypatch.setattr(SA, "BROADCAST_OFFSET_ROWS", 0)
    b, m = SA.number_by_hash(df, "row_key", 3, "t", group="o_orderstatus")
    assert n == m
    sa, sb = a.select("row_key", "_pos"), b.select("row_key", "_pos")
    assert sa.exceptAll(sb).count() == 0 and sb.exceptAll(sa).count() == 0
    assert a.groupBy("o_orderstatus").agg(F.max("_pos").alias("m"), F.count(F.lit(1)).alias("c")) \
        .where("m + 1 != c").count() == 0


def test_threshold_refinement_levels_agree(spark, monkeypatch):
    """Forcing the recursive refinement (tiny boundary limit) selects the same rows."""
    from tabtaint.functions.rng import hash_hex
    df = keyed(spark, SF001, "orders")
    h = hash_hex(8, "rows", "row_key")
    one, _ = SA.hash_thresholds(df, h, SA.row_count_k(0.3), group=F.col("o_orderstatus"))
    monkeypatch.setattr(SA, "_SMALL", 0)      # every boundary bucket recurses, down to the full digest
    deep, _ = SA.hash_thresholds(df, h, SA.row_count_k(0.3), group=F.col("o_orderstatus"))
    assert one == deep
