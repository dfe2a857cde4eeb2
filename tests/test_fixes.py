"""Rows, groups and values that earlier versions lost: large maps, null groups, key collisions, sinks, folds."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabtaint.operators import corrupt as C
from tabtaint.operators import generate as G
from tabtaint.operators import neighbors as NB
from tabtaint.operators import ordered as OR
from tabtaint.operators import sampling as SA
from tabtaint.operators import split as SP
from tabtaint.plans import experiment as EX
from tabtaint.plans import grid as GR
from tabtaint.plans.tables import SPECS, keyed
from tabtaint.spec import TableSpec, with_row_key
from tabtaint.streaming import corrupt_stream as CS
from tabtaint.streaming import tasks as ST


def test_gap_of_distributions_beyond_int64_products(spark):
    big = 2 ** 61
    rows = [("c", 1.0, big, 0), ("c", 2.0, 0, big // 2), ("c", 3.0, 0, big // 2), ("d", 5.0, 3, 3)]
    d = spark.createDataFrame(rows, "g string, v double, a bigint, b bigint")
    out = OR.max_cdf_gap_by_group(d, "g", "v", "a", "b", {"c": (big, big), "d": (3, 3)})
    assert out == {"c": 1.0, "d": 0.0}


def test_null_group_is_a_group(spark):
    d = spark.range(40).select(F.col("id").cast("string").alias("row_key"),
                               F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("g"))
    numbered, sizes = SA.number_by_hash(d, "row_key", 1, "t", group="g")
    assert numbered.count() == 40 and sizes[None] == 10
    s = SP.stratified_split(d, "row_key", "g", test_size=0.5, seed=1)
    assert {r["g"]: r["n"] for r in s.where("split = 'test'").groupBy("g").agg(F.count("*").alias("n")).collect()} == \
        {None: 5, 1: 5, 2: 5, 3: 5}
    assert G.per_class(d.withColumn("x", F.col("g") * 2), ["x"], "g", 30, 1).where("g IS NULL").count() == 0


def test_content_key_separates_look_alikes(spark):
    rows = [("␀", "x"), (None, "x"), ("a␟b", "c"), ("a", "b␟c"), ("", "x"), ("1:a", None)]
    d = with_row_key(spark.createDataFrame(rows, "a string, b string"))
    assert d.select(F.substring("row_key", 1, 32)).distinct().count() == len(rows)
    two = with_row_key(spark.createDataFrame(rows, "a string, b string"), ["a", "b"])
    assert two.select("row_key").distinct().count() == len(rows)


def test_value_map_too_large_to_broadcast(spark, monkeypatch):
    d = spark.range(3000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 300).cast("string").alias("c"),
                                 F.lit(1.0).alias("x"))
    spec = TableSpec("t", categorical=("c",), numeric=("x",))
    a = C.corrupt(d, spec, "SFT", 0.3, 0.5, seed=5, audit=False).df
    monkeypatch.setattr(C, "BROADCAST_MAP_BYTES", 0)
    b = C.corrupt(d, spec, "SFT", 0.3, 0.5, seed=5, audit=False).df
    monkeypatch.setattr(C, "SMALL_MAP", 1000)
    c = C.corrupt(d, spec, "SFT", 0.3, 0.5, seed=5, audit=False).df
    want = sorted(tuple(r) for r in a.collect())
    assert want == sorted(tuple(r) for r in b.collect()) == sorted(tuple(r) for r in c.collect())
    assert a.join(d.select("row_key", F.col("c").alias("old")), "row_key").where("c <> old").count() == 900


def test_stream_and_batch_write_the_same_placeholder(spark):
    d = spark.createDataFrame([(str(i), i % 3, i * 1.0) for i in range(50)], "row_key string, k int, x double")
    spec = TableSpec("t", categorical=("k",), numeric=("x",))
    plan = CS.fit_plan(d, spec, "PLC", 1.0, 1.0, seed=3)
    out = CS.apply_plan(d, plan)
    batch = C.corrupt(d, spec, "PLC", 1.0, 1.0, seed=3, audit=False).df
    assert sorted(map(str, out.select("row_key", "k", "x").collect())) == sorted(map(str, batch.select("row_key", "k", "x").collect()))


def test_lof_keeps_all_rows(spark):
    few = spark.createDataFrame([(str(i), float(i)) for i in range(15)], "row_key string, x double")
    assert NB.lof(few, ["x"], [], k=20).count() == 15
    assert NB.lof(few.limit(1), ["x"], [], k=20).collect()[0]["lof"] == 1.0
    holes = few.withColumn("x", F.when(F.col("x") % 4 != 0, F.col("x")))
    assert NB.lof(holes, ["x"], [], k=3).count() == 15


def test_task_sink_replaces_a_retried_batch(spark):
    src, out = ST.scratch(spark, "retry-src"), ST.scratch(spark, "retry-out")
    spark.createDataFrame([(f"LOF#{i}", "e") for i in range(6)], "evaluation_id string, experiment_id string").write.json(src)
    ledger = spark.createDataFrame([("LOF#1", "e")], "evaluation_id string, experiment_id string")
    for _ in range(2):   # a fresh checkpoint makes the second run repeat batch 0
        ST.run_task_stream(spark, src, ledger, out, ST.scratch(spark, "retry-ckpt"))
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and rows.where("state = 'done'").count() == 1


def test_unreadable_ledger_is_an_error(spark, tmp_path):
    assert GR.read_ledger(spark, str(tmp_path / "none"), "errors").count() == 0
    (tmp_path / "errors").mkdir()
    (tmp_path / "errors" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        GR.read_ledger(spark, str(tmp_path), "errors").count()


def test_experiment_is_stored_once(spark):
    store, df = ST.scratch(spark, "store"), keyed(spark, SF001, "customer")
    exp = EX.Experiment("customer", "marginal_distributions", 100, "IMP", "PLC", 0.2)
    syn, row, reason = EX.run_experiment(df, SPECS["customer"], exp, store=store)
    assert reason is None and spark.read.parquet(f"{store}/{EX.synthetic_path(exp)}").count() == syn.count()
    kept = GR.read_ledger(spark, store, "experiments").first()
    assert kept["error_rate"] == "20" and kept["training_size"] == 750
    assert GR.read_ledger(spark, store, "corrupted_rows").count() == 150
    assert spark.read.text(f"{store}/tasks").count() > 0
    assert EX.run_experiment(df, SPECS["customer"], exp, store=store)[2] == GR.EXISTS_REASON
    assert GR.read_ledger(spark, store, "skipped_computations").where(F.col("computation_id") == exp.id).count() == 1


def test_augmentation_evaluators_run_from_ids(spark):
    store, df = ST.scratch(spark, "store"), keyed(spark, SF001, "customer")
    eid = "NOR#customer#100#IMP#PLC#10#marginal_distributions"
    assert EX.run_evaluation("APR#R#SH", eid, df, SPECS["customer"], store) == "done"
    assert EX.run_evaluation("APR#R#SH", eid, df, SPECS["customer"], store) == "skipped"
    assert EX.run_evaluation("AR2#R#SH", eid, df, SPECS["customer"], store) == "skipped"
    r = GR.read_ledger(spark, store, "evaluations").first()
    assert r["first_target"] == "R" and r["second_target"] == "SH" and r["result"] >= 0
    assert GR.read_ledger(spark, store, "errors").count() == 0


def test_codes_of_many_values(spark, monkeypatch):
    from tabtaint.functions import encoders as EN
    d = spark.range(200_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("v"), "id")
    table = EN.code_table(d, "v")
    for limit in (EN.BROADCAST_CODE_BYTES, 0):
        monkeypatch.setattr(EN, "BROADCAST_CODE_BYTES", limit)
        out = EN.encode(d.unionByName(spark.createDataFrame([("new", -1), (None, -1)], "v string, id long")), "v", table, "c")
        assert out.count() == 200_002 and out.where("c <> id").count() == 0
    first = EN.factorize(d.withColumn("back", -F.col("id")), "v", "back")
    assert first.where("code <> 199999 - cast(v AS int)").count() == 0
