"""Steps that must not grow with the table: what is broadcast, copied or read by one task."""

from pyspark.sql import functions as F

from tabtaint.operators import intervals, models
from tabtaint.plans import experiment as EX
from tabtaint.spec import TableSpec, with_row_key


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_join_broadcasts_no_side(spark):
    """A range of draws looks small to Spark however often it is exploded (F1, F11, F12)."""
    draws = spark.range(1000).select(F.lit("").alias("_g"), F.col("id").alias("_pos"))
    parts = spark.range(10).select(F.lit("").alias("_g"), "id", (F.col("id") * 100).alias("_lo"), ((F.col("id") + 1) * 100).alias("_hi"))
    out = intervals.join_intervals(draws, parts, ["_g"], 1000)
    assert "BroadcastHashJoin" not in plan(out) and "SortMergeJoin" in plan(out)
    assert out.where("id = floor(_pos / 100)").count() == 1000


def test_drawn_targets_are_kept(spark):
    """Evaluators read a synthetic table several times; it is drawn once (F1)."""
    df = spark.createDataFrame([(str(i), float(i), "ab"[i % 2]) for i in range(40)], "row_key string, x double, y string")
    spec = TableSpec("t", target="y", categorical=("y",), numeric=("x",))
    out = EX.resolve_targets(df, spec, EX.Experiment("t", "marginal_distributions", 1, "IMP", "PLC", 0.2))
    for name in ("S", "SH"):
        assert "Join" not in plan(out[name]) and out[name].count() == 20


def test_content_keys_of_copies_and_missing_values(spark):
    """Copies are found by a short hash and numbered by content: every key once, nulls apart from texts (F9, F10)."""
    rows = [("a", None), ("a", None), (None, "a"), ("n", "a"), ("b", "c"), ("b", "c"), ("b", "c"), ("1:b", "c")]
    keys = [r["row_key"] for r in with_row_key(spark.createDataFrame(rows * 3, "x string, y string").repartition(4)).collect()]
    assert len(set(keys)) == len(keys) == 24
    assert sorted(int(k.split("-")[1]) for k in keys).count(0) == 5
    df = with_row_key(spark.createDataFrame(rows[2:5], "x string, y string"))
    assert "exchange hashpartitioning(_ch" not in plan(df).lower() and df.count() == 3


def test_lineitem_key_is_stored_not_cached(spark):
    from tabtaint.plans.tables import keyed
    li = keyed(spark, "/root/testdata/sf0.001", "lineitem")
    assert "InMemoryTableScan" not in plan(li) and "ReadSchema: struct<row_key:string>" in plan(li.select("row_key"))


def test_forest_rows_are_dealt(spark, monkeypatch):
    """MLlib keeps a count a tree with each training row: rows a task follow from the number of trees (F7, F8)."""
    df = spark.range(2000).coalesce(1)
    assert models._dealt(df, 100).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "FOREST_BYTES", 20_000)
    dealt = models._dealt(df, 100)
    assert dealt.rdd.getNumPartitions() == 100 and dealt.count() == 2000


def test_f1_makes_predictions_once(spark):
    """Label, prediction and their agreement are counted in one pass over the predictions (F1); nulls stay apart."""
    from tabtaint.functions import metrics
    rows = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "a"), (None, "a"), ("b", None), ("c", "c")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    out = metrics.per_class_f1(df)
    assert plan(out).count("Scan ExistingRDD") == 1
    got = sorted((r["class"] or "", r["support"], round(r["precision"], 6), round(r["recall"], 6)) for r in out.collect())
    assert got == [("", 0, 0.0, 0.0), ("", 1, 0.0, 0.0), ("a", 5, 0.6, 0.6), ("b", 2, 0.0, 0.0), ("c", 1, 1.0, 1.0)]


def test_few_draws_sum_along_their_parts_only(spark, monkeypatch):
    """Where draws are few, parts of the values that no draw hits are added up, not sorted (F1)."""
    monkeypatch.setattr(intervals, "WINDOW_VALUES", 50)
    values = spark.range(3000).select(F.lit("").alias("g"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 4 + 1).alias("w"))
    points = spark.createDataFrame([("", p) for p in (0, 5, 7499, 4000, 4000)], "g string, _pos bigint")
    whole = {r["v"]: (r["_lo"], r["_hi"]) for r in intervals.along(values, ["g"], "v", "w", 5, "t").collect()}
    some = intervals.along(values, ["g"], "v", "w", 5, "t", points, 5, 7500)
    got = {r["v"]: (r["_lo"], r["_hi"]) for r in some.collect()}
    assert len(whole) == 3000 and len(got) < 300 and got.items() <= whole.items()
    assert intervals.join_intervals(points, some, ["g"], 7500).count() == 5
