"""States of evaluation tasks: any order of events, repeated batches, tasks that expire."""

import json

from tabtaint.streaming import states as SS
from tabtaint.streaming import tasks as ST


def write(tmp_path, name, events):
    (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("evaluation_id", "experiment_id", "event"), e))) for e in events))


def test_states_of_events_in_any_order(spark, tmp_path):
    src, out, ck = tmp_path / "in", ST.scratch(spark, "states"), ST.scratch(spark, "states-ckpt")
    src.mkdir()
    write(src, "1.json", [("a", "x", "finished"), ("b", "x", "published"), ("c", "x", "published"), ("d", "x", "published"), ("e", "x", "odd")])
    SS.run_task_states(spark, str(src), out, ck)
    write(src, "2.json", [("a", "x", "published"), ("b", "x", "failed"), ("c", "x", "skipped"), ("b", "y", "published")])
    SS.run_task_states(spark, str(src), out, ck, files_per_batch=1)   # the state store goes on where it was
    write(src, "3.json", [("b", "x", "finished"), ("c", "x", "skipped"), ("b", "x", "published")])
    SS.run_task_states(spark, str(src), out, ck)
    got = {(r["evaluation_id"], r["experiment_id"]): r["state"] for r in SS.current_states(spark, out).collect()}
    assert got == {("a", "x"): "finished", ("b", "x"): "finished", ("c", "x"): "skipped", ("d", "x"): "pending", ("b", "y"): "pending"}
    changes = spark.read.parquet(out).where("evaluation_id = 'c'").count()
    assert changes == 2   # pending, skipped; the repeated event changes nothing


def test_pending_tasks_expire(spark, tmp_path):
    src, out, ck = tmp_path / "in", ST.scratch(spark, "expire"), ST.scratch(spark, "expire-ckpt")
    src.mkdir()
    write(src, "1.json", [("a", "x", "published"), ("b", "x", "finished")])
    SS.run_task_states(spark, str(src), out, ck, timeout_ms=1000, seconds=25)
    got = {r["evaluation_id"]: r["state"] for r in SS.current_states(spark, out).collect()}
    assert got == {"a": "failed", "b": "finished"}
