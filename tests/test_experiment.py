"""Experiment layer: id round trip, SEMI targets, guards, evaluator arity, stream plan limits."""

import pytest

from conftest import SF001
from tabtaint.plans import experiment as EX
from tabtaint.plans import grid as GR
from tabtaint.plans.tables import SPECS, keyed
from tabtaint.streaming import corrupt_stream as CS
from tabtaint.streaming import tasks as ST


def test_experiment_id_round_trip():
    e = EX.Experiment("anneal", "marginal_distributions", 16840, "SEMI", "LER", 0.4)
    assert e.id == "NOR#anneal#16840#SEMI#LER#40#marginal_distributions"
    back = EX.Experiment.from_id(e.id)
    assert (back.dataset, back.generator, back.seed, back.perfectness, back.error, back.rate) == \
        ("anneal", "marginal_distributions", 16840, "SEMI", "LER", 0.4)
    assert back.perfect_counterpart().id == "NOR#anneal#16840#PERF#NULL#NULL#marginal_distributions"


def test_semi_perfect_drops_exactly_the_corrupted_rows(spark):
    df = keyed(spark, SF001, "customer")
    exp = EX.Experiment("customer", "dummy_sampler", 100, "SEMI", "PLC", 0.2)
    t = EX.resolve_targets(df, SPECS["customer"], exp, n_samples=50)
    n, k = t["R"].count(), t["corruption"].params["k"]
    assert k == int(max(0.2 * n, 1))
    assert t["RH"].count() == n - k
    assert t["RH"].join(t["corruption"].rows, "row_key").count() == 0


def test_guard_on_training_rows(spark):
    df = keyed(spark, SF001, "customer")
    exp = EX.Experiment("customer", "marginal_distributions", 100, "IMP", "PLC", 0.2, max_training_rows=10)
    syn, row, reason = EX.run_experiment(df, SPECS["customer"], exp)
    assert syn is None and row is None and "exceed" in reason


def test_evaluator_arity(spark):
    df = keyed(spark, SF001, "customer")
    with pytest.raises(ValueError):
        EX.evaluate("QLT", [df], SPECS["customer"])


def test_stream_plan_refuses_duplicates(spark):
    df = keyed(spark, SF001, "customer")
    plan = CS.fit_plan(df, SPECS["customer"], "DUP", 0.1, 0.5, seed=1)
    with pytest.raises(ValueError):
        CS.apply_plan(df, plan)


def _rows(spark, store):
    out = {t: GR.read_ledger(spark, store, t).count() for t in (*GR.LEDGER_KEYS, "corrupted_rows")}
    return out | {"tasks": spark.read.text(f"{store}/tasks").count()}


def test_lost_run_comes_again(spark, monkeypatch):
    """The driver is lost before the ledger row is written; the run that follows leaves everything once."""
    store, df = ST.scratch(spark, "lost"), keyed(spark, SF001, "customer")
    exp = EX.Experiment("customer", "dummy_sampler", 100, "IMP", "PLC", 0.2)
    own = GR.append_ledger

    def lost(rows, path, table, key=None):
        if table == "experiments":
            raise KeyboardInterrupt
        own(rows, path, table, key)

    monkeypatch.setattr(GR, "append_ledger", lost)
    with pytest.raises(KeyboardInterrupt):
        EX.run_experiment(df, SPECS["customer"], exp, store=store)
    monkeypatch.setattr(GR, "append_ledger", own)
    before = _rows(spark, store)
    assert before["experiments"] == 0 and before["corrupted_rows"] == 150
    assert EX.run_experiment(df, SPECS["customer"], exp, store=store)[2] is None
    assert _rows(spark, store) == before | {"experiments": 1}
    assert EX.run_experiment(df, SPECS["customer"], exp, store=store, force=True)[2] is None
    assert _rows(spark, store) == before | {"experiments": 1}


def test_failed_experiment_is_kept_and_skipped(spark, monkeypatch):
    store, df = ST.scratch(spark, "failed"), keyed(spark, SF001, "customer")
    exp = EX.Experiment("customer", "broken", 100)

    def broken(*_):
        raise RuntimeError("no luck")

    monkeypatch.setitem(EX.GENERATORS, "broken", broken)
    assert EX.run_experiment(df, SPECS["customer"], exp, store=store)[2] == "no luck"
    assert EX.run_experiment(df, SPECS["customer"], exp, store=store)[2] == GR.EXISTS_REASON
    kept = GR.read_ledger(spark, store, "errors").collect()
    assert [(r["experiment_id"], r["file_path"], r["error_message"]) for r in kept] == [(exp.id, exp.id, "no luck")]
    assert EX.run_evaluation("QLT#R#S", exp.id, df, SPECS["customer"], store) == "failed"
    assert f"QLT#R#S/{exp.id}" in {r["file_path"] for r in GR.read_ledger(spark, store, "errors").collect()}


def test_targets_come_from_the_store(spark, monkeypatch):
    store, df = ST.scratch(spark, "targets"), keyed(spark, SF001, "customer")
    exp = EX.Experiment("customer", "dummy_sampler", 100, "IMP", "PLC", 0.2)
    for e in (exp, exp.perfect_counterpart()):
        assert EX.run_experiment(df, SPECS["customer"], e, store=store)[2] is None

    def none(*_):
        raise AssertionError("drawn again")

    monkeypatch.setitem(EX.GENERATORS, "dummy_sampler", none)
    t = EX.resolve_targets(df, SPECS["customer"], exp, names=("S", "SH"), store=store)
    assert set(t) == {"S", "SH"} and t["S"].count() == t["SH"].count() == 750
    monkeypatch.setattr(EX, "split_real", none)
    assert EX.run_evaluation("LOF#S#NULL", exp.perfect_counterpart().id, df, SPECS["customer"], store) == "done"


def test_compaction_counts_rows_once(spark):
    store = ST.scratch(spark, "compact")
    for i in (1, 2, 2, 3):
        GR.append_ledger(GR.ledger_row(spark, "errors", "local", experiment_id=f"e{i}", error_message=f"m{i}"), store, "errors")
    assert GR.read_ledger(spark, store, "errors").count() == 3
    assert GR.compact_ledger(spark, store, "errors") == 4 and GR.compact_ledger(spark, store, "errors") == 1
    GR.append_ledger(GR.ledger_row(spark, "errors", "local", experiment_id="e1", error_message="later"), store, "errors", "e1")
    rows = {r["experiment_id"]: r["error_message"] for r in GR.read_ledger(spark, store, "errors").collect()}
    assert rows == {"e1": "later", "e2": "m2", "e3": "m3"}


def test_corruptors_are_registered(spark, monkeypatch):
    """A new error type needs a function and a code; the audit log knows its changes."""
    from pyspark.sql import functions as F

    from tabtaint.operators import corrupt as C
    monkeypatch.setattr(C, "CORRUPTORS", dict(C.CORRUPTORS))
    monkeypatch.setattr(C, "APPLICABILITY", dict(C.APPLICABILITY))

    @C.corruptor("NEG", applies="numeric")
    def negate(job):
        return job.df.withColumns({c: F.when(job.hit, -F.col(c)).otherwise(F.col(c)) for c in job.columns})

    df = keyed(spark, SF001, "customer")
    out = C.corrupt(df, SPECS["customer"], "NEG", 0.1, 1.0, seed=1)
    assert out.columns == ["c_acctbal"] and out.df.columns == df.columns
    rows = out.changes.collect()
    assert len(rows) == out.rows.count() == 150 and all(float(r["old_value"]) == -float(r["new_value"]) for r in rows)
    with pytest.raises(ValueError):
        C.corrupt(df, SPECS["customer"], "NEW", 0.1, seed=1)
