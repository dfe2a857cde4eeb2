"""Experiment runner, evaluation targets, evaluator and generator registries
(GRD6, GRD8, GRD9, EV0, EV2, EXT1).

An experiment = split -> guard -> corrupt -> (drop corrupted rows for SEMI) -> generate.
The four evaluation targets are lazily planned DataFrames: R (real training half),
RH (its corrupted version), S (synthetic from R), SH (synthetic from RH).  Evaluators are
registered functions returning a one-row ``(result double, notes string)`` DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.strings import decode_evaluation_id
from tabtaint.operators import corrupt as C
from tabtaint.operators import generate as G
from tabtaint.operators import split as SP
from tabtaint.session import cut_lineage
from tabtaint.spec import TableSpec

GENERATORS: dict[str, Callable] = {}
EVALUATORS: dict[str, tuple[int, Callable]] = {}


def generator(name: str):
    """EXT1: register ``fn(df, spec, n_samples, seed) -> DataFrame``."""
    def deco(fn):
        GENERATORS[name] = fn
        return fn
    return deco


def evaluator(code: str, arity: int):
    """EXT1: register ``fn(targets: list[DataFrame], spec, **params) -> (result, notes)``."""
    def deco(fn):
        EVALUATORS[code] = (arity, fn)
        return fn
    return deco


def _cols(spec: TableSpec):
    num = [c for c in spec.numeric if c != spec.target]
    cat = [c for c in spec.categorical if c != spec.target]
    return num, cat


def _whole(spec: TableSpec):
    """Numeric and categorical columns with the target among them: table-level evaluators score
    the table as it is."""
    num, cat = _cols(spec)
    if not spec.target:
        return num, cat
    return (num + [spec.target], cat) if spec.problem_type == "regression" else (num, cat + [spec.target])


@generator("marginal_distributions")
def _gen_marginal(df, spec, n, seed):
    num, cat = _cols(spec)
    return G.marginal(df, num + cat + ([spec.target] if spec.target else []), n, seed, spec.row_key)


@generator("uniform_sampler")
def _gen_uniform(df, spec, n, seed):
    num, cat = _cols(spec)
    tgt = [spec.target] if spec.target else []
    cats = tuple(cat) + (tuple(tgt) if spec.problem_type == "classification" else ())
    return G.uniform_sampler(df, num + cat + tgt, n, seed, categorical=cats)


@generator("dummy_sampler")
def _gen_boot(df, spec, n, seed):
    num, cat = _cols(spec)
    return G.bootstrap(df, num + cat + ([spec.target] if spec.target else []), n, seed, spec.row_key)


@generator("bayesian_network")
def _gen_cl(df, spec, n, seed):
    from tabtaint.operators.bayes import chow_liu
    num, cat = _cols(spec)
    tnum = [spec.target] if spec.target and spec.problem_type == "regression" else []
    tcat = [spec.target] if spec.target and spec.problem_type == "classification" else []
    return chow_liu(df, num + tnum, cat + tcat, n, seed)


@generator("privbayes")
def _gen_pb(df, spec, n, seed):
    from tabtaint.operators.bayes import privbayes
    num, cat = _cols(spec)
    tnum = [spec.target] if spec.target and spec.problem_type == "regression" else []
    tcat = [spec.target] if spec.target and spec.problem_type == "classification" else []
    return privbayes(df, num + tnum, cat + tcat, n, seed)


@generator("per_class")
def _gen_per_class(df, spec, n, seed):
    num, cat = _cols(spec)
    return G.per_class(df, num + cat, spec.target, n, seed, spec.row_key)


@dataclass
class Experiment:
    dataset: str
    generator: str
    seed: int
    perfectness: str = "PERF"
    error: str | None = None
    rate: float | None = None
    experiment_type: str = "NOR"
    test_size: float = 0.5   # fixed value: the halves that an id stands for
    max_training_rows: float = float("inf")

    @property
    def id(self) -> str:
        pct = None if self.rate is None else str(int(round(self.rate * 100)))
        parts = [self.experiment_type, self.dataset, str(self.seed), self.perfectness, self.error or "NULL",
                 pct or "NULL", self.generator]
        return "#".join(parts)

    @classmethod
    def from_id(cls, eid: str) -> "Experiment":
        p = eid.split("#")
        return cls(dataset=p[1], generator=p[6], seed=int(p[2]), perfectness=p[3],
                   error=None if p[4] == "NULL" else p[4], rate=None if p[5] == "NULL" else int(p[5]) / 100.0,
                   experiment_type=p[0])

    def perfect_counterpart(self) -> "Experiment":
        return Experiment(self.dataset, self.generator, self.seed, "PERF", None, None, self.experiment_type,
                          self.test_size, self.max_training_rows)


def split_real(df: DataFrame, spec: TableSpec, exp: Experiment):
    """Training / validation halves (stratified by class or by target bins)."""
    if spec.target and spec.problem_type == "classification":
        s = SP.stratified_split(df, spec.row_key, spec.target, exp.test_size, seed=exp.seed)
    elif spec.target:
        s = SP.regression_split(df, spec.row_key, spec.target, exp.test_size, seed=exp.seed)
    else:
        s = SP.random_split(df, spec.row_key, exp.test_size, seed=exp.seed)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def stored_synthetic(spark, store: str | None, exp: Experiment) -> DataFrame | None:
    """The synthetic table that an experiment has left in the store, or None."""
    from pyspark.errors import AnalysisException
    if not store:
        return None
    try:
        return spark.read.parquet(f"{store}/{synthetic_path(exp)}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resolve_targets(df: DataFrame, spec: TableSpec, exp: Experiment, n_samples: int | None = None,
                    names=("R", "RH", "S", "SH", "V"), store: str | None = None) -> dict:
    """EV2: those of R, RH, S, SH and the validation half V that ``names`` asks for (with RH, the corruption
    result too).

    S and SH are read from the ``store`` where their experiments have left them (S is the perfect
    counterpart's), and drawn anew otherwise.  The table is split only for what needs a half of it."""
    perfect = exp if exp.error is None else exp.perfect_counterpart()
    found = {t: stored_synthetic(df.sparkSession, store, e) for t, e in (("S", perfect), ("SH", exp)) if t in names}
    out = {t: f for t, f in found.items() if f is not None}
    wanted = [t for t in names if t not in out and (exp.error or t not in ("RH", "SH"))]
    if not wanted:
        return out
    train, valid = split_real(df, spec, exp)
    gen = GENERATORS[exp.generator]
    n = (n_samples or train.count()) if {"S", "SH"} & set(wanted) else None
    if "R" in wanted:
        out["R"] = train
    if "V" in wanted:
        out["V"] = valid
    if "S" in wanted:   # drawn once: evaluators read a table several times
        out["S"] = cut_lineage(gen(train, spec, n, exp.seed))
    if {"RH", "SH"} & set(wanted):
        res = C.corrupt(train, spec, exp.error, exp.rate, seed=exp.seed, audit=False)
        rh = C.drop_corrupted(res.df, res.rows, spec.row_key) if exp.perfectness == "SEMI" else res.df
        out["RH"], out["corruption"] = rh, res
        if "SH" in wanted:
            out["SH"] = cut_lineage(gen(rh, spec, n, exp.seed))
    return out


def guard(train_rows: int, spec: TableSpec, exp: Experiment) -> str | None:
    """GRD6: reason to skip, or None."""
    if train_rows > exp.max_training_rows:
        return f"Training rows {train_rows} exceed the maximum {exp.max_training_rows}."
    if exp.error:
        pool = C.choose_columns(spec, exp.error, 0.2, exp.seed)
        if not pool:
            return f"No column to corrupt with {exp.error}."
    return None


def run_experiment(df: DataFrame, spec: TableSpec, exp: Experiment, profile: str = "local", store: str | None = None,
                   force: bool = False):
    """GRD8: returns ``(synthetic DataFrame or None, experiments-ledger row DataFrame, reason)``.

    With ``store`` the outcome is kept below that folder: the synthetic table under its object path, the
    corrupted rows' keys as a table of their own (``corrupted_rows``; the ledger's array stays empty,
    whatever their number), the evaluation tasks, and last the ledger row, which stands for all of them.
    Each is a folder of the experiment's that is replaced as a whole: a run that was lost half-way and
    comes again leaves everything once.  An experiment that any ledger knows is skipped, unless
    ``force``; the reason is kept.  A failure is kept as an ``errors`` row and returned as the reason.
    """
    from tabtaint.plans import grid as GR
    spark = df.sparkSession
    reason = GR.EXISTS_REASON if store and not force and GR.known_experiment(spark, store, exp.id) else None
    if reason is None:
        if not store:
            return _run_experiment(df, spec, exp, profile, None)
        done, failure = GR.guarded(spark, exp.id, profile, lambda: _run_experiment(df, spec, exp, profile, store), task=exp.id)
        if failure is not None:
            GR.append_ledger(failure, store, "errors", exp.id)
            return None, None, failure.first()["error_message"]
        if done[2] is None:
            return done
        reason = done[2]
    GR.append_ledger(GR.ledger_row(spark, "skipped_computations", profile, computation_id=exp.id, reason=reason),
                     store, "skipped_computations", f"{exp.id}/{reason}")
    return None, None, reason


def _run_experiment(df: DataFrame, spec: TableSpec, exp: Experiment, profile: str, store: str | None):
    import time

    from tabtaint.plans import grid as GR
    spark = df.sparkSession
    train, _ = split_real(df, spec, exp)
    n = train.count()
    if reason := guard(n, spec, exp):
        return None, None, reason
    cols_, rows_, data = [], None, train
    if exp.error:
        res = C.corrupt(train, spec, exp.error, exp.rate, seed=exp.seed, audit=False)
        data = res.df if exp.perfectness != "SEMI" else C.drop_corrupted(res.df, res.rows, spec.row_key)
        rows_, cols_ = res.rows, res.columns
    t0 = time.time()   # the generator's time alone
    syn = GENERATORS[exp.generator](data, spec, n, exp.seed)
    if store:
        path = f"{store}/{synthetic_path(exp)}"
        syn.write.mode("overwrite").parquet(path)
        syn = spark.read.parquet(path)
    m = syn.count()
    row = GR.ledger_row(spark, "experiments", profile, experiment_id=exp.id, experiment_type=exp.experiment_type,
                     dataset_name=exp.dataset, random_seed=exp.seed, data_perfectness=exp.perfectness,
                     data_error=exp.error, error_rate=None if exp.rate is None else str(round(exp.rate * 100)),
                     generator=exp.generator, training_size=n, synthetic_size=m,
                     execution_time=round(time.time() - t0, 2), corrupted_rows=[], corrupted_cols=cols_)
    if store:
        if rows_ is not None:
            GR.append_ledger(rows_.select(F.lit(exp.id).alias("experiment_id"), F.col(spec.row_key).cast("string").alias("row_key")),
                             store, "corrupted_rows", exp.id)
        publish_tasks(row, spec, store, profile, exp.id)
        GR.append_ledger(row, store, "experiments", exp.id)   # last: it says that the rest is there
    return syn, row, None


def synthetic_path(exp: Experiment) -> str:
    """The experiment id as a folder, absent parts left out."""
    return "synthetic/" + "/".join(p for p in exp.id.split("#") if p != "NULL")


def publish_tasks(experiments: DataFrame, spec: TableSpec, store: str, profile: str, key: str | None = None) -> None:
    """The evaluation tasks of ledger rows as JSON, one folder an experiment, replaced as a whole; repeated
    baselines go to the skipped computations (under ``key``)."""
    from tabtaint.plans import grid as GR
    spark = experiments.sparkSession
    kinds = spark.createDataFrame([(spec.name, spec.problem_type)], "dataset_name string, problem_type string")
    work = experiments.withColumn("error_rate", F.col("error_rate").cast("double") / 100)
    tasks, skipped = GR.evaluation_tasks(work, kinds)
    GR.task_json(tasks).select("experiment_id", F.col("task").alias("value")) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").text(f"{store}/tasks")
    GR.append_ledger(skipped.select(F.lit(None).cast("long").alias("id"), "computation_id", "reason",
                                    F.lit(profile).alias("execution_profile"), F.current_timestamp().alias("created_at")),
                     store, "skipped_computations", None if key is None else f"{key}/baselines")


def evaluate(code: str, targets: list, spec: TableSpec, **params) -> DataFrame:
    """EV0: run a registered evaluator; always a one-row ``(result, notes)`` table."""
    arity, fn = EVALUATORS[code]
    if len(targets) != arity:
        raise ValueError(f"{code} takes {arity} table(s), got {len(targets)}")
    # an error may turn a categorical column into text in one table only; its values compare as text
    def as_text(df):
        return df.withColumns({c: F.col(c).cast("string") for c in spec.categorical if c in df.columns})

    if params.get("validation") is not None:
        params["validation"] = as_text(params["validation"])
    result, notes = fn([as_text(t) for t in targets], spec, **params)
    spark = targets[0].sparkSession
    return spark.createDataFrame([(None if result is None else float(result), json.dumps(notes, default=str))],
                                 "result double, notes string")


#: Methods that score on the validation half as well.
WITH_VALIDATION = ("APR", "ARC", "AR2")


def replay(evaluation_id: str, experiment_id: str, df: DataFrame, spec: TableSpec, store: str | None = None, **params) -> DataFrame:
    """GRD9: recompute one evaluation from its two id strings; synthetic tables come from the ``store``."""
    code, first, second = evaluation_id.split("#")
    exp = Experiment.from_id(experiment_id)
    names = [first] + ([] if second == "NULL" else [second])
    if exp.error is None and any(n in ("RH", "SH") for n in names):
        raise ValueError("RH/SH need a corrupted experiment")
    t = resolve_targets(df, spec, exp, names=(*names, *(("V",) if code in WITH_VALIDATION else ())), store=store)
    out = evaluate(code, [t[n] for n in names], spec, validation=t.get("V"), seed=exp.seed,
                   **(default_params(code, spec, t.get("V")) | params))
    return out.select(F.lit(evaluation_id).alias("evaluation_id"), F.lit(experiment_id).alias("experiment_id"), "*")


def default_params(code: str, spec: TableSpec, validation: DataFrame | None) -> dict:
    """What an evaluator needs beside its tables: the minority label of the validation half, the
    columns an attacker knows and the one they are after."""
    if code in ("APR", "ARC"):
        from tabtaint.operators.profile import minority_label
        return {"minority": minority_label(validation, spec.target).first()["minority_label"]}
    if code == "DPR":
        num, cat = _cols(spec)
        sensitive = spec.target or cat[-1]
        return {"known": [c for c in cat if c != sensitive] or [c for c in num if c != sensitive], "sensitive": [sensitive],
                "continuous": tuple(num) + ((spec.target,) if spec.target and spec.problem_type == "regression" else ())}
    return {}


def skip_reason(evaluation_id: str, exp: Experiment, spec: TableSpec, first_rate: float | None = None) -> str | None:
    """Why an evaluation isn't run, or None."""
    from tabtaint.plans import grid as GR
    code, *targets = [p for p in evaluation_id.split("#") if p != "NULL"]
    first_rate = GR.DEFAULT_RATES[0] if first_rate is None else first_rate
    if code in GR.CLASSIFICATION_ONLY and spec.problem_type != "classification" \
            or code in GR.REGRESSION_ONLY and spec.problem_type != "regression":
        return f"{code} does not apply to a {spec.problem_type} target."
    if exp.error is None and {"RH", "SH"} & set(targets):
        return "The experiment has no corrupted data."
    if exp.error and set(targets) <= {"R", "S"} and abs(exp.rate - first_rate) > 1e-9:
        return GR.BASELINE_REASON.format(rate=first_rate)
    return None


def run_evaluation(evaluation_id: str, experiment_id: str, df: DataFrame, spec: TableSpec, store: str,
                   profile: str = "local", force: bool = False, first_rate: float | None = None, **params) -> str:
    """EV0: one evaluation with its ledger row; returns ``done``, ``skipped`` or ``failed``.

    A skipped one leaves its reason, a failed one its message (and no score); ``force`` runs an
    evaluation that the ledger already has."""
    from tabtaint.plans import grid as GR
    spark, exp, task = df.sparkSession, Experiment.from_id(experiment_id), f"{evaluation_id}/{experiment_id}"
    reason = skip_reason(evaluation_id, exp, spec, first_rate)
    if reason is None and not force and not GR.read_ledger(spark, store, "evaluations").where(
            (F.col("evaluation_id") == evaluation_id) & (F.col("experiment_id") == experiment_id)).isEmpty():
        reason = GR.EXISTS_REASON
    if reason:
        GR.append_ledger(GR.ledger_row(spark, "skipped_computations", profile, reason=reason, computation_id=task), store,
                         "skipped_computations", f"{task}/{reason}")
        return "skipped"

    def run():
        return GR.timed(lambda: replay(evaluation_id, experiment_id, df, spec, store, **params).first())

    done, failure = GR.guarded(spark, experiment_id, profile, run, task=task)
    if failure is not None:
        GR.append_ledger(failure, store, "errors", task)
        return "failed"
    result, seconds = done
    _, first, second = evaluation_id.split("#")
    GR.append_ledger(GR.ledger_row(
        spark, "evaluations", profile, evaluation_id=evaluation_id, experiment_id=experiment_id, first_target=first,
        second_target=None if second == "NULL" else second, result=result["result"], notes=result["notes"],
        execution_time=seconds), store, "evaluations", task)
    return "done"


# ---------------------------------------------------------------- built-in evaluators

@evaluator("QLT", 2)
def _qlt(t, spec, **_):
    from tabtaint.operators.quality import quality_report
    num, cat = _cols(spec)
    tgt_num = [spec.target] if spec.target and spec.problem_type == "regression" else []
    tgt_cat = [spec.target] if spec.target and spec.problem_type == "classification" else []
    r = quality_report(t[0], t[1], num + tgt_num, cat + tgt_cat).first()
    return r["score"], {"column_shapes": r["column_shapes"], "column_pair_trends": r["column_pair_trends"]}


@evaluator("DCR", 2)
def _dcr(t, spec, seed=0, **_):
    from tabtaint.operators.neighbors import dcr
    num, cat = _whole(spec)
    r = dcr(t[0], t[1].withColumn(spec.row_key, F.col("draw_id").cast("string")) if "draw_id" in t[1].columns else t[1],
            num, cat, seed, spec.row_key).first()
    return r["score"], {"median_dcr_synthetic": r["median_dcr_synthetic"], "median_dcr_random": r["median_dcr_random"]}


@evaluator("LOF", 1)
def _lof(t, spec, n_neighbors=20, contamination="auto", details=None, **_):
    """``details``: a folder for the scores of all rows."""
    from tabtaint.operators.neighbors import lof
    num, cat = _whole(spec)
    return _outliers(lof(_keyed(t[0], spec), num, cat, n_neighbors, spec.row_key, contamination), details,
                     {"n_neighbors": n_neighbors, "contamination": contamination})


def _outliers(scores, details, notes):
    if details:
        scores.write.mode("overwrite").parquet(details)
        scores = scores.sparkSession.read.parquet(details)
    r = scores.agg(F.count_if("is_outlier").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return r["n"], notes | {"rows": r["rows"], "details": details}


@evaluator("IFO", 1)
def _ifo(t, spec, seed=0, contamination="auto", details=None, **_):
    from tabtaint.operators.iforest import isolation_forest
    num, cat = _whole(spec)
    return _outliers(isolation_forest(_keyed(t[0], spec), num, cat, 100, 256, seed, spec.row_key, contamination), details,
                     {"n_estimators": 100, "contamination": contamination})


@evaluator("HFD", 1)
def _hfd(t, spec, max_lhs=None, **_):
    from tabtaint.operators.fd import discover
    cols = [c for c in t[0].columns if c not in (spec.row_key, "draw_id")]
    fds = discover(t[0], cols, max_lhs=max_lhs)
    return len(fds), {"fds": [f"{','.join(lhs)} -> {rhs}" for lhs, rhs in fds]}


@evaluator("DFD", 1)
def _dfd(t, spec, seed=0, **_):
    from tabtaint.operators.fd import walk
    cols = [c for c in t[0].columns if c not in (spec.row_key, "draw_id")]
    fds = walk(t[0], cols, seed=seed)
    return len(fds), {"fds": [{"lhs": list(lhs), "rhs": rhs} for lhs, rhs in fds]}


@evaluator("LGD", 2)
def _lgd(t, spec, seed=0, **_):
    from tabtaint.operators.models import detection
    num, cat = _whole(spec)
    r = detection(_keyed(t[0], spec), _keyed(t[1], spec), num, cat, seed, "logistic", spec.row_key).first()
    return r["score"], {"fold_auc": r["fold_auc"]}


@evaluator("SVD", 2)
def _svd(t, spec, seed=0, **_):
    from tabtaint.operators.models import detection
    num, cat = _whole(spec)
    r = detection(_keyed(t[0], spec), _keyed(t[1], spec), num, cat, seed, "svc", spec.row_key).first()
    return r["score"], {"fold_auc": r["fold_auc"]}


@evaluator("EFF", 2)
def _eff(t, spec, seed=0, **_):
    from tabtaint.operators.models import efficacy
    num, cat = _cols(spec)
    r = efficacy(t[1], t[0], num, cat, spec.target, spec.problem_type, seed).first()
    return r["score"], {"task": r["task"], "metric": r["metric"]}


def _augmentation(t, spec, validation, minority, fixed, seed):
    from tabtaint.operators.models import augmentation_classification
    num, cat = _cols(spec)
    cols = num + cat + [spec.target]
    r = augmentation_classification(t[0].select(cols), t[1].select(cols), validation.select(cols), num, cat, spec.target,
                                    minority, fixed, seed=seed).first()
    return r["score"], {"augmented_data": r["augmented_data"], "real_data_baseline": r["real_data_baseline"],
                        "minority_label": minority}


@evaluator("APR", 2)
def _apr(t, spec, validation=None, minority=None, seed=0, **_):
    return _augmentation(t, spec, validation, minority, "recall", seed)


@evaluator("ARC", 2)
def _arc(t, spec, validation=None, minority=None, seed=0, **_):
    return _augmentation(t, spec, validation, minority, "precision", seed)


@evaluator("AR2", 2)
def _ar2(t, spec, validation=None, seed=0, **_):
    from tabtaint.operators.models import augmentation_regression
    num, cat = _cols(spec)
    cols = num + cat + [spec.target]
    r = augmentation_regression(t[0].select(cols), t[1].select(cols), validation.select(cols), num, cat, spec.target, seed).first()
    return r["r2_improvement"], r.asDict()


@evaluator("DPR", 2)
def _dpr(t, spec, known=None, sensitive=None, continuous=(), **_):
    from tabtaint.operators.privacy import disclosure_protection
    r = disclosure_protection(t[0], t[1], known, sensitive, continuous).first()
    return r["score"], {"cap_protection": r["cap_protection"], "baseline_protection": r["baseline_protection"]}


def _keyed(df, spec):
    return df if spec.row_key in df.columns else df.withColumn(spec.row_key, F.col("draw_id").cast("string"))
