"""Experiment grid, evaluation tasks, skip rules, result ledger and result analytics
(GRD1-GRD10, JN1, JN2, JN4, JN8, SNK4-SNK5, RES1-RES5).

The grid is a small dimension product built with ``explode`` over literal dimension arrays
(bounded by #datasets x #seeds x #models x #errors x #rates x #levels); the work list is
the grid minus the ledgers (left anti joins), so a re-run only does what is missing.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtaint.functions.strings import evaluation_id, experiment_id

# fixed values: codes and default dimensions of the experiment grid
EXPERIMENT_TYPES = ["NOR", "PRI", "AUG", "REB"]
PERFECTNESS = ["PERF", "IMP", "SEMI"]
ERROR_TYPES = ["SFT", "NOI", "PLC", "DUP", "OUT", "INC", "LER"]
TARGETS = ["R", "S", "RH", "SH"]
DEFAULT_SEEDS = [100, 200, 300]
DEFAULT_RATES = [0.1, 0.2, 0.4]
GENERIC_MODELS = ["ctgan", "nflow", "rtvae", "tvae", "ddpm", "arf", "marginal_distributions",
                  "bayesian_network", "great", "realtabformer", "tabpfn", "tabebm"]
EXCLUDED_MODELS = ["tabebm", "arf", "realtabformer"]
PRIVACY_MODELS = ["adsgan", "pategan", "aim", "dpgan", "decaf", "privbayes"]
SINGULAR_METHODS = ["DFD", "HFD", "IFO", "LOF"]
DUAL_METHODS = ["DCR", "DPR", "APR", "ARC", "AR2", "EFF", "QLT", "LGD", "SVD"]
QUALITY_METHODS = ["DFD", "HFD", "IFO", "LOF", "QLT", "LGD", "SVD"]
PRIVACY_METHODS = ["DCR", "DPR"]
ML_METHODS = ["APR", "ARC", "AR2", "EFF"]
SINGULAR_TARGETS = [("R",), ("RH",), ("S",), ("SH",)]
DUAL_TARGETS = [("R", "S"), ("RH", "SH"), ("R", "RH"), ("S", "SH"), ("R", "SH")]
CLASSIFICATION_ONLY = ["APR", "ARC"]
REGRESSION_ONLY = ["AR2"]
SEMI_ONLY_RATE = 0.4
BASELINE_REASON = "The perfect baseline is only computed for error rate: {rate}."
EXISTS_REASON = "Already exists in the ledger."

LEDGER_SCHEMAS = {
    "errors": "id long, experiment_id string, file_path string, error_message string, execution_profile string, "
              "created_at timestamp",
    "skipped_computations": "id long, computation_id string, reason string, execution_profile string, created_at timestamp",
    "evaluations": "evaluation_id string, experiment_id string, first_target string, second_target string, "
                   "result double, notes string, execution_time double, execution_profile string, created_at timestamp",
    "corrupted_rows": "experiment_id string, row_key string",
    "experiments": "experiment_id string, experiment_type string, dataset_name string, random_seed long, "
                   "data_perfectness string, data_error string, error_rate string, generator string, "
                   "training_size long, synthetic_size long, execution_time double, corrupted_rows array<string>, "
                   "corrupted_cols array<string>, execution_profile string, created_at timestamp",
}


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def models(exclude=EXCLUDED_MODELS) -> list[str]:
    return [m for m in GENERIC_MODELS if m not in exclude]


def perfect_grid(datasets: DataFrame, seeds=DEFAULT_SEEDS, model_names=None, name_col: str = "dataset_name") -> DataFrame:
    """GRD1: seed x dataset x model, perfect data, no error."""
    model_names = model_names or models()
    g = (datasets.select(F.col(name_col).alias("dataset_name"))
         .withColumn("random_seed", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in seeds])))
         .withColumn("generator", F.explode(_arr(model_names)))
         .withColumn("experiment_type", F.lit("NOR"))
         .withColumn("data_perfectness", F.lit("PERF"))
         .withColumn("data_error", F.lit(None).cast("string"))
         .withColumn("error_rate", F.lit(None).cast("double")))
    return _with_id(g)


def imperfect_grid(datasets: DataFrame, seeds=DEFAULT_SEEDS, model_names=None, errors=ERROR_TYPES,
                   rates=DEFAULT_RATES, levels=("IMP", "SEMI"), name_col: str = "dataset_name") -> DataFrame:
    """GRD2: x error x rate x level; SEMI only at rate 0.4 and never for DUP."""
    model_names = model_names or models()
    g = (datasets.select(F.col(name_col).alias("dataset_name"))
         .withColumn("random_seed", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in seeds])))
         .withColumn("generator", F.explode(_arr(model_names)))
         .withColumn("data_error", F.explode(_arr(errors)))
         .withColumn("error_rate", F.explode(F.array(*[F.lit(float(x)) for x in rates])))
         .withColumn("data_perfectness", F.explode(_arr(list(levels))))
         .withColumn("experiment_type", F.lit("NOR"))
         .where(~((F.col("data_perfectness") == "SEMI") &
                  ((F.abs(F.col("error_rate") - F.lit(SEMI_ONLY_RATE)) > 1e-9) | (F.col("data_error") == "DUP")))))
    return _with_id(g)


def _with_id(g: DataFrame) -> DataFrame:
    return g.withColumn("experiment_id", experiment_id(
        F.col("experiment_type"), F.col("dataset_name"), F.col("random_seed"), F.col("data_perfectness"),
        F.col("data_error"), F.col("error_rate"), F.col("generator"))).select(
        "experiment_id", "experiment_type", "dataset_name", "random_seed", "data_perfectness", "data_error",
        "error_rate", "generator")


def evaluation_tasks(experiments: DataFrame, problem_types: DataFrame, methods=QUALITY_METHODS + ML_METHODS,
                     first_rate: float = DEFAULT_RATES[0]) -> tuple[DataFrame, DataFrame]:
    """GRD3 + EV1 + GRD4: (tasks, skipped).

    Each method gets 4 singular or 5 dual target tuples; methods incompatible with the
    dataset's problem type are dropped; baseline tuples (targets within {R, S}) of a
    corrupted experiment are kept only at the first error rate, the others go to ``skipped``
    with the reason text.
    """
    single = [m for m in methods if m in SINGULAR_METHODS]
    dual = [m for m in methods if m in DUAL_METHODS]
    tuples = F.array(
        *[F.struct(F.lit(m).alias("method"), F.lit(t[0]).alias("first_target"), F.lit(None).cast("string").alias("second_target"))
          for m in single for t in SINGULAR_TARGETS],
        *[F.struct(F.lit(m).alias("method"), F.lit(t[0]).alias("first_target"), F.lit(t[1]).alias("second_target"))
          for m in dual for t in DUAL_TARGETS])
    x = (experiments.join(F.broadcast(problem_types), "dataset_name", "left")   # one row per dataset
         .withColumn("t", F.explode(tuples)).select("*", "t.*").drop("t"))
    compatible = ~(((F.col("method").isin(*CLASSIFICATION_ONLY)) & (F.col("problem_type") != "classification")) |
                   ((F.col("method").isin(*REGRESSION_ONLY)) & (F.col("problem_type") != "regression")))
    x = x.where(compatible)
    baseline = (F.col("first_target").isin("R", "S") & F.coalesce(F.col("second_target").isin("R", "S"), F.lit(True)))
    repeat = F.col("data_error").isNotNull() & baseline & (F.abs(F.col("error_rate") - F.lit(first_rate)) > 1e-9)
    x = x.withColumn("evaluation_id", evaluation_id(F.col("method"), F.col("first_target"), F.col("second_target")))
    tasks = x.where(~repeat).select("evaluation_id", "experiment_id", "method", "first_target", "second_target")
    skipped = x.where(repeat).select(F.concat(F.col("evaluation_id"), F.lit("/"), F.col("experiment_id")).alias("computation_id"),
                                     F.lit(BASELINE_REASON.format(rate=first_rate)).alias("reason"))
    return tasks, skipped


def pending_experiments(grid: DataFrame, experiments: DataFrame, errors: DataFrame, skipped: DataFrame,
                        force: bool = False) -> DataFrame:
    """JN1 / GRD5: experiments not yet in any of the three ledgers (one anti join);
    ``force`` re-runs everything."""
    if force:
        return grid
    done = (experiments.select("experiment_id")
            .unionByName(errors.select("experiment_id"))
            .unionByName(skipped.select(F.col("computation_id").alias("experiment_id"))))
    return grid.join(done, "experiment_id", "left_anti")


def pending_evaluations(tasks: DataFrame, evaluations: DataFrame, force: bool = False) -> DataFrame:
    """JN2: evaluation tasks whose (evaluation_id, experiment_id) is not in the ledger."""
    if force:
        return tasks
    return tasks.join(evaluations.select("evaluation_id", "experiment_id"), ["evaluation_id", "experiment_id"], "left_anti")


def perfect_counterparts(experiments: DataFrame) -> DataFrame:
    """JN8: each corrupted experiment with its perfect counterpart (same type, dataset, seed, generator)."""
    perf = experiments.where(F.col("data_perfectness") == "PERF").select(
        "experiment_type", "dataset_name", "random_seed", "generator", F.col("experiment_id").alias("perfect_experiment_id"))
    return (experiments.where(F.col("data_perfectness") != "PERF")
            .join(perf, ["experiment_type", "dataset_name", "random_seed", "generator"], "left")
            .select("experiment_id", "perfect_experiment_id"))


def task_json(tasks: DataFrame, params: Column | None = None) -> DataFrame:
    """GRD10: ``{evaluation_id, experiment_id, params}`` JSON records (one per task)."""
    p = params if params is not None else F.create_map().cast("map<string,string>")
    return tasks.select("evaluation_id", "experiment_id",
                        F.to_json(F.struct("evaluation_id", "experiment_id", p.alias("params"))).alias("task"))


# ---------------------------------------------------------------- ledger rows (SNK4, SNK5, RES5)

def ledger_row(spark, table: str, profile: str, **values) -> DataFrame:
    """One typed ledger row with ``execution_profile`` and ``created_at`` filled in."""
    schema = LEDGER_SCHEMAS[table]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    row = {n: values.get(n) for n in names}
    row["execution_profile"] = profile
    df = spark.createDataFrame([tuple(row[n] for n in names)], schema)
    return df.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp()))


#: What tells a ledger's rows apart; of rows with equal values the latest counts.
LEDGER_KEYS = {"errors": ["experiment_id", "file_path"], "skipped_computations": ["computation_id", "reason"],
               "evaluations": ["evaluation_id", "experiment_id"], "experiments": ["experiment_id"]}


def append_ledger(df: DataFrame, path: str, table: str, key: str | None = None):
    """SNK4: rows into a Parquet ledger table (``<path>/<table>``).

    Rows written under a ``key`` are a folder of their own that is replaced as a whole, so a retried run
    leaves them once; without one they get a new folder.  Spark's committer makes a folder's rows
    visible together."""
    name = f"k{uuid.uuid4().hex}" if key is None else hashlib.sha1(key.encode()).hexdigest()
    df.write.mode("overwrite").parquet(f"{path}/{table}/key={name}")


def read_ledger(spark, path: str, table: str) -> DataFrame:
    """The ledger table, the latest row of each key; one that was never written is empty, any other
    error is raised."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema(LEDGER_SCHEMAS[table]).option("recursiveFileLookup", "true").parquet(f"{path}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMAS[table])
    if table not in LEDGER_KEYS:
        return rows
    w = Window.partitionBy(*LEDGER_KEYS[table]).orderBy(F.desc("created_at"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def compact_ledger(spark, path: str, table: str) -> int:
    """Writes the table's folders as one and drops them; returns how many there were.

    The new folder is renamed into place before the old ones go: if the driver is lost in between, rows
    are there twice and :func:`read_ledger` counts them once.  Meant for a time without writers."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/{table}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("key=")] if fs.exists(root) else []
    if len(old) > 1:
        name = f"c{uuid.uuid4().hex}"
        staged = hadoop.Path(f"{path}/.staged/{table}-{name}")
        read_ledger(spark, path, table).coalesce(8).write.parquet(staged.toString())
        if not fs.rename(staged, hadoop.Path(f"{path}/{table}/key={name}")):
            raise OSError(f"could not move {staged} into place")
        for f in old:
            fs.delete(f, True)
    return len(old)


def known_experiment(spark, path: str, experiment: str) -> bool:
    """GRD5: whether the experiment is in any of the three ledgers."""
    return not all(read_ledger(spark, path, t).where(F.col(c) == experiment).isEmpty() for t, c in (
        ("experiments", "experiment_id"), ("errors", "experiment_id"), ("skipped_computations", "computation_id")))


def timed(fn, *args, **kw):
    """Run ``fn`` and return ``(result, seconds rounded to 2 decimals)``."""
    t = time.time()
    out = fn(*args, **kw)
    return out, round(time.time() - t, 2)


def guarded(spark, experiment_id_value: str, profile: str, fn, *args, task: str | None = None, **kw):
    """RES5: run a job; on failure return an ``errors`` ledger row instead of raising.  ``task`` names
    what has failed, in the row's ``file_path``."""
    try:
        return fn(*args, **kw), None
    except Exception as e:  # noqa: BLE001 — the failure is recorded, the sweep continues
        return None, ledger_row(spark, "errors", profile, experiment_id=experiment_id_value, file_path=task, error_message=str(e))


# ---------------------------------------------------------------- result analytics (RES1-RES3)

def score_matrix(results: DataFrame, row: str = "model", col: str = "scenario", value: str = "score",
                 columns=None) -> DataFrame:
    """RES1: ``model x scenario`` matrix (pivot; pass ``columns`` to skip the distinct probe)."""
    g = results.groupBy(row)
    return (g.pivot(col, list(columns)) if columns else g.pivot(col)).agg(F.first(value))


def best_scenario(results: DataFrame, row: str = "model", col: str = "scenario", value: str = "score",
                  exclude=("Clean (Baseline)",)) -> DataFrame:
    """RES2 / TOP1: argmax scenario per model."""
    r = results.where(~F.col(col).isin(*exclude)) if exclude else results
    return r.groupBy(row).agg(F.max_by(F.col(col), F.col(value)).alias("best_scenario"),
                              F.max(value).alias("best_score"))


def baseline_gap(results: DataFrame, baseline: str = "Clean (Baseline)", row: str = "model", col: str = "scenario",
                 value: str = "score") -> DataFrame:
    """RES3: score minus the model's baseline score, per model and scenario."""
    base = results.where(F.col(col) == baseline).select(row, F.col(value).alias("_base"))
    return (results.where(F.col(col) != baseline).join(base, row)
            .select(row, col, value, (F.col(value) - F.col("_base")).alias("gap")))
