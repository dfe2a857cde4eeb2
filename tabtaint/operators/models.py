"""Model-based evaluators on MLlib (DET1, DET2, ML1-ML5).

Named deviations from the reference's libraries: gradient-boosted trees stand in for
XGBoost (ML2/ML3); the RBF SVC detector uses random Fourier features (Rahimi & Recht 2007)
with a linear SVM (DET2); AdaBoost (ML1 binary) is in :mod:`boost`.
Folds, thresholds and metrics are distributed jobs; only fitted models and a few numbers
are on the driver.
"""

from __future__ import annotations



import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.encoders import mllib_features
from tabtaint.functions.metrics import f1_scores, regression_metrics, roc_auc
from tabtaint.functions.rng import py_hash
from tabtaint.operators import boost
from tabtaint.operators.sampling import number_by_hash
from tabtaint.session import cut_lineage
from tabtaint.operators.profile import bounded_values

N_FOLDS = 3


def _parallel(fn, items, workers: int = 3) -> list:
    """Independent model fits submitted as concurrent Spark jobs from a few driver threads."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    with ThreadPoolExecutor(max_workers=min(workers, max(len(items), 1))) as pool:
        return list(pool.map(fn, items))


def _features(train: DataFrame, others, numeric, categorical):
    model, tr = mllib_features(train, numeric, categorical, "features")
    return tr, [model.transform(_prep(o, numeric)) for o in others]


#: Bytes of a forest's training rows in one task; MLlib holds a count for each tree with every row.
FOREST_BYTES = 64 << 20


def _dealt(df: DataFrame, num_trees: int) -> DataFrame:
    """Training rows for a forest in as many partitions as their number and that of the trees ask for."""
    n = math.ceil(df.count() * (8 * num_trees + 200) / FOREST_BYTES)
    return df.repartition(n) if n > df.sparkSession.sparkContext.defaultParallelism else df


def _prep(df, numeric):
    for c in numeric:
        df = df.withColumn(f"_{c}_num", F.col(c).cast("double"))
    return df


# ---------------------------------------------------------------- detection (DET1, DET2)

def _fold_table(real: DataFrame, syn: DataFrame, cols, key, seed):
    r = real.select(*cols, F.col(key).cast("string").alias("_k"), F.lit(0.0).alias("label"))
    s = syn.select(*cols, F.concat(F.lit("s:"), F.col(key).cast("string")).alias("_k"), F.lit(1.0).alias("label"))
    both = r.unionByName(s)
    numbered, _ = number_by_hash(both, "_k", seed, "folds", group="label")
    return numbered.withColumn("fold", (F.col("_pos") % N_FOLDS).cast("int")).drop("_pos")


def _rff(df: DataFrame, dims: int, n_components: int, gamma: float, seed) -> DataFrame:
    rng = np.random.default_rng(int(py_hash(seed, "rff", "")[:15], 16))
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dims, n_components))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    bc = df.sparkSession.sparkContext.broadcast((W, b))
    df = df.select("label", "_x")                       # Arrow cannot carry ML vectors
    schema = "label double, _x array<double>, _rff array<double>"

    def run(it):
        Wb, bb = bc.value
        for pdf in it:
            X = np.array(pdf["_x"].tolist(), dtype=float).reshape(len(pdf), dims)
            Z = math.sqrt(2.0 / n_components) * np.cos(X @ Wb + bb)
            yield pd.DataFrame({"label": pdf["label"], "_x": pdf["_x"], "_rff": list(Z)})
    return df.mapInPandas(run, schema)


def detection(real: DataFrame, syn: DataFrame, numeric, categorical, seed, method: str = "logistic",
              key: str = "row_key", rff_components: int = 100) -> DataFrame:
    """DET1 (logistic) / DET2 (svc): ``score = 1 - mean_folds(max(0.5, AUC) * 2 - 1)``."""
    cols = list(numeric) + list(categorical)
    data = _fold_table(real, syn, cols, key, seed)
    data = cut_lineage(data)
    def fold_auc(k):
        tr, te = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        ftr, (fte,) = _features(tr, [te], numeric, categorical)
        sc = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(ftr)
        ztr, zte = sc.transform(ftr), sc.transform(fte)
        if method == "logistic":
            m = LogisticRegression(featuresCol="z", labelCol="label", maxIter=100).fit(ztr)
            pred = m.transform(zte).withColumn("s", vector_to_array("probability")[1])
        else:
            dims = len(ztr.select("z").first()[0])
            gamma = 1.0 / max(dims, 1)          # 'scale' on standardised features (variance 1)
            ztr2 = _rff(ztr.withColumn("_x", vector_to_array("z")), dims, rff_components, gamma, seed) \
                .withColumn("r", array_to_vector("_rff"))
            zte2 = _rff(zte.withColumn("_x", vector_to_array("z")), dims, rff_components, gamma, seed) \
                .withColumn("r", array_to_vector("_rff"))
            m = LinearSVC(featuresCol="r", labelCol="label", maxIter=100).fit(ztr2)
            pred = m.transform(zte2).withColumn("s", vector_to_array("rawPrediction")[1])
        return roc_auc(pred, "label", "s", 1.0)
    aucs = _parallel(fold_auc, range(N_FOLDS))
    score = 1.0 - float(np.mean([max(0.5, a) * 2 - 1 for a in aucs]))
    return real.sparkSession.createDataFrame([(score, [float(a) for a in aucs])], "score double, fold_auc array<double>")


# ---------------------------------------------------------------- ML1 efficacy

def efficacy(syn: DataFrame, real: DataFrame, numeric, categorical, target: str, problem_type: str,
             seed=0, ada_rounds: int = 50) -> DataFrame:
    """ML1: train on synthetic, test on real.  regression -> R^2 (LinearRegression);
    multiclass -> macro F1 (decision tree); binary -> F1 of boosted stumps (:mod:`boost`)."""
    spark = syn.sparkSession
    if problem_type == "regression":
        ftr, (fte,) = _features(syn.withColumn("label", F.col(target).cast("double")),
                                [real.withColumn("label", F.col(target).cast("double"))], numeric, categorical)
        m = LinearRegression(featuresCol="features", labelCol="label").fit(ftr)
        r2 = regression_metrics(m.transform(fte), "label", "prediction").first()["r2"]
        return spark.createDataFrame([("regression", "r2", r2)], "task string, metric string, score double")
    classes = sorted(bounded_values(syn.select(F.col(target).cast("string").alias("_t")).union(
        real.select(F.col(target).cast("string").alias("_t"))), "_t"))
    code = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])
    lab = F.element_at(code, F.col(target).cast("string"))
    if len(classes) <= 2:
        binned, stumps = boost.fit(syn.withColumn("label", lab), numeric, categorical, ada_rounds)
        pred = boost.predict(real.withColumn("label", lab), binned, stumps)
        f1 = f1_scores(pred, "label", "prediction", positive="1.0").first()["f1_binary"]
        return spark.createDataFrame([("binary", "f1", f1)], "task string, metric string, score double")
    ftr, (fte,) = _features(syn.withColumn("label", lab), [real.withColumn("label", lab)], numeric, categorical)
    m = DecisionTreeClassifier(labelCol="label", seed=0).fit(ftr)
    f1 = f1_scores(m.transform(fte), "label", "prediction").first()["f1_macro"]
    return spark.createDataFrame([("multiclass", "f1_macro", f1)], "task string, metric string, score double")


# ---------------------------------------------------------------- ML2 / ML3 augmentation (classification)

def _threshold_for(pred: DataFrame, fixed: str, target_value: float):
    """Largest threshold reaching recall >= target (fixed='recall'), or smallest reaching
    precision >= target (fixed='precision'), from per-score counts.

    Probabilities are grouped on a 1e-6 grid, so the driver receives at most 1,000,001 rows
    whatever the table size (a bound by construction); thresholds are exact on that grid.
    """
    per = pred.groupBy(F.round(F.col("s"), 6).alias("s")).agg(F.count_if(F.col("label") == 1.0).alias("pos"),
                                                  F.count(F.lit(1)).alias("n"))
    rows = sorted(((r["s"], r["pos"], r["n"]) for r in per.collect()), reverse=True)
    P = sum(p for _, p, _ in rows)
    tp = npred = 0
    best = None
    for s, p, n in rows:
        tp += p
        npred += n
        rec = tp / P if P else 0.0
        prec = tp / npred if npred else 0.0
        if fixed == "recall" and rec >= target_value:
            return s
        if fixed == "precision" and prec >= target_value:
            best = s
    return best if best is not None else (rows[0][0] if rows else 0.5)


def _prec_rec(pred: DataFrame, thr: float):
    r = pred.agg(F.count_if((F.col("s") >= thr) & (F.col("label") == 1.0)).alias("tp"),
                 F.count_if(F.col("s") >= thr).alias("pp"), F.count_if(F.col("label") == 1.0).alias("p")).first()
    prec = r["tp"] / r["pp"] if r["pp"] else 0.0
    rec = r["tp"] / r["p"] if r["p"] else 0.0
    return prec, rec


def augmentation_classification(real: DataFrame, syn: DataFrame, validation: DataFrame, numeric, categorical,
                                target: str, minority, fixed: str = "recall", fixed_value: float = 0.9,
                                seed=0) -> DataFrame:
    """ML2 (fixed recall -> precision gain) / ML3 (fixed precision -> recall gain).

    ``score = max(0, augmented - baseline)``; GBT classifier, minority label = positive.
    """
    lab = (F.col(target).cast("string") == F.lit(str(minority))).cast("double")

    def run(train):
        ftr, (fv,) = _features(train.withColumn("label", lab), [validation.withColumn("label", lab)], numeric, categorical)
        m = GBTClassifier(labelCol="label", maxIter=50, seed=0).fit(ftr)
        ptr = m.transform(ftr).withColumn("s", vector_to_array("probability")[1])
        pv = m.transform(fv).withColumn("s", vector_to_array("probability")[1])
        thr = _threshold_for(ptr, fixed, fixed_value)
        prec, rec = _prec_rec(pv, thr)
        return prec if fixed == "recall" else rec
    base, aug = _parallel(run, [real, real.select(*syn.columns).unionByName(syn)])
    score = max(0.0, aug - base)
    return real.sparkSession.createDataFrame([(score, aug, base)], "score double, augmented_data double, real_data_baseline double")


# ---------------------------------------------------------------- ML4 augmentation (regression)

def augmentation_regression(real: DataFrame, syn: DataFrame, validation: DataFrame, numeric, categorical,
                            target: str, seed=0, num_trees: int = 100) -> DataFrame:
    """ML4: random forest on real vs real+synthetic, scored on validation; improvements as
    ``R2_aug - R2_base``, ``MSE_base - MSE_aug``, ``MAE_base - MAE_aug``."""
    lab = F.col(target).cast("double")

    def run(train):
        ftr, (fv,) = _features(train.withColumn("label", lab), [validation.withColumn("label", lab)], numeric, categorical)
        m = RandomForestRegressor(labelCol="label", numTrees=num_trees, seed=int(py_hash(seed, "rf", "")[:7], 16)).fit(_dealt(ftr, num_trees))
        return regression_metrics(m.transform(fv), "label", "prediction").first()
    b, a = _parallel(run, [real, real.select(*syn.columns).unionByName(syn)])
    row = (b["r2"], b["mse"], b["mae"], a["r2"], a["mse"], a["mae"], a["r2"] - b["r2"], b["mse"] - a["mse"], b["mae"] - a["mae"])
    return real.sparkSession.createDataFrame([row], "baseline_r2 double, baseline_mse double, baseline_mae double, "
                                                    "augmented_r2 double, augmented_mse double, augmented_mae double, "
                                                    "r2_improvement double, mse_improvement double, mae_improvement double")


# ---------------------------------------------------------------- ML5 utility of the worked example

def utility_f1(syn: DataFrame, heldout: DataFrame, numeric, categorical, target: str, num_trees: int = 50,
               placeholders=("?", -1)) -> float:
    """ML5: placeholders -> null, numeric nulls <- synthetic median, categorical nulls ->
    'missing_value', labels encoded on the union vocabulary, RF(50) trained on synthetic,
    weighted F1 on the held-out table."""
    from tabtaint.operators.clean import impute, placeholders_to_null
    s = placeholders_to_null(syn, list(placeholders))
    h = placeholders_to_null(heldout, list(placeholders))
    s, h, _ = impute(s, h, numeric, list(categorical) + [target])
    classes = sorted(bounded_values(s.select(target).union(h.select(target)), target))
    code = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])
    ftr, (fte,) = _features(s.withColumn("label", F.element_at(code, F.col(target))),
                            [h.withColumn("label", F.element_at(code, F.col(target)))], numeric, categorical)
    m = RandomForestClassifier(labelCol="label", numTrees=num_trees, seed=42).fit(_dealt(ftr, num_trees))
    return f1_scores(m.transform(fte), "label", "prediction").first()["f1_weighted"]
