"""Model-quality metrics as aggregations over a (label, prediction) table (ML6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.operators.ordered import auc_from_counts


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R^2, MSE, MAE in one aggregation (R^2 = 1 - SSE / SST)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = df.agg(F.avg(y).alias("mu"), F.count(F.lit(1)).alias("n")).first()
    return df.agg(
        (F.lit(1.0) - F.sum((y - p) * (y - p)) / F.sum((y - F.lit(a["mu"])) * (y - F.lit(a["mu"])))).alias("r2"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"))


def per_class_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``class, support, precision, recall, f1`` for every class seen as label or prediction."""
    # one pass over the predictions: each pair of label and prediction counts for both classes (nulls of the two sides apart)
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hits = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(*[F.struct(F.col(c).alias("class"), F.when(F.col(c).isNull(), F.lit(c)).alias("side"), *counts) for c, counts in (
        ("y", [F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hits.cast("bigint").alias("tp")]),
        ("p", [F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")]))])
    j = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("class", "side") \
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return j.select("class", "support", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))


def f1_scores(df: DataFrame, label: str = "label", prediction: str = "prediction", positive=None) -> DataFrame:
    """weighted F1 (support-weighted), macro F1, and binary F1 for ``positive`` when given."""
    pc = per_class_f1(df, label, prediction)
    out = pc.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
                 F.avg("f1").alias("f1_macro"))
    if positive is not None:
        pos = pc.where(F.col("class") == F.lit(str(positive))).agg(F.max("f1").alias("f1_binary"))
        out = out.withColumn("f1_binary", F.lit(pos.first()[0]).cast("double"))
    return out


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> float:
    """Exact ROC AUC (ties count one half) from per-score counts; no global sort in one task."""
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == F.lit(positive)).alias("pos"),
        F.count_if(F.col(label) != F.lit(positive)).alias("neg"))
    return auc_from_counts(per, "s", "pos", "neg")
