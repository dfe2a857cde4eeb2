"""Privacy scores: disclosure protection (DPR1) and distance to closest record (DCR1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.operators.profile import equal_width_bin

N_BINS = 10


def disclosure_protection(real: DataFrame, syn: DataFrame, known, sensitive, continuous=()) -> DataFrame:
    """DPR1 (CAP): for each real row, the share of synthetic rows with the same known-key whose
    sensitive tuple equals the real one; real rows whose key has no synthetic match are skipped.

    ``cap_protection = 1 - mean(share)``, ``baseline_protection = 1 - 1/#distinct sensitive
    tuples (real)``, ``score = min(1, cap / baseline)``.  Everything is pre-aggregated by
    (known, sensitive) before the equi join, so a hot key costs one row, not a third of the table.
    """
    known, sensitive = list(known), list(sensitive)
    if not known or not sensitive or set(known) & set(sensitive):
        raise ValueError("known and sensitive columns are required and must be disjoint")
    cont = [c for c in continuous if c in known + sensitive]
    if cont:
        mm = real.agg(*[x for c in cont for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()

        def disc(df):
            return df.select(*[equal_width_bin(F.col(c).cast("double"), F.lit(float(mm[f"lo_{c}"])),
                                               F.lit(float(mm[f"hi_{c}"])), N_BINS).alias(c) if c in cont else F.col(c)
                               for c in known + sensitive])
        real, syn = disc(real), disc(syn)
    ks = [F.col(c).cast("string").alias(f"k_{i}") for i, c in enumerate(known)]
    ss = [F.col(c).cast("string").alias(f"s_{i}") for i, c in enumerate(sensitive)]
    kcols = [f"k_{i}" for i in range(len(known))]
    scols = [f"s_{i}" for i in range(len(sensitive))]
    r = real.select(*ks, *ss).groupBy(*kcols, *scols).agg(F.count(F.lit(1)).alias("nr"))
    s_ks = syn.select(*ks, *ss).groupBy(*kcols, *scols).agg(F.count(F.lit(1)).alias("ns"))
    s_k = s_ks.groupBy(*kcols).agg(F.sum("ns").alias("nk"))
    j = (r.join(s_k, kcols)                                   # keys with a synthetic match only
         .join(s_ks, kcols + scols, "left")
         .select("nr", (F.coalesce(F.col("ns"), F.lit(0)) / F.col("nk")).alias("share")))
    agg = j.agg((F.sum(F.col("nr") * F.col("share")) / F.sum("nr")).alias("mean_share"))
    n_sens = real.select(*ss).distinct().agg(F.count(F.lit(1)).alias("n_sens"))
    mean_share = agg.first()["mean_share"]
    n_cat = n_sens.first()["n_sens"]
    cap = None if mean_share is None else 1.0 - mean_share
    base = 1.0 - 1.0 / n_cat if n_cat else None
    score = None if cap is None or not base else min(1.0, cap / base)
    return real.sparkSession.createDataFrame([(score, cap, base)],
                                             "score double, cap_protection double, baseline_protection double")
