"""Bayesian-network generators: Chow-Liu trees (GEN2) and PrivBayes of any degree (GEN3).

Counting and sampling are Spark's: the contingency cells of many attribute sets come from one
aggregation and stay a table, from which mutual information is summed (one number a set reaches the
driver) and the conditional distributions are taken.  Ancestral sampling gives each draw a position in
the running counts of its parents' values and finds the value whose interval holds it, by the equi
join of :mod:`tabtaint.operators.intervals` (JN6); the root's parents are the empty set, one value
among others.  No cell, and no product of domains, is collected.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.rng import py_uniform, uniform
from tabtaint.operators.intervals import MISSING, along, join_intervals
from tabtaint.operators.profile import equal_width_bin
from tabtaint.session import cut_lineage

N_BINS = 10
#: PrivBayes: the least ratio of information to noise of a marginal, and the most parents that are tried.
THETA, MAX_DEGREE = 4.0, 3
#: A noisy count is kept as a whole number of this many parts.
WEIGHT_PARTS = 1024


def discretise(df: DataFrame, numeric, categorical, n_bins: int = N_BINS):
    """Codes as strings: numeric -> equal-width bin index, categorical -> the value."""
    mm = df.agg(*[x for c in numeric for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() if numeric else {}
    bounds = {c: (float(mm[f"lo_{c}"]), float(mm[f"hi_{c}"])) for c in numeric}
    cols = [equal_width_bin(F.col(c).cast("double"), F.lit(bounds[c][0]), F.lit(bounds[c][1]), n_bins).cast("string").alias(c)
            for c in numeric] + [F.col(c).cast("string").alias(c) for c in categorical]
    return df.select(*cols), bounds


def _text(columns) -> Column:
    """Values of some columns as one text, each behind its length; nulls are a value."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns]
    return F.concat(F.lit(""), *[x for v in parts for x in (F.length(v).cast("string"), F.lit(":"), v)])


def set_counts(d: DataFrame, sets) -> DataFrame:
    """``s, a, b, n`` for each (parents, child) of ``sets``, in one aggregation: ``a`` is the parents'
    values as text, ``b`` the child's."""
    items = [F.struct(F.lit(i).alias("s"), _text(parents).alias("a"), F.coalesce(F.col(child), F.lit(MISSING)).alias("b"))
             for i, (parents, child) in enumerate(sets)]
    return d.select(F.explode(F.array(*items)).alias("x")).groupBy("x.s", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))


def information(d: DataFrame, sets) -> list[float]:
    """Mutual information of each (parents, child), summed over its cells."""
    sets = list(sets)
    if not sets:
        return []
    cells = cut_lineage(set_counts(d, sets))
    left = cells.groupBy("s", "a").agg(F.sum("n").alias("na"))
    right = cells.groupBy("s", "b").agg(F.sum("n").alias("nb"))
    log = F.log("n") - F.log("na") - F.log("nb")
    rows = cells.join(left, ["s", "a"]).join(right, ["s", "b"]).groupBy("s") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * log).alias("t")).collect()    # one row a set
    out = [0.0] * len(sets)
    for r in rows:
        out[r["s"]] = max(0.0, r["t"] / r["n"] + math.log(r["n"]))
    return out


def mutual_information(d: DataFrame, columns) -> dict:
    pairs = list(combinations(columns, 2))
    return dict(zip(pairs, information(d, [((a,), b) for a, b in pairs])))


def chow_liu_tree(mi: dict, columns) -> list:
    """Maximum spanning tree (Prim from the first column): ``[(parent, child)]`` in order."""
    columns = list(columns)
    if not columns:
        return []
    inside, edges = {columns[0]}, []
    while len(inside) < len(columns):
        best = None
        for a in inside:
            for b in columns:
                if b in inside:
                    continue
                w = mi.get((a, b), mi.get((b, a), 0.0))
                if best is None or w > best[0] or (w == best[0] and (a, b) < best[1:]):
                    best = (w, a, b)
        edges.append((best[1], best[2]))
        inside.add(best[2])
    return edges


def conditional_tables(d: DataFrame, network) -> DataFrame:
    """``s, a, b, w``: weights of the child's values for each of its parents' values, for every (parents,
    child) of ``network``."""
    return set_counts(d, network).withColumnRenamed("n", "w")


def noisy_tables(d: DataFrame, network, seed, scale: float) -> DataFrame:
    """The same over the whole domains, with Laplace noise on every count, clipped at 0.  Parents'
    values without any weight have all children alike.

    A domain product is built by joining the columns' values within an edge."""
    columns = sorted({c for parents, child in network for c in (*parents, child)})
    values = cut_lineage(set_counts(d, [((), c) for c in columns]).select("s", F.col("b").alias("v")))
    number = {c: i for i, c in enumerate(columns)}
    out = None
    for i, (parents, child) in enumerate(network):   # as many as columns
        cells = values.where(F.col("s") == number[child]).select(F.lit(i).alias("s"), F.col("v").alias("b"))
        for j, p in enumerate(parents):
            cells = cells.join(values.where(F.col("s") == number[p]).select(F.lit(i).alias("s"), F.col("v").alias(f"p{j}")), "s")
        cells = cells.select("s", _text([f"p{j}" for j in range(len(parents))]).alias("a"), "b")
        out = cells if out is None else out.unionByName(cells)
    u = uniform(seed, "laplace", F.concat_ws("|", F.col("s").cast("string"), "a", "b")) - 0.5
    noise = -F.lit(scale) * F.signum(u) * F.log(F.greatest(F.lit(1e-300), 1 - 2 * F.abs(u)))
    counts = out.join(set_counts(d, network), ["s", "a", "b"], "left")
    parts = F.greatest(F.lit(0.0), F.coalesce("n", F.lit(0)) + noise) * WEIGHT_PARTS
    weighed = cut_lineage(counts.select("s", "a", "b", F.round(parts).cast("bigint").alias("w")))
    some = weighed.groupBy("s", "a").agg(F.sum("w").alias("t"))
    return weighed.join(some, ["s", "a"]).select("s", "a", "b", F.when(F.col("t") == 0, F.lit(1)).otherwise(F.col("w")).cast("bigint").alias("w")) \
        .where("w > 0")


def sample_network(spark, network, tables: DataFrame, n_samples: int, seed, tag: str) -> DataFrame:
    """Ancestral sampling (JN6): ``network`` lists (parents, child) so that parents come first."""
    intervals = cut_lineage(along(tables, ["s", "a"], "b", "w", seed, f"{tag}:order"))
    totals = cut_lineage(intervals.groupBy("s", "a").agg(F.sum("w").alias("_size")))
    most = totals.agg(F.max("_size")).first()[0] or 1
    out = spark.range(n_samples).withColumnRenamed("id", "draw_id")
    for i, (parents, child) in enumerate(network):
        mine = intervals.where(F.col("s") == i).select(F.col("a").alias("_a"), F.col("b").alias(child), "_lo", "_hi")
        out = out.withColumn("_a", _text(parents)).join(totals.where(F.col("s") == i).select(F.col("a").alias("_a"), "_size"), "_a")
        place = F.floor(uniform(seed, f"{tag}:{child}", F.col("draw_id")) * F.col("_size")).cast("bigint")
        out = join_intervals(out.withColumn("_pos", place).drop("_size"), mine, ["_a"], most).drop("_a", "_pos")
    return out


def decode(df: DataFrame, numeric, bounds: dict, seed, tag: str, n_bins: int = N_BINS) -> DataFrame:
    """Bin codes back to numbers: uniform within the bin; the null category back to null."""
    out = df
    for c in df.columns:
        if c == "draw_id":
            continue
        out = out.withColumn(c, F.when(F.col(c) == MISSING, F.lit(None)).otherwise(F.col(c)))
    for c in numeric:
        lo, hi = bounds[c]
        w = (hi - lo) / n_bins
        u = uniform(seed, f"{tag}:val:{c}", F.col("draw_id"))
        b = F.col(c).cast("int")
        out = out.withColumn(c, F.when(F.col(c).isNull(), None).otherwise(
            F.lit(lo) + (b.cast("double") + u) * F.lit(w) if w > 0 else F.lit(lo)))
    return out


def chow_liu(df: DataFrame, numeric, categorical, n_samples: int, seed) -> DataFrame:
    """GEN2: Chow-Liu tree (mutual information, maximum spanning tree) + ancestral sampling."""
    cols = list(numeric) + list(categorical)
    d, bounds = discretise(df, numeric, categorical)
    d = cut_lineage(d)
    edges = chow_liu_tree(mutual_information(d, cols), cols)
    network = [((), cols[0])] + [((p,), c) for p, c in edges]
    s = sample_network(df.sparkSession, network, conditional_tables(d, network), n_samples, seed, "cl")
    return decode(s, numeric, bounds, seed, "cl").select("draw_id", *cols)


def degree(n: int, columns: int, epsilon: float, theta: float = THETA, most: int = MAX_DEGREE) -> int:
    """The most parents at which a binary marginal stays theta-useful: its cells' mean count is theta times
    the mean noise."""
    k = 0
    while k + 1 <= min(most, columns - 1) and n * epsilon / ((columns - k - 1) * 2 ** (k + 3)) >= theta:
        k += 1
    return k


def greedy_network(d: DataFrame, cols, n: int, epsilon: float, seed, theta: float = THETA, most: int = MAX_DEGREE):
    """PrivBayes' structure: each step takes a child and its parents, of at most ``degree`` columns, by the
    exponential mechanism on mutual information."""
    k, total = degree(n, len(cols), epsilon, theta, most), len(cols)
    sens = (2.0 / n) * math.log((n + 1) / 2.0) + ((n - 1.0) / n) * math.log((n + 1.0) / (n - 1.0)) if n > 1 else 1.0
    first = cols[int(py_uniform(seed, "pb:first", "") * total)]
    inside, network = [first], [((), first)]
    for step in range(total - 1):
        size = min(max(k, 1), len(inside))
        choices = [(p, c) for c in cols if c not in inside for p in combinations(inside, size)]
        scores = information(d, choices)
        w = [epsilon * s / (2.0 * max(total - 1, 1) * sens) for s in scores]
        w = [math.exp(x - max(w)) for x in w]
        u, acc = py_uniform(seed, "pb:pick", step) * sum(w), 0.0
        for choice, x in zip(choices, w):
            acc += x
            if u < acc:
                break
        network.append(choice)
        inside.append(choice[1])
    return network


def privbayes(df: DataFrame, numeric, categorical, n_samples: int, seed, epsilon: float = 1.0, theta: float = THETA,
              most: int = MAX_DEGREE) -> DataFrame:
    """GEN3: structure by the exponential mechanism on mutual information (budget epsilon/2), Laplace
    noise on the conditional counts (budget epsilon/2), clip, normalise, ancestral sampling.

    The number of parents follows theta-usefulness.  The noise is a seeded hash draw — reproducible for
    tests; a production run must use a real entropy source."""
    cols = list(numeric) + list(categorical)
    d, bounds = discretise(df, numeric, categorical)
    d = cut_lineage(d)
    network = greedy_network(d, cols, d.count(), epsilon / 2, seed, theta, most)
    tables = noisy_tables(d, network, seed, 2.0 * len(cols) / (epsilon / 2))
    s = sample_network(df.sparkSession, network, tables, n_samples, seed, "pb")
    return decode(s, numeric, bounds, seed, "pb").select("draw_id", *cols)
