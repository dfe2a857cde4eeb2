"""Isolation Forest (OUT1), Liu, Ting & Zhou 2008.

* sampling: each tree takes the ``psi`` rows of the whole table with the least hash for that tree.  A
  task computes its rows' hashes for all trees in numpy, keeps a bottom-psi sketch of each tree, and
  sends of it only what lies below a bound that psi rows of the table lie below almost surely (if they
  don't, the bound is widened): about 2 psi rows a tree in all, however many tasks there are;
* building: ``groupBy(tree).applyInPandas`` merges a tree's sketches and splits them at random, seeded
  by (seed, tree), so retries rebuild the same tree.  A category is split off by value, as a one-hot
  column would be; no vocabulary is needed;
* scoring: the forest (T trees x <= 2*psi nodes) is broadcast and ``mapInPandas`` walks every
  row through every tree in vectorised numpy: ``score = 2^(-E[h(x)] / c(psi))``;
  ``contamination='auto'`` flags ``score > 0.5``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtaint.functions.rng import hash_hex, py_hash
from tabtaint.operators.neighbors import plain_features
from tabtaint.operators.ordered import exact_quantile
from tabtaint.session import cut_lineage

EULER_GAMMA = 0.5772156649
#: Fixed value: the prime 2**31 - 1, modulus of the trees' hash functions.
PRIME = 2147483647


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


# ---------------------------------------------------------------- sampling

def tree_hashes(seed, trees: int) -> np.ndarray:
    """Four coefficients for each tree: its hash of a row is the pair ``(a x + b, c y + d)`` modulo the
    prime, of two 31-bit parts of the row's digest."""
    out = []
    for t in range(trees):
        d = py_hash(seed, "iforest:tree", t)
        out.append([int(d[8 * i:8 * i + 8], 16) % (PRIME - 1) + 1 for i in range(4)])
    return np.array(out, np.uint64)


def bottom_rows(df: DataFrame, key: str, trees: int, psi: int, seed, keep=()) -> tuple[DataFrame, int]:
    """``tree, _h, key, keep...``: a superset of each tree's ``psi`` least rows that holds all of them, and
    the number of rows a tree gets.  One pass, unless a tree's bound has to be widened."""
    n = df.count()
    psi = min(psi, n)
    digest = hash_hex(seed, "iforest:row", key)
    part = [F.pmod(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint"), F.lit(PRIME)).alias(f"_{c}") for i, c in enumerate("xy")]
    rows = df.select(F.col(key), *keep, *part)
    schema = df.select(F.col(key), *keep).schema.add("tree", T.IntegerType()).add("_h", T.LongType())
    hashes, wide = tree_hashes(seed, trees), 1.0
    while True:
        share = min(1.0, wide * (psi + 8 * math.sqrt(psi) + 16) / max(n, 1))
        limit = np.uint64(int(share * (PRIME << 31)))

        def run(it, limit=limit):
            held: dict[int, pd.DataFrame] = {}
            for pdf in it:
                x, y = pdf.pop("_x").to_numpy(np.uint64), pdf.pop("_y").to_numpy(np.uint64)
                for t, (a, b, c, d) in enumerate(hashes):
                    h = ((a * x + b) % np.uint64(PRIME) << np.uint64(31)) + (c * y + d) % np.uint64(PRIME)
                    at = np.flatnonzero(h <= limit)
                    if len(at):
                        some = pdf.iloc[at].assign(tree=np.int32(t), _h=h[at].astype(np.int64))
                        both = pd.concat([held[t], some]) if t in held else some
                        held[t] = both.nsmallest(psi, ["_h"], keep="all") if len(both) > psi else both
            if held:
                yield pd.concat(held.values())[[f.name for f in schema]]

        found = cut_lineage(rows.mapInPandas(run, schema))
        least = found.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count(F.lit(1))).first()
        if share >= 1.0 or (least[1] == trees and least[0] >= psi):
            return found, psi
        wide *= 4


# ---------------------------------------------------------------- trees

def _build(X: np.ndarray, C: list[np.ndarray], rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes ``feature, threshold, value, left, right, size, depth``: a number goes left below the threshold,
    a category (feature ``numbers + column``) unless it is the value; a leaf has feature -1."""
    nodes: list[list] = []

    def node(idx, d):
        i = len(nodes)
        nodes.append([-1, 0.0, None, -1, -1, len(idx), d])
        if d >= max_depth or len(idx) <= 1:
            return i
        ways = []
        if X.shape[1]:
            sub = X[idx]
            known = ~np.isnan(sub).all(axis=0)
            lo, hi = (np.where(known, f(np.where(np.isnan(sub), e, sub), axis=0), 0.0) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
            ways += [(int(j), None) for j in np.flatnonzero(hi > lo)]
        for j, c in enumerate(C):
            values = pd.unique(c[idx])
            ways += [(X.shape[1] + j, v) for v in sorted(v for v in values if v is not None)] if len(values) > 1 else []
        if not ways:
            return i
        f, value = ways[int(rng.integers(len(ways)))]
        if value is None:
            t = float(rng.uniform(lo[f], hi[f]))
            left = X[idx, f] < t
        else:
            t, left = 0.0, C[f - X.shape[1]][idx] != value
        nodes[i][:3] = f, t, value
        nodes[i][3] = node(idx[left], d + 1)
        nodes[i][4] = node(idx[~left], d + 1)
        return i

    node(np.arange(len(X)), 0)
    return nodes


def _tree_seed(seed, tree: int) -> int:
    return int(hashlib.md5(f"{seed}:iforest:{tree}".encode()).hexdigest()[:15], 16)


def _numbers(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return np.array(pdf["_f"].tolist(), dtype=float).reshape(len(pdf), width)


def _categories(pdf: pd.DataFrame, width: int) -> list[np.ndarray]:
    return list(np.array(pdf["_c"].tolist(), dtype=object).reshape(len(pdf), width).T)


def fit(df: DataFrame, numeric, categorical, n_estimators: int = 100, max_samples: int = 256, seed=0,
        key: str = "row_key"):
    """Returns ``(forest pandas frame, psi)``; the forest is small by construction."""
    X = plain_features(df, numeric, categorical).select(F.col(key).cast("string").alias("k"), "_f", "_c")
    sketches, psi = bottom_rows(X, "k", n_estimators, max_samples, seed, ("_f", "_c"))
    max_depth, n, m = int(math.ceil(math.log2(max(psi, 2)))), len(numeric), len(categorical)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_h", "k"]).head(psi)
        nodes = _build(_numbers(pdf, n), _categories(pdf, m), np.random.default_rng(_tree_seed(seed, t)), max_depth)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "value", "left", "right", "size", "depth"])
        return out.assign(tree=t, node=np.arange(len(out)))[["tree", "node", *out.columns]]

    schema = "tree int, node int, feature int, threshold double, value string, left int, right int, size int, depth int"
    forest = sketches.groupBy("tree").applyInPandas(build, schema).toPandas()   # T x <= 2*psi nodes
    return forest, psi


def score(df: DataFrame, forest: pd.DataFrame, psi: int, numeric, categorical, key: str = "row_key",
          contamination="auto") -> DataFrame:
    """``row_key, score, is_outlier`` for every row (scores as in the paper, in (0, 1])."""
    spark, n, m = df.sparkSession, len(numeric), len(categorical)
    X = plain_features(df, numeric, categorical).select(F.col(key).cast("string").alias(key), "_f", "_c")
    # a category's code is its place among those that some node splits off
    codes = [{v: i for i, v in enumerate(sorted(set(forest.loc[forest["feature"] == n + j, "value"])))} for j in range(m)]
    packed = []
    for _, g in forest.sort_values(["tree", "node"]).groupby("tree"):
        feature = g["feature"].to_numpy()
        value = np.array([codes[f - n][v] if f >= n else -2 for f, v in zip(feature, g["value"])])
        # path length of a leaf = its depth + c(size): precomputed per node
        packed.append((feature, g["threshold"].to_numpy(), value, g["left"].to_numpy(), g["right"].to_numpy(),
                       g["depth"].to_numpy() + np.array([c_factor(float(v)) for v in g["size"]])))
    sent = spark.sparkContext.broadcast((packed, codes))
    cpsi, n_trees = c_factor(psi), len(packed)

    def run(it):
        trees, known = sent.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            cats = [np.array([k.get(v, -1) for v in c], float) for c, k in zip(_categories(pdf, m), known)]
            Xb = np.column_stack([_numbers(pdf, n), *cats]) if n + m else np.empty((len(pdf), 0))
            total = np.zeros(len(pdf))
            for f, th, val, left, right, adj in trees:
                node = np.zeros(len(pdf), dtype=int)
                idx = np.flatnonzero(f[node] >= 0)
                while len(idx):
                    at = node[idx]
                    x = Xb[idx, f[at]]
                    node[idx] = np.where(np.where(f[at] >= n, x != val[at], x < th[at]), left[at], right[at])
                    idx = idx[f[node[idx]] >= 0]
                total += adj[node]
            mean_h = total / max(n_trees, 1)
            sc = np.power(2.0, -mean_h / cpsi) if cpsi > 0 else np.full(len(pdf), 0.5)
            yield pd.DataFrame({key: pdf[key], "score": sc})

    out = X.mapInPandas(run, f"{key} string, score double")
    if contamination == "auto":
        return out.withColumn("is_outlier", F.col("score") > F.lit(0.5))
    thr = exact_quantile(out, "score", 1.0 - float(contamination))
    return out.withColumn("is_outlier", F.col("score") > F.lit(thr))


def isolation_forest(df: DataFrame, numeric, categorical, n_estimators: int = 100, max_samples: int = 256,
                     seed=0, key: str = "row_key", contamination="auto") -> DataFrame:
    forest, psi = fit(df, numeric, categorical, n_estimators, max_samples, seed, key)
    return score(df, forest, psi, numeric, categorical, key, contamination)


def outlier_batch(spark, tables: dict[str, tuple[DataFrame, list[str], list[str], str]], seed=0, n_neighbors: int = 20,
                  n_estimators: int = 100, max_samples: int = 256) -> DataFrame:
    """OUT3: both detectors over many tables ``{name: (table, numbers, categories, key)}``: ``dataset, method,
    result, notes`` (a JSON record with the parameters and the number of rows)."""
    from tabtaint.operators.neighbors import lof
    out = None
    for name, (df, num, cat, key) in tables.items():   # one job chain a table and method, as many as the batch names
        runs = {"LOF": (lof(df, num, cat, n_neighbors, key), {"n_neighbors": n_neighbors}),
                "IFO": (isolation_forest(df, num, cat, n_estimators, max_samples, seed, key), {"n_estimators": n_estimators, "max_samples": max_samples})}
        for method, (scores, params) in runs.items():
            notes = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in params.items()], F.count(F.lit(1)).alias("rows")))
            report = scores.agg(F.lit(name).alias("dataset"), F.lit(method).alias("method"), F.count_if("is_outlier").alias("result"), notes.alias("notes")) \
                .select("dataset", "method", "result", "notes")
            out = report if out is None else out.unionByName(report)
    return out
