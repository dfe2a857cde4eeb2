"""Boosted stumps (ML1, binary): SAMME over bounded splits, without a fitted model or a chain of tables.

Columns are binned once: numbers into ``BINS`` equal widths of the training range, categories into
their ``VALUES`` most frequent values (others share a bin that no stump splits off).  A round is one
aggregation over the binned table: each task works out its rows' weights from the stumps so far, adds
them up by (column, bin, label), and sends that histogram, whose size the bins bound; the best split is
chosen from the sum.  Nothing but the binned table is stored, so a lost executor costs its tasks alone.

A stump asks ``bin <= b`` of a number and ``value = v`` of a category; each side votes for the label of
more weight (0, if equal).  A missing number is in the lowest bin, a missing category is a value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtaint.session import cut_lineage

BINS, VALUES = 32, 256
MISSING = "∅"
#: Errors that differ by less are equal: the first column and split is taken.
SAME_ERROR = 10


@dataclass
class Binned:
    """How columns are binned."""
    numeric: dict[str, tuple[float, float]]
    categorical: dict[str, list[str]]
    names: list[str] = field(init=False)
    sizes: list[int] = field(init=False)

    def __post_init__(self):
        self.names = [*self.numeric, *self.categorical]
        self.sizes = [BINS] * len(self.numeric) + [len(v) + 1 for v in self.categorical.values()]

    @classmethod
    def of(cls, df: DataFrame, numeric, categorical) -> Binned:
        x = {c: F.col(c).cast("double") for c in numeric}
        r = df.agg(F.count(F.lit(1)), *[f(F.nanvl(v, F.lit(None))).alias(f"{n}_{c}") for c, v in x.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
        bounds = {c: (r[f"lo_{c}"] or 0.0, r[f"hi_{c}"] or 0.0) for c in numeric}
        values = {}
        for c in categorical:
            top = df.groupBy(_value(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(VALUES).collect()
            values[c] = sorted(t["v"] for t in top)
        return cls(bounds, values)

    def column(self) -> Column:
        """All columns' bins as an array."""
        out = []
        for c, (lo, hi) in self.numeric.items():
            x = F.nanvl(F.col(c).cast("double"), F.lit(None))
            place = F.floor((x - F.lit(lo)) / F.lit((hi - lo) or 1.0) * BINS)
            out.append(F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)), F.lit(0)).cast("int"))
        for c, values in self.categorical.items():
            out.append((F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), _value(c)), F.lit(0)), F.lit(len(values) + 1)) - 1).cast("int"))
        return F.array(*out)


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


@dataclass
class Stump:
    column: int
    split: int
    equal: bool      # of a category: ``bin = split`` instead of ``bin <= split``
    yes: float       # the labels voted for
    no: float
    error: float
    alpha: float

    def votes(self, bins: np.ndarray) -> np.ndarray:
        b = bins[:, self.column]
        return np.where(b == self.split if self.equal else b <= self.split, self.yes, self.no)

    def vote(self, bins: Column) -> Column:
        b = bins[self.column]
        return F.when(b == self.split if self.equal else b <= self.split, F.lit(self.yes)).otherwise(F.lit(self.no))


def _histogram(data: DataFrame, sizes: list[int], stumps: list[Stump]) -> np.ndarray:
    """Weight by (column, bin, label) as one array: columns one after another."""
    first, total = np.cumsum([0, *sizes[:-1]]), sum(sizes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * total)
        for f in frames:
            bins = f["bins"].flatten().to_numpy(zero_copy_only=False).reshape(f.num_rows, len(sizes))
            y = f["label"].to_numpy(zero_copy_only=False)
            w = np.zeros(len(y))
            for s in stumps:
                w += np.where(s.votes(bins) != y, s.alpha, 0.0)
            at = (bins + first) * 2 + y.astype(int)[:, None]
            out += np.bincount(at.ravel(), weights=np.repeat(np.exp(w), len(sizes)), minlength=2 * total)
        k = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "w": out[k]})

    out = np.zeros(2 * total)
    for r in data.mapInArrow(run, "k int, w double").groupBy("k").agg(F.sum("w").alias("w")).collect():   # one row a bin and label
        out[r["k"]] = r["w"]
    return out.reshape(total, 2)


def best_stump(hist: np.ndarray, sizes: list[int], n_numeric: int) -> Stump | None:
    """The split of least error; ties to the first column and the lowest split."""
    best, at = None, 0
    for c, size in enumerate(sizes):
        h = hist[at:at + size]
        at += size
        equal = c >= n_numeric
        yes = h if equal else np.cumsum(h, axis=0)
        no = h.sum(axis=0) - yes
        last = size - 1        # the last bin of a number leaves nothing over; of a category it is the rest
        error = (np.minimum(yes[:, 0], yes[:, 1]) + np.minimum(no[:, 0], no[:, 1]))[:last] / max(h.sum(), 1e-300)
        for s in range(last):
            if best is None or round(error[s], SAME_ERROR) < round(best.error, SAME_ERROR):
                best = Stump(c, s, equal, float(yes[s, 1] > yes[s, 0]), float(no[s, 1] > no[s, 0]), float(error[s]), 0.0)
    return best


def fit(train: DataFrame, numeric, categorical, rounds: int) -> tuple[Binned, list[Stump]]:
    """Stumps over ``train``, whose ``label`` is 0.0 or 1.0."""
    binned = Binned.of(train, numeric, categorical)
    data = cut_lineage(train.select(F.col("label").cast("double").alias("label"), binned.column().alias("bins")))
    stumps: list[Stump] = []
    for _ in range(rounds):
        s = best_stump(_histogram(data, binned.sizes, stumps), binned.sizes, len(binned.numeric))
        if s is None or s.error >= 0.5:
            break
        s.alpha = math.log((1 - s.error) / s.error) if s.error > 0 else 1.0
        stumps.append(s)
        if s.error <= 0:
            break
    return binned, stumps


def predict(df: DataFrame, binned: Binned, stumps: list[Stump]) -> DataFrame:
    """``df`` with ``prediction``: 1.0 if the stumps' weighted votes for it are the more."""
    vote = F.lit(0.0)
    for s in stumps:
        vote = vote + F.lit(s.alpha) * (2 * s.vote(F.col("_bins")) - 1)
    return df.withColumn("_bins", binned.column()).withColumn("prediction", F.when(vote > 0, 1.0).otherwise(0.0)).drop("_bins")


def describe(binned: Binned, stumps: list[Stump]) -> list[tuple]:
    """``round, column, split, error, alpha``: the split as the number's upper bound or the category."""
    out = []
    for i, s in enumerate(stumps, 1):
        name = binned.names[s.column]
        split = binned.categorical[name][s.split] if s.equal else f"bin <= {s.split}"
        out.append((i, name, split, s.yes, s.no, s.error, s.alpha))
    return out
