"""Exact k-nearest neighbours by pivot cells (JN5), and the evaluators on top: distance to closest
record (DCR1) and local outlier factor (OUT2).

Pivots are chosen by farthest-point sampling, and every reference row belongs to the cell of its
nearest pivot.  A query row first searches its own cell, which bounds the distance of its k-th
neighbour; then it goes to those cells only that the triangle inequality can't rule out.  Cells
meet their visitors in a cogroup, small cells in groups; a cell or a crowd of visitors too large for a task is dealt
over several, and within a task rows have cells of their own, searched in the same way, so neither reference rows nor pairs pass through the driver, which holds the pivots and
one line of statistics for each.  Of reference rows with equal features only the first k (by key)
can be neighbours, so copies are dropped before they meet anything.

Both distances are metrics: ``euclidean`` over numbers and one-hot categories (compared as values,
never expanded), and ``mixed``, a sum of per-column distances.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtaint.session import cut_lineage, stored

#: Memory of a block of reference rows or of visitors in one task.
DEFAULT_BLOCK_BYTES = 8 * 1024 * 1024
#: Pivots at most, rows that a cell has on average at least, and sampled rows for each pivot.
MAX_PIVOTS, CELL_ROWS, SAMPLE_ROWS = 1024, 64, 32
_CHUNK_CELLS = 1 << 20
_VISITS = 10_000   # visits that leave a task in one batch
#: From so many numbers on, bounds rule out little and a task compares all rows by matrix products, in blocks of this size.
DENSE_COLUMNS, _DENSE_ROWS = 8, 2048
_SLACK = 1e-9   # rounding of the bounds


# ---------------------------------------------------------------- distances

@dataclass
class Points:
    numbers: np.ndarray            # rows x numeric columns, NaN = missing
    values: list[np.ndarray]       # per categorical column

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Points:
        n = len(pdf)
        f = np.array(pdf["_f"].tolist(), dtype=float).reshape(n, -1) if n else np.empty((0, 0))
        c = np.array(pdf["_c"].tolist(), dtype=object).reshape(n, -1) if n else np.empty((0, 0), object)
        return cls(f, list(c.T))

    def __len__(self) -> int:
        return len(self.numbers)

    def take(self, at) -> Points:
        return Points(self.numbers[at], [v[at] for v in self.values])


def distances(a: Points, b: Points, metric: str, kinds: np.ndarray | None = None) -> np.ndarray:
    """All distances.  ``euclidean``: numbers, and 1 for each one-hot column that differs (a missing
    category has none set).  ``mixed``: mean over columns of |a - b| up to 1 (``kinds`` 0), or 0 / 1
    for equal or not; one missing gives 1, both missing 0."""
    return _coded_distances(*coded(a, b), metric, kinds)


def coded(a: Points, b: Points) -> tuple[Points, Points]:
    """Both with their categories as numbers, -1 for a missing one."""
    codes = [pd.factorize(np.concatenate([x, y]))[0] for x, y in zip(a.values, b.values, strict=True)]
    return Points(a.numbers, [c[:len(a)] for c in codes]), Points(b.numbers, [c[len(a):] for c in codes])


def _coded_distances(a: Points, b: Points, metric: str, kinds: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    pairs = [(x[:, None], y[None, :]) for x, y in zip(a.values, b.values, strict=True)]
    if metric == "euclidean":
        for j in range(a.numbers.shape[1]):
            diff = a.numbers[:, j][:, None] - b.numbers[:, j][None, :]
            out += diff * diff
        for x, y in pairs:
            differ = x != y
            out += differ & (x >= 0)
            out += differ & (y >= 0)
        return np.sqrt(out)
    if metric != "mixed":
        raise ValueError(metric)
    for j in range(a.numbers.shape[1]):
        x, y = a.numbers[:, j][:, None], b.numbers[:, j][None, :]
        gone_x, gone_y = np.isnan(x), np.isnan(y)
        d = np.minimum(np.abs(x - y), 1.0) if kinds is None or kinds[j] == 0 else (x != y).astype(float)
        out += np.where(gone_x & gone_y, 0.0, np.where(gone_x | gone_y, 1.0, d))
    for x, y in pairs:
        out += x != y
    return out / max(a.numbers.shape[1] + len(pairs), 1)


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` least finite entries, ties to the lower column."""
    k = min(k, d.shape[1])
    if not k or not len(d):
        return np.empty(0, int), np.empty(0, int)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    near = (d <= kth) & np.isfinite(d)
    tied = np.flatnonzero(near.sum(axis=1) > k)
    if len(tied):   # as many of the k-th distance as there is room for
        last = near[tied] & (d[tied] == kth[tied])
        room = k - (near[tied] & ~last).sum(axis=1, keepdims=True)
        near[tied] &= ~last | (np.cumsum(last, axis=1) <= room)
    return np.nonzero(near)


# ---------------------------------------------------------------- pivots

def _farthest(points: Points, n: int, metric: str, kinds) -> np.ndarray:
    """Places of ``n`` points, each the farthest from those before it."""
    far, out = np.full(len(points), np.inf), [0] if len(points) and n else []
    while out and len(out) < min(n, len(points)):
        far = np.minimum(far, distances(points, points.take([out[-1]]), metric, kinds)[:, 0])
        best = int(np.argmax(far))
        if far[best] == 0:
            break
        out.append(best)
    return np.array(out, int)


def pivots(ref: DataFrame, n_ref: int, wanted: int, metric: str, kinds) -> Points:
    """At most ``wanted`` pivots: half of them far apart, the others a plain sample, which is dense
    where the rows are.  Farthest points are chosen in groups of a bounded hash sample, and once more
    among the groups' choices."""
    share = min(1.0, 2 * SAMPLE_ROWS * wanted / max(n_ref, 1))
    sample = ref.select("_f", "_c", F.xxhash64("_k").alias("_h")) \
        .where(F.pmod(F.col("_h"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h").head(SAMPLE_ROWS * wanted).reset_index(drop=True)
        far = _farthest(Points.of(pdf), wanted // 2 + 1, metric, kinds)
        return pdf.iloc[np.unique(np.concatenate([far, np.arange(min(len(pdf), wanted // 8 + 1))]))]

    rows = sample.groupBy(F.pmod(F.shiftright("_h", 32), F.lit(8)).alias("_g")) \
        .applyInPandas(choose, sample.schema).collect()      # 8 groups of fewer than ``wanted`` rows
    found = pd.DataFrame([(r["_f"], r["_c"], r["_h"]) for r in rows], columns=["_f", "_c", "_h"]).sort_values("_h")
    if len(found) <= wanted:
        return Points.of(found)
    p = Points.of(found)
    far = _farthest(p, max(1, wanted // 2), metric, kinds)
    rest = np.setdiff1d(np.arange(len(p)), far)[:wanted - len(far)]
    return p.take(np.concatenate([far, rest]))


@dataclass
class Cells:
    """Pivots and, for each, its rows' number and least and greatest distance."""
    pivots: Points
    metric: str
    kinds: np.ndarray | None
    between: np.ndarray
    rows: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    groups: np.ndarray | None = None   # what cells travel together

    def to(self, points: Points) -> np.ndarray:
        return distances(points, self.pivots, self.metric, self.kinds)

    def deal(self, block_rows: int) -> None:
        """Cells that are small are put together, those at like distances of the first pivot, so that a visitor
        of many cells is sent to few tasks."""
        order = np.argsort(self.between[0], kind="stable")
        self.groups = np.zeros(len(order), np.int32)
        self.groups[order] = (np.cumsum(self.rows[order]) - self.rows[order]) // block_rows

    def bound(self, d: np.ndarray, need: int) -> np.ndarray:
        """A distance within which ``need`` rows lie: the cells' farthest rows, nearest cells first."""
        reach = np.where(self.rows > 0, d + self.high, np.inf)
        alone = np.where(self.rows >= need, reach, np.inf).min(axis=1)   # one cell that holds them all
        if np.isfinite(alone).all():
            return alone
        order = np.argsort(reach, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= need
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
        found = np.take_along_axis(reach, order, axis=1)[np.arange(len(d)), at]
        return np.where(enough.any(axis=1), found, np.inf)

    def least(self, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer than this."""
        near = d[np.arange(len(d)), own][:, None]
        out = np.maximum(np.maximum(d - self.high, self.low - d), (d - near) / 2)
        if self.metric == "euclidean":   # beyond the plane halfway between the pivots
            gap = self.between[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.maximum(out, np.where(gap > 0, (d * d - near * near) / (2 * gap), 0))
        return np.where(self.rows > 0, np.maximum(out, 0), np.inf)


# ---------------------------------------------------------------- the join

def _prepared(df: DataFrame, key: str, features: str, categories: str | None) -> DataFrame:
    c = F.col(categories) if categories else F.array().cast("array<string>")
    return df.select(F.col(key).cast("string").alias("_k"), F.col(features).cast("array<double>").alias("_f"), c.alias("_c"))


def _chunks(pdf: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, _CHUNK_CELLS // max(width, 1))
    for i in range(0, len(pdf), step):
        yield pdf.iloc[i:i + step]


def _pair_distances(q: Points, i: np.ndarray, r: Points, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, added up like those of :func:`distances`."""
    out = np.zeros(len(i))
    for c in range(q.numbers.shape[1]):
        diff = q.numbers[i, c] - r.numbers[j, c]
        out += diff * diff
    for x, y in zip(q.values, r.values, strict=True):
        differ = x[i] != y[j]
        out += differ & (x[i] >= 0)
        out += differ & (y[j] >= 0)
    return np.sqrt(out)


def _dense(q: Points, key_q: np.ndarray, bound: np.ndarray, r: Points, key_r: np.ndarray, k: int, need: int, exclude_self: bool):
    """What :func:`_local` gives, for finite numbers in many columns: a matrix product gives all squared distances up to
    a known rounding error, and only pairs that it doesn't rule out are compared exactly."""
    center = r.numbers.mean(axis=0)
    a, b = q.numbers - center, r.numbers - center
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = (a.shape[1] + 16) * 2.0 ** -50 * (aa + bb.max())
    q, r = (Points(np.asfortranarray(x.numbers), x.values) for x in (q, r))
    out = []
    for i in range(0, len(q), _DENSE_ROWS):
        at = slice(i, min(i + _DENSE_ROWS, len(q)))
        slack = error[at]
        limit = (bound[at] * (1 + _SLACK) + _SLACK) ** 2 + slack
        who, there, dist = np.empty(0, int), np.empty(0, int), np.empty(0)
        for j in range(0, len(r), _DENSE_ROWS):
            block = slice(j, min(j + _DENSE_ROWS, len(r)))
            d = a[at] @ (-2 * b[block].T)
            d += aa[at][:, None]
            d += bb[block]
            for x, y in zip(q.values, r.values, strict=True):
                differ = x[at][:, None] != y[block][None, :]
                d += differ & (x[at] >= 0)[:, None]
                d += differ & (y[block] >= 0)[None, :]
            near = d <= limit[:, None]
            many = np.flatnonzero(near.sum(axis=1) > 4 * need)
            if len(many):   # the block's own nearest bound these visitors
                kth = np.partition(d[many], need - 1, axis=1)[:, need - 1]
                limit[many] = np.minimum(limit[many], kth + 2 * slack[many])
                near[many] = d[many] <= limit[many][:, None]
            x, y = np.nonzero(near)
            y += j
            if exclude_self:
                other = key_q[at][x] != key_r[y]
                x, y = x[other], y[other]
            if not len(x):
                continue
            who, there, dist = np.concatenate([who, x]), np.concatenate([there, y]), np.concatenate([dist, _pair_distances(q, i + x, r, y)])
            o = np.lexsort((there, dist, who))
            who, there, dist = who[o], there[o], dist[o]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == k - 1
            limit[who[last]] = np.minimum(limit[who[last]], (dist[last] * (1 + _SLACK) + _SLACK) ** 2 + slack[who[last]])
            who, there, dist = who[rank < k], there[rank < k], dist[rank < k]
        out.append((i + who, there, dist))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(3))


def _local(q: Points, own: np.ndarray, bound: np.ndarray, r: Points, names: np.ndarray, k: int, exclude_self: bool, metric, kinds):
    """Visitor, row and distance of each visitor's ``k`` nearest rows, ties to the lower row; those beyond its ``bound``
    may be left out.  The rows get pivots and cells of their own, about the root of their number, so that a visitor meets
    few of them."""
    q, r = coded(q, r)
    key = pd.factorize(np.concatenate([names, own]))[0]   # keys may repeat or be null
    key_r, key_q = key[:len(r)], key[len(r):]
    need = k + (int(np.unique(key_r, return_counts=True)[1].max()) if exclude_self else 0)
    if metric == "euclidean" and q.numbers.shape[1] >= DENSE_COLUMNS and np.isfinite(q.numbers).all() and np.isfinite(r.numbers).all():
        return _dense(q, key_q, bound, r, key_r, k, need, exclude_self)
    rows = np.arange(len(r))
    p = r.take(np.linspace(0, len(r) - 1, max(1, math.isqrt(len(r)))).astype(int))
    step = max(1, _CHUNK_CELLS // len(p))

    def to_pivots(x: Points) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(x), step):
            at = np.arange(i, min(i + step, len(x)))
            yield at, _coded_distances(x.take(at), p, metric, kinds)

    cell, far = np.empty(len(r), int), np.empty(len(r))
    for at, d in to_pivots(r):
        cell[at] = d.argmin(axis=1)
        far[at] = d[np.arange(len(at)), cell[at]]
    order = np.argsort(cell, kind="stable")   # by cell, and by key within it
    cells = Cells(p, metric, kinds, _coded_distances(p, p, metric, kinds), np.bincount(cell, minlength=len(p)), np.full(len(p), np.inf), np.zeros(len(p)))
    np.minimum.at(cells.low, cell, far)
    np.maximum.at(cells.high, cell, far)
    ends = np.cumsum(cells.rows)
    members = [rows[order[e - n:e]] for e, n in zip(ends, cells.rows)]
    home = np.concatenate([np.empty(0, int), *[np.where(cells.rows > 0, d, np.inf).argmin(axis=1) for _, d in to_pivots(q)]])
    by_home = np.argsort(home, kind="stable")   # visitors next to each other visit the same cells
    out = []
    for i in range(0, len(q), step):
        at = by_home[i:i + step]
        some, mine = q.take(at), home[at]
        d = _coded_distances(some, p, metric, kinds)
        within = np.minimum(bound[at], cells.bound(d, need))
        least, found = cells.least(d, mine), []

        def visit(who: np.ndarray, c: int, some=some, at=at, found=found) -> None:
            there = members[c]
            e = _coded_distances(some.take(who), r.take(there), metric, kinds)
            if exclude_self:
                e[key_q[at[who]][:, None] == key_r[there][None, :]] = np.inf
            x, y = nearest(e, k)
            found.append((who[x], there[y], e[x, y]))

        for c in np.unique(mine):
            visit(np.flatnonzero(mine == c), c)
        who, dist = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
        kth = np.full(len(at), np.inf)
        full = np.bincount(who, minlength=len(at)) >= k
        most = np.zeros(len(at))
        np.maximum.at(most, who, dist)
        kth[full] = most[full]
        open_ = least <= (np.minimum(within, kth) * (1 + _SLACK) + _SLACK)[:, None]
        open_[np.arange(len(at)), mine] = False
        for c in np.flatnonzero(open_.any(axis=0)):
            visit(np.flatnonzero(open_[:, c]), c)
        who, there, dist = (np.concatenate([f[j] for f in found]) for j in range(3))
        o = np.lexsort((there, dist, who))
        who, there, dist = who[o], there[o], dist[o]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append((at[who[first]], there[first], dist[first]))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(3))


def _search(visits: DataFrame, rows: DataFrame, cells: Cells, k: int, exclude_self: bool, block_rows: int, seen: dict) -> DataFrame:
    """Each visitor's ``k`` nearest of the groups of cells it visits: ``qkey, dists, nkeys``, a row for each task it went to."""
    spark, metric, kinds = rows.sparkSession, cells.metric, cells.kinds
    crowd = visits.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.sum("_open").alias("open")).collect()   # one a group
    seen["pairs"] = seen.get("pairs", 0) + sum(r["open"] for r in crowd)
    held = np.bincount(cells.groups, weights=cells.rows).astype(int)
    sizes = [(r["_group"], max(1, round(int(held[r["_group"]]) / block_rows)), math.ceil(r["n"] / block_rows)) for r in crowd]
    parts = F.broadcast(spark.createDataFrame(sizes, "_group int, _blocks int, _crowds int"))   # one row a group
    mine = F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int")
    theirs = F.pmod(F.xxhash64("_k"), F.col("_crowds")).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = visits.join(parts, "_group").withColumn("_part", theirs).withColumn("_block", every("_blocks"))
    right = rows.join(parts, "_group").withColumn("_block", mine).withColumn("_part", every("_crowds"))
    key = ["_group", "_block", "_part"]

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"qkey": [], "dists": [], "nkeys": []})
        r = r.sort_values("_k", kind="stable")     # ties go to the least key
        own, names = q["_k"].to_numpy(object), r["_k"].to_numpy(object)
        i, j, d = _local(Points.of(q), own, q["_bound"].to_numpy(), Points.of(r), names, k, exclude_self, metric, kinds)
        o = np.argsort(i, kind="stable")
        i, near, d = i[o], names[j[o]], d[o]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        ends = np.append(begin, len(i))
        cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return pd.DataFrame({"qkey": own[i[begin]], "dists": [d[a:b] for a, b in cut], "nkeys": [near[a:b] for a, b in cut]})

    return left.select(*key, "_k", "_f", "_c", "_bound").groupBy(*key).cogroup(right.select(*key, "_k", "_f", "_c").groupBy(*key)) \
        .applyInPandas(meet, "qkey string, dists array<double>, nkeys array<string>")


def _first(found: DataFrame, k: int) -> DataFrame:
    """``qkey, near``: of all that the tasks have found for a row, the first ``k`` by distance and key."""
    return found.select("qkey", F.arrays_zip(F.col("dists").alias("dist"), F.col("nkeys").alias("nkey")).alias("near")) \
        .groupBy("qkey").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def knn(query: DataFrame, ref: DataFrame, k: int, qkey: str = "row_key", rkey: str = "row_key",
        features: str = "_f", metric: str = "euclidean", kinds=None, exclude_self: bool = False,
        max_block_bytes: int = DEFAULT_BLOCK_BYTES, categories: str | None = None,
        max_pivots: int = MAX_PIVOTS, report: dict | None = None) -> DataFrame:
    """``(qkey, nkey, dist, rank)``: the k nearest reference rows of every query row, exactly.

    ``features`` is an ``array<double>`` column on both sides (NaN = missing), ``categories`` an
    ``array<string>`` one.  Query keys are unique; ties are broken by the reference key.  ``report``
    takes the numbers of pivots and, for each query row, of rows in its own cell and the cells that it can't rule out
    in other groups.
    """
    spark, kinds = query.sparkSession, None if kinds is None else np.asarray(kinds)
    schema = "qkey string, nkey string, dist double, rank int"
    need = k + 1 if exclude_self else k
    q, r = _prepared(query, qkey, features, categories), _prepared(ref, rkey, features, categories)
    first = r.select("_f", "_c").first()
    if first is None or k < 1:
        return spark.createDataFrame([], schema)
    n_ref = r.count()
    width = 8 * len(first["_f"]) + 32 * len(first["_c"]) + 64
    block_rows = max(1, max_block_bytes // width)
    wanted = max(1, min(max_pivots, math.isqrt(n_ref), n_ref // CELL_ROWS, (32 << 20) // width))
    p = pivots(r, n_ref, wanted, metric, kinds)
    cells = Cells(p, metric, kinds, distances(p, p, metric, kinds))
    sent = spark.sparkContext.broadcast(cells)

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for some in _chunks(pdf, len(sent.value.pivots)):
                d = sent.value.to(Points.of(some))
                own = d.argmin(axis=1)
                yield some.assign(_cell=own.astype(np.int32), _d=d[np.arange(len(d)), own])

    unlike = r.withColumn("_n", F.row_number().over(Window.partitionBy("_f", "_c").orderBy("_k"))).where(F.col("_n") <= need).drop("_n")
    points = "_k string, _f array<double>, _c array<string>"
    rows = cut_lineage(unlike.mapInPandas(assign, points + ", _cell int, _d double"))
    cells.rows = np.zeros(len(p), np.int64)
    cells.low, cells.high = np.zeros(len(p)), np.zeros(len(p))
    for x in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("low"), F.max("_d").alias("high")).collect():
        cells.rows[x["_cell"]], cells.low[x["_cell"]], cells.high[x["_cell"]] = x["n"], x["low"], x["high"]
    cells.deal(block_rows)
    known = spark.sparkContext.broadcast(cells)
    of_cell = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(cells.groups)], "_cell int, _group int"))   # one row a pivot
    rows = rows.join(of_cell, "_cell")

    def home(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = known.value
        for pdf in it:
            for some in _chunks(pdf, len(c.pivots)):
                d = c.to(Points.of(some))
                own = np.where(c.rows > 0, d, np.inf).argmin(axis=1)
                yield some.assign(_cell=own.astype(np.int32), _group=c.groups[own], _open=c.rows[own], _bound=c.bound(d, need))

    def away(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = known.value
        for pdf in it:
            for some in _chunks(pdf, len(c.pivots)):
                d, own = c.to(Points.of(some)), some["_cell"].to_numpy()
                within = some["_bound"].to_numpy()[:, None]
                visit = c.least(d, own) <= within * (1 + _SLACK) + _SLACK
                visit &= c.groups[None, :] != c.groups[own][:, None]   # the whole group has been searched
                i, j = np.nonzero(visit)
                open_ = pd.DataFrame({"i": i, "_group": c.groups[j], "_open": c.rows[j]}).groupby(["i", "_group"], as_index=False)["_open"].sum()
                for n in range(0, len(open_), _VISITS):
                    part = open_.iloc[n:n + _VISITS]
                    yield some.iloc[part["i"]][["_k", "_f", "_c", "_bound"]].assign(_group=part["_group"].to_numpy(np.int32), _open=part["_open"].to_numpy(np.int64))

    seen: dict = {}
    at_home = cut_lineage(q.mapInPandas(home, points + ", _cell int, _group int, _open bigint, _bound double"))
    near = cut_lineage(_first(_search(at_home.withColumn("_bound", F.lit(math.inf)), rows, cells, k, exclude_self, block_rows, seen), k))
    reach = near.where(F.size("near") == k).select(F.col("qkey").alias("_k"), F.get("near", F.lit(k - 1))["dist"].alias("dist"))
    bounded = at_home.join(reach, "_k", "left").withColumn("_bound", F.least("_bound", F.coalesce("dist", "_bound"))).drop("dist")
    visits = cut_lineage(bounded.mapInPandas(away, points + ", _bound double, _group int, _open bigint"))
    far = _search(visits, rows, cells, k, exclude_self, block_rows, seen)
    if report is not None:
        n = at_home.count()
        report |= {"pivots": len(p), "query_rows": n, "candidates_per_row": seen["pairs"] / max(n, 1), "reference_rows": n_ref}
    near = near.select("qkey", F.col("near.dist").alias("dists"), F.col("near.nkey").alias("nkeys"))
    return _first(near.unionByName(far), k).select("qkey", F.posexplode("near").alias("_at", "x")) \
        .select("qkey", "x.nkey", "x.dist", (F.col("_at") + 1).alias("rank"))


# ---------------------------------------------------------------- feature preparation

def fill_medians(df: DataFrame, numeric) -> DataFrame:
    """Missing (null or NaN) numeric values replaced by the column's exact median; a column
    without any value by 0."""
    from tabtaint.operators.ordered import exact_quantile
    x = {c: F.col(c).cast("double") for c in numeric}
    missing = {c: x[c].isNull() | F.isnan(x[c]) for c in numeric}
    if not numeric:
        return df
    counts = df.agg(*[F.count_if(missing[c]).alias(c) for c in numeric]).first()
    for c in (c for c in numeric if counts[c]):
        m = exact_quantile(df, c, 0.5)
        df = df.withColumn(c, F.when(missing[c], F.lit(0.0 if m is None else m)).otherwise(x[c]))
    return df


def plain_features(df: DataFrame, numeric, categorical, scale: dict | None = None) -> DataFrame:
    """``_f`` (numbers, divided by ``scale`` where it is positive) and ``_c`` (categories as text)."""
    def number(c):
        x = F.col(c).cast("double")
        return F.coalesce(x / F.lit(scale[c]) if scale and scale[c] else x, F.lit(float("nan")))

    return df.withColumn("_c", F.array(*[F.col(c).cast("string") for c in categorical]).cast("array<string>")) \
        .withColumn("_f", F.array(*[number(c) for c in numeric]).cast("array<double>"))


# ---------------------------------------------------------------- DCR1

def dcr(real: DataFrame, syn: DataFrame, numeric, categorical, seed, key: str = "row_key", report: dict | None = None) -> DataFrame:
    """Distance to closest record: ``score = min(1, median(DCR_syn) / median(DCR_random))``.

    The random baseline is the uniform sampler over the real ranges / vocabularies, with as
    many rows as the synthetic table.
    """
    from tabtaint.operators.generate import uniform_sampler
    spark = real.sparkSession
    m = syn.count()
    rnd = uniform_sampler(real, list(numeric) + list(categorical), m, seed, categorical=tuple(categorical)) \
        .withColumn(key, F.col("draw_id").cast("string"))
    mm = real.agg(*[y for c in numeric for y in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() if numeric else {}
    scale = {c: float(mm[f"hi_{c}"]) - float(mm[f"lo_{c}"]) if mm[f"lo_{c}"] is not None else 0.0 for c in numeric}
    kinds = [0 if scale[c] > 0 else 1 for c in numeric]   # a column of one value is compared for equality

    def closest(df: DataFrame, name: str) -> DataFrame:
        near = knn(plain_features(df, numeric, categorical, scale), R, 1, key, key, metric="mixed", kinds=kinds,
                   categories="_c", report=None if report is None else report.setdefault(name, {}))
        return cut_lineage(near.select("dist"))   # read by several quantile jobs

    R = plain_features(real, numeric, categorical, scale)
    d_syn, d_rnd = closest(syn, "synthetic"), closest(rnd, "random")
    from tabtaint.operators.ordered import exact_quantile
    ms = exact_quantile(d_syn, "dist", 0.5)
    mr = exact_quantile(d_rnd, "dist", 0.5)
    score = None if ms is None or mr is None else (1.0 if mr == 0 else min(1.0, ms / mr))
    return spark.createDataFrame([(score, ms, mr)], "score double, median_dcr_synthetic double, median_dcr_random double")


# ---------------------------------------------------------------- OUT2

def lof(df: DataFrame, numeric, categorical, k: int = 20, key: str = "row_key",
        contamination="auto", max_block_bytes: int = DEFAULT_BLOCK_BYTES, report: dict | None = None) -> DataFrame:
    """Local outlier factor per row: ``row_key, lof, is_outlier`` (``auto``: LOF > 1.5).

    With n <= k rows every row has n - 1 neighbours; a single row has LOF 1.  Missing numeric
    values take the column's exact median, so no row is lost.  Rows are compared as points
    (:func:`_lof_of_points`); where keys repeat or are null, neighbours are joined by key instead.
    """
    n = df.count()
    k = min(k, n - 1)
    if k < 1:
        return df.select(F.col(key).cast("string").alias(key), F.lit(1.0).alias("lof"), F.lit(False).alias("is_outlier"))
    X = plain_features(fill_medians(df, numeric), numeric, categorical).select(F.col(key).cast("string").alias("k"), "_f", "_c")
    keys = X.groupBy(F.xxhash64("k").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("k").isNull()).alias("gone")) \
        .agg(F.max("n").alias("n"), F.max("gone").alias("gone")).first()
    if keys["n"] == 1 and not keys["gone"]:
        return _judged(_lof_of_points(X, n, k, max_block_bytes, report), key, contamination)
    nn = cut_lineage(knn(X, X, k, "k", "k", exclude_self=True, max_block_bytes=max_block_bytes, categories="_c", report=report))
    return lof_of_neighbours(nn, k, key, contamination)


# Points, the rows of equal features taken together, are dealt into units: groups of cells, large ones in blocks.  A
# unit's state is one packed message that travels from step to step with the visitors and answers of other units.
# Neighbours are searched three times (distance of the k-th, density, factor) and never kept: a task adds up what
# it finds, and only lists of points that other units may hold neighbours of travel.

_MESSAGE = "unit int, source int, data binary, met bigint"
UNIT_ROWS, VISITORS, LISTED = 20_000, 20_000, 1 << 21   # rows of a unit at least, visitors searched and list entries held at once


def _pack(**parts) -> bytes:
    return zlib.compress(pickle.dumps(parts, 5), 1)


def _unpack(data: bytes) -> dict:
    return pickle.loads(zlib.decompress(data))


def _codes(points: Points) -> list:
    """Categories as numbers and values, to be packed."""
    return [pd.factorize(v) for v in points.values]


def _points(part: dict) -> Points:
    return Points(part["f"], [np.where(codes < 0, None, np.append(values, None)[codes]) for codes, values in part["c"]])


@dataclass
class Units:
    cells: Cells
    first: np.ndarray    # each group's first unit
    blocks: np.ndarray   # and number of units
    need: int            # neighbours of a point, one of its own rows among them

    def of(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        group = self.cells.groups[cell]
        return self.first[group] + h % self.blocks[group]

    def bounded(self, points: Points, kth: np.ndarray) -> np.ndarray:
        """``kth``, or the cells' bound where a unit has too few rows."""
        out, few = kth.copy(), np.flatnonzero(np.isinf(kth))
        for at in np.array_split(few, max(1, len(few) * len(self.cells.rows) // _CHUNK_CELLS)):
            out[at] = self.cells.bound(self.cells.to(points.take(at)), self.need)
        return out

    def open(self, points: Points, cell: np.ndarray, unit: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Points and the other units that may hold neighbours of theirs, and how many rows they may meet."""
        c, who, units, met = self.cells, [], [], 0
        for at in np.array_split(np.arange(len(points)), max(1, len(points) * len(c.rows) // _CHUNK_CELLS)):
            own = cell[at]
            visit = c.least(c.to(points.take(at)), own) <= bound[at][:, None] * (1 + _SLACK) + _SLACK
            visit &= c.groups[None, :] != c.groups[own][:, None]
            i, j = np.nonzero(visit)
            met += int(c.rows[own].sum() + c.rows[j].sum())
            pairs = np.unique(np.concatenate([i, np.arange(len(at))]) << 32 | c.groups[np.concatenate([j, own])])   # and the own group's blocks
            i, group = pairs >> 32, pairs & 0xFFFFFFFF
            n = self.blocks[group]
            to = np.repeat(self.first[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(i, n)
            who.append(at[i[to != unit]])
            units.append(to[to != unit])
        return np.concatenate(who), np.concatenate(units), met

    def search(self, state: dict, points: Points, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Visitor, row of the unit and distance, by visitor."""
        rows = _points(state).take(state["at"])
        i, j, d = _local(points, np.empty(0, object), bound, rows, np.array(state["names"], object), self.need, False, "euclidean", None)
        o = np.argsort(i, kind="stable")
        return i[o], j[o], d[o]

    # ---- steps: each gives messages (unit, source, data, met), the unit's own state with source -1

    def visits(self, unit: int, state: dict, points: Points, who: np.ndarray, to: np.ndarray, bound: np.ndarray) -> Iterator[tuple]:
        codes = state["c"]
        for u in np.unique(to):
            at = who[to == u]
            yield int(u), unit, _pack(i=at, f=points.numbers[at], c=[(x[at], v) for x, v in codes], bound=bound[at]), 0

    def home(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """First search of a unit's points among its own rows."""
        unit, points = int(pdf["unit"].iloc[0]), Points.of(pdf)
        names = np.concatenate([np.asarray(x, object) for x in pdf["keys"]])
        at = np.repeat(np.arange(len(pdf)), pdf["keys"].map(len))
        o = np.argsort(names, kind="stable")   # ties go to the least key
        state = {"f": points.numbers, "c": _codes(points), "names": names[o].tolist(), "at": at[o].astype(np.int32), "cell": pdf["_cell"].to_numpy()}
        i, j, d = self.search(state, points, np.full(len(pdf), np.inf))
        begin, kd = np.searchsorted(i, np.arange(len(pdf) + 1)), np.full(len(pdf), np.inf)
        full = np.diff(begin) == self.need
        kd[full] = d[begin[1:][full] - 1]
        bound = self.bounded(points, kd)
        who, to, met = self.open(points, state["cell"], unit, bound)
        waits = np.isin(i, who)
        state |= {"kd": kd, "waiting": np.unique(who), "lists": self.lists(state, i[waits], j[waits], d[waits], None)}
        yield unit, -1, _pack(**state), met
        yield from self.visits(unit, state, points, who, to, bound)

    @staticmethod
    def lists(state: dict, who: np.ndarray, row: np.ndarray, dist: np.ndarray, value: str | None, home: bool = True) -> pd.DataFrame:
        point = state["at"][row]
        return pd.DataFrame({"who": who, "dist": dist, "name": np.array(state["names"], object)[row],
                             "value": state[value][point] if value else 0.0, "own": point == who if home else False})

    def first_of(self, lists: pd.DataFrame) -> pd.DataFrame:
        x = lists.sort_values(["who", "dist", "name"], kind="stable")
        return x[x.groupby("who").cumcount() < self.need]

    def added(self, state: dict, out: str, who: np.ndarray, dist: np.ndarray, value: np.ndarray, own: np.ndarray) -> None:
        """The density or factor of points from all their neighbours, one of their own rows left out."""
        at = who[::self.need]
        dist, value, own = (x.reshape(-1, self.need) for x in (dist, value, own))
        x = np.maximum(value, dist) if out == "lrd" else value / state["lrd"][at][:, None]
        x = x.copy()
        x[np.arange(len(at)), np.where(own.any(axis=1), own.argmax(axis=1), self.need - 1)] = 0.0
        mean = x.sum(axis=1) / (self.need - 1)
        state[out][at] = 1.0 / (mean + 1e-10) if out == "lrd" else mean

    def begin(self, unit: int, state: dict, value: str, out: str) -> Iterator[tuple]:
        """Search of a unit's points among its own rows, which have a ``value`` each."""
        points = _points(state)
        if "open" not in state:   # of those that the first search left open
            some = state["waiting"]
            who, to, _ = self.open(points.take(some), state["cell"][some], unit, state["kd"][some])
            state["open"] = some[who], to
        who, to = state["open"]
        i, j, d = self.search(state, points, state["kd"])
        waits = np.isin(i, who)
        state |= {"waiting": np.unique(who), "lists": self.lists(state, i[waits], j[waits], d[waits], value), out: np.zeros(len(points))}
        i, j, d = i[~waits], j[~waits], d[~waits]
        point = state["at"][j]
        self.added(state, out, i, d, state[value][point], point == i)
        yield unit, -1, _pack(**state), 0
        yield from self.visits(unit, state, points, who, to, state["kd"])

    def answers(self, batches: Iterator[pd.DataFrame], value: str | None) -> Iterator[pd.DataFrame]:
        """Visitors' nearest among a unit's rows, sent to the units they come from."""
        unit, state, waiting = None, None, []

        def asked() -> Iterator[tuple]:
            if state is None or not waiting:
                return
            parts = [x for _, x in waiting]
            points = [_points(x) for x in parts]
            q = Points(np.concatenate([x.numbers for x in points]), [np.concatenate(x) for x in zip(*[y.values for y in points])])
            i, j, d = self.search(state, q, np.concatenate([x["bound"] for x in parts]))
            ends = np.cumsum([len(x["i"]) for x in parts])
            for (source, x), end in zip(waiting, ends.tolist()):
                some = slice(*np.searchsorted(i, (end - len(x["i"]), end)))
                if some.start < some.stop:
                    who = x["i"][i[some] - (end - len(x["i"]))]
                    yield source, unit, _pack(lists=self.lists(state, who, j[some], d[some], value, home=False)), 0

        for b in batches:
            for u, source, data in zip(b["unit"], b["source"], b["data"], strict=True):
                if u != unit or sum(len(x["i"]) for _, x in waiting) >= VISITORS:
                    yield _frame(asked())
                    waiting = []
                if u != unit:
                    unit, state = u, None
                if source < 0:
                    state = _unpack(data)
                    yield _frame([(u, -1, data, 0)])
                else:
                    waiting.append((source, _unpack(data)))
        yield _frame(asked())

    def merged(self, batches: Iterator[pd.DataFrame], out: str) -> Iterator[pd.DataFrame]:
        """A unit's points with ``out`` of all units' answers, and the next search, or in the end the points' factors."""
        unit, state, lists = None, None, []

        def done() -> Iterator[pd.DataFrame]:
            if state is None:
                return
            x = self.first_of(pd.concat(lists))
            who, dist, value, own = (x[c].to_numpy() for c in ("who", "dist", "value", "own"))
            if out == "kd":
                state["kd"][who[self.need - 1::self.need]] = dist[self.need - 1::self.need]
            else:
                self.added(state, out, who, dist, value, own.astype(bool))
            if out == "lof":
                points, names = _points(state), pd.Series(state["names"]).groupby(state["at"]).agg(list)
                yield pd.DataFrame({"_f": list(points.numbers), "_c": list(map(list, zip(*points.values))) if points.values else [[]] * len(points),
                                    "keys": names.to_numpy(), "lof": state["lof"]})
            else:
                yield _frame(self.begin(unit, state, out, {"kd": "lrd", "lrd": "lof"}[out]))

        for b in batches:
            for u, source, data in zip(b["unit"], b["source"], b["data"], strict=True):
                if u != unit:
                    yield from done()
                    unit, state, lists = u, None, []
                part = _unpack(data)
                if source < 0:
                    state = part
                lists.append(part.pop("lists"))
                if len(lists) > 1 and sum(map(len, lists)) > LISTED + len(lists[0]):
                    lists = [self.first_of(pd.concat(lists))]
        yield from done()


def _frame(messages) -> pd.DataFrame:
    return pd.DataFrame(list(messages), columns=["unit", "source", "data", "met"])


def _lof_of_points(X: DataFrame, n: int, k: int, max_block_bytes: int, report: dict | None) -> DataFrame:
    """``k, lof`` of rows ``k, _f, _c`` with distinct keys.

    Rows of equal features share all: their k + 1 nearest rows, themselves among them, have the same distances, and whichever
    of their own rows is left out, its part in the sums is the same.  So only the first k + 1 keys of a point are kept."""
    spark, need = X.sparkSession, k + 1
    first = X.withColumn("_n", F.row_number().over(Window.partitionBy("_f", "_c").orderBy("k"))).where(F.col("_n") <= need)
    P = stored(first.groupBy("_f", "_c").agg(F.sort_array(F.collect_list("k")).alias("keys")), "points")
    some = P.select("_f", "_c").first()
    r = P.agg(F.count(F.lit(1)).alias("points"), F.sum(F.size("keys")).alias("rows")).first()
    width = 8 * len(some["_f"]) + 32 * len(some["_c"]) + 64
    block_rows = max(1, max_block_bytes // width)
    wanted = max(1, min(MAX_PIVOTS, math.isqrt(r["points"]), r["points"] // CELL_ROWS, (32 << 20) // width))
    p = pivots(P.select("_f", "_c", F.col("keys")[0].alias("_k")), r["points"], wanted, "euclidean", None)
    cells = Cells(p, "euclidean", None, distances(p, p, "euclidean"), np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p)))

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for x in _chunks(pdf, len(sent.value.pivots)):
                d = sent.value.to(Points.of(x))
                own = d.argmin(axis=1)
                yield pd.DataFrame({"_cell": own.astype(np.int32), "_d": d[np.arange(len(d)), own], "_n": x["_n"]})

    sent = spark.sparkContext.broadcast(cells)
    stats = P.select("_f", "_c", F.size("keys").alias("_n")).mapInPandas(assign, "_cell int, _d double, _n bigint")
    for x in stats.groupBy("_cell").agg(F.sum("_n").alias("n"), F.min("_d").alias("low"), F.max("_d").alias("high")).collect():   # one a pivot
        cells.rows[x["_cell"]], cells.low[x["_cell"]], cells.high[x["_cell"]] = x["n"], x["low"], x["high"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit_rows = min(block_rows, max(UNIT_ROWS, r["rows"] // (2 * tasks)))
    cells.deal(unit_rows)
    held = np.bincount(cells.groups, weights=cells.rows).astype(np.int64)
    blocks = np.maximum(1, np.round(held / block_rows).astype(np.int64))
    known = spark.sparkContext.broadcast(Units(cells, np.cumsum(blocks) - blocks, blocks, need))
    units = int(blocks.sum())

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for x in _chunks(pdf, len(known.value.cells.pivots)):
                own = known.value.cells.to(Points.of(x)).argmin(axis=1)
                yield x.drop(columns="_h").assign(_cell=own.astype(np.int32), unit=known.value.of(own, x["_h"].to_numpy()).astype(np.int32))

    def step(messages: DataFrame, run, schema: str = _MESSAGE) -> DataFrame:
        return messages.repartition(units, "unit").sortWithinPartitions("unit", "source").mapInPandas(run, schema)

    points = "_f array<double>, _c array<string>, keys array<string>"
    routed = P.withColumn("_h", F.pmod(F.xxhash64("_f", "_c"), F.lit(1 << 30))).mapInPandas(route, f"{points}, _cell int, unit int")
    m = routed.repartition(units, "unit").groupBy("unit").applyInPandas(lambda pdf: _frame(known.value.home(pdf)), _MESSAGE)
    if report is not None:
        m = stored(m, "messages")
        report |= {"pivots": len(p), "query_rows": r["points"], "reference_rows": n,
                   "candidates_per_row": m.agg(F.sum("met")).first()[0] / r["points"]}
    for value, out in ((None, "kd"), ("kd", "lrd"), ("lrd", "lof")):
        m = step(m, lambda it, value=value: known.value.answers(it, value))
        m = step(m, lambda it, out=out: known.value.merged(it, out), f"{points}, lof double" if out == "lof" else _MESSAGE)
    found = stored(m, "factors")
    if r["rows"] == n:
        return found.select(F.explode("keys").alias("k"), "lof")
    return X.join(found.drop("keys"), ["_f", "_c"]).select("k", "lof")   # copies beyond those kept


def lof_of_neighbours(nn: DataFrame, k: int, key: str = "row_key", contamination="auto") -> DataFrame:
    """The factor from each row's ``k`` neighbours (a stored table: it is read three times)."""
    kdist = nn.where(F.col("rank") == k).select(F.col("qkey").alias("nkey"), F.col("dist").alias("kd"))
    reach = nn.join(kdist, "nkey").withColumn("reach", F.greatest("kd", "dist"))
    lrd = reach.groupBy("qkey").agg((F.lit(1.0) / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    ratio = (nn.join(lrd.select(F.col("qkey").alias("nkey"), F.col("lrd").alias("lrd_o")), "nkey")
             .join(lrd, "qkey")
             .groupBy("qkey").agg(F.avg(F.col("lrd_o") / F.col("lrd")).alias("lof")))
    return _judged(ratio.withColumnRenamed("qkey", "k"), key, contamination)


def _judged(ratio: DataFrame, key: str, contamination) -> DataFrame:
    if contamination == "auto":
        cut = F.col("lof") > F.lit(1.5)
        return ratio.select(F.col("k").alias(key), "lof", cut.alias("is_outlier"))
    from tabtaint.operators.ordered import exact_quantile
    ratio = cut_lineage(ratio)
    thr = exact_quantile(ratio, "lof", 1.0 - float(contamination))
    return ratio.select(F.col("k").alias(key), "lof", (F.col("lof") > F.lit(thr)).alias("is_outlier"))
