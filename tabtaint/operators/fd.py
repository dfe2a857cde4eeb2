"""Functional-dependency discovery (FD1-FD3).

``X -> A`` holds iff rows that agree on X agree on A (nulls equal nulls).  Two searches share the two
questions they put to the table:

* *Agreement sets*: on which columns do two rows agree?  Every partition sorts its rows by each column
  and compares neighbours, so all rows take part in one pass; each set X refutes Y -> A for every Y in X
  and A outside X.  A sample of pairs can refute only, never confirm.
* *Validation*: do some candidates hold for the whole table?  For each left side a task keeps one row
  for each of its values, so a frequent value costs one row a task; only these are grouped.  Rows that
  a left side tells apart by a column's unique value are left out (stripped position lists).  Where
  a candidate fails, a pair of rows that refutes it comes back as a new agreement set.

:func:`discover` keeps minimal candidates in a prefix tree and specialises them by each agreement
set, level by level until a level is valid.  :func:`walk` is a depth-first random walk over each right
side's lattice, with holes found as minimal transversals; the walks of all right sides go in step, so
that a round's questions are one job.  Only candidates, agreement sets and pairs that refute reach
the driver.

Values are compared by 128 bits of hash, with a bit for null.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.strings import fd_text
from tabtaint.session import cut_lineage

#: Agreement sets that a task and the whole first pass give at most; more would only refute earlier.
TASK_SETS, FIRST_SETS = 2000, 20_000
#: Rows that a task compares at a time, and left sides in one job.
CHUNK_ROWS, JOB_SIDES = 100_000, 256
#: A column with this share of distinct values is worth finding its unique values.
KEY_LIKE = 0.5


def bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


# ---------------------------------------------------------------- the table

def _packed(equal: np.ndarray) -> list[int]:
    """Rows of a boolean matrix as ints, without repetition."""
    rows = np.unique(np.packbits(equal, axis=1, bitorder="little"), axis=0)
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def _arrays(t: pa.Table | pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second hashes, rows x columns; a first hash's lowest bit says that the value is unique."""
    out = []
    for name in ("a", "b"):
        c = t[name].combine_chunks() if isinstance(t, pa.Table) else t[name]
        c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
        out.append(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
    return out[0], out[1]


def _tables(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    some, n = [], 0
    for b in frames:
        some.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


class Hashed:
    """The table as two 64-bit hashes a value, written once."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.n, self.spark = len(columns), df.sparkSession
        first = [F.xxhash64(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).bitwiseAND(F.lit(-2)) for c in columns]
        second = [F.xxhash64(F.lit(7), F.col(f"`{c}`"), F.col(f"`{c}`").isNull()) for c in columns]
        rows = df.select(F.array(*first).alias("a"), F.array(*second).alias("b"))
        r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col("a")[i]).alias(f"d{i}") for i in range(self.n)]).first()
        self.rows, self.key_like = r["n"], [i for i in range(self.n) if r["n"] and r[f"d{i}"] >= KEY_LIKE * r["n"]]
        for i in self.key_like:
            one = rows.groupBy(F.col("a")[i].alias("_a"), F.col("b")[i].alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
            marked = rows.join(one, (F.col("a")[i] == F.col("_a")) & (F.col("b")[i] == F.col("_b")), "left")
            mark = F.transform("a", lambda x, k: F.when((k == i) & F.col("_n").isNotNull(), x.bitwiseOR(F.lit(1))).otherwise(x))  # noqa: B023
            rows = marked.select(mark.alias("a"), "b")
        self.data = cut_lineage(rows)

    def agreement_sets(self) -> list[int]:
        """Columns on which neighbours in the order of some column agree, largest sets first."""
        n = self.n

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[int] = set()
            for t in _tables(frames):
                a, b = _arrays(t, n)
                for i in range(n):
                    order = np.argsort(a[:, i], kind="stable")
                    for step in (1, 2):
                        x, y = order[:-step], order[step:]
                        same = a[x, i] == a[y, i]
                        if same.any():
                            x, y = x[same], y[same]
                            found.update(_packed((a[x] == a[y]) & (b[x] == b[y])))
            top = sorted(found, key=lambda m: (-m.bit_count(), m))[:TASK_SETS]
            yield pa.RecordBatch.from_pydict({"m": pa.array([m.to_bytes(n // 8 + 1, "little") for m in top], pa.binary()),
                                              "size": pa.array([m.bit_count() for m in top], pa.int32())})

        sets = self.data.mapInArrow(run, "m binary, size int").distinct().orderBy(F.desc("size"), "m").limit(FIRST_SETS).collect()
        return [int.from_bytes(r["m"], "little") for r in sets]

    def refutations(self, sides: list[tuple[int, int]]) -> dict[int, set[int]]:
        """For each left side (with the right sides asked for) that fails, agreement sets that show it."""
        out: dict[int, set[int]] = {}
        for k in range(0, len(sides), JOB_SIDES):
            for lhs, sets in self._refuted(sides[k:k + JOB_SIDES]).items():
                out.setdefault(lhs, set()).update(sets)
        return out

    def _refuted(self, sides: list[tuple[int, int]]) -> dict[int, set[int]]:
        n, sent = self.n, [(i, bits(x), bits(a)) for i, (x, a) in enumerate(sides)]

        def mixed(h: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h), np.uint64)
            for j in range(h.shape[1]):
                out = (out ^ (h[:, j].astype(np.uint64) >> np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            return out.astype(np.int64)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _tables(frames):
                a, b = _arrays(t, n)
                plain, unique = a & -2, (a & 1).astype(bool)
                row = np.concatenate([plain, b], axis=1)
                for side, lhs, rhs in sent:
                    at = np.flatnonzero(~unique[:, lhs].any(axis=1)) if lhs else np.arange(len(a))
                    x, y, r = mixed(plain[np.ix_(at, lhs)]), mixed(b[np.ix_(at, lhs)]), mixed(np.concatenate([plain[np.ix_(at, rhs)], b[np.ix_(at, rhs)]], axis=1))
                    order = np.lexsort((r, y, x))
                    x, y, r, at = x[order], y[order], r[order], at[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    least = r[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(r) else r
                    last = np.append(new[1:], True)[:len(new)]
                    keep = new | last & (r != least)   # of each value a row, and one that refutes
                    if (k := np.flatnonzero(keep)).size:
                        yield pa.RecordBatch.from_pydict({
                            "side": np.full(len(k), side, np.int32), "x": x[k], "y": y[k], "r": r[k],
                            "row": pa.array([v.tobytes() for v in row[at[k]]], pa.binary())})

        kept = self.data.mapInArrow(run, "side int, x bigint, y bigint, r bigint, row binary")
        pairs = kept.groupBy("side", "x", "y").agg(
            F.min("r").alias("low"), F.max("r").alias("high"), F.min_by("row", "r").alias("p"), F.max_by("row", "r").alias("q")) \
            .where("low <> high")
        pair = F.struct("p", "q")
        found = pairs.groupBy("side").agg(*[f(pair, F.xxhash64("x", "y", F.lit(s))).alias(f"v{i}")
                                            for i, (f, s) in enumerate([(F.min_by, 1), (F.max_by, 1), (F.min_by, 2), (F.max_by, 2)])]).collect()
        out = {}
        for r in found:   # one row a left side
            sets = set()
            for p, q in (r[f"v{i}"] for i in range(4)):
                same = (np.frombuffer(p, "<i8") == np.frombuffer(q, "<i8")).reshape(2, n).all(axis=0)
                sets.add(sum(1 << i for i in np.flatnonzero(same).tolist()))
            out[sides[r["side"]][0]] = sets
        return out


# ---------------------------------------------------------------- agreement sets and the prefix tree

class Tree:
    """Candidate left sides in a prefix tree: a node stands for the columns on its path, and holds the
    right sides that it is a candidate for and those that some node below is."""

    __slots__ = ("below", "children", "rhs")

    def __init__(self):
        self.children: dict[int, Tree] = {}
        self.rhs = self.below = 0

    def add(self, lhs: int, rhs: int) -> None:
        node = self
        for i in bits(lhs):
            node.below |= 1 << rhs
            node = node.children.setdefault(i, Tree())
        node.rhs |= 1 << rhs

    def has_part_of(self, lhs: int, rhs: int) -> bool:
        """Whether some candidate for ``rhs`` is part of ``lhs``."""
        if self.rhs >> rhs & 1:
            return True
        if not self.below >> rhs & 1:
            return False
        return any(c.has_part_of(lhs, rhs) for i, c in self.children.items() if lhs >> i & 1)

    def take_parts_of(self, lhs: int, rhs: int, path: int = 0) -> list[int]:
        """Removes the candidates for ``rhs`` that are part of ``lhs``."""
        out = []
        if self.rhs >> rhs & 1:
            self.rhs &= ~(1 << rhs)
            out.append(path)
        if self.below >> rhs & 1:
            for i, c in self.children.items():
                if lhs >> i & 1:
                    out += c.take_parts_of(lhs, rhs, path | 1 << i)
            if not any((c.rhs | c.below) >> rhs & 1 for c in self.children.values()):
                self.below &= ~(1 << rhs)
        return out

    def level(self, size: int, path: int = 0) -> list[tuple[int, int]]:
        """Left sides of ``size`` columns with their right sides."""
        if size == 0:
            return [(path, self.rhs)] if self.rhs else []
        return [x for i, c in sorted(self.children.items()) for x in c.level(size - 1, path | 1 << i)]

    def specialise(self, agree: int, n: int, most: int) -> None:
        """No candidate within ``agree`` holds for a column outside: each is replaced by those with one
        more column, unless a part of them is a candidate still."""
        for rhs in range(n):
            if agree >> rhs & 1:
                continue
            for lhs in self.take_parts_of(agree, rhs):
                if lhs.bit_count() >= most:
                    continue
                for i in range(n):
                    if not (agree >> i & 1 or i == rhs) and not self.has_part_of(lhs | 1 << i, rhs):
                        self.add(lhs | 1 << i, rhs)


def discover(df: DataFrame, columns=None, max_lhs: int | None = None, sample_size=None, seed: int = 0,
             key: str | None = None, max_columns: int | None = None):
    """Minimal FDs ``(lhs tuple, rhs)``; ``()`` lhs = constant column.

    The whole lattice is searched; ``max_lhs`` and ``max_columns`` are opt-in limits.  ``sample_size``
    and ``seed`` have no effect any more: agreement sets come from all rows.  An empty table has every
    column constant.
    """
    cols = _columns(df, columns, key, max_columns)
    n = len(cols)
    most = n if max_lhs is None else max_lhs
    table = Hashed(df, cols)
    tree = Tree()
    for a in range(n):
        tree.add(0, a)
    for agree in table.agreement_sets():
        tree.specialise(agree, n, most)
    size, valid = 0, set()
    while size <= min(n - 1, most):
        asked = [(lhs, rhs) for lhs, rhs in tree.level(size) if (lhs, rhs) not in valid]
        refuted = table.refutations(asked)
        valid |= {(lhs, rhs) for lhs, rhs in asked if lhs not in refuted}
        for agree in sorted(set().union(*refuted.values()), key=lambda m: -m.bit_count()):
            tree.specialise(agree, n, most)
        size += not refuted
    return sorted(((_names(lhs, cols), cols[a]) for k in range(n + 1) for lhs, rhs in tree.level(k) for a in bits(rhs)),
                  key=lambda x: (len(x[0]), [cols.index(c) for c in x[0]], cols.index(x[1])))


def _columns(df: DataFrame, columns, key: str | None, max_columns: int | None) -> list[str]:
    cols = list(columns or [c for c in df.columns if c != key])
    if max_columns is not None and len(cols) >= max_columns:
        raise ValueError(f"{len(cols)} columns: FD discovery was limited to fewer than {max_columns} columns")
    return cols


def _names(mask: int, cols: list[str]) -> tuple[str, ...]:
    return tuple(cols[i] for i in bits(mask))


# ---------------------------------------------------------------- depth-first random walk

def _transversals(sets: list[int], within: int) -> list[int]:
    """Minimal column sets that meet the complement (in ``within``) of each of ``sets``."""
    out = [0]
    for s in sets:
        gap = within & ~s
        hit = [t for t in out if t & gap]
        grown = {t | 1 << i for t in out if not t & gap for i in bits(gap)}
        out = hit + [t for t in grown if not any(h & t == h for h in hit)]
        out = [t for t in out if not any(u != t and u & t == u for u in out)]
    return out


def _walk(rhs: int, n: int, pick: random.Random):
    """Minimal left sides of ``rhs``.  Yields a left side to be judged and is sent whether it holds."""
    within = ((1 << n) - 1) & ~(1 << rhs)
    holds: list[int] = []    # left sides known to hold
    fails: list[int] = []    # maximal among those known to fail
    least: set[int] = set()

    def known(x: int) -> bool | None:
        if any(h & x == h for h in holds):
            return True
        return False if any(x & f == x for f in fails) else None

    def judged(x: int):
        verdict = known(x)
        if verdict is None:
            verdict = yield x
            if verdict:
                holds.append(x)
            else:
                fails[:] = [f for f in fails if f & x != f] + [x]
        return verdict

    if (yield from judged(0)):
        return {0}
    seeds = [1 << i for i in bits(within)]
    pick.shuffle(seeds)
    while seeds:
        trace, node = [], seeds.pop()
        while node is not None:
            if (yield from judged(node)):
                down = [node & ~(1 << i) for i in bits(node)]
                ways = [x for x in down if known(x) is None]
                if not ways and not any(known(x) for x in down):
                    least.add(node)
                ways = ways or [x for x in down if known(x) and not any(m & x == m for m in least)]
            else:
                ways = [node | 1 << i for i in bits(within & ~node) if known(node | 1 << i) is None]
            if ways:
                trace.append(node)
                node = pick.choice(ways)
            else:
                node = trace.pop() if trace else None
        if not seeds:   # holes: what no failed side covers and no least side is part of
            seeds = [t for t in _transversals(fails, within) if not any(m & t == m for m in least)]
    return least


def walk(df: DataFrame, columns=None, seed: int = 0, key: str | None = None, max_columns: int | None = None):
    """The same minimal FDs by depth-first random walks (DFD), one for each right side.

    A question that an agreement set answers costs nothing; the others of a round are one job."""
    cols = _columns(df, columns, key, max_columns)
    n = len(cols)
    table = Hashed(df, cols)
    agree = table.agreement_sets()
    walks = {a: _walk(a, n, random.Random(f"{seed}:{cols[a]}")) for a in range(n)}
    asked, found = {}, {}

    def step(a: int, verdict: bool | None) -> None:
        """Goes on until a question is left that the known agreement sets can't answer."""
        try:
            x = walks[a].send(verdict)
            while any(m & x == x and not m >> a & 1 for m in agree):
                x = walks[a].send(False)
            asked[a] = x
        except StopIteration as end:
            found[a] = end.value

    for a in walks:
        step(a, None)
    while asked:
        sides: dict[int, int] = {}
        for a, x in asked.items():
            sides[x] = sides.get(x, 0) | 1 << a
        refuted = table.refutations(sorted(sides.items()))
        agree += sorted(set().union(*refuted.values()) - set(agree))
        questions, again = dict(asked), set()
        asked.clear()
        for a, x in questions.items():
            if x not in refuted:
                step(a, True)
            elif any(m & x == x and not m >> a & 1 for m in agree):
                step(a, False)
            else:   # refuted for another right side: ask again
                again.add(a)
        asked |= {a: questions[a] for a in again}
    out = [(_names(x, cols), cols[a]) for a, sides in found.items() for x in sides]
    return sorted(out, key=lambda x: (len(x[0]), [cols.index(c) for c in x[0]], cols.index(x[1])))


# ---------------------------------------------------------------- reports

def fd_table(spark, fds) -> DataFrame:
    """FDs as a table ``lhs, rhs, fd`` (``A,B -> C``)."""
    rows = [(",".join(lhs), rhs) for lhs, rhs in fds]
    df = spark.createDataFrame(rows, "lhs string, rhs string")
    return df.withColumn("fd", fd_text(F.array(F.col("lhs")), F.col("rhs")))


def fd_records(spark, fds) -> DataFrame:
    """FDs as records: ``lhs`` an array of columns, ``rhs`` a column."""
    return spark.createDataFrame([(list(lhs), rhs) for lhs, rhs in fds], "lhs array<string>, rhs string")


def fd_report(spark, name: str, fds) -> DataFrame:
    """FD3: one JSON record per dataset: ``{dataset, result: count, notes: [fd texts]}``."""
    texts = [f"{','.join(lhs)} -> {rhs}" for lhs, rhs in fds]
    df = spark.createDataFrame([(name, len(texts), texts)], "dataset string, result long, fds array<string>")
    return df.select("dataset", "result", F.to_json(F.struct(F.col("fds").alias("fds"))).alias("notes"))


def fd_batch(spark, tables: dict[str, tuple[DataFrame, str, list[str]]], rows: int = 100, seed: int = 0) -> DataFrame:
    """FD3 over many tables ``{name: (table, row key, columns)}``: FDs of a hash sample of ``rows`` rows of
    each (all rows, if ``rows`` is None), one report record a table."""
    from tabtaint.operators.sampling import sample_rows
    out = None
    for name, (df, key, columns) in tables.items():   # one job chain a table, as many as the batch names
        part = df if rows is None else sample_rows(df, key, rows, seed, "fd-batch")
        report = fd_report(spark, name, discover(part, columns))
        out = report if out is None else out.unionByName(report)
    return out
