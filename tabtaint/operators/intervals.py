"""Range join of positions with disjoint integer intervals as an equi join (JN6).

An interval is cut into blocks of a fixed grid: of ``BASE ** level`` positions each, aligned, as large
as fit.  A position lies in one block of each level, so it meets the block that holds its interval
by equality of (level, block), and no other.  An interval has at most ``2 * (BASE - 1)`` blocks a
level, a single position just one, and a position as many keys as there are levels: neither depends
on how the intervals' lengths are spread, and no join key is constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtaint.functions.rng import hash_hex
from tabtaint.session import cut_lineage

BASE = 16
#: Values that one window sums along; more are dealt by the hash of the value.
WINDOW_VALUES, MOST_DIGITS = 50_000, 4
#: Positions that only have their own parts of the values summed along: at most so many, and one for so many values.
FEW_POINTS, VALUES_PER_POINT = 100_000, 16
MISSING = "∅"


def levels_for(positions: int) -> int:
    """Levels of a grid over ``positions`` positions."""
    n = 1
    while BASE ** n < positions:
        n += 1
    return n


def blocks(lo: Column, hi: Column, levels: int) -> Column:
    """The blocks of ``[lo, hi)`` as an array of (level, block)."""
    def aligned(level: int) -> tuple[Column, Column]:
        size = BASE ** level
        return _div(lo + (size - 1), size), _div(hi, size)

    def run(level: int, first: Column, end: Column) -> Column:
        blocks_ = F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(blocks_, lambda k: F.struct(F.lit(level).alias("level"), k.alias("block")))

    parts = []
    for level in range(levels):
        first, end = aligned(level)
        if level + 1 == levels:
            parts.append(run(level, first, end))
            continue
        up_first, up_end = aligned(level + 1)
        covered = up_first < up_end      # the middle is made of larger blocks
        parts += [run(level, first, F.when(covered, up_first * BASE).otherwise(end)),
                  run(level, F.when(covered, up_end * BASE).otherwise(end), end)]
    return F.concat(*parts)


def _div(a: Column, size: int) -> Column:
    """``a // size`` of a number that isn't negative; sizes are powers of two."""
    return F.shiftright(a, size.bit_length() - 1)


def keys(position: Column, levels: int) -> Column:
    """The blocks that a position lies in."""
    return F.array(*[F.struct(F.lit(level).alias("level"), _div(position, BASE ** level).alias("block")) for level in range(levels)])


def join_intervals(points: DataFrame, intervals: DataFrame, on: list[str], positions: int,
                   position: str = "_pos", lo: str = "_lo", hi: str = "_hi") -> DataFrame:
    """``points`` with the columns of the interval that holds their ``position``, within equal ``on``
    columns; points in no interval are dropped.  The intervals of a group are disjoint, and
    positions lie below ``positions``."""
    n = levels_for(positions)
    left = points.withColumn("_key", F.explode(keys(F.col(position).cast("bigint"), n)))
    right = intervals.withColumn("_key", F.explode(blocks(F.col(lo).cast("bigint"), F.col(hi).cast("bigint"), n))).drop(lo, hi)
    names = [*on, "_level", "_block"]
    left, right = (x.withColumn("_level", F.col("_key.level")).withColumn("_block", F.col("_key.block")).drop("_key") for x in (left, right))
    # both sides are a multiple of what Spark's size estimates say (draws are a range, exploded), so neither is broadcast
    return left.hint("merge").join(right, names).drop("_level", "_block")


def along(counts: DataFrame, groups: list[str], value: str, weight: str, seed, tag: str,
          points: DataFrame | None = None, n_points: int = 0, positions: int = 1) -> DataFrame:
    """``_lo`` and ``_hi``: each row's interval of the running total of ``weight`` in its group, in the
    order of the hash of ``value`` (distinct in a group).

    Groups with many values are summed by parts of the hash space first, then within each part.  With
    ``points`` (``n_points`` rows of the group columns and ``_pos``, below ``positions``) ``counts`` is a stored table, and the
    rows of a part without any point may be missing: where points are few, most values are only added up."""
    h = hash_hex(seed, tag, F.coalesce(F.col(value).cast("string"), F.lit(MISSING)))
    x = counts.withColumn("_h", h)
    x = cut_lineage(x) if points is None else x
    n, digits = x.count(), 0
    while digits < MOST_DIGITS and n > WINDOW_VALUES * 16 ** digits:
        digits += 1
    few = points is not None and digits > 0 and n_points <= min(FEW_POINTS, n // VALUES_PER_POINT)
    while few and digits < MOST_DIGITS and 16 ** digits < VALUES_PER_POINT * n_points:
        digits += 1
    x = x.withColumn("_part", F.substring("_h", 1, digits) if digits else F.lit(""))
    parts = x.groupBy(*groups, "_part").agg(F.sum(weight).alias("_sum"))
    order = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0)))
    if few:
        parts = cut_lineage(parts)
        spans = parts.select(*groups, "_part", F.col("_before").alias("_lo"), (F.col("_before") + F.col("_sum")).alias("_hi"))
        hit = cut_lineage(join_intervals(points.select(*groups, "_pos"), spans, groups, positions).select(*groups, "_part").distinct())
        x = x.join(F.broadcast(hit), [*groups, "_part"], "left_semi")   # FEW_POINTS rows at most
    parts = parts.drop("_sum")
    within = Window.partitionBy(*groups, "_part").orderBy("_h", value).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("_lo", F.coalesce(F.sum(weight).over(within), F.lit(0))) \
        .join(parts, [*groups, "_part"]) \
        .withColumn("_lo", (F.col("_before") + F.col("_lo")).cast("bigint")) \
        .withColumn("_hi", (F.col("_lo") + F.col(weight)).cast("bigint")).drop("_before", "_part", "_h")
