"""Data-error injection (ERR1-ERR15).

``corrupt(df, spec, kind, row_fraction, column_fraction, seed)`` picks exactly
``int(max(row_fraction * n, 1))`` rows (smallest ``md5(seed:rows:row_key)``) and
``int(max(column_fraction * (#numeric + #categorical), 1))`` columns from the pool the error
applies to, then rewrites the chosen cells in ONE projection: ``when(hit, new).otherwise(old)``.
No join back, no per-column pass over the data.  Per-column constants (scale factors, noise
scales, standard deviations, value maps) are computed once, on the driver or in one
aggregation over all chosen columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtaint.functions.rng import (hash_hex, normal, py_hash, py_sample, py_uniform, uniform)
from tabtaint.functions.strings import typo
from tabtaint.operators.sampling import (hash_thresholds, number_by_hash, row_count_k,
                                         threshold_flag)
from tabtaint.spec import INTEGRAL_TYPES, TableSpec

# fixed values that define the error types (codes, applicability, placeholders, factors)
ERROR_CODES = {"SFT": "categorical_shift", "NOI": "gaussian_noise", "PLC": "placeholder",
               "DUP": "near_duplicate", "OUT": "outlier", "INC": "inconsistency",
               "LER": "label_error", "EMV": "explicit_missing_value"}
APPLICABILITY = {"SFT": "categorical", "NOI": "numeric", "PLC": "any", "DUP": "any",
                 "OUT": "numeric", "INC": "categorical", "LER": "target", "EMV": "any"}
NUMERIC_PLACEHOLDER = -1
CATEGORICAL_PLACEHOLDER = "UNKNOWN"
OUTLIER_FACTORS = [10, 100, 1000]
NOISE_SCALE_MIN, NOISE_SCALE_MAX = 1.0, 5.0
SMALL_MAP = 64     # value maps up to this size become literals: planning costs grow with every entry
BROADCAST_MAP_BYTES = 32 << 20   # larger maps up to this size are broadcast
MAP_SALTS = 16     # copies of a map that is too large to broadcast


@dataclass
class CorruptionResult:
    df: DataFrame                      # corrupted table (same row_key column)
    rows: DataFrame                    # (row_key) of the chosen rows
    columns: list = field(default_factory=list)
    changes: DataFrame | None = None   # audit: (row_key, column, old_value, new_value)
    params: dict = field(default_factory=dict)


def _validate(row_fraction, column_fraction):
    if not 0 <= row_fraction <= 1:
        raise ValueError(f"row_fraction is a share of the rows between 0 and 1, not {row_fraction}")
    if not 0 <= column_fraction <= 1:
        raise ValueError(f"column_fraction is a share of the columns between 0 and 1, not {column_fraction}")


def _require_seed(seed):
    if seed is None:
        raise ValueError("a random seed is required for every draw (RND1)")


def choose_columns(spec: TableSpec, kind: str, column_fraction: float, seed, present=None) -> list[str]:
    """ERR1 column choice: count from #numeric + #categorical, drawn from the applicable pool."""
    num = [c for c in spec.numeric if present is None or c in present]
    cat = [c for c in spec.categorical if present is None or c in present]
    if APPLICABILITY[kind] == "target":
        return [spec.target] if spec.target and (present is None or spec.target in present) else []
    how_many = int(max(column_fraction * (len(num) + len(cat)), 1))
    pool = {"categorical": cat, "numeric": num, "any": num + cat}[APPLICABILITY[kind]]
    return py_sample(pool, how_many, seed, f"cols:{kind}")


def row_hash(spec: TableSpec, seed, tag: str = "rows") -> Column:
    return hash_hex(seed, tag, spec.row_key)


def pick_rows(df: DataFrame, spec: TableSpec, row_fraction: float, seed, tag: str = "rows"):
    """Exactly ``int(max(fraction*n, 1))`` rows: (flag column, k, n)."""
    h = row_hash(spec, seed, tag)
    th, counts = hash_thresholds(df, h, row_count_k(row_fraction))
    n = sum(counts.values())
    k = int(max(row_fraction * n, 1)) if n else 0
    return threshold_flag(h, th), k, n


def derangement_map(df: DataFrame, column: str, seed, tag: str):
    """RND5 over the distinct values of ``column``: successor in hash order (single cycle).

    Returns ``("literal", {old: new})`` when the vocabulary is small, else
    ``("table", DataFrame(old, new))`` built distributed by hash numbering.
    """
    values = df.select(F.col(column).alias("old")).where(F.col("old").isNotNull()).distinct()
    m = values.count()
    if m <= SMALL_MAP:
        vals = [r["old"] for r in values.collect()]
        order = sorted(vals, key=lambda v: py_hash(seed, tag, v))
        if len(order) < 2:
            return "literal", {v: v for v in order}
        return "literal", {v: order[(i + 1) % len(order)] for i, v in enumerate(order)}
    numbered, m = number_by_hash(values, "old", seed, tag)
    succ = numbered.select(F.col("old").alias("new"), ((F.col("_pos") - 1 + m) % m).alias("_pos"))
    return "table", numbered.join(succ, "_pos").select("old", "new").withColumn("_m", F.lit(m))


def _map_expr(mapping: dict, col: Column) -> Column:
    if not mapping:
        return col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, col), col)


def _apply_value_map(df: DataFrame, column: str, kind_map, hit: Column) -> DataFrame:
    kind, mp = kind_map
    if kind == "literal":
        return df.withColumn(column, F.when(hit, _map_expr(mp, F.col(column))).otherwise(F.col(column)))
    # large vocabulary: a map of checked size is broadcast (the data is not shuffled, so a hot
    # value costs nothing extra); beyond that only the rows that change are joined, on the value
    # and a salt, so that a hot value's rows meet its entry in many tasks
    size = mp.agg(F.sum(F.octet_length(F.col("old").cast("string")) + F.octet_length(F.col("new").cast("string")) + 32)).first()[0] or 0
    mp = mp.select(F.col("old").alias(column), "new")
    tmp = df.withColumn("_hit", hit & F.col(column).isNotNull())
    if size <= BROADCAST_MAP_BYTES:
        j = tmp.join(F.broadcast(mp), column, "left")
        return j.withColumn(column, F.when(F.col("_hit") & F.col("new").isNotNull(), F.col("new"))
                            .otherwise(F.col(column))).drop("new", "_hit").select(*df.columns)
    salted = mp.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(MAP_SALTS - 1))))
    hits = tmp.where("_hit").withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(MAP_SALTS)).cast("int")) \
        .join(salted, [column, "_salt"], "left").withColumn(column, F.coalesce("new", column))
    return hits.select(*df.columns).unionByName(tmp.where(~F.col("_hit")).select(*df.columns))


def _placeholder(dtype, numeric_value, text_value):
    if isinstance(dtype, T.StringType):
        return F.lit(text_value)
    if isinstance(dtype, (T.NumericType,)):
        return F.lit(numeric_value).cast(dtype)
    return F.lit(text_value)


@dataclass
class Job:
    """What a corruptor works on: ``df`` is the table with the rows that are hit marked by ``hit``."""
    df: DataFrame
    spec: TableSpec
    kind: str
    columns: list
    hit: Column
    seed: object
    params: dict

    def __post_init__(self):
        self.types = {f.name: f.dataType for f in self.df.schema.fields}


#: EXT1: error types by code; see :func:`corruptor`.
CORRUPTORS: dict[str, Callable[[Job], DataFrame]] = {}


def corruptor(*codes: str, applies: str = "any"):
    """Registers ``fn(job) -> DataFrame`` for some codes: the table with the columns of the rows that are hit
    changed.  It keeps all other columns, known or not, and may leave numbers in ``job.params``.
    ``applies`` says which columns a new code is for: any, numeric, categorical or the target."""
    def deco(fn):
        for c in codes:
            CORRUPTORS[c] = fn
            APPLICABILITY.setdefault(c, applies)
        return fn
    return deco


@corruptor("PLC", "EMV")
def _put_placeholders(job: Job) -> DataFrame:
    out = job.df
    for c in job.columns:
        new = F.lit(None).cast(job.types[c])
        if job.kind == "PLC":
            if c in job.spec.categorical and not isinstance(job.types[c], T.StringType):
                out = out.withColumn(c, F.col(c).cast("string"))
                new = F.lit(CATEGORICAL_PLACEHOLDER)
            else:
                new = _placeholder(job.types[c], NUMERIC_PLACEHOLDER, CATEGORICAL_PLACEHOLDER)
        out = out.withColumn(c, F.when(job.hit, new).otherwise(F.col(c)))
    return out


@corruptor("OUT")
def _put_outliers(job: Job) -> DataFrame:
    factors = job.params["factors"] = {c: py_sample(OUTLIER_FACTORS, 1, job.seed, f"out:{c}")[0] for c in job.columns}
    out = job.df
    for c in job.columns:
        x = F.col(c).cast("bigint") if isinstance(job.types[c], INTEGRAL_TYPES) else F.col(c)
        new = F.try_multiply(x, F.lit(factors[c]).cast(x_type(job.types[c])))
        out = out.withColumn(c, F.when(job.hit, new).otherwise(x))
    return out


@corruptor("NOI")
def _put_noise(job: Job) -> DataFrame:
    sig = job.df.agg(*[F.stddev_pop(c).alias(c) for c in job.columns]).first().asDict()
    scales = {c: NOISE_SCALE_MIN + py_uniform(job.seed, f"noi-scale:{c}", "") * (NOISE_SCALE_MAX - NOISE_SCALE_MIN)
              for c in job.columns}
    job.params.update({"std": sig, "scales": scales})
    out = job.df
    for c in job.columns:
        noise = normal(job.seed, f"noi:{c}", job.spec.row_key) * F.lit(scales[c] * (sig[c] or 0.0))
        if isinstance(job.types[c], INTEGRAL_TYPES):
            x = F.col(c).cast("bigint")
            new = x + F.greatest(noise.cast("bigint"), F.lit(1).cast("bigint"))
        else:
            x = F.col(c).cast("double")
            new = x + noise
        out = out.withColumn(c, F.when(job.hit, new).otherwise(x))
    return out


@corruptor("SFT", "LER")
def _swap_values(job: Job) -> DataFrame:
    out = job.df
    for c in job.columns:
        out = _apply_value_map(out, c, derangement_map(job.df, c, job.seed, f"sft:{c}"), job.hit)
    return out


@corruptor("INC")
def _put_typos(job: Job) -> DataFrame:
    out = job.df
    for c in job.columns:
        x = F.col(c).cast("string")
        out = out.withColumn(c, F.when(job.hit, typo(x, job.seed, f"inc:{c}")).otherwise(x))
    return out


@corruptor("DUP")
def _add_duplicates(job: Job) -> DataFrame:
    """Copies of the rows that are hit, changed and with a key of their own, beside all rows."""
    key, dup, base = job.spec.row_key, job.df.filter(job.hit), job.df
    for c in job.columns:
        if c in job.spec.categorical:
            dup = dup.withColumn(c, typo(F.col(c), job.seed, f"inc:{c}"))
            base = base.withColumn(c, F.col(c).cast("string"))
        else:
            dup = dup.withColumn(c, _placeholder(job.types[c], NUMERIC_PLACEHOLDER, CATEGORICAL_PLACEHOLDER))
    dup = dup.withColumn(key, F.concat(F.col(key), F.lit(COPY_MARK)))
    return base.unionByName(dup.select(*base.columns))


COPY_MARK = "#dup"


def corrupt(df: DataFrame, spec: TableSpec, kind: str, row_fraction: float,
            column_fraction: float = 0.2, seed=None, audit: bool = True) -> CorruptionResult:
    """Apply a registered error type (SFT NOI PLC DUP OUT INC LER EMV) to a fraction of the rows.

    The audit log comes from the same projection: it carries each changed column's text from before."""
    _require_seed(seed)
    _validate(row_fraction, column_fraction)
    kind = kind.upper()
    if kind not in CORRUPTORS:
        raise ValueError(f"unknown error type {kind}; valid: {sorted(CORRUPTORS)}")
    hit, k, n = pick_rows(df, spec, row_fraction, seed)
    cols = choose_columns(spec, kind, column_fraction, seed, present=set(df.columns))
    rows = df.filter(hit).select(spec.row_key)
    params: dict = {"k": k, "n": n}
    if not cols:
        return CorruptionResult(df, rows, [], _empty_changes(df), params)
    old = [f"_before_{i}" for i in range(len(cols))] if audit else []
    data = df.withColumns({o: F.col(c).cast("string") for o, c in zip(old, cols)}) if audit else df
    out = CORRUPTORS[kind](Job(data, spec, kind, cols, hit, seed, params))
    changes = None
    if audit:
        key = F.col(spec.row_key)
        changed = out.filter(key.endswith(COPY_MARK)) if kind == "DUP" else out.filter(hit)
        changes = _changes(changed.withColumn(spec.row_key, F.regexp_replace(spec.row_key, f"{COPY_MARK}$", "")) if kind == "DUP" else changed,
                           spec, cols, old)
    return CorruptionResult(out.drop(*old), rows, cols, changes, params)


def x_type(dtype):
    return "bigint" if isinstance(dtype, INTEGRAL_TYPES) else dtype


def _empty_changes(df):
    return df.sparkSession.createDataFrame([], "row_key string, column string, old_value string, new_value string")


def _changes(changed: DataFrame, spec: TableSpec, cols, old) -> DataFrame:
    """Audit log of changed cells: one row per (row_key, column) whose value changed, from before and after
    side by side."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(o).alias("old_value"),
                                         F.col(c).cast("string").alias("new_value")) for o, c in zip(old, cols)]))
    return (changed.select(F.col(spec.row_key).alias("row_key"), cells.alias("_c"))
            .select("row_key", "_c.column", "_c.old_value", "_c.new_value")
            .where(~F.col("old_value").eqNullSafe(F.col("new_value"))))


def drop_corrupted(df: DataFrame, rows: DataFrame, key: str = "row_key") -> DataFrame:
    """FLT4: semi-perfect data = rows not in the corrupted set (left anti join)."""
    return df.join(rows.select(key), key, "left_anti")
