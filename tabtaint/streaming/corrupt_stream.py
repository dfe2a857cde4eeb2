"""STM2: corrupt an unbounded table with a plan frozen on a batch.

Exact-k row choice needs the whole table, so a stream uses a Bernoulli rule instead:
row hit iff ``u(seed, rows, row_key) < rate`` (deterministic per row, so replays and
retries hit the same rows).  Columns, noise scales, standard deviations and value maps are
fitted once on a batch and applied as a stateless projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtaint.functions.rng import normal, py_uniform, uniform
from tabtaint.functions.strings import typo
from tabtaint.operators import corrupt as C
from tabtaint.spec import INTEGRAL_TYPES, TableSpec


@dataclass
class FrozenPlan:
    kind: str
    rate: float
    seed: object
    columns: list
    std: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    factors: dict = field(default_factory=dict)
    maps: dict = field(default_factory=dict)
    integral: set = field(default_factory=set)
    placeholders: dict = field(default_factory=dict)   # column -> the value the batch operator writes


def fit_plan(batch: DataFrame, spec: TableSpec, kind: str, rate: float, column_fraction: float = 0.2, seed=None) -> FrozenPlan:
    if seed is None:
        raise ValueError("a random seed is required (RND1)")
    kind = kind.upper()
    cols = C.choose_columns(spec, kind, column_fraction, seed, present=set(batch.columns))
    plan = FrozenPlan(kind, rate, seed, cols,
                      integral={f.name for f in batch.schema.fields if isinstance(f.dataType, INTEGRAL_TYPES)})
    if kind == "NOI" and cols:
        plan.std = batch.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first().asDict()
        plan.scales = {c: C.NOISE_SCALE_MIN + py_uniform(seed, f"noi-scale:{c}", "") * (C.NOISE_SCALE_MAX - C.NOISE_SCALE_MIN)
                       for c in cols}
    text = {f.name for f in batch.schema.fields if isinstance(f.dataType, T.StringType)} | set(spec.categorical)
    plan.placeholders = {c: C.CATEGORICAL_PLACEHOLDER if c in text else C.NUMERIC_PLACEHOLDER for c in cols}
    if kind == "OUT":
        from tabtaint.functions.rng import py_sample
        plan.factors = {c: py_sample(C.OUTLIER_FACTORS, 1, seed, f"out:{c}")[0] for c in cols}
    if kind in ("SFT", "LER"):
        for c in cols:
            k, mp = C.derangement_map(batch, c, seed, f"sft:{c}")
            plan.maps[c] = mp   # literal pairs, or a static table that the stream is joined with
    return plan


def apply_plan(stream: DataFrame, plan: FrozenPlan, key: str = "row_key") -> DataFrame:
    hit = uniform(plan.seed, "rows", key) < F.lit(plan.rate)
    out = stream
    for c in plan.columns:
        x = F.col(c)
        if plan.kind == "NOI":
            noise = normal(plan.seed, f"noi:{c}", key) * F.lit(plan.scales[c] * (plan.std[c] or 0.0))
            if c in plan.integral:
                new, x = x.cast("bigint") + F.greatest(noise.cast("bigint"), F.lit(1).cast("bigint")), x.cast("bigint")
            else:
                new, x = x.cast("double") + noise, x.cast("double")
        elif plan.kind == "OUT":
            x = x.cast("bigint") if c in plan.integral else x
            new = F.try_multiply(x, F.lit(plan.factors[c]).cast("bigint" if c in plan.integral else "double"))
        elif plan.kind == "PLC":
            value = plan.placeholders[c]
            new = F.lit(value) if isinstance(value, str) else F.lit(value).cast(stream.schema[c].dataType)
            x = x.cast("string") if isinstance(value, str) else x
        elif plan.kind == "EMV":
            new = F.lit(None).cast(stream.schema[c].dataType)
        elif plan.kind == "INC":
            x = x.cast("string")
            new = typo(x, plan.seed, f"inc:{c}")
        elif plan.kind in ("SFT", "LER"):
            if isinstance(plan.maps[c], DataFrame):
                out = out.join(plan.maps[c].select(F.col("old").alias(c), F.col("new").alias(f"_new_{c}")), c, "left")
                out = out.withColumn(c, F.when(hit, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c))).select(*stream.columns)
                continue
            mp = F.create_map(*[y for k, v in plan.maps[c].items() for y in (F.lit(k), F.lit(v))])
            new = F.coalesce(F.element_at(mp, x), x)
        else:
            raise ValueError(f"{plan.kind} is not a row-local error (DUP needs the whole table)")
        out = out.withColumn(c, F.when(hit, new).otherwise(x))
    return out
