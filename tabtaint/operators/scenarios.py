"""Multi-error scenarios of the worked example (ERR10-ERR15, RND8-RND10).

Five error kinds hit five disjoint row blocks (10% each) cut from ONE hash permutation;
each kind has at most three columns chosen from the sorted candidates.  A scenario is the
set of active kinds, applied in the fixed order scale, shift, noise, missing, label flip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.functions.rng import normal, py_hash, py_sample, py_uniform, uniform
from tabtaint.operators.sampling import number_by_hash
from tabtaint.spec import INTEGRAL_TYPES
from tabtaint.operators.profile import bounded_values

# fixed values of the worked example
ERROR_KINDS = ["scale", "shift", "missing", "noise", "label_flip"]
APPLY_ORDER = ["scale", "shift", "noise", "missing", "label_flip"]
SCALE_FACTOR = 100
NOISE_RANGE = (0.1, 2.0)
NUMERIC_MISSING, TEXT_MISSING = -1, "?"
SCENARIOS = {
    "Clean (Baseline)": [],
    "Clean Scaling": [e for e in ERROR_KINDS if e != "scale"],
    "Clean Shifting": [e for e in ERROR_KINDS if e != "shift"],
    "Clean Missing": [e for e in ERROR_KINDS if e != "missing"],
    "Clean Noise": [e for e in ERROR_KINDS if e != "noise"],
    "Clean Labels": [e for e in ERROR_KINDS if e != "label_flip"],
    "No cleaning": list(ERROR_KINDS),
}


class ScenarioCorruptor:
    """Plans the blocks and columns once; ``corrupted(active)`` returns a lazily planned table."""

    def __init__(self, df: DataFrame, key: str, target: str, numeric, categorical, seed,
                 error_rate: float = 0.1, n_cols: int = 3):
        if seed is None:
            raise ValueError("a random seed is required (RND1)")
        self.key, self.target, self.seed = key, target, seed
        self.numeric, self.categorical = list(numeric), list(categorical)
        allc = self.numeric + self.categorical

        def pick(tag, cands):
            return py_sample(sorted(cands), min(len(cands), n_cols), seed, f"pick:{tag}") if cands else []
        self.columns = {"scale": pick("scale", self.numeric), "shift": pick("shift", self.categorical),
                        "missing": pick("missing", allc), "noise": pick("noise", self.numeric)}
        numbered, n = number_by_hash(df, key, seed, "blocks")
        self.n = n
        self.per = int(n * error_rate)
        block = F.when(F.col("_pos") < 5 * self.per, F.floor(F.col("_pos") / F.lit(max(self.per, 1)))).cast("int")
        # every scenario starts from this table: number it once
        self.base = numbered.withColumn("_block", block).drop("_pos").persist()
        self.schema = {f.name: f.dataType for f in df.schema.fields}
        self.df = df
        self._vocab = {}
        self._sigma = {}

    def _values(self, c):
        if c not in self._vocab:
            vals = bounded_values(self.df, c)
            self._vocab[c] = sorted(vals, key=lambda v: py_hash(self.seed, f"vals:{c}", v))
        return self._vocab[c]

    def expressions(self, active) -> dict:
        """Column expressions over the numbered base table for a scenario: every kind is a
        per-row rewrite, so several scenarios can be evaluated side by side in one projection."""
        cur = {c: F.col(c) for c in self.df.columns}
        for kind in APPLY_ORDER:
            if kind not in active:
                continue
            hit = F.col("_block") == ERROR_KINDS.index(kind)
            if kind == "scale":
                for c in self.columns["scale"]:
                    integral = isinstance(self.schema[c], INTEGRAL_TYPES)
                    x = cur[c].cast("bigint") if integral else cur[c]
                    cur[c] = F.when(hit, F.try_multiply(x, F.lit(SCALE_FACTOR).cast("bigint" if integral else "double"))) \
                        .otherwise(x)
            elif kind == "shift":
                for c in self.columns["shift"]:
                    vals = self._values(c)
                    m = len(vals)
                    if m < 2:
                        continue
                    off = 1 + int(py_uniform(self.seed, f"shift-offset:{c}", "") * (m - 1))
                    mp = F.create_map(*[x for i, v in enumerate(vals) for x in (F.lit(v), F.lit(vals[(i + off) % m]))])
                    cur[c] = F.when(hit, F.coalesce(F.element_at(mp, cur[c]), cur[c])).otherwise(cur[c])
            elif kind == "noise":
                cols = self.columns["noise"]
                if not cols:
                    continue
                # sample std of the table as it is at this point: only an earlier scaling can
                # change the noise columns, so scenarios share one std job per case
                key = "scale" in active and bool(set(cols) & set(self.columns["scale"]))
                if key not in self._sigma:
                    self._sigma[key] = self.base.agg(*[F.stddev_samp(cur[c]).alias(c) for c in cols]).first().asDict()
                sig = self._sigma[key]
                for c in cols:
                    s = NOISE_RANGE[0] + py_uniform(self.seed, f"noise-scale:{c}", "") * (NOISE_RANGE[1] - NOISE_RANGE[0])
                    noise = normal(self.seed, f"ex-noise:{c}", self.key) * F.lit(s * (sig[c] or 0.0))
                    x = cur[c].cast("double")
                    cur[c] = F.when(hit, x + noise).otherwise(x)
            elif kind == "missing":
                for c in self.columns["missing"]:
                    if c in self.numeric:
                        x = cur[c]
                        new = F.lit(NUMERIC_MISSING).cast(self.base.select(x.alias("_t")).schema["_t"].dataType)
                    else:
                        x, new = cur[c].cast("string"), F.lit(TEXT_MISSING)
                    cur[c] = F.when(hit, new).otherwise(x)
            elif kind == "label_flip":
                labels = self._values(self.target)
                m = len(labels)
                if m < 2:
                    continue
                arr = F.array(*[F.lit(v) for v in labels])
                t = cur[self.target]
                idx = F.floor(uniform(self.seed, "flip", self.key) * F.lit(m - 1)).cast("int")
                cur[self.target] = F.when(hit, F.element_at(F.array_remove(arr, t), idx + 1)).otherwise(t)
        return cur

    def corrupted(self, active) -> DataFrame:
        cur = self.expressions(active)
        return self.base.select(*[cur[c].alias(c) for c in self.df.columns])

    def scenario_table(self, spark) -> DataFrame:
        """The scenario grid as a table ``scenario, active_errors``."""
        return spark.createDataFrame([(k, v) for k, v in SCENARIOS.items()], "scenario string, active_errors array<string>")
