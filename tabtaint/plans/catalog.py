"""Query catalog: every operator as a named query over the test tables, with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL`` (DuckDB, tables
pre-registered as views).  Column names are aliased identically on both sides; doubles are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabtaint.functions.rng import py_sample, py_uniform, sql_hash
from tabtaint.operators import corrupt as C
from tabtaint.operators import profile as P
from tabtaint.session import cut_lineage, stored
from tabtaint.plans.tables import SPECS, keyed, load, sql_keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEED = 42


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- SQL helpers

def sql_hits(table: str, frac: float, seed=SEED, tag: str = "rows") -> str:
    """Keyed table plus ``_hit``: the ``int(max(frac*n,1))`` rows with the smallest hash."""
    return (f"(SELECT *, row_number() OVER (ORDER BY {sql_hash(seed, tag, 'row_key')}) <= "
            f"(SELECT CAST(floor(greatest({frac!r}::DOUBLE * count(*), 1)) AS BIGINT) FROM {table}) AS _hit "
            f"FROM {sql_keyed(table)})")


def _cols(table):
    from tabtaint.plans.tables import LINEITEM_COLS
    return {
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "lineitem": LINEITEM_COLS,
        "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    }[table]


def _round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- flagship: corrupt + profile

def _plc_customer(spark, sf_dir, frac=0.1):
    spec = SPECS["customer"]
    return C.corrupt(keyed(spark, sf_dir, "customer"), spec, "PLC", frac, 0.5, seed=SEED)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders into 10% of ``customer`` -> null/placeholder profile before vs after."""
    clean = keyed(spark, sf_dir, "customer")
    res = _plc_customer(spark, sf_dir)
    before = P.placeholder_profile(clean).withColumn("stage", F.lit("before"))
    after = P.placeholder_profile(res.df).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


def _flagship_sql():
    spec = SPECS["customer"]
    cols = C.choose_columns(spec, "PLC", 0.5, SEED)
    sel = []
    for c in _cols("customer"):
        if c in cols:
            if c in spec.categorical:
                sel.append(f"CASE WHEN _hit THEN 'UNKNOWN' ELSE CAST({c} AS VARCHAR) END AS {c}")
            else:
                sel.append(f"CASE WHEN _hit THEN -1 ELSE {c} END AS {c}")
        else:
            sel.append(c)
    after = f"(SELECT {', '.join(sel)} FROM {sql_hits('customer', 0.1)})"

    def prof(t, stage):
        parts = []
        for c in _cols("customer"):
            is_num = c in ("c_custkey", "c_nationkey", "c_acctbal") and not (c in cols and c in spec.categorical and stage == "after")
            ph = f"{c} = -1" if is_num else f"CAST({c} AS VARCHAR) = 'UNKNOWN'"
            parts.append(f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
                         f"CAST(count(*) FILTER (WHERE {ph}) AS BIGINT) AS placeholder_count, '{stage}' AS stage FROM {t}")
        return " UNION ALL ".join(parts)
    return prof("customer", "before") + " UNION ALL " + prof(after, "after")


register("flagship_placeholder_profile", _flagship_sql())(flagship)


# ---------------------------------------------------------------- ERR2-ERR9: one query per error type

def sql_derangement_map(table_sql: str, column: str, seed, tag: str) -> str:
    """DuckDB twin of :func:`corrupt.derangement_map`: (old, new) successor in hash order."""
    return (f"(WITH v AS (SELECT DISTINCT {column} AS old FROM {table_sql} WHERE {column} IS NOT NULL), "
            f"o AS (SELECT old, row_number() OVER (ORDER BY {sql_hash(seed, tag, 'old')}) AS rn, "
            f"count(*) OVER () AS m FROM v) "
            f"SELECT a.old AS old, b.old AS new FROM o a JOIN o b ON b.rn = (a.rn % a.m) + 1)")


def sql_corrupt(table: str, kind: str, frac: float, colfrac: float, seed=SEED) -> str:
    from tabtaint.functions.rng import sql_normal
    from tabtaint.functions.strings import sql_typo
    from tabtaint.spec import INTEGRAL_TYPES  # noqa: F401
    spec = SPECS[table]
    cols = C.choose_columns(spec, kind, colfrac, seed)
    ints = _INTEGRAL[table]
    hits = sql_hits(table, frac, seed)
    sel = []
    for c in _cols(table) + ["row_key"]:
        if c not in cols:
            sel.append(c)
            continue
        is_cat = c in spec.categorical or (kind == "LER")
        if kind == "PLC":
            e = (f"CASE WHEN _hit THEN 'UNKNOWN' ELSE CAST({c} AS VARCHAR) END" if is_cat and c not in _STRINGS[table]
                 else (f"CASE WHEN _hit THEN 'UNKNOWN' ELSE {c} END" if is_cat else f"CASE WHEN _hit THEN -1 ELSE {c} END"))
        elif kind == "EMV":
            e = f"CASE WHEN _hit THEN NULL ELSE {c} END"
        elif kind == "OUT":
            f = py_sample(C.OUTLIER_FACTORS, 1, seed, f"out:{c}")[0]
            e = (f"CASE WHEN _hit THEN CAST({c} AS BIGINT) * {f} ELSE CAST({c} AS BIGINT) END" if c in ints
                 else f"CASE WHEN _hit THEN {c} * CAST({f} AS DOUBLE) ELSE {c} END")
        elif kind == "NOI":
            s = C.NOISE_SCALE_MIN + py_uniform(seed, f"noi-scale:{c}", "") * (C.NOISE_SCALE_MAX - C.NOISE_SCALE_MIN)
            noise = f"({sql_normal(seed, f'noi:{c}', 'row_key')} * ({s!r} * (SELECT stddev_pop({c}) FROM {table})))"
            e = (f"CASE WHEN _hit THEN CAST({c} AS BIGINT) + greatest(CAST(trunc({noise}) AS BIGINT), 1) "
                 f"ELSE CAST({c} AS BIGINT) END" if c in ints
                 else f"CASE WHEN _hit THEN CAST({c} AS DOUBLE) + {noise} ELSE CAST({c} AS DOUBLE) END")
        elif kind in ("SFT", "LER"):
            mp = sql_derangement_map(table, c, seed, f"sft:{c}")
            e = f"CASE WHEN _hit THEN coalesce((SELECT mp.new FROM {mp} mp WHERE mp.old = h.{c}), {c}) ELSE {c} END"
        elif kind == "INC":
            e = f"CASE WHEN _hit THEN {sql_typo(c, seed, f'inc:{c}')} ELSE CAST({c} AS VARCHAR) END"
        elif kind == "DUP":
            e = f"CAST({c} AS VARCHAR)" if c in spec.categorical else c
        else:
            raise ValueError(kind)
        sel.append(f"{e} AS {c}")
    body = f"SELECT {', '.join(sel)} FROM {hits} h"
    if kind != "DUP":
        return body
    dsel = []
    for c in _cols(table):
        if c not in cols:
            dsel.append(c)
        elif c in spec.categorical:
            dsel.append(f"{sql_typo(c, seed, f'inc:{c}')} AS {c}")
        else:
            dsel.append(f"-1 AS {c}")
    dsel.append("row_key || '#dup' AS row_key")
    return f"{body} UNION ALL SELECT {', '.join(dsel)} FROM {hits} h WHERE _hit"


_INTEGRAL = {"customer": {"c_custkey", "c_nationkey"}, "part": {"p_partkey", "p_size"},
             "orders": {"o_orderkey", "o_custkey"}, "lineitem": {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"},
             "supplier": {"s_suppkey", "s_nationkey"}, "events": {"event_id", "user_id"}}
_STRINGS = {"customer": {"c_name", "c_mktsegment"}, "part": {"p_name", "p_brand", "p_type"},
            "orders": {"o_orderstatus", "o_orderpriority"}, "lineitem": {"l_returnflag", "l_linestatus"},
            "supplier": {"s_name"}, "events": {"event_type", "props"}}

CORRUPT_CASES = {
    "corrupt_placeholder_part": ("part", "PLC", 0.1, 0.5),
    "corrupt_missing_customer": ("customer", "EMV", 0.2, 0.7),
    "corrupt_outlier_part": ("part", "OUT", 0.1, 0.4),
    "corrupt_noise_part": ("part", "NOI", 0.2, 0.4),
    "corrupt_noise_lineitem": ("lineitem", "NOI", 0.1, 0.5),
    "corrupt_shift_customer": ("customer", "SFT", 0.2, 0.7),
    "corrupt_label_customer": ("customer", "LER", 0.2, 0.2),
    "corrupt_typo_part": ("part", "INC", 0.2, 0.6),
    "corrupt_duplicate_customer": ("customer", "DUP", 0.1, 0.7),
    "corrupt_shift_lineitem": ("lineitem", "SFT", 0.05, 0.5),
}


def _digits(kind):
    # Gaussian noise goes through ln/cos/sqrt and a std aggregate whose last bits differ between
    # engines; 4 decimals keeps the comparison away from rounding boundaries.
    return 4 if kind == "NOI" else 6


def _corrupt_query(table, kind, frac, colfrac):
    def q(spark, sf_dir):
        res = C.corrupt(keyed(spark, sf_dir, table), SPECS[table], kind, frac, colfrac, seed=SEED, audit=False)
        return _round_doubles(res.df, _digits(kind))
    return q


def _sql_round(sql: str, table: str, kind: str, colfrac: float) -> str:
    spec = SPECS[table]
    cols = C.choose_columns(spec, kind, colfrac, SEED)
    dbl = _DOUBLES[table] | ({c for c in cols if kind == "NOI" and c not in _INTEGRAL[table]})
    sel = [f"round({c}, {_digits(kind)}) AS {c}" if c in dbl else c for c in _cols(table) + ["row_key"]]
    return f"SELECT {', '.join(sel)} FROM ({sql}) z"


_DOUBLES = {"customer": {"c_acctbal"}, "part": {"p_retailprice"}, "orders": {"o_totalprice"},
            "lineitem": {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}, "supplier": {"s_acctbal"},
            "events": {"value"}}

for _name, (_t, _k, _f, _cf) in CORRUPT_CASES.items():
    register(_name, _sql_round(sql_corrupt(_t, _k, _f, _cf), _t, _k, _cf))(_corrupt_query(_t, _k, _f, _cf))


def audit_typo_part(spark, sf_dir):
    """ERR1 audit log: every changed cell of a typo corruption."""
    res = C.corrupt(keyed(spark, sf_dir, "part"), SPECS["part"], "INC", 0.2, 0.6, seed=SEED)
    return res.changes


def _audit_sql():
    from tabtaint.functions.strings import sql_typo
    cols = C.choose_columns(SPECS["part"], "INC", 0.6, SEED)
    parts = [f"SELECT row_key, '{c}' AS column, CAST({c} AS VARCHAR) AS old_value, "
             f"{sql_typo(c, SEED, f'inc:{c}')} AS new_value FROM {sql_hits('part', 0.2)} h WHERE _hit" for c in cols]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) z WHERE old_value IS DISTINCT FROM new_value"


register("corrupt_audit_log", _audit_sql())(audit_typo_part)


def semiperfect_customer(spark, sf_dir):
    """FLT4: the table without the rows chosen for corruption (left anti join)."""
    res = C.corrupt(keyed(spark, sf_dir, "customer"), SPECS["customer"], "PLC", 0.1, 0.5, seed=SEED, audit=False)
    return _round_doubles(C.drop_corrupted(keyed(spark, sf_dir, "customer"), res.rows))


register("semiperfect_customer",
         f"SELECT {', '.join(_cols('customer'))}, row_key FROM {sql_hits('customer', 0.1)} h WHERE NOT _hit")(
    semiperfect_customer)


# ---------------------------------------------------------------- curation, filters, imputation, profiles
from tabtaint.operators import clean as CL  # noqa: E402
from tabtaint.operators import split as SP  # noqa: E402
from tabtaint.operators import sampling as SA  # noqa: E402
from tabtaint.functions.rng import sql_normal, sql_uniform, hash_hex, uniform, normal  # noqa: E402,F401

# nulls injected from the data itself (the test tables have none): negative balances and
# the names of three market segments
_NULLY_CUSTOMER_SQL = ("(SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY') THEN NULL "
                       "ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END "
                       "AS c_acctbal, CASE WHEN c_nationkey IN (1, 2, 3) THEN NULL ELSE c_mktsegment END AS c_mktsegment "
                       "FROM customer)")


def nully_customer(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_nationkey").isin(1, 2, 3), F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


def q_null_profile(spark, sf_dir):
    return P.null_profile(nully_customer(spark, sf_dir), "customer")


register("null_profile_table", f"""
SELECT 'customer' AS dataset, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, count(*) * 5 AS n_cells,
  CAST(sum((c_custkey IS NULL)::INT + (c_name IS NULL)::INT + (c_nationkey IS NULL)::INT + (c_acctbal IS NULL OR isnan(c_acctbal))::INT
      + (c_mktsegment IS NULL)::INT) AS BIGINT) AS n_nulls,
  round(sum((c_custkey IS NULL)::INT + (c_name IS NULL)::INT + (c_nationkey IS NULL)::INT + (c_acctbal IS NULL OR isnan(c_acctbal))::INT
      + (c_mktsegment IS NULL)::INT) * 100.0 / (count(*) * 5), 6) AS null_pct,
  CAST(count(*) FILTER (WHERE c_custkey IS NULL OR c_name IS NULL OR c_nationkey IS NULL OR c_acctbal IS NULL OR c_mktsegment IS NULL) AS BIGINT) AS rows_with_nulls,
  sum((c_name IS NULL)::INT + (c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) > 0 AS has_nulls
FROM {_NULLY_CUSTOMER_SQL} t""")(q_null_profile)


def q_column_nulls(spark, sf_dir):
    return P.column_null_profile(nully_customer(spark, sf_dir))


def _colnull_sql():
    types = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    parts = [f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, "
             f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS null_pct FROM {_NULLY_CUSTOMER_SQL} t"
             for c, t in types.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) z WHERE null_count > 0"


register("null_profile_columns", _colnull_sql())(q_column_nulls)


def q_profile_many(spark, sf_dir):
    tables = {"customer_nulls": nully_customer(spark, sf_dir), "part": load(spark, sf_dir, "part"),
              "orders": load(spark, sf_dir, "orders"), "events": load(spark, sf_dir, "events")}
    return P.profile_summary(P.profile_many(tables))


register("null_profile_summary", f"""
SELECT CAST(4 AS BIGINT) AS datasets_checked,
  CAST((SELECT count(*) FILTER (WHERE c_name IS NULL OR c_acctbal IS NULL OR c_mktsegment IS NULL) > 0 FROM {_NULLY_CUSTOMER_SQL} t)::INT
   + (SELECT count(*) FILTER (WHERE p_partkey IS NULL OR p_name IS NULL OR p_brand IS NULL OR p_type IS NULL OR p_size IS NULL OR p_retailprice IS NULL) > 0 FROM part)::INT
   + (SELECT count(*) FILTER (WHERE o_orderkey IS NULL OR o_custkey IS NULL OR o_orderstatus IS NULL OR o_totalprice IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL) > 0 FROM orders)::INT
   + (SELECT count(*) FILTER (WHERE event_id IS NULL OR ts IS NULL OR user_id IS NULL OR event_type IS NULL OR value IS NULL OR props IS NULL) > 0 FROM events)::INT AS BIGINT) AS datasets_with_nulls,
  CAST(0 AS BIGINT) AS datasets_with_errors""")(q_profile_many)


def q_curate(spark, sf_dir):
    spec = SPECS["customer"]
    df, spec2, dropped = CL.curate(with_key(nully_customer(spark, sf_dir), "c_custkey"), spec)
    return _round_doubles(df)


def with_key(df, key):
    from tabtaint.spec import with_row_key
    return with_row_key(df, key)


register("curate_table", f"""
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal,
  c_mktsegment, CAST(c_custkey AS VARCHAR) AS row_key
FROM {_NULLY_CUSTOMER_SQL} t WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")(q_curate)


def q_curate_report(spark, sf_dir):
    raw = nully_customer(spark, sf_dir)
    df, _, dropped = CL.curate(raw, SPECS["customer"])
    return CL.curation_report(raw, df, "customer", dropped)


register("curate_report", f"""
SELECT 'customer' AS dataset, CAST((SELECT count(*) FROM customer) AS BIGINT) AS initial_rows, CAST(5 AS BIGINT) AS initial_columns,
  CAST((SELECT count(*) FROM {_NULLY_CUSTOMER_SQL} t WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS BIGINT) AS final_rows,
  CAST(4 AS BIGINT) AS final_columns, 'c_name' AS dropped_columns""")(q_curate_report)


def q_dates(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    txt = F.when(F.col("o_orderstatus") == "P", F.lit("not-a-date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", txt.alias("o_date_text"), CL.date_to_epoch(txt).alias("o_epoch"))


register("curate_date_epoch", """
SELECT o_orderkey, o_date_text, coalesce(CAST(epoch(try_strptime(o_date_text, '%Y-%m-%d')) AS BIGINT), 0) AS o_epoch
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_date_text
      FROM orders)""")(q_dates)


def q_binary(spark, sf_dir):
    return CL.narrow_binary(load(spark, sf_dir, "labels"), exclude=("doc_id",))


register("curate_binary_narrow", "SELECT doc_id, CAST(quality AS TINYINT) AS quality, CAST(toxic AS TINYINT) AS toxic FROM labels")(q_binary)


def _plc_df(spark, sf_dir):
    return C.corrupt(keyed(spark, sf_dir, "customer"), SPECS["customer"], "PLC", 0.1, 0.5, seed=SEED, audit=False).df


def q_drop_placeholders(spark, sf_dir):
    return _round_doubles(CL.drop_placeholder_rows(_plc_df(spark, sf_dir), [-1, "UNKNOWN"]))


def _plc_sql():
    return f"({_flagship_after_sql()})"


def _flagship_after_sql():
    spec = SPECS["customer"]
    cols = C.choose_columns(spec, "PLC", 0.5, SEED)
    sel = []
    for c in _cols("customer") + ["row_key"]:
        if c in cols:
            if c in spec.categorical:
                sel.append(f"CASE WHEN _hit THEN 'UNKNOWN' ELSE CAST({c} AS VARCHAR) END AS {c}")
            else:
                sel.append(f"CASE WHEN _hit THEN -1 ELSE {c} END AS {c}")
        else:
            sel.append(c)
    return f"SELECT {', '.join(sel)} FROM {sql_hits('customer', 0.1)}"


def _plc_cond():
    spec = SPECS["customer"]
    cols = C.choose_columns(spec, "PLC", 0.5, SEED)
    conds = []
    for c in _cols("customer"):
        numeric = c in ("c_custkey", "c_nationkey", "c_acctbal") and not (c in cols and c in spec.categorical)
        conds.append(f"coalesce({c} = -1, false)" if numeric else f"coalesce({c} = 'UNKNOWN', false)")
    return " OR ".join(conds)


register("filter_placeholder_rows",
         f"SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment, row_key "
         f"FROM {_plc_sql()} t WHERE NOT ({_plc_cond()})")(q_drop_placeholders)


def q_placeholders_null(spark, sf_dir):
    return _round_doubles(CL.placeholders_to_null(_plc_df(spark, sf_dir), [-1, "UNKNOWN"]))


def _ph_null_sql():
    spec = SPECS["customer"]
    cols = C.choose_columns(spec, "PLC", 0.5, SEED)
    sel = []
    for c in _cols("customer"):
        numeric = c in ("c_custkey", "c_nationkey", "c_acctbal") and not (c in cols and c in spec.categorical)
        v = "-1" if numeric else "'UNKNOWN'"
        e = f"CASE WHEN coalesce({c} = {v}, false) THEN NULL ELSE {c} END"
        sel.append(f"round({e}, 6) AS {c}" if c == "c_acctbal" else f"{e} AS {c}")
    return f"SELECT {', '.join(sel)}, row_key FROM {_plc_sql()} t"


register("filter_placeholder_to_null", _ph_null_sql())(q_placeholders_null)


def q_impute(spark, sf_dir):
    df = nully_customer(spark, sf_dir)
    filled, _, _ = CL.impute(df, None, ["c_acctbal"], ["c_name", "c_mktsegment"])
    return _round_doubles(filled)


register("impute_median_missing", f"""
SELECT c_custkey, coalesce(CAST(c_name AS VARCHAR), 'missing_value') AS c_name, c_nationkey,
  round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {_NULLY_CUSTOMER_SQL} s)), 6) AS c_acctbal,
  coalesce(CAST(c_mktsegment AS VARCHAR), 'missing_value') AS c_mktsegment
FROM {_NULLY_CUSTOMER_SQL} t""")(q_impute)


def q_value_counts(spark, sf_dir):
    return P.value_counts(load(spark, sf_dir, "orders"), "o_orderpriority")


register("value_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")(q_value_counts)


def q_minority(spark, sf_dir):
    return P.minority_label(load(spark, sf_dir, "customer"), "c_mktsegment")


register("minority_label", """
SELECT arg_min(c_mktsegment, n * 1000000 + 0) AS minority_label, min(n) AS minority_count
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")(q_minority)


def q_stats(spark, sf_dir):
    """AGG6-AGG8: std (population, sample), exact median (histogram refinement), distinct count."""
    from tabtaint.operators.ordered import exact_quantile
    o = load(spark, sf_dir, "orders")
    med = exact_quantile(o, "o_totalprice", 0.5)
    return o.agg(r6(F.stddev_pop("o_totalprice")).alias("std_pop"), r6(F.stddev_samp("o_totalprice")).alias("std_samp"),
                 r6(F.lit(med)).alias("median"), F.count_distinct("o_orderstatus").alias("n_status"))


register("column_stats", """
SELECT round(stddev_pop(o_totalprice), 6) AS std_pop, round(stddev_samp(o_totalprice), 6) AS std_samp,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median, count(DISTINCT o_orderstatus) AS n_status FROM orders""")(q_stats)


def q_vocab(spark, sf_dir):
    """AGG10: distinct union vocabulary of two tables."""
    a = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value"))
    b = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("value"))
    return a.union(b).distinct()


register("union_vocabulary", "SELECT DISTINCT c_mktsegment AS value FROM customer UNION SELECT DISTINCT l_returnflag FROM lineitem")(q_vocab)


# ---------------------------------------------------------------- sampling (RND*) and splits (SPL*)

def _keyed_cols(table):
    return ", ".join(_cols(table) + ["row_key"])


def q_sample_exact(spark, sf_dir):
    return _round_doubles(SA.sample_rows(keyed(spark, sf_dir, "orders"), "row_key", 1000, SEED, "sample"))


register("sample_exact_k", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority, row_key
FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash(SEED, 'sample', 'row_key')}) AS rn FROM {sql_keyed('orders')}) WHERE rn <= 1000
""")(q_sample_exact)


def q_sample_fraction(spark, sf_dir):
    df = keyed(spark, sf_dir, "lineitem")
    flag, n = SA.sample_flag(df, "row_key", SA.row_count_k(0.1), SEED, "sample")
    return df.filter(flag).select("row_key", "l_orderkey", "l_linenumber")


register("sample_fraction_lineitem", f"""
SELECT row_key, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (ORDER BY {sql_hash(SEED, 'sample', 'row_key')}) AS rn FROM {sql_keyed('lineitem')})
WHERE rn <= (SELECT CAST(floor(greatest(0.1::DOUBLE * count(*), 1)) AS BIGINT) FROM lineitem)""")(q_sample_fraction)


def q_shuffle_index(spark, sf_dir):
    df, _ = SA.number_by_hash(keyed(spark, sf_dir, "orders"), "row_key", SEED, "shuffle")
    return df.select("row_key", F.col("_pos").alias("new_index"))


register("shuffle_reindex", f"""
SELECT row_key, row_number() OVER (ORDER BY {sql_hash(SEED, 'shuffle', 'row_key')}) - 1 AS new_index FROM {sql_keyed('orders')}""")(
    q_shuffle_index)


def q_derangement(spark, sf_dir):
    kind, mp = C.derangement_map(load(spark, sf_dir, "part"), "p_brand", SEED, "sft:p_brand")
    if kind == "literal":
        return spark.createDataFrame(sorted(mp.items()), "old string, new string")
    return mp


register("derangement_map", f"SELECT old, new FROM {sql_derangement_map('part', 'p_brand', SEED, 'sft:p_brand')}")(q_derangement)


def q_draws(spark, sf_dir):
    o = keyed(spark, sf_dir, "orders")
    return o.select("row_key", r6(F.lit(2.0) + F.lit(3.0) * uniform(SEED, "u", "row_key")).alias("u_2_5"),
                    F.round(F.lit(10.0) + F.lit(2.0) * normal(SEED, "n", "row_key"), 4).alias("n_10_2"))


register("random_draws", f"""
SELECT row_key, round(2.0 + 3.0 * {sql_uniform(SEED, 'u', 'row_key')}, 6) AS u_2_5,
  round(10.0 + 2.0 * {sql_normal(SEED, 'n', 'row_key')}, 4) AS n_10_2 FROM {sql_keyed('orders')}""")(q_draws)


def q_bootstrap(spark, sf_dir):
    out = SA.sample_with_replacement(keyed(spark, sf_dir, "customer"), "row_key", 2000, SEED, "boot")
    return _round_doubles(out.select("draw_id", *_cols("customer"), "row_key"))


register("bootstrap_sample", f"""
WITH b AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(SEED, 'boot:order', 'row_key')}) - 1 AS pos FROM {sql_keyed('customer')}),
d AS (SELECT range AS draw_id, CAST(floor({sql_uniform(SEED, 'boot:draw', 'range')} * (SELECT count(*) FROM customer)) AS BIGINT) AS pos
      FROM range(2000))
SELECT draw_id, c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment, row_key FROM d JOIN b USING (pos)""")(
    q_bootstrap)


def q_blocks(spark, sf_dir):
    """RND10: disjoint 10% row blocks for five error types from one hash permutation."""
    df, n = SA.number_by_hash(keyed(spark, sf_dir, "orders"), "row_key", SEED, "blocks")
    per = int(n * 0.1)
    return (df.where(F.col("_pos") < 5 * per)
            .select("row_key", F.floor(F.col("_pos") / per).cast("bigint").alias("block")))


register("disjoint_blocks", f"""
SELECT row_key, CAST(floor(pos / (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM orders)) AS BIGINT) AS block FROM (
  SELECT row_key, row_number() OVER (ORDER BY {sql_hash(SEED, 'blocks', 'row_key')}) - 1 AS pos FROM {sql_keyed('orders')})
WHERE pos < 5 * (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM orders)""")(q_blocks)


def _sql_lr_quota(groups_sql: str, total_sql: str) -> str:
    """Largest-remainder quotas: groups_sql gives (g, n); total_sql a scalar."""
    return f"""(WITH c AS ({groups_sql}), t AS (SELECT sum(n) AS tot, {total_sql} AS nt FROM c),
q0 AS (SELECT g, n, nt * n / CAST(tot AS DOUBLE) AS ex, floor(nt * n / CAST(tot AS DOUBLE)) AS fl, nt FROM c, t)
SELECT g, CAST(fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, CAST(g AS VARCHAR)) <= nt - (SELECT sum(fl) FROM q0)
  THEN 1 ELSE 0 END AS BIGINT) AS q FROM q0)"""


def q_split_strat(spark, sf_dir):
    df = SP.stratified_split(keyed(spark, sf_dir, "customer"), "row_key", "c_mktsegment", 0.25, seed=SEED)
    return df.select("row_key", "c_mktsegment", "split")


register("split_stratified", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_hash(SEED, 'split', 'row_key')}) AS rn
           FROM {sql_keyed('customer')}),
q AS {_sql_lr_quota("SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1", "CAST(ceil(0.25::DOUBLE * sum(n)) AS BIGINT)")}
SELECT row_key, c_mktsegment, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split FROM b JOIN q ON b.c_mktsegment = q.g""")(
    q_split_strat)


def q_split_many(spark, sf_dir):
    """SPL1 by a label with as many classes as there are parts; classes of one row are left out first."""
    li = keyed(spark, sf_dir, "lineitem").select("row_key", "l_partkey")
    several = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l_partkey")
    return SP.stratified_split(li.join(several, "l_partkey", "left_semi"), "row_key", "l_partkey", 0.25, seed=SEED) \
        .groupBy("l_partkey", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first"))


register("split_many_strata", f"""
WITH x AS (SELECT * FROM {sql_keyed('lineitem')} WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {sql_hash(SEED, 'split', 'row_key')}) AS rn FROM x),
q AS {_sql_lr_quota("SELECT l_partkey AS g, count(*) AS n FROM x GROUP BY 1", "CAST(ceil(0.25::DOUBLE * sum(n)) AS BIGINT)")}
SELECT l_partkey, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(row_key) AS first
FROM b JOIN q ON b.l_partkey = q.g GROUP BY 1, 2""")(q_split_many)


def q_split_random(spark, sf_dir):
    return SP.random_split(keyed(spark, sf_dir, "orders"), "row_key", 0.3, seed=SEED).select("row_key", "split")


register("split_random", f"""
SELECT row_key, CASE WHEN row_number() OVER (ORDER BY {sql_hash(SEED, 'split', 'row_key')})
  <= (SELECT CAST(ceil(0.3::DOUBLE * count(*)) AS BIGINT) FROM orders) THEN 'test' ELSE 'train' END AS split
FROM {sql_keyed('orders')}""")(q_split_random)


def q_split_abs(spark, sf_dir):
    df = SP.stratified_split(keyed(spark, sf_dir, "orders"), "row_key", "o_orderstatus", test_size=9000,
                             train_size=3000, seed=SEED)
    return df.select("row_key", "o_orderstatus", "split")


register("split_absolute", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(SEED, 'split', 'row_key')}) AS rn
           FROM {sql_keyed('orders')}),
qt AS {_sql_lr_quota("SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1", "CAST(9000 AS BIGINT)")},
qr AS {_sql_lr_quota("SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1", "CAST(3000 AS BIGINT)")}
SELECT row_key, o_orderstatus, CASE WHEN rn <= qt.q THEN 'test' WHEN rn <= qt.q + qr.q THEN 'train' ELSE 'unused' END AS split
FROM b JOIN qt ON b.o_orderstatus = qt.g JOIN qr ON b.o_orderstatus = qr.g""")(q_split_abs)


def _sql_bin(x, lo, hi, nb):
    w = f"(({hi}) - ({lo})) / {nb}"
    return (f"(CASE WHEN ({hi}) = ({lo}) THEN 0 WHEN {x} <= ({lo}) THEN 0 ELSE "
            f"least(greatest(CAST(ceil(({x} - ({lo})) / ({w})) AS INTEGER) - 1, 0), {nb} - 1) END)")


def q_split_reg(spark, sf_dir):
    df = SP.regression_split(keyed(spark, sf_dir, "orders"), "row_key", "o_totalprice", 0.25, seed=SEED)
    return df.select("row_key", "split")


def _split_reg_sql():
    lo, hi = "(SELECT min(o_totalprice) FROM orders)", "(SELECT max(o_totalprice) FROM orders)"
    cases = " ".join(f"WHEN {nb} THEN {_sql_bin('o_totalprice', lo, hi, nb)}" for nb in range(2, 11))
    return f"""
WITH nb AS (SELECT max(k) AS k FROM (SELECT k, min(cnt) AS mc FROM (
    SELECT k, b, count(*) AS cnt FROM (SELECT k, CASE k {cases} END AS b FROM orders, range(2, 11) r(k)) GROUP BY k, b)
  GROUP BY k) WHERE mc >= 2),
x AS (SELECT *, CASE (SELECT k FROM nb) {cases} END AS bin FROM {sql_keyed('orders')}),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {sql_hash(SEED, 'split', 'row_key')}) AS rn FROM x),
q AS {_sql_lr_quota("SELECT bin AS g, count(*) AS n FROM x GROUP BY 1", "CAST(ceil(0.25::DOUBLE * sum(n)) AS BIGINT)")}
SELECT row_key, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split FROM r JOIN q ON r.bin = q.g"""


register("split_regression_bins", _split_reg_sql())(q_split_reg)


# ---------------------------------------------------------------- generators (GEN1, GEN4, GEN5, GEN6)
from tabtaint.operators import generate as G  # noqa: E402
from tabtaint.operators import quality as Q  # noqa: E402
from tabtaint.operators import privacy as PV  # noqa: E402
from tabtaint.functions import metrics as M  # noqa: E402

GEN_COLS = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def q_gen_marginal(spark, sf_dir):
    return _round_doubles(G.marginal(keyed(spark, sf_dir, "customer"), GEN_COLS, 1000, SEED))


def _sql_intervals(table, c, tag, group=None):
    """Running counts of the values of ``c`` (in each group) in the order of the value's hash."""
    text = f"coalesce(CAST(v AS VARCHAR), '∅')"
    w = f"OVER ({'PARTITION BY g ' if group else ''}ORDER BY {sql_hash(SEED, tag, text)}, v NULLS FIRST)"
    return (f"(SELECT g, v, sum(n) {w} - n AS lo, sum(n) {w} AS hi FROM "
            f"(SELECT {group or 'NULL'} AS g, {c} AS v, count(*) AS n FROM {table} GROUP BY 1, 2))")


def _gen_marginal_sql():
    n = "(SELECT count(*) FROM customer)"
    joins, sel = [], []
    for i, c in enumerate(GEN_COLS):
        pos = f"CAST(floor({sql_uniform(SEED, f'gen1:{c}', 'd.draw_id')} * {n}) AS BIGINT)"
        joins.append(f"JOIN {_sql_intervals('customer', c, 'gen1:order')} b{i} ON {pos} >= b{i}.lo AND {pos} < b{i}.hi")
        sel.append(f"round(b{i}.v, 6) AS {c}" if c == "c_acctbal" else f"b{i}.v AS {c}")
    return f"WITH d AS (SELECT range AS draw_id FROM range(1000)) SELECT d.draw_id, {', '.join(sel)} FROM d {' '.join(joins)}"


register("gen_marginal", _gen_marginal_sql())(q_gen_marginal)


def q_gen_uniform(spark, sf_dir):
    return _round_doubles(G.uniform_sampler(load(spark, sf_dir, "customer"), GEN_COLS, 1000, SEED,
                                            categorical=("c_mktsegment",)))


def _gen_uniform_sql():
    u = {c: sql_uniform(SEED, f"gen4:{c}", "draw_id") for c in GEN_COLS}
    return f"""
WITH v AS (SELECT c_mktsegment AS val, row_number() OVER (ORDER BY {sql_hash(SEED, 'gen4:c_mktsegment:order', 'c_mktsegment')}) AS rn
           FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
mm AS (SELECT min(c_nationkey) AS lo1, max(c_nationkey) AS hi1, min(c_acctbal) AS lo2, max(c_acctbal) AS hi2,
       (SELECT count(*) FROM v) AS m FROM customer)
SELECT range AS draw_id, CAST(least(floor(lo1 + {u['c_nationkey']} * (hi1 - lo1 + 1)), hi1) AS INTEGER) AS c_nationkey,
  round(lo2 + {u['c_acctbal']} * (hi2 - lo2), 6) AS c_acctbal,
  (SELECT val FROM v WHERE rn = CAST(floor({u['c_mktsegment']} * m) AS BIGINT) + 1) AS c_mktsegment
FROM range(1000), mm"""


register("gen_uniform", _gen_uniform_sql())(q_gen_uniform)


def q_gen_bootstrap(spark, sf_dir):
    return _round_doubles(G.bootstrap(keyed(spark, sf_dir, "customer"), GEN_COLS, 1000, SEED))


register("gen_bootstrap", f"""
WITH b AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(SEED, 'boot:order', 'row_key')}) - 1 AS pos FROM {sql_keyed('customer')}),
d AS (SELECT range AS draw_id, CAST(floor({sql_uniform(SEED, 'boot:draw', 'range')} * (SELECT count(*) FROM customer)) AS BIGINT) AS pos
      FROM range(1000))
SELECT draw_id, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM d JOIN b USING (pos)""")(q_gen_bootstrap)


def q_gen_per_class(spark, sf_dir):
    return _round_doubles(G.per_class(keyed(spark, sf_dir, "customer"), ["c_nationkey", "c_acctbal"], "c_mktsegment",
                                      1000, SEED))


def _gen_per_class_sql():
    cols = ["c_nationkey", "c_acctbal"]
    joins, sel = [], []
    for i, c in enumerate(cols):
        pos = f"CAST(floor({sql_uniform(SEED, f'gen6:{c}', 'd.draw_id')} * d.n) AS BIGINT)"
        joins.append(f"JOIN {_sql_intervals('customer', c, 'gen6:order', 'c_mktsegment')} b{i} "
                     f"ON b{i}.g = d.c_mktsegment AND {pos} >= b{i}.lo AND {pos} < b{i}.hi")
        sel.append(f"round(b{i}.v, 6) AS {c}" if c == "c_acctbal" else f"b{i}.v AS {c}")
    return f"""
WITH cl AS (SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY {sql_hash(SEED, 'gen6:classes', 'c_mktsegment')}) - 1 AS ci
       FROM customer GROUP BY 1),
per AS (SELECT greatest(2, 1000 // count(*)) AS per, count(*) AS k FROM cl),
d AS (SELECT range AS draw_id, cl.c_mktsegment, cl.n FROM range((SELECT per * k FROM per)) r
      JOIN cl ON cl.ci = r.range // (SELECT per FROM per))
SELECT d.draw_id, {', '.join(sel)}, d.c_mktsegment FROM d {' '.join(joins)}"""


register("gen_per_class", _gen_per_class_sql())(q_gen_per_class)


# ---------------------------------------------------------------- quality (QLT*), privacy (DPR1), metrics (ML6)

def _halves(spark, sf_dir, table):
    df = keyed(spark, sf_dir, table)
    u = uniform(SEED, "half", "row_key")
    return df.where(u < 0.5), df.where(u >= 0.5)


def _sql_half(table, real=True):
    op = "<" if real else ">="
    return f"(SELECT * FROM {sql_keyed(table)} WHERE {sql_uniform(SEED, 'half', 'row_key')} {op} 0.5)"


Q_NUM = ["o_totalprice", "o_custkey"]
Q_CAT = ["o_orderstatus", "o_orderpriority"]


def q_quality_shapes(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "orders")
    return Q.column_shapes(r, s, Q_NUM, Q_CAT).withColumn("score", r6(F.col("score")))


def _sql_ks(c):
    R, S = _sql_half("orders"), _sql_half("orders", False)
    return f"""SELECT '{c}' AS column, 'KSComplement' AS metric, round(1 - max(abs(cum)) / (n * m), 6) AS score FROM (
  SELECT sum(step) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, n, m FROM (
    SELECT v, sum(sr) * (SELECT count({c}) FROM {S} s2) - sum(ss) * (SELECT count({c}) FROM {R} r2) AS step,
      (SELECT count({c}) FROM {R} r3) AS n, (SELECT count({c}) FROM {S} s3) AS m
    FROM (SELECT CAST({c} AS DOUBLE) AS v, 1 AS sr, 0 AS ss FROM {R} r WHERE {c} IS NOT NULL
          UNION ALL SELECT CAST({c} AS DOUBLE), 0, 1 FROM {S} s WHERE {c} IS NOT NULL) GROUP BY v)) GROUP BY n, m"""


def _sql_tv(c):
    R, S = _sql_half("orders"), _sql_half("orders", False)
    return f"""SELECT '{c}' AS column, 'TVComplement' AS metric, round(1 - 0.5 * sum(abs(coalesce(pr, 0) - coalesce(ps, 0))), 6) AS score
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) / sum(count(*)) OVER () AS pr FROM {R} GROUP BY 1) a
FULL JOIN (SELECT CAST({c} AS VARCHAR) AS v, count(*) / sum(count(*)) OVER () AS ps FROM {S} GROUP BY 1) b USING (v)"""


register("quality_column_shapes", " UNION ALL ".join([_sql_ks(c) for c in Q_NUM] + [_sql_tv(c) for c in Q_CAT]))(
    q_quality_shapes)


def q_quality_pairs(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "orders")
    return Q.column_pair_trends(r, s, Q_NUM, Q_CAT).withColumn("score", r6(F.col("score")))


def _sql_pairs():
    from itertools import combinations
    R, S = _sql_half("orders"), _sql_half("orders", False)
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(1 - abs((SELECT corr({a}, {b}) FROM {R}) - "
             f"(SELECT corr({a}, {b}) FROM {S})) / 2, 6) AS score, 'CorrelationSimilarity' AS metric"
             for a, b in combinations(Q_NUM, 2)]
    cols = Q_NUM + Q_CAT

    def disc(c, t):
        if c in Q_NUM:
            lo, hi = f"(SELECT CAST(min({c}) AS DOUBLE) FROM {R})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {R})"
            return f"CAST({_sql_bin(f'CAST({t}.{c} AS DOUBLE)', lo, hi, 10)} AS VARCHAR)"
        return f"CAST({t}.{c} AS VARCHAR)"
    for a, b in combinations(cols, 2):
        if a not in Q_CAT and b not in Q_CAT:
            continue
        parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(1 - 0.5 * sum(abs(coalesce(pr, 0) - coalesce(ps, 0))), 6) AS score,
  'ContingencySimilarity' AS metric FROM
 (SELECT {disc(a, 'r')} AS va, {disc(b, 'r')} AS vb, count(*) / sum(count(*)) OVER () AS pr FROM {R} r GROUP BY 1, 2) x
 FULL JOIN (SELECT {disc(a, 's')} AS va, {disc(b, 's')} AS vb, count(*) / sum(count(*)) OVER () AS ps FROM {S} s GROUP BY 1, 2) y
 ON x.va IS NOT DISTINCT FROM y.va AND x.vb IS NOT DISTINCT FROM y.vb""")
    return " UNION ALL ".join(parts)


register("quality_pair_trends", _sql_pairs())(q_quality_pairs)


def q_quality_overall(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "orders")
    rep = Q.quality_report(r, s, Q_NUM, Q_CAT)
    return rep.select(*[F.round(c, 4).alias(c) for c in rep.columns])


register("quality_overall", f"""
WITH sh AS ({' UNION ALL '.join([_sql_ks(c) for c in Q_NUM] + [_sql_tv(c) for c in Q_CAT])}),
pt AS ({_sql_pairs()})
SELECT round(((SELECT avg(score) FROM sh) + (SELECT avg(score) FROM pt)) / 2, 4) AS score,
  round((SELECT avg(score) FROM sh), 4) AS column_shapes, round((SELECT avg(score) FROM pt), 4) AS column_pair_trends""")(
    q_quality_overall)


def q_disclosure(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "customer")
    out = PV.disclosure_protection(r, s, ["c_nationkey"], ["c_mktsegment"])
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


def _dpr_sql():
    R, S = _sql_half("customer"), _sql_half("customer", False)
    return f"""
WITH r AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS nr FROM {R} GROUP BY 1, 2),
sks AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS ns FROM {S} GROUP BY 1, 2),
sk AS (SELECT k, sum(ns) AS nk FROM sks GROUP BY 1),
j AS (SELECT nr, coalesce(ns, 0) / nk AS share FROM r JOIN sk USING (k) LEFT JOIN sks USING (k, s)),
cap AS (SELECT 1 - sum(nr * share) / sum(nr) AS cap FROM j),
base AS (SELECT 1 - 1.0 / count(DISTINCT c_mktsegment) AS base FROM {R})
SELECT round(least(1.0, cap / base), 6) AS score, round(cap, 6) AS cap_protection, round(base, 6) AS baseline_protection FROM cap, base"""


register("disclosure_protection", _dpr_sql())(q_disclosure)


def _pred_table(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    means = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    return o.join(F.broadcast(means), "o_orderpriority").select(F.col("o_totalprice").alias("label"), "prediction")


def q_reg_metrics(spark, sf_dir):
    m = M.regression_metrics(_pred_table(spark, sf_dir))
    # the squared error is ~1e10: 1 decimal keeps the check off summation-order ulps
    return m.select(r6(F.col("r2")).alias("r2"), F.round("mse", 1).alias("mse"), r6(F.col("mae")).alias("mae"))


register("regression_metrics", """
WITH p AS (SELECT o_totalprice AS label, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS prediction FROM orders)
SELECT round(1 - sum((label - prediction) ^ 2) / sum((label - (SELECT avg(label) FROM p)) ^ 2), 6) AS r2,
  round(avg((label - prediction) ^ 2), 1) AS mse, round(avg(abs(label - prediction)), 6) AS mae FROM p""")(q_reg_metrics)


def _cls_table(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    mode = (o.groupBy("o_orderpriority", "o_orderstatus").count()
            .groupBy("o_orderpriority").agg(F.max_by("o_orderstatus", F.struct("count", F.col("o_orderstatus"))).alias("prediction")))
    return o.join(F.broadcast(mode), "o_orderpriority").select(F.col("o_orderstatus").alias("label"), "prediction")


def q_f1(spark, sf_dir):
    m = M.f1_scores(_cls_table(spark, sf_dir), positive="F")
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


register("classification_f1", """
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
mode AS (SELECT o_orderpriority, arg_max(o_orderstatus, n * 100 + ascii(o_orderstatus)) AS prediction FROM c GROUP BY 1),
p AS (SELECT o_orderstatus AS label, prediction FROM orders JOIN mode USING (o_orderpriority)),
cls AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE prediction = class) AS predicted,
      (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS tp FROM cls),
f AS (SELECT class, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
      CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM s),
g AS (SELECT class, support, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM f)
SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro,
  round((SELECT max(f1) FROM g WHERE class = 'F'), 6) AS f1_binary FROM g""")(q_f1)


def q_auc(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"),
                                              F.col("o_totalprice").alias("score"))
    return spark.createDataFrame([(round(M.roc_auc(o, "label", "score", 1), 6),)], "auc double")


register("roc_auc", """
WITH c AS (SELECT o_totalprice AS s, count(*) FILTER (WHERE o_orderstatus = 'F') AS pos,
           count(*) FILTER (WHERE o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1),
w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + neg / 2.0)) / ((SELECT sum(pos) FROM c) * (SELECT sum(neg) FROM c)), 6) AS auc FROM w""")(q_auc)


# ---------------------------------------------------------------- worked-example scenarios (ERR10-ERR15)
from tabtaint.operators import scenarios as SC  # noqa: E402
from tabtaint.functions import encoders as EN  # noqa: E402

SC_NUM, SC_CAT, SC_TARGET = ["o_custkey", "o_totalprice"], ["o_orderpriority"], "o_orderstatus"


def _scenario_corruptor(spark, sf_dir):
    return SC.ScenarioCorruptor(keyed(spark, sf_dir, "orders"), "row_key", SC_TARGET, SC_NUM, SC_CAT, SEED)


def q_scenario_all(spark, sf_dir):
    sc = _scenario_corruptor(spark, sf_dir)
    return _round_doubles(sc.corrupted(SC.SCENARIOS["No cleaning"]), 4).drop("o_orderdate")


def _scenario_sql(active=None, final=True):
    active = list(SC.ERROR_KINDS) if active is None else list(active)
    allc = SC_NUM + SC_CAT

    def pick(tag, cands):
        return py_sample(sorted(cands), min(len(cands), 3), SEED, f"pick:{tag}") if cands else []
    cols = {"scale": pick("scale", SC_NUM), "shift": pick("shift", SC_CAT), "missing": pick("missing", allc),
            "noise": pick("noise", SC_NUM)}
    keep = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "row_key"]
    n = "(SELECT count(*) FROM orders)"
    per = f"CAST(floor({n} * 0.1) AS BIGINT)"
    b0 = (f"SELECT {', '.join(keep)}, CASE WHEN pos < 5 * {per} THEN CAST(floor(pos / {per}) AS INTEGER) END AS blk FROM "
          f"(SELECT *, row_number() OVER (ORDER BY {sql_hash(SEED, 'blocks', 'row_key')}) - 1 AS pos FROM {sql_keyed('orders')})")

    def stage(prev, exprs):
        sel = [exprs.get(c, c) + (f" AS {c}" if c in exprs else "") for c in keep] + ["blk"]
        return f"SELECT {', '.join(sel)} FROM ({prev})"
    s1 = stage(b0, {c: (f"CASE WHEN blk = 0 THEN CAST({c} AS BIGINT) * 100 ELSE CAST({c} AS BIGINT) END" if c in _INTEGRAL["orders"]
                        else f"CASE WHEN blk = 0 THEN {c} * 100.0 ELSE {c} END") for c in cols["scale"]}) \
        if "scale" in active else b0
    sh = {}
    for c in (cols["shift"] if "shift" in active else []):
        m_vals = f"(SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL)"
        u_off = py_uniform(SEED, f"shift-offset:{c}", "")
        off = f"(1 + CAST(floor({u_off!r} * (a.m - 1)) AS BIGINT))"
        sh[c] = (f"CASE WHEN blk = 1 THEN (SELECT b.v FROM (SELECT v, row_number() OVER (ORDER BY {sql_hash(SEED, f'vals:{c}', 'v')}) - 1 AS i, "
                 f"count(*) OVER () AS m FROM {m_vals}) a JOIN (SELECT v, row_number() OVER (ORDER BY {sql_hash(SEED, f'vals:{c}', 'v')}) - 1 AS i "
                 f"FROM {m_vals}) b ON b.i = (a.i + {off}) % a.m WHERE a.v = z.{c}) ELSE {c} END")
    s2 = stage(s1, {}) if not sh else \
        f"SELECT {', '.join([sh.get(c, c) + (f' AS {c}' if c in sh else '') for c in keep])}, blk FROM ({s1}) z"
    nz = {}
    for c in (cols["noise"] if "noise" in active else []):
        s = SC.NOISE_RANGE[0] + py_uniform(SEED, f"noise-scale:{c}", "") * (SC.NOISE_RANGE[1] - SC.NOISE_RANGE[0])
        nz[c] = (f"CASE WHEN blk = 3 THEN CAST({c} AS DOUBLE) + {sql_normal(SEED, f'ex-noise:{c}', 'row_key')} * "
                 f"({s!r} * (SELECT stddev_samp({c}) FROM ({s2}))) ELSE CAST({c} AS DOUBLE) END")
    s3 = stage(s2, nz)
    ms = {c: (f"CASE WHEN blk = 2 THEN -1 ELSE {c} END" if c in SC_NUM else f"CASE WHEN blk = 2 THEN '?' ELSE CAST({c} AS VARCHAR) END")
          for c in (cols["missing"] if "missing" in active else [])}
    s4 = stage(s3, ms)
    labels = (f"(SELECT list(v ORDER BY {sql_hash(SEED, f'vals:{SC_TARGET}', 'v')}) FROM "
              f"(SELECT DISTINCT {SC_TARGET} AS v FROM orders WHERE {SC_TARGET} IS NOT NULL))")
    flip = (f"CASE WHEN blk = 4 THEN list_filter({labels}, lambda x: x <> {SC_TARGET})"
            f"[CAST(floor({sql_uniform(SEED, 'flip', 'row_key')} * (len({labels}) - 1)) AS INTEGER) + 1] ELSE {SC_TARGET} END")
    s5 = stage(s4, {SC_TARGET: flip}) if "label_flip" in active else s4
    if not final:
        return s5
    out = [f"round({c}, 4) AS {c}" if c in ("o_totalprice", "o_custkey") else c for c in keep]
    return f"SELECT {', '.join(out)} FROM ({s5})"


register("scenario_all_errors", _scenario_sql())(q_scenario_all)


def q_scenarios(spark, sf_dir):
    """ERR15: rows changed by each scenario against the clean table (numbers compared as
    numbers, text as text) — all seven scenarios in one projection and one aggregate."""
    sc = _scenario_corruptor(spark, sf_dir)
    aggs = []
    for name, active in SC.SCENARIOS.items():
        cur = sc.expressions(active)
        diff = None
        for c in SC_NUM + SC_CAT + [SC_TARGET]:
            t = "double" if c in SC_NUM else "string"
            e = ~cur[c].cast(t).eqNullSafe(F.col(c).cast(t))
            diff = e if diff is None else diff | e
        aggs.append(F.count_if(diff).alias(name))
    one = sc.base.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"`{n}`").alias("changed_rows"))
                                          for n in SC.SCENARIOS])).alias("s")).select("s.*")


def _scenarios_changed_sql():
    parts = []
    cols = SC_NUM + SC_CAT + [SC_TARGET]
    clean = _scenario_sql([], final=False)
    for name, active in SC.SCENARIOS.items():
        d = _scenario_sql(active, final=False)
        cond = " OR ".join(f"CAST(d.{c} AS {'DOUBLE' if c in SC_NUM else 'VARCHAR'}) IS DISTINCT FROM "
                           f"CAST(c.{c} AS {'DOUBLE' if c in SC_NUM else 'VARCHAR'})" for c in cols)
        parts.append(f"SELECT '{name}' AS scenario, count(*) FILTER (WHERE {cond}) AS changed_rows "
                     f"FROM ({d}) d JOIN ({clean}) c USING (row_key)")
    return " UNION ALL ".join(parts)


register("scenario_changed_rows", _scenarios_changed_sql())(q_scenarios)


# ---------------------------------------------------------------- encoders (ENC1-ENC7)

def q_onehot(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return EN.one_hot(p, ["p_type"], {"p_type": EN.vocabulary(p, "p_type")}, keep=["p_partkey"])


_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]   # fixed values: the part types
_SQL_ONEHOT = ", ".join(f"""CAST(p_type = '{x}' AS INTEGER) AS "p_type_{x}\"""" for x in _PART_TYPES)
register("encode_onehot", f"SELECT p_partkey, {_SQL_ONEHOT} FROM part")(q_onehot)


def q_ordinal(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    for c in ("p_brand", "p_type"):
        p = EN.encode(p, c, EN.code_table(p, c), f"{c}_code")
    return p.select("p_partkey", "p_brand_code", "p_type_code")


register("encode_ordinal", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_code,
  CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type_code FROM part""")(q_ordinal)


def q_factorize(spark, sf_dir):
    return EN.factorize(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


register("encode_factorize", """
SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS code FROM orders GROUP BY 1""")(
    q_factorize)


def q_union_encode(spark, sf_dir):
    """ENC5: label encoding fitted on the union vocabulary of two tables, applied to both."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"),
                                                F.lit("customer").alias("src"))
    b = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("v"),
                                                F.lit("lineitem").alias("src"))
    counts = a.unionByName(b).groupBy("src", "v").agg(F.count(F.lit(1)).alias("n"))
    return EN.encode(counts, "v", EN.code_table(a, b, "v"), "code")


register("encode_union_vocabulary", """
WITH u AS (SELECT 'customer' AS src, c_mktsegment AS v FROM customer UNION ALL SELECT 'lineitem', l_returnflag FROM lineitem),
voc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT v FROM u))
SELECT src, v, count(*) AS n, code FROM u JOIN voc USING (v) GROUP BY src, v, code""")(q_union_encode)


def q_decode(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    vocab = EN.vocabulary(p, "p_type")
    x = (F.col("p_size") / F.lit(8.0)) - F.lit(0.7)
    return p.select("p_partkey", EN.decode_ordinal(x, vocab).alias("p_type_decoded"))


register("encode_decode_clip", """
WITH voc AS (SELECT list(p_type ORDER BY p_type) AS l FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, l[least(greatest(CAST(round(p_size / 8.0 - 0.7) AS INTEGER), 0), len(l) - 1) + 1] AS p_type_decoded
FROM part, voc""")(q_decode)


def q_discretise(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("p_size_small", F.col("p_size") % 7)
    return EN.discretise(p, ["p_type", "p_size_small", "p_size", "p_retailprice"], 10, keep=["p_partkey"])


register("encode_discretise", f"""
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
  CAST(dense_rank() OVER (ORDER BY p_size % 7) - 1 AS INTEGER) AS p_size_small,
  {_sql_bin('CAST(p_size AS DOUBLE)', '(SELECT CAST(min(p_size) AS DOUBLE) FROM part)', '(SELECT CAST(max(p_size) AS DOUBLE) FROM part)', 10)} AS p_size,
  {_sql_bin('p_retailprice', '(SELECT min(p_retailprice) FROM part)', '(SELECT max(p_retailprice) FROM part)', 10)} AS p_retailprice
FROM part""")(q_discretise)


# ---------------------------------------------------------------- functional dependencies (FD1-FD3)
from tabtaint.operators import fd as FD  # noqa: E402

FD_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
FD_NATION = ["n_nationkey", "n_name", "n_regionkey"]


def _sql_fd(table_sql: str, cols) -> str:
    """All minimal FDs by exhaustive distinct counts of every column set (the oracle's brute force)."""
    sets = []
    for m in range(1 << len(cols)):
        names = [c for b, c in enumerate(cols) if m >> b & 1]
        sets.append(f"SELECT {m} AS m, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(names)} FROM {table_sql} t)) AS n" if names
                    else f"SELECT 0 AS m, (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM {table_sql} t) AS n")
    names = ", ".join(f"({1 << b}, '{c}')" for b, c in enumerate(cols))
    return f"""WITH card AS MATERIALIZED ({" UNION ALL ".join(sets)}), col(b, name) AS (VALUES {names}),
h AS (SELECT x.m, b, name AS rhs FROM card x JOIN col ON (x.m & b) = 0 JOIN card y ON y.m = (x.m | b) WHERE x.n = y.n),
f AS (SELECT m, rhs FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.b = h.b AND g.m <> h.m AND (g.m & h.m) = g.m))
SELECT coalesce(lhs, '') AS lhs, rhs, coalesce(lhs, '') || ' -> ' || rhs AS fd FROM f LEFT JOIN (
  SELECT m, string_agg(name, ',' ORDER BY b) AS lhs FROM card JOIN col ON (m & b) <> 0 GROUP BY m) USING (m)"""


def q_fd_level1(spark, sf_dir):
    return FD.fd_table(spark, [f for f in FD.discover(load(spark, sf_dir, "part"), FD_PART, max_lhs=1) if len(f[0]) == 1])


register("fd_level1", f"SELECT * FROM ({_sql_fd('part', FD_PART)}) z WHERE lhs <> '' AND lhs NOT LIKE '%,%'")(q_fd_level1)


def q_fd_discovery(spark, sf_dir):
    p = keyed(spark, sf_dir, "part")
    return FD.fd_table(spark, FD.discover(p, FD_PART, sample_size=500, seed=SEED, key="row_key"))


register("fd_discovery", _sql_fd("part", FD_PART))(q_fd_discovery)


def q_fd_dfd(spark, sf_dir):
    """FD2: the same dependencies by depth-first random walks, as records."""
    fds = FD.walk(load(spark, sf_dir, "part"), FD_PART, seed=SEED)
    return FD.fd_records(spark, fds).select(F.array_join("lhs", ",").alias("lhs"), F.size("lhs").alias("n_lhs"), "rhs")


register("fd_dfd", f"SELECT lhs, CAST(CASE WHEN lhs = '' THEN 0 ELSE len(string_split(lhs, ',')) END AS INTEGER) AS n_lhs, rhs "
         f"FROM ({_sql_fd('part', FD_PART)}) z")(q_fd_dfd)


def q_fd_nation(spark, sf_dir):
    return FD.fd_table(spark, FD.discover(load(spark, sf_dir, "nation"), FD_NATION))


register("fd_nation", _sql_fd("nation", FD_NATION))(q_fd_nation)


def q_fd_sample(spark, sf_dir):
    """FD3: FD discovery over 100 hash-sampled rows, reported as one JSON record."""
    o = keyed(spark, sf_dir, "orders")
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    small = SA.sample_rows(o, "row_key", 100, SEED, "fd-batch")
    fds = FD.discover(small, cols)
    return FD.fd_table(spark, fds)


#: Table, key and columns of each dataset of the batch.
FD_BATCH = {"part": ("part", "p_partkey", FD_PART), "orders": ("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"]),
            "supplier": ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"]),
            "customer": ("customer", "c_custkey", ["c_nationkey", "c_mktsegment", "c_name"])}


def q_fd_batch(spark, sf_dir):
    """FD3 over several tables: 100 hash-sampled rows of each, one JSON record a table."""
    return FD.fd_batch(spark, {k: (keyed(spark, sf_dir, t), "row_key", cols) for k, (t, _, cols) in FD_BATCH.items()}, 100, SEED)


def _fd_batch_sql():
    out = []
    for name, (t, _, cols) in FD_BATCH.items():
        part = (f"(SELECT * FROM {sql_keyed(t)} ORDER BY {sql_hash(SEED, 'fd-batch', 'row_key')} LIMIT 100)")
        place = " ".join(f"WHEN '{c}' THEN {i:03}" for i, c in enumerate(cols))
        out.append(f"""SELECT '{name}' AS dataset, count(*) AS result, '{{"fds":[' || coalesce(string_agg('"' || fd || '"', ','
  ORDER BY n, {", ".join(f"p{k}" for k in range(len(cols)))}, CASE rhs {place} END), '') || ']}}' AS notes
FROM (SELECT *, CASE WHEN lhs = '' THEN 0 ELSE len(string_split(lhs, ',')) END AS n,
      {", ".join(f"CASE string_split(lhs, ',')[{k + 1}] {place} ELSE -1 END AS p{k}" for k in range(len(cols)))}
      FROM ({_sql_fd(part, cols)}) z)""")
    return " UNION ALL ".join(out)


register("fd_batch", _fd_batch_sql())(q_fd_batch)


FD_XOR = ["a", "b", "c", "x"]
_SQL_XOR = "(SELECT p_size % 2 AS a, p_partkey % 2 AS b, ascii(p_brand) % 2 + length(p_name) % 2 AS c, " \
           "(p_size % 2 + p_partkey % 2 + ascii(p_brand) % 2 + length(p_name) % 2) % 2 AS x FROM part)"


def q_fd_xor(spark, sf_dir):
    """FDs with three columns on the left: a parity over ``part``."""
    p = load(spark, sf_dir, "part").select(
        (F.col("p_size") % 2).alias("a"), (F.col("p_partkey") % 2).alias("b"),
        (F.ascii("p_brand") % 2 + F.length("p_name") % 2).alias("c")).withColumn("x", (F.col("a") + F.col("b") + F.col("c")) % 2)
    return FD.fd_table(spark, FD.discover(p, FD_XOR))


register("fd_xor", _sql_fd(_SQL_XOR, FD_XOR))(q_fd_xor)

register("fd_sample_batch", _sql_fd(
    f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash(SEED, 'fd-batch', 'row_key')}) AS rn "
    f"FROM {sql_keyed('orders')}) WHERE rn <= 100)", ["o_custkey", "o_orderstatus", "o_orderpriority"]))(q_fd_sample)


# ---------------------------------------------------------------- neighbours: DCR1, OUT2 (LOF)
from tabtaint.operators import neighbors as NB  # noqa: E402


def _q_dcr(table, num, cat):
    def q(spark, sf_dir):
        r, s = _halves(spark, sf_dir, table)
        out = NB.dcr(r, s, [num], [cat], SEED)
        return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])
    return q


def _dcr_sql(table, num, cat):
    """The least distance of a row is its least one among rows of its category, or one more for all rows
    (numbers nearest in order); so the twin needs no pairs."""
    R, S = _sql_half(table), _sql_half(table, False)
    u_a = sql_uniform(SEED, f"gen4:{num}", "range")
    u_n = sql_uniform(SEED, f"gen4:{cat}", "range")

    def dist(src):
        def gap(side, same, op):
            near = "max" if side == "<=" else "min"
            part = "PARTITION BY c " if same else ""
            frame = "" if op == "up" else " DESC"
            return (f"{near}(CASE WHEN real THEN a END) OVER ({part}ORDER BY a{frame} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        return f"""
SELECT k, least(least(coalesce(least(a - s_lo, s_hi - a), coalesce(a - s_lo, s_hi - a)), 1.0),
                least(coalesce(least(a - a_lo, a_hi - a), coalesce(a - a_lo, a_hi - a)), 1.0) + 1.0) / 2 AS d
FROM (SELECT *, {gap("<=", True, "up")} AS s_lo, {gap(">=", True, "down")} AS s_hi, {gap("<=", False, "up")} AS a_lo,
      {gap(">=", False, "down")} AS a_hi
      FROM (SELECT CAST(row_key AS VARCHAR) AS k, {num} / (mm.hi - mm.lo) AS a, CAST({cat} AS VARCHAR) AS c, true AS real FROM r, mm
            UNION ALL
            SELECT CAST({src[1]} AS VARCHAR), {num} / (mm.hi - mm.lo), CAST({cat} AS VARCHAR), false FROM {src[0]}, mm))
WHERE NOT real"""
    return f"""
WITH r AS (SELECT * FROM {R}), s AS (SELECT * FROM {S}),
mm AS (SELECT CAST(min({num}) AS DOUBLE) AS lo, CAST(max({num}) AS DOUBLE) AS hi FROM r),
v AS (SELECT val, row_number() OVER (ORDER BY {sql_hash(SEED, f'gen4:{cat}:order', 'val')}) AS rn
      FROM (SELECT DISTINCT {cat} AS val FROM r WHERE {cat} IS NOT NULL)),
rnd AS (SELECT x.range AS k, lo + {u_a} * (hi - lo) AS {num}, val AS {cat}
        FROM range((SELECT count(*) FROM s)) x CROSS JOIN mm JOIN v ON rn = CAST(floor({u_n} * (SELECT count(*) FROM v)) AS BIGINT) + 1),
dist_s AS ({dist(("s", "row_key"))}),
dist_r AS ({dist(("rnd", "k"))}),
m AS (SELECT (SELECT median(d) FROM dist_s) AS ms, (SELECT median(d) FROM dist_r) AS mr)
SELECT round(CASE WHEN mr = 0 THEN 1.0 ELSE least(1.0, ms / mr) END, 6) AS score, round(ms, 6) AS median_dcr_synthetic,
  round(mr, 6) AS median_dcr_random FROM m"""


register("dcr_score", _dcr_sql("supplier", "s_acctbal", "s_nationkey"))(_q_dcr("supplier", "s_acctbal", "s_nationkey"))
register("dcr_customer", _dcr_sql("customer", "c_acctbal", "c_nationkey"))(_q_dcr("customer", "c_acctbal", "c_nationkey"))
register("dcr_orders", _dcr_sql("orders", "o_totalprice", "o_orderpriority"))(_q_dcr("orders", "o_totalprice", "o_orderpriority"))


def _q_lof(table, num, cat, k=20):
    def q(spark, sf_dir):
        out = NB.lof(keyed(spark, sf_dir, table), [num], [cat], k=k)
        return out.select("row_key", r6(F.col("lof")).alias("lof"), "is_outlier")
    return q


def _lof_sql(table, num, cat, k=20):
    """A row's nearest are among the k before and the k after it in the order of the number, within its
    category and over all rows (ties in the number by key: rows of equal number on each side)."""
    def near(part):
        w = f"OVER ({part} ORDER BY a, row_key ROWS BETWEEN {{}})"
        return (f"SELECT row_key AS q, a, n, unnest(list({{'nk': row_key, 'b': a, 'm': n}}) {w.format(f'{k} PRECEDING AND 1 PRECEDING')}) AS o FROM f "
                f"UNION SELECT row_key, a, n, unnest(list({{'nk': row_key, 'b': a, 'm': n}}) {w.format(f'1 FOLLOWING AND {k} FOLLOWING')}) FROM f")
    return f"""
WITH f AS (SELECT row_key, CAST({num} AS DOUBLE) AS a, CAST({cat} AS VARCHAR) AS n FROM {sql_keyed(table)}),
p AS ({near("PARTITION BY n")} UNION {near("")}),
d AS (SELECT DISTINCT q, o.nk AS nk, CASE WHEN n = o.m THEN sqrt((a - o.b) * (a - o.b)) ELSE sqrt(((a - o.b) * (a - o.b) + 1.0) + 1.0) END AS dist FROM p),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, nk) AS rk FROM d) WHERE rk <= {k}),
kd AS (SELECT q AS nk, dist AS kd FROM nn WHERE rk = {k}),
reach AS (SELECT nn.q, greatest(kd.kd, nn.dist) AS r FROM nn JOIN kd USING (nk)),
lrd AS (SELECT q, 1.0 / (avg(r) + 1e-10) AS lrd FROM reach GROUP BY q),
lf AS (SELECT nn.q, avg(l2.lrd / l1.lrd) AS lof FROM nn JOIN lrd l2 ON l2.q = nn.nk JOIN lrd l1 ON l1.q = nn.q GROUP BY nn.q)
SELECT q AS row_key, round(lof, 6) AS lof, lof > 1.5 AS is_outlier FROM lf"""


register("lof_scores", _lof_sql("supplier", "s_acctbal", "s_nationkey"))(_q_lof("supplier", "s_acctbal", "s_nationkey"))
register("lof_customer", _lof_sql("customer", "c_acctbal", "c_nationkey"))(_q_lof("customer", "c_acctbal", "c_nationkey"))
register("lof_orders", _lof_sql("orders", "o_totalprice", "o_orderpriority"))(_q_lof("orders", "o_totalprice", "o_orderpriority"))


def q_lof_small_null(spark, sf_dir):
    """LOF where rows are fewer than the neighbours asked for and some values are missing: no row is lost."""
    n = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("row_key"),
        F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey").cast("double")).alias("v"),
        F.col("n_regionkey").alias("r"))
    return NB.lof(n, ["v"], ["r"], k=40).select("row_key", F.round("lof", 4).alias("lof"), "is_outlier")


register("lof_small_and_null", """
WITH x AS (SELECT CAST(n_nationkey AS VARCHAR) AS row_key, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS v,
           n_regionkey AS r FROM nation),
f AS (SELECT row_key, coalesce(v, (SELECT median(v) FROM x)) AS a, r FROM x),
nn AS (SELECT p.row_key AS q, o.row_key AS nk, sqrt((p.a - o.a) * (p.a - o.a) + CASE WHEN p.r = o.r THEN 0 ELSE 2 END) AS dist
       FROM f p JOIN f o ON p.row_key <> o.row_key),
kd AS (SELECT q AS nk, max(dist) AS kd FROM nn GROUP BY q),
lrd AS (SELECT q, 1.0 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM nn JOIN kd USING (nk) GROUP BY q),
lf AS (SELECT nn.q, avg(b.lrd / a.lrd) AS lof FROM nn JOIN lrd b ON b.q = nn.nk JOIN lrd a ON a.q = nn.q GROUP BY nn.q)
SELECT q AS row_key, round(lof, 4) AS lof, lof > 1.5 AS is_outlier FROM lf""")(q_lof_small_null)


def q_lof_embeddings(spark, sf_dir):
    """LOF on the 64-dim embedding vectors (k=20), outlier count per label."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("row_key"), "label",
                                                  F.col("embedding").cast("array<double>").alias("_f"))
    lof = NB.lof_of_neighbours(cut_lineage(NB.knn(e, e, 20, exclude_self=True)), 20)
    return (lof.join(e.select("row_key", "label"), "row_key")
            .groupBy("label").agg(F.count_if(F.col("lof") > 1.5).alias("outliers"), F.count(F.lit(1)).alias("rows")))


register("lof_embeddings", """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS k, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nn AS (
  SELECT q, o.k AS nk, o.d AS dist, row_number() OVER (PARTITION BY q ORDER BY o.d, o.k) AS rk
  FROM (SELECT a.k AS q, unnest(min({'d': list_distance(a.v, b.v), 'k': b.k}, 20)) AS o FROM e a JOIN e b ON a.k <> b.k GROUP BY a.k)),
kd AS (SELECT q AS nk, dist AS kd FROM nn WHERE rk = 20),
lrd AS (SELECT q, 1.0 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM nn JOIN kd USING (nk) GROUP BY q),
lf AS (SELECT nn.q, avg(b.lrd / a.lrd) AS lof FROM nn JOIN lrd b ON b.q = nn.nk JOIN lrd a ON a.q = nn.q GROUP BY nn.q)
SELECT label, count(*) FILTER (WHERE lof > 1.5) AS outliers, count(*) AS rows FROM lf JOIN e ON k = q GROUP BY label""")(q_lof_embeddings)


# ---------------------------------------------------------------- OUT1 isolation forest (rows-only check)
from tabtaint.operators import iforest as IF  # noqa: E402


def q_iforest(spark, sf_dir):
    ev = keyed(spark, sf_dir, "events")
    return IF.isolation_forest(ev, ["value", "user_id"], ["event_type"], 100, 256, SEED).select(
        "row_key", F.round("score", 6).alias("score"), "is_outlier")


register("iforest_scores", None)(q_iforest)


def q_iforest_sample(spark, sf_dir):
    """The rows that each of 100 trees is built from: the 256 least hashes of the whole table."""
    ev = keyed(spark, sf_dir, "events").select("row_key")
    rows, psi = IF.bottom_rows(ev, "row_key", 100, 256, SEED)
    least = rows.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "row_key"))).where(F.col("rank") <= psi)
    return least.select("tree", "rank", "row_key")


def _iforest_sample_sql():
    trees = ", ".join(f"({t}, {a}, {b}, {c}, {d})" for t, (a, b, c, d) in enumerate(IF.tree_hashes(SEED, 100).tolist()))
    h = sql_hash(SEED, "iforest:row", "row_key")
    return f"""
WITH x AS (SELECT row_key, CAST('0x' || substr({h}, 1, 8) AS BIGINT) % {IF.PRIME} AS x, CAST('0x' || substr({h}, 9, 8) AS BIGINT) % {IF.PRIME} AS y
           FROM {sql_keyed('events')}),
t(tree, a, b, c, d) AS (VALUES {trees}),
r AS (SELECT tree, row_key, row_number() OVER (PARTITION BY tree ORDER BY (a * x + b) % {IF.PRIME} * 2147483648 + (c * y + d) % {IF.PRIME}, row_key) AS rank
      FROM x, t)
SELECT CAST(tree AS INTEGER) AS tree, CAST(rank AS INTEGER) AS rank, row_key FROM r WHERE rank <= 256"""


register("iforest_sample", _iforest_sample_sql())(q_iforest_sample)


OUTLIER_BATCH = {"supplier": (["s_acctbal"], ["s_nationkey"]), "customer": (["c_acctbal"], ["c_nationkey", "c_mktsegment"]),
                 "part": (["p_size", "p_retailprice"], ["p_brand"])}


def q_outlier_batch(spark, sf_dir):
    """OUT3 over several tables, a JSON record for each table and method."""
    return IF.outlier_batch(spark, {t: (keyed(spark, sf_dir, t), num, cat, "row_key") for t, (num, cat) in OUTLIER_BATCH.items()}, SEED)


register("outlier_batch", None)(q_outlier_batch)


def q_outlier_counts(spark, sf_dir):
    """OUT3: outlier counts of both detectors per dataset, as one report table."""
    sup = keyed(spark, sf_dir, "supplier")
    lof_n = NB.lof(sup, ["s_acctbal"], ["s_nationkey"]).agg(F.count_if("is_outlier").alias("result"))
    if_n = IF.isolation_forest(sup, ["s_acctbal"], ["s_nationkey"], 100, 256, SEED).agg(F.count_if("is_outlier").alias("result"))
    return (lof_n.select(F.lit("supplier").alias("dataset"), F.lit("LOF").alias("method"), "result")
            .unionByName(if_n.select(F.lit("supplier").alias("dataset"), F.lit("IFO").alias("method"), "result")))


register("outlier_discovery_report", None)(q_outlier_counts)


# ---------------------------------------------------------------- model evaluators (rows-only checks)
from tabtaint.operators import models as MD  # noqa: E402


def q_detect_logistic(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "customer")
    return MD.detection(r, s, ["c_acctbal"], ["c_nationkey", "c_mktsegment"], SEED, "logistic")


def q_detect_svc(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "customer")
    return MD.detection(r, s, ["c_acctbal"], ["c_nationkey", "c_mktsegment"], SEED, "svc")


register("detect_logistic", None)(q_detect_logistic)
register("detect_svc", None)(q_detect_svc)


def _doc_features(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = load(spark, sf_dir, "labels")
    return keyed(spark, sf_dir, "labels").join(d, "doc_id").select("row_key", "lang", "source", "n_chars", "quality", "toxic")


def q_eff_binary(spark, sf_dir):
    """ML1 binary: AdaBoost stumps trained on a synthetic table (GEN6 per-class), tested on real."""
    real = _doc_features(spark, sf_dir)
    syn = G.per_class(real, ["lang", "source", "n_chars"], "quality", 400, SEED)
    return MD.efficacy(syn, real, ["n_chars"], ["lang", "source"], "quality", "classification", SEED, ada_rounds=50)


from tabtaint.operators import boost as BO  # noqa: E402


def q_eff_multiclass(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "customer")
    syn = G.marginal(s, ["c_nationkey", "c_acctbal", "c_mktsegment"], 700, SEED)
    return MD.efficacy(syn, r, ["c_acctbal"], ["c_nationkey"], "c_mktsegment", "classification", SEED)


def q_eff_regression(spark, sf_dir):
    r, s = _halves(spark, sf_dir, "orders")
    return MD.efficacy(s, r, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_totalprice", "regression", SEED)


register("ml_efficacy_binary", None)(q_eff_binary)


def q_boost_rounds(spark, sf_dir):
    """The first three boosted stumps for the quality of documents."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    binned, stumps = BO.fit(d.where("label IS NOT NULL"), ["n_chars"], ["lang", "source"], 3)
    rows = spark.createDataFrame(BO.describe(binned, stumps), "round int, column string, split string, yes double, no double, error double, alpha double")
    return rows.withColumn("error", r6(F.col("error"))).withColumn("alpha", r6(F.col("alpha")))


def _boost_rounds_sql():
    cols = [("n_chars", True), ("lang", False), ("source", False)]

    def bin_of(c, number):
        if number:
            return (f"CAST(least(greatest(floor(({c} - (SELECT min({c}) FROM d)) / CAST((SELECT max({c}) - min({c}) FROM d) AS DOUBLE) * {BO.BINS}), 0), "
                    f"{BO.BINS - 1}) AS INTEGER)")
        return f"(SELECT count(DISTINCT coalesce(o.{c}, '∅')) FROM d o WHERE coalesce(o.{c}, '∅') < coalesce(d.{c}, '∅'))"

    ctes = ["d AS (SELECT doc_id, n_chars, lang, source, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)",
            "x AS MATERIALIZED (SELECT doc_id, y, " + ", ".join(f"{bin_of(c, n)} AS b{i}" for i, (c, n) in enumerate(cols)) + " FROM d)",
            "v AS (" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS c, {bin_of(c, n)} AS s, coalesce({c}, '∅') AS name FROM d"
                                          for i, (c, n) in enumerate(cols) if not n) + ")",
            "w0 AS (SELECT doc_id, 1.0::DOUBLE AS w FROM x)"]
    for k in range(1, 4):
        long = " UNION ALL ".join(f"SELECT {i} AS c, b{i} AS b, y, w FROM x JOIN w{k - 1} USING (doc_id)" for i in range(len(cols)))
        ctes += [f"h{k} AS MATERIALIZED (SELECT c, b, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM ({long}) GROUP BY 1, 2)",
                 f"t{k} AS (SELECT sum(p) AS p, sum(q) AS q FROM h{k} WHERE c = 0)",
                 f"""e{k} AS (
  SELECT c, s, yp, yq, t{k}.p - yp AS np, t{k}.q - yq AS nq, (least(yp, yq) + least(t{k}.p - yp, t{k}.q - yq)) / (t{k}.p + t{k}.q) AS e
  FROM (SELECT 0 AS c, r.s, coalesce(sum(p), 0) AS yp, coalesce(sum(q), 0) AS yq FROM range({BO.BINS - 1}) r(s) LEFT JOIN h{k} ON c = 0 AND b <= r.s GROUP BY r.s
        UNION ALL SELECT c, b, p, q FROM h{k} WHERE c > 0), t{k})""",
                 f"s{k} AS MATERIALIZED (SELECT *, CASE WHEN yp > yq THEN 1.0 ELSE 0.0 END AS yes, CASE WHEN np > nq THEN 1.0 ELSE 0.0 END AS no, "
                 f"ln((1 - e) / e) AS alpha FROM e{k} ORDER BY round(e, {BO.SAME_ERROR}), c, s LIMIT 1)"]
        side = "CASE s.c " + " ".join(f"WHEN {i} THEN b{i} {'<=' if n else '='} s.s" for i, (_, n) in enumerate(cols)) + " END"
        ctes.append(f"w{k} AS MATERIALIZED (SELECT doc_id, w * CASE WHEN (CASE WHEN {side} THEN yes ELSE no END) <> y THEN exp(alpha) ELSE 1.0 END AS w "
                    f"FROM x JOIN w{k - 1} USING (doc_id), s{k} s)")
    names = "CASE c " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(cols)) + " END"
    rounds = " UNION ALL ".join(
        f"SELECT {k} AS round, {names} AS column, CASE WHEN c = 0 THEN 'bin <= ' || s ELSE (SELECT name FROM v WHERE v.c = s{k}.c AND v.s = s{k}.s) END AS split, "
        f"CAST(yes AS DOUBLE) AS yes, CAST(no AS DOUBLE) AS no, round(e, 6) AS error, round(alpha, 6) AS alpha FROM s{k}" for k in range(1, 4))
    return f"WITH {', '.join(ctes)} {rounds}"


register("boost_rounds", _boost_rounds_sql())(q_boost_rounds)
register("ml_efficacy_multiclass", None)(q_eff_multiclass)
register("ml_efficacy_regression", None)(q_eff_regression)


def _aug_inputs(spark, sf_dir):
    real = _doc_features(spark, sf_dir)
    sp = SP.stratified_split(real, "row_key", "quality", 0.3, seed=SEED)
    train, valid = sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split")
    syn = G.per_class(train, ["lang", "source", "n_chars"], "quality", 300, SEED).withColumn("toxic", F.lit(0)) \
        .withColumn("row_key", F.concat(F.lit("syn-"), F.col("draw_id").cast("string"))).drop("draw_id")
    minority = P.minority_label(train, "quality").first()["minority_label"]
    return train, syn.select(*train.columns), valid, minority


def q_aug_precision(spark, sf_dir):
    t, s, v, mino = _aug_inputs(spark, sf_dir)
    return MD.augmentation_classification(t, s, v, ["n_chars"], ["lang", "source"], "quality", mino, "recall", 0.9, SEED)


def q_aug_recall(spark, sf_dir):
    t, s, v, mino = _aug_inputs(spark, sf_dir)
    return MD.augmentation_classification(t, s, v, ["n_chars"], ["lang", "source"], "quality", mino, "precision", 0.9, SEED)


register("ml_aug_precision", None)(q_aug_precision)
register("ml_aug_recall", None)(q_aug_recall)


def q_aug_regression(spark, sf_dir):
    o = keyed(spark, sf_dir, "orders")
    sp = SP.regression_split(o, "row_key", "o_totalprice", 0.25, seed=SEED)
    train, valid = sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split")
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    syn = G.marginal(train, cols, 2000, SEED)
    return MD.augmentation_regression(train.select(*cols), syn.select(*cols), valid.select(*cols), ["o_custkey"],
                                      ["o_orderstatus", "o_orderpriority"], "o_totalprice", SEED, num_trees=100)


register("ml_aug_regression", None)(q_aug_regression)


def q_utility(spark, sf_dir):
    """ML5: weighted F1 of RF(50) trained on a synthetic table from the corrupted 'No cleaning'
    scenario, scored on the held-out split, for every scenario (the worked example's loop)."""
    o = keyed(spark, sf_dir, "orders")
    sp = SP.stratified_split(o, "row_key", SC_TARGET, test_size=0.5, seed=SEED)
    src, held = sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split")
    sc = SC.ScenarioCorruptor(src, "row_key", SC_TARGET, SC_NUM, SC_CAT, SEED)
    cols = SC_NUM + SC_CAT + [SC_TARGET]
    held = stored(held.select(*cols), "held-out")   # read by every scenario's model
    for active in SC.SCENARIOS.values():       # plan (and run the small std jobs) up front
        sc.expressions(active)

    def one(item):
        name, active = item
        syn = cut_lineage(G.marginal(sc.corrupted(active), cols, 1000, SEED))   # drawn once for all jobs of the model
        f1 = MD.utility_f1(syn.select(*cols), held, SC_NUM, SC_CAT, SC_TARGET)
        return ("marginal_distributions", name, float(f1))
    # the scenarios are independent: their Spark jobs run concurrently from a few driver threads
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = list(pool.map(one, SC.SCENARIOS.items()))
    return spark.createDataFrame(rows, "model string, scenario string, score double")


register("ml_utility_scenarios", None)(q_utility)


# ---------------------------------------------------------------- grid, ledger, ids, results (GRD*, JN1/2/8, STR*, RES*)
from tabtaint.plans import grid as GR  # noqa: E402
from tabtaint.functions.strings import decode_experiment_id  # noqa: E402


def _datasets(spark, sf_dir):
    return load(spark, sf_dir, "region").select(F.col("r_name").alias("dataset_name"))


def _problem_types(spark, sf_dir):
    return load(spark, sf_dir, "region").select(
        F.col("r_name").alias("dataset_name"),
        F.when(F.col("r_regionkey") % 2 == 0, "classification").otherwise("regression").alias("problem_type"))


def _sql_list(vals):
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in vals) + "]"


def _sql_eid(t, d, seed, perf, err, rate, gen):
    return (f"concat_ws('#', {t}, {d}, CAST({seed} AS VARCHAR), {perf}, coalesce({err}, 'NULL'), "
            f"coalesce(CAST(CAST(round({rate} * 100) AS INTEGER) AS VARCHAR), 'NULL'), {gen})")


_SQL_PERFECT = f"""SELECT {_sql_eid("'NOR'", 'r_name', 'seed', "'PERF'", 'NULL', 'NULL', 'gen')} AS experiment_id,
  'NOR' AS experiment_type, r_name AS dataset_name, CAST(seed AS BIGINT) AS random_seed, 'PERF' AS data_perfectness,
  CAST(NULL AS VARCHAR) AS data_error, CAST(NULL AS DOUBLE) AS error_rate, gen AS generator
FROM region, unnest({_sql_list(GR.DEFAULT_SEEDS)}) s(seed), unnest({_sql_list(GR.models())}) m(gen)"""

_SQL_IMPERFECT = f"""SELECT {_sql_eid("'NOR'", 'r_name', 'seed', 'lvl', 'err', 'rate', 'gen')} AS experiment_id,
  'NOR' AS experiment_type, r_name AS dataset_name, CAST(seed AS BIGINT) AS random_seed, lvl AS data_perfectness,
  err AS data_error, CAST(rate AS DOUBLE) AS error_rate, gen AS generator
FROM region, unnest({_sql_list(GR.DEFAULT_SEEDS)}) s(seed), unnest({_sql_list(GR.models())}) m(gen),
  unnest({_sql_list(GR.ERROR_TYPES)}) e(err), unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE]) r(rate), unnest(['IMP', 'SEMI']) l(lvl)
WHERE NOT (lvl = 'SEMI' AND (abs(rate - 0.4) > 1e-9 OR err = 'DUP'))"""


def q_grid_perfect(spark, sf_dir):
    return GR.perfect_grid(_datasets(spark, sf_dir))


def q_grid_imperfect(spark, sf_dir):
    return GR.imperfect_grid(_datasets(spark, sf_dir))


register("grid_perfect", _SQL_PERFECT)(q_grid_perfect)
register("grid_imperfect", _SQL_IMPERFECT)(q_grid_imperfect)


def _sql_tasks(skipped=False):
    single = [m for m in GR.QUALITY_METHODS + GR.ML_METHODS if m in GR.SINGULAR_METHODS]
    dual = [m for m in GR.QUALITY_METHODS + GR.ML_METHODS if m in GR.DUAL_METHODS]
    vals = [f"('{m}', '{t[0]}', NULL)" for m in single for t in GR.SINGULAR_TARGETS] + \
           [f"('{m}', '{t[0]}', '{t[1]}')" for m in dual for t in GR.DUAL_TARGETS]
    base = f"""WITH g AS ({_SQL_IMPERFECT}),
pt AS (SELECT r_name AS dataset_name, CASE WHEN r_regionkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type FROM region),
t AS (SELECT * FROM (VALUES {', '.join(vals)}) v(method, first_target, second_target)),
x AS (SELECT g.*, pt.problem_type, t.*, concat_ws('#', t.method, t.first_target, coalesce(t.second_target, 'NULL')) AS evaluation_id,
        (g.data_error IS NOT NULL AND t.first_target IN ('R', 'S') AND coalesce(t.second_target IN ('R', 'S'), true)
         AND abs(g.error_rate - 0.1) > 1e-9) AS rep
      FROM g LEFT JOIN pt USING (dataset_name), t
      WHERE NOT ((t.method IN ('APR', 'ARC') AND pt.problem_type <> 'classification') OR (t.method = 'AR2' AND pt.problem_type <> 'regression')))"""
    if skipped:
        return base + f" SELECT evaluation_id || '/' || experiment_id AS computation_id, '{GR.BASELINE_REASON.format(rate=0.1)}' AS reason FROM x WHERE rep"
    return base + " SELECT evaluation_id, experiment_id, method, first_target, second_target FROM x WHERE NOT rep"


def q_tasks(spark, sf_dir):
    return GR.evaluation_tasks(GR.imperfect_grid(_datasets(spark, sf_dir)), _problem_types(spark, sf_dir))[0]


def q_tasks_skipped(spark, sf_dir):
    return GR.evaluation_tasks(GR.imperfect_grid(_datasets(spark, sf_dir)), _problem_types(spark, sf_dir))[1]


register("grid_evaluation_tasks", _sql_tasks())(q_tasks)
register("grid_skipped_baselines", _sql_tasks(True))(q_tasks_skipped)


def q_pending(spark, sf_dir):
    """JN1 / GRD5: ledgers derived from the grid itself (seed 100 done, 'great' at 200 failed, 'ddpm' at 300 skipped)."""
    g = GR.perfect_grid(_datasets(spark, sf_dir))
    exp = g.where("random_seed = 100").select("experiment_id")
    err = g.where("random_seed = 200 AND generator = 'great'").select("experiment_id")
    skp = g.where("random_seed = 300 AND generator = 'ddpm'").select(F.col("experiment_id").alias("computation_id"))
    return GR.pending_experiments(g, exp, err, skp)


register("ledger_pending_experiments", f"""
WITH g AS ({_SQL_PERFECT})
SELECT * FROM g WHERE experiment_id NOT IN (
  SELECT experiment_id FROM g WHERE random_seed = 100 UNION ALL
  SELECT experiment_id FROM g WHERE random_seed = 200 AND generator = 'great' UNION ALL
  SELECT experiment_id FROM g WHERE random_seed = 300 AND generator = 'ddpm')""")(q_pending)


def q_pending_evals(spark, sf_dir):
    tasks = q_tasks(spark, sf_dir)
    done = tasks.where("method = 'QLT' OR first_target = 'RH'").select("evaluation_id", "experiment_id")
    return GR.pending_evaluations(tasks, done)


register("ledger_pending_evaluations", f"""
WITH tk AS ({_sql_tasks()}) SELECT * FROM tk WHERE NOT (method = 'QLT' OR first_target = 'RH')""")(q_pending_evals)


def q_counterparts(spark, sf_dir):
    d = _datasets(spark, sf_dir)
    return GR.perfect_counterparts(GR.perfect_grid(d).unionByName(GR.imperfect_grid(d)))


register("experiment_counterparts", f"""
WITH a AS ({_SQL_PERFECT} UNION ALL {_SQL_IMPERFECT})
SELECT i.experiment_id, p.experiment_id AS perfect_experiment_id FROM a i LEFT JOIN a p
  ON p.data_perfectness = 'PERF' AND p.experiment_type = i.experiment_type AND p.dataset_name = i.dataset_name
  AND p.random_seed = i.random_seed AND p.generator = i.generator
WHERE i.data_perfectness <> 'PERF'""")(q_counterparts)


def q_id_codec(spark, sf_dir):
    g = GR.imperfect_grid(_datasets(spark, sf_dir))
    return g.select("experiment_id", *decode_experiment_id(F.col("experiment_id")))


register("id_codec", f"""
SELECT experiment_id, nullif(split_part(experiment_id, '#', 1), 'NULL') AS experiment_type,
  nullif(split_part(experiment_id, '#', 2), 'NULL') AS dataset_name, CAST(nullif(split_part(experiment_id, '#', 3), 'NULL') AS BIGINT) AS random_seed,
  nullif(split_part(experiment_id, '#', 4), 'NULL') AS data_perfectness, nullif(split_part(experiment_id, '#', 5), 'NULL') AS data_error,
  CAST(nullif(split_part(experiment_id, '#', 6), 'NULL') AS INTEGER) / 100.0 AS error_rate, nullif(split_part(experiment_id, '#', 7), 'NULL') AS generator
FROM ({_SQL_IMPERFECT})""")(q_id_codec)


# results ledger stand-in read from the data: model = order status, scenario = priority
def _results(spark, sf_dir):
    return (load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("scenario"))
            .agg(F.round(F.avg("o_totalprice") / 100000.0, 6).alias("score")))


_SQL_RESULTS = ("SELECT o_orderstatus AS model, o_orderpriority AS scenario, round(avg(o_totalprice) / 100000.0, 6) AS score "
                "FROM orders GROUP BY 1, 2")


def q_pivot(spark, sf_dir):
    return GR.score_matrix(_results(spark, sf_dir))


_SCENARIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]   # fixed values: the order priorities
_SQL_PIVOT = ", ".join(f"""max(score) FILTER (scenario = '{x}') AS "{x}\"""" for x in _SCENARIOS)
register("result_pivot", f"SELECT model, {_SQL_PIVOT} FROM ({_SQL_RESULTS}) GROUP BY model")(q_pivot)


def q_best(spark, sf_dir):
    return GR.best_scenario(_results(spark, sf_dir), exclude=("3-MEDIUM",))


register("best_scenario", f"""SELECT model, arg_max(scenario, score) AS best_scenario, max(score) AS best_score
FROM ({_SQL_RESULTS}) WHERE scenario <> '3-MEDIUM' GROUP BY model""")(q_best)


def q_gap(spark, sf_dir):
    return GR.baseline_gap(_results(spark, sf_dir), baseline="3-MEDIUM").withColumn("gap", r6(F.col("gap")))


register("baseline_gap", f"""WITH r AS ({_SQL_RESULTS})
SELECT a.model, a.scenario, a.score, round(a.score - b.score, 6) AS gap FROM r a JOIN r b ON a.model = b.model AND b.scenario = '3-MEDIUM'
WHERE a.scenario <> '3-MEDIUM'""")(q_gap)


def q_task_json(spark, sf_dir):
    t = q_tasks(spark, sf_dir)
    return GR.task_json(t).select("evaluation_id", "experiment_id", "task")


register("task_json", f"""WITH tk AS ({_sql_tasks()})
SELECT evaluation_id, experiment_id, '{{"evaluation_id":"' || evaluation_id || '","experiment_id":"' || experiment_id || '","params":{{}}}}' AS task
FROM tk""")(q_task_json)


# ---------------------------------------------------------------- streaming (STM1, STM2)
from tabtaint.streaming import states as SS  # noqa: E402
from tabtaint.streaming import tasks as ST  # noqa: E402
from tabtaint.streaming import corrupt_stream as CS  # noqa: E402


def q_stream_tasks(spark, sf_dir):
    """STM1: the grid's tasks published twice (duplicates), a ledger of the RH tasks; the stream
    dedups, marks done/pending and the result is read back from the sink."""
    tasks = q_tasks(spark, sf_dir)
    src = ST.scratch(spark, "task-source")
    recs = tasks.select("evaluation_id", "experiment_id", F.create_map().cast("map<string,string>").alias("params"))
    recs.write.mode("overwrite").json(f"{src}/a")
    recs.write.mode("overwrite").json(f"{src}/b")   # every task published twice
    ledger = tasks.where("first_target = 'RH'").select("evaluation_id", "experiment_id")
    out, ck = ST.scratch(spark, "task-sink"), ST.scratch(spark, "task-ckpt")
    ST.run_task_stream(spark, f"{src}/*", ledger, out, ck)
    return spark.read.parquet(out).select("evaluation_id", "experiment_id", "state")


register("stream_tasks_dedup", f"""WITH tk AS ({_sql_tasks()})
SELECT DISTINCT evaluation_id, experiment_id, CASE WHEN first_target = 'RH' THEN 'done' ELSE 'pending' END AS state
FROM tk""")(q_stream_tasks)


def q_stream_states(spark, sf_dir):
    """STM1: every task is published, and later finished, failed, skipped or left pending, by its hash; some
    outcomes come before the publication, some twice.  The states are kept by the stream."""
    tasks = q_tasks(spark, sf_dir).select("evaluation_id", "experiment_id")
    part = F.pmod(F.conv(F.substring(F.md5(F.concat("evaluation_id", F.lit("/"), "experiment_id")), 1, 8), 16, 10).cast("bigint"), F.lit(8))
    src = ST.scratch(spark, "event-source")
    outcome = F.when(part < 2, "finished").when(part == 2, "failed").when(part == 3, "skipped")
    done = tasks.withColumn("part", part).withColumn("event", outcome).where("event IS NOT NULL")
    done.where("part % 2 = 0").drop("part").write.json(f"{src}/a")
    tasks.withColumn("event", F.lit("published")).write.json(f"{src}/b")
    done.drop("part").write.json(f"{src}/c")
    out = ST.scratch(spark, "event-sink")
    SS.run_task_states(spark, f"{src}/*", out, ST.scratch(spark, "event-ckpt"), files_per_batch=9)
    return SS.current_states(spark, out)


register("stream_task_states", f"""WITH tk AS ({_sql_tasks()}),
p AS (SELECT DISTINCT evaluation_id, experiment_id, CAST('0x' || substr(md5(evaluation_id || '/' || experiment_id), 1, 8) AS BIGINT) % 8 AS part FROM tk)
SELECT evaluation_id, experiment_id, CASE WHEN part < 2 THEN 'finished' WHEN part = 2 THEN 'failed' WHEN part = 3 THEN 'skipped' ELSE 'pending' END AS state
FROM p""")(q_stream_states)


def q_stream_corrupt(spark, sf_dir):
    """STM2: Gaussian noise on the events stream (rate 0.1) with a plan frozen on the table."""
    spec = SPECS["events"]
    batch = keyed(spark, sf_dir, "events")
    plan = CS.fit_plan(batch, spec, "NOI", 0.1, 1.0, seed=SEED)
    stream = (spark.readStream.schema(load(spark, sf_dir, "events").schema)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    stream = stream.withColumn("row_key", F.col("event_id").cast("string"))
    out, ck = ST.scratch(spark, "stream-out"), ST.scratch(spark, "stream-ckpt")
    q = (CS.apply_plan(stream, plan).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.select("event_id", "ts", F.round("value", 4).alias("value"), "user_id", "event_type", "props", "row_key")


def _stream_corrupt_sql():
    spec = SPECS["events"]
    cols = C.choose_columns(spec, "NOI", 1.0, SEED)
    sel = {}
    for c in cols:
        s = C.NOISE_SCALE_MIN + py_uniform(SEED, f"noi-scale:{c}", "") * (C.NOISE_SCALE_MAX - C.NOISE_SCALE_MIN)
        noise = f"({sql_normal(SEED, f'noi:{c}', 'row_key')} * ({s!r} * (SELECT stddev_pop({c}) FROM events)))"
        hit = f"{sql_uniform(SEED, 'rows', 'row_key')} < 0.1"
        if c in _INTEGRAL["events"]:
            sel[c] = f"CASE WHEN {hit} THEN CAST({c} AS BIGINT) + greatest(CAST(trunc({noise}) AS BIGINT), 1) ELSE CAST({c} AS BIGINT) END"
        else:
            sel[c] = f"CASE WHEN {hit} THEN CAST({c} AS DOUBLE) + {noise} ELSE CAST({c} AS DOUBLE) END"
    v = f"round({sel.get('value', 'value')}, 4)"
    u = sel.get("user_id", "user_id")
    return f"SELECT event_id, ts, {v} AS value, {u} AS user_id, event_type, props, row_key FROM {sql_keyed('events')}"


register("stream_corrupt", _stream_corrupt_sql())(q_stream_corrupt)


# ---------------------------------------------------------------- sources and sinks (SRC*, SNK*)
from tabtaint.sources import readers as RD  # noqa: E402
from tabtaint.sources import sinks as SK  # noqa: E402


def q_csv_roundtrip(spark, sf_dir):
    """SNK1/SRC2: customer written as CSV with a header, read back with supplied names/types."""
    path = ST.scratch(spark, "csv")
    load(spark, sf_dir, "customer").write.option("header", True).csv(path)
    names = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
             ("c_mktsegment", "string")]
    return RD.read_csv_named(spark, path, names, header=True)


register("source_csv_named", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(q_csv_roundtrip)


def q_name_list(spark, sf_dir):
    """SRC7: a list file with comments and blank lines, from the region names."""
    path = ST.scratch(spark, "names")
    r = load(spark, sf_dir, "region")
    lines = r.select(F.explode(F.array(F.concat(F.lit("  "), F.col("r_name")), F.lit(""), F.concat(F.lit("# "), F.col("r_name"))))
                     .alias("value"))
    lines.write.text(path)
    return RD.read_name_list(spark, path)


register("source_name_list", "SELECT r_name AS name FROM region")(q_name_list)


def q_discover(spark, sf_dir):
    """SRC6: dataset discovery by file listing (contents never read)."""
    return RD.discover_datasets(spark, sf_dir).select("name")


register("source_discovery", None)(q_discover)


def q_json_tasks(spark, sf_dir):
    """SNK3/SRC8: task records written as JSON and read back with the task schema."""
    path = ST.scratch(spark, "json")
    t = q_tasks(spark, sf_dir).select("evaluation_id", "experiment_id",
                                                                F.create_map(F.lit("method"), F.col("method")).alias("params"))
    SK.write_json(t, path)
    return RD.read_json_records(spark, path, ST.TASK_SCHEMA, multiline=False).select(
        "evaluation_id", "experiment_id", F.col("params")["method"].alias("method"))


register("source_json_records", f"WITH tk AS ({_sql_tasks()}) SELECT evaluation_id, experiment_id, method FROM tk")(
    q_json_tasks)


def q_metadata(spark, sf_dir):
    """SNK6 + SRC5: per-dataset metadata as key/value rows, pivoted back."""
    n = load(spark, sf_dir, "nation").select(SK.safe_table_name(F.col("n_name")).alias("dataset"), "n_regionkey")
    kv = n.select("dataset", F.explode(F.array(
        F.struct(F.lit("name").alias("key"), F.col("dataset").alias("value")),
        F.struct(F.lit("problem_type").alias("key"),
                 F.when(F.col("n_regionkey") % 2 == 0, "classification").otherwise("regression").alias("value")),
        F.struct(F.lit("target_feature").alias("key"), F.lit("target").alias("value")))).alias("kv")).select("dataset", "kv.*")
    return RD.metadata_table(kv)


register("metadata_pivot", """
SELECT lower(translate(n_name, '- ', '__')) AS dataset, NULL::VARCHAR AS categorical_features, lower(translate(n_name, '- ', '__')) AS name,
  CASE WHEN n_regionkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type, 'target' AS target_feature FROM nation""")(q_metadata)


def q_object_path(spark, sf_dir):
    g = GR.imperfect_grid(_datasets(spark, sf_dir))
    parts = F.split("experiment_id", "#")
    return g.select("experiment_id", SK.object_path(*[parts.getItem(i) for i in range(7)]).alias("path"))


register("object_path", f"""SELECT experiment_id, replace(replace(experiment_id, '#NULL', ''), '#', '/') AS path FROM ({_SQL_IMPERFECT})""")(
    q_object_path)


# ---------------------------------------------------------------- GEN2 / GEN3 (rows-only)
from tabtaint.operators import bayes as BN  # noqa: E402


BN_COLS = ["o_totalprice", "o_orderstatus", "o_orderpriority"]


def q_chow_liu(spark, sf_dir):
    return _round_doubles(BN.chow_liu(load(spark, sf_dir, "orders"), BN_COLS[:1], BN_COLS[1:], 2000, SEED), 4)


def q_privbayes(spark, sf_dir):
    return BN.privbayes(load(spark, sf_dir, "orders"), BN_COLS[:1], BN_COLS[1:], 2000, SEED, 1.0)


def _chow_liu_sql():
    """Three columns: the tree leaves out the pair of least mutual information, which settles each column's parent."""
    x, y, z = "xyz"

    def text(v):
        return f"(length({v}) || ':' || {v})"

    def mi(a, b):
        return (f"(SELECT sum(n * (ln(n) - ln(na) - ln(nb))) FROM (SELECT {a}, {b}, count(*) AS n FROM d GROUP BY 1, 2) "
                f"JOIN (SELECT {a}, count(*) AS na FROM d GROUP BY 1) USING ({a}) JOIN (SELECT {b}, count(*) AS nb FROM d GROUP BY 1) USING ({b}))")

    def drawn(src, parent, child, name):
        a = text(parent) if parent else "''"
        w = f"OVER (PARTITION BY a ORDER BY {sql_hash(SEED, 'cl:order', 'b')}, b)"
        return f"""(SELECT s.*, b AS {child} FROM (SELECT *, {a} AS pa, {sql_uniform(SEED, f'cl:{name}', 'draw_id')} AS u FROM {src}) s JOIN
  (SELECT a, b, sum(n) {w} - n AS lo, sum(n) {w} AS hi, sum(n) OVER (PARTITION BY a) AS t
   FROM (SELECT {a} AS a, {child} AS b, count(*) AS n FROM d GROUP BY 1, 2)) i
  ON i.a = s.pa AND floor(u * t) >= lo AND floor(u * t) < hi)"""

    names = dict(zip("xyz", BN_COLS))
    trees = {"xy": [("x", "z"), ("z", "y")], "xz": [("x", "y"), ("y", "z")], "yz": [("x", "y"), ("x", "z")]}   # by the pair left out
    parts = []
    for out, edges in trees.items():
        src = f"(SELECT * EXCLUDE (pa, u) FROM {drawn('(SELECT range AS draw_id FROM range(2000))', None, 'x', names['x'])})"
        for p, c in edges:
            src = f"(SELECT * EXCLUDE (pa, u) FROM {drawn(src, p, c, names[c])})"
        parts.append(f"SELECT draw_id, x, y, z FROM {src} WHERE (SELECT least_pair FROM m) = '{out}'")
    lo, hi = "(SELECT min(o_totalprice) FROM orders)", "(SELECT max(o_totalprice) FROM orders)"
    return f"""
WITH d AS MATERIALIZED (SELECT CAST({_sql_bin('o_totalprice', lo, hi, 10)} AS VARCHAR) AS x, o_orderstatus AS y, o_orderpriority AS z FROM orders),
m AS (SELECT arg_min(p, v) AS least_pair FROM (VALUES ('xy', {mi(x, y)}), ('xz', {mi(x, z)}), ('yz', {mi(y, z)})) t(p, v)),
s AS ({" UNION ALL ".join(parts)})
SELECT draw_id, round({lo} + (CAST(x AS DOUBLE) + {sql_uniform(SEED, 'cl:val:o_totalprice', 'draw_id')}) * (({hi} - {lo}) / 10), 4) AS o_totalprice,
  y AS o_orderstatus, z AS o_orderpriority FROM s"""


register("gen_chow_liu", _chow_liu_sql())(q_chow_liu)
register("gen_privbayes", None)(q_privbayes)


# ---------------------------------------------------------------- experiment run and evaluation replay (GRD8, GRD9, EV*)
from tabtaint.plans import experiment as EX  # noqa: E402


def q_experiment(spark, sf_dir):
    """GRD8: one imperfect experiment on customer (placeholders at 20%, marginal generator)."""
    exp = EX.Experiment("customer", "marginal_distributions", 100, "IMP", "PLC", 0.2)
    syn, row, reason = EX.run_experiment(keyed(spark, sf_dir, "customer"), SPECS["customer"], exp)
    return row.drop("execution_time", "created_at")


register("experiment_run", None)(q_experiment)


def q_experiment_store(spark, sf_dir):
    """GRD5, GRD8, SNK4: an experiment run into a store, run again by force after its ledger row was lost,
    run once more (skipped), and compacted: how many rows each table of the store has."""
    store, df = ST.scratch(spark, "experiment"), keyed(spark, sf_dir, "customer")
    exp = EX.Experiment("customer", "marginal_distributions", 100, "IMP", "PLC", 0.2)
    for force in (False, True, False):
        EX.run_experiment(df, SPECS["customer"], exp, store=store, force=force)
    for t in GR.LEDGER_KEYS:
        GR.compact_ledger(spark, store, t)
    tables = {t: GR.read_ledger(spark, store, t) for t in (*GR.LEDGER_KEYS, "corrupted_rows")}
    tables |= {"tasks": spark.read.text(f"{store}/tasks"), "synthetic": spark.read.parquet(f"{store}/{EX.synthetic_path(exp)}")}
    out = None
    for name, t in tables.items():
        n = t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def _experiment_store_sql():
    single = [m for m in GR.QUALITY_METHODS + GR.ML_METHODS if m in GR.SINGULAR_METHODS]
    dual = [m for m in GR.QUALITY_METHODS + GR.ML_METHODS if m in GR.DUAL_METHODS and m not in GR.REGRESSION_ONLY]
    every = len(single) * len(GR.SINGULAR_TARGETS) + len(dual) * len(GR.DUAL_TARGETS)
    repeated = len(single) * 2 + len(dual)   # R and S alone, R with S, at a rate that isn't the first
    n = "(SELECT count(*) - CAST(ceil(0.5 * count(*)) AS BIGINT) FROM customer)"
    return f"""SELECT * FROM (VALUES ('experiments', 1), ('errors', 0), ('evaluations', 0), ('skipped_computations', {repeated} + 1),
  ('corrupted_rows', CAST(floor(greatest(0.2 * {n}, 1)) AS BIGINT)), ('tasks', {every - repeated}), ('synthetic', {n})) t("table", "rows")"""


register("experiment_store", _experiment_store_sql())(q_experiment_store)


def q_replay(spark, sf_dir):
    """GRD9: replay quality evaluations R-S and R-SH of an experiment from the id strings."""
    eid = "NOR#customer#100#IMP#PLC#20#marginal_distributions"
    a = EX.replay("QLT#R#S", eid, keyed(spark, sf_dir, "customer"), SPECS["customer"])
    b = EX.replay("QLT#R#SH", eid, keyed(spark, sf_dir, "customer"), SPECS["customer"])
    return a.unionByName(b)


register("evaluation_replay", None)(q_replay)


METHODS = ["AR2", "DCR", "DPR", "HFD", "LOF", "QLT"]   # the model-fitting ones are run by tests
_EVAL_EXPERIMENT = "NOR#customer#100#IMP#PLC#20#marginal_distributions"


def _evaluation_ids():
    return [f"{m}#{'RH#NULL' if EX.EVALUATORS[m][0] == 1 else 'R#SH'}" for m in METHODS] + ["QLT#R#S", "QLT#R#SH"]


def q_evaluations(spark, sf_dir):
    """EV0, GRD5: methods run from their id strings with ledger rows; a baseline at another rate,
    a method for regression and a repeated id are skipped with their reasons."""
    store, df = ST.scratch(spark, "evaluations"), keyed(spark, sf_dir, "customer")
    for e in _evaluation_ids():
        EX.run_evaluation(e, _EVAL_EXPERIMENT, df, SPECS["customer"], store)
    done = GR.read_ledger(spark, store, "evaluations").select("evaluation_id", F.lit("done").alias("state"), F.lit("").alias("reason"))
    skipped = GR.read_ledger(spark, store, "skipped_computations").select(
        F.split("computation_id", "/")[0].alias("evaluation_id"), F.lit("skipped").alias("state"), "reason")
    failed = GR.read_ledger(spark, store, "errors").select(F.lit("").alias("evaluation_id"), F.lit("failed").alias("state"),
                                                            F.col("error_message").alias("reason"))
    return done.unionByName(skipped).unionByName(failed)


def _evaluations_sql():
    rows, seen = [], set()
    for e in _evaluation_ids():
        reason = "AR2 does not apply to a classification target." if e.startswith("AR2") else \
            GR.BASELINE_REASON.format(rate=0.1) if e.endswith("#R#S") else GR.EXISTS_REASON if e in seen else ""
        seen.add(e)
        rows.append(f"('{e}', '{'skipped' if reason else 'done'}', '{reason}')")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(evaluation_id, state, reason) WHERE (SELECT count(*) FROM customer) > 0"


register("evaluation_methods", _evaluations_sql())(q_evaluations)


# ---------------------------------------------------------------- projections, pairing, FD records, describe
from tabtaint.operators import columns as CO  # noqa: E402


def q_reattach(spark, sf_dir):
    df = keyed(spark, sf_dir, "customer")
    x, y = CO.split_x_y(df, "c_mktsegment")
    return _round_doubles(CO.concat_x_y(CO.cast_categorical(x, ["c_nationkey"]), y, df.columns))


register("reattach_target", f"""SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal,
  c_mktsegment, row_key FROM {sql_keyed('customer')}""")(q_reattach)


def q_restore(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    drifted = o.select((F.col("o_orderkey") + F.lit(0.4)).alias("o_orderkey"), (F.col("o_custkey") - F.lit(0.3)).alias("o_custkey"),
                       F.col("o_totalprice").cast("string").alias("o_totalprice"))
    return _round_doubles(CO.restore_types(drifted, o.select("o_orderkey", "o_custkey", "o_totalprice").schema))


register("restore_types", """SELECT CAST(round(o_orderkey + 0.4) AS BIGINT) AS o_orderkey, CAST(round(o_custkey - 0.3) AS BIGINT) AS o_custkey,
  round(o_totalprice, 6) AS o_totalprice FROM orders""")(q_restore)


def q_pairing(spark, sf_dir):
    """CUR5: a folder with a CSV per region and a YAML only for even region keys."""
    root = ST.scratch(spark, "datasets")
    r = load(spark, sf_dir, "region")
    for rk, name in [(x["r_regionkey"], x["r_name"]) for x in r.collect()]:   # 5 rows: the region table
        spark.createDataFrame([(name,)], "name string").write.csv(f"{root}/{name}.csv")
        if rk % 2 == 0:
            spark.createDataFrame([(f"name: {name}",)], "v string").write.text(f"{root}/{name}.yaml")
    files = spark.createDataFrame([(p,) for p in _list_dir(spark, root)], "path string")   # a directory listing
    return CO.pair_dataset_files(files)


def _list_dir(spark, root):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    return [s.getPath().toString() for s in fs.listStatus(p)]


register("curate_batch_pairing", """SELECT r_name AS stem, true AS has_data, r_regionkey % 2 = 0 AS has_meta,
  r_regionkey % 2 = 0 AS complete FROM region""")(q_pairing)


from tabtaint.plans import curation as CB  # noqa: E402


def _curated_batch(spark, sf_dir):
    """Three datasets with metadata, data without metadata, and metadata without data."""
    root, out = ST.scratch(spark, "raw-datasets"), ST.scratch(spark, "curated")
    tables = {"customer": nully_customer(spark, sf_dir), **{t: load(spark, sf_dir, t) for t in ("part", "supplier", "nation")}}
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{root}/{name}.csv")
    meta = {"customer": "name: Customer\nproblem_type: classification\ntarget_feature: c_mktsegment\ncategorical_features: [c_nationkey, c_mktsegment]",
            "part": "name: The Part\nproblem_type: regression\ntarget_feature: p_retailprice\ncategorical_features: [p_name, p_brand, p_type]",
            "supplier": "name: supplier\ncategorical_features: s_nationkey", "region": "name: region"}
    for name, text in meta.items():
        spark.createDataFrame([(text,)], "v string").coalesce(1).write.text(f"{root}/{name}.yaml")
    return CB.curate_batch(spark, _list_dir(spark, root), out), out


def q_curate_batch(spark, sf_dir):
    """CUR5: all complete datasets of a folder, curated and reported."""
    return _curated_batch(spark, sf_dir)[0]


register("curate_batch", f"""
SELECT 'customer' AS dataset, (SELECT count(*) FROM customer) AS initial_rows, 5 AS initial_columns,
  (SELECT count(*) FROM {_NULLY_CUSTOMER_SQL} t WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS final_rows,
  4 AS final_columns, 'c_name' AS dropped_columns, NULL AS error
UNION ALL SELECT 'part', count(*), 6, count(*), 6, '', NULL FROM part
UNION ALL SELECT 'supplier', count(*), 4, count(*), 4, '', NULL FROM supplier""")(q_curate_batch)


def q_curate_roles(spark, sf_dir):
    """SRC1, SRC5, SNK6, PRJ5, PRJ7: the column roles of the curated datasets, read back from their metadata."""
    return CB.roles(spark, _curated_batch(spark, sf_dir)[1])


register("curate_roles", """SELECT * FROM (VALUES
  ('customer', 'c_custkey', 'numerical'), ('customer', 'c_acctbal', 'numerical'), ('customer', 'c_nationkey', 'categorical'),
  ('customer', 'c_mktsegment', 'categorical'), ('part', 'p_partkey', 'numerical'), ('part', 'p_size', 'numerical'),
  ('part', 'p_retailprice', 'numerical'), ('part', 'p_name', 'categorical'), ('part', 'p_brand', 'categorical'),
  ('part', 'p_type', 'categorical'), ('supplier', 's_suppkey', 'numerical'), ('supplier', 's_name', 'numerical'),
  ('supplier', 's_acctbal', 'numerical'), ('supplier', 's_nationkey', 'categorical')) t(dataset, "column", sdtype)
WHERE (SELECT count(*) FROM customer) > 0""")(q_curate_roles)


def q_fd_records(spark, sf_dir):
    """JSN2: FD records of the part table written as JSON lines (plus a malformed line and a
    record of another type), parsed back."""
    fds = FD.discover(load(spark, sf_dir, "part"), FD_PART)
    import json as _json
    lines = [_json.dumps({"type": "FunctionalDependency",
                          "determinant": {"columnIdentifiers": [{"columnIdentifier": c} for c in lhs]},
                          "dependant": {"columnIdentifier": rhs}}) for lhs, rhs in fds]
    lines += ["{not json", _json.dumps({"type": "UniqueColumnCombination"})]
    path = ST.scratch(spark, "fd-records")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return CO.read_fd_records(spark, path)


register("fd_json_records", f"SELECT lhs, rhs FROM ({_sql_fd('part', FD_PART)}) z")(q_fd_records)


def q_describe(spark, sf_dir):
    """AGG12: ``describe``-style summary of the numeric order columns, exact quartiles included."""
    from tabtaint.operators.ordered import exact_quantile
    o = load(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    basic = o.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (
        ("count", F.count), ("mean", F.avg), ("stddev", F.stddev_samp), ("min", F.min), ("max", F.max))]).first()
    rows = [(n, *[float(basic[f"{n}_{c}"]) for c in cols]) for n in ("count", "mean", "stddev", "min", "max")]
    rows += [(n, *[exact_quantile(o, c, q) for c in cols]) for n, q in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))]
    return spark.createDataFrame(rows, "summary string, " + ", ".join(f"{c} double" for c in cols)).select(
        "summary", *[F.round(c, 4).alias(c) for c in cols])


def _describe_sql():
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    parts = {"count": "count({})", "mean": "avg({})", "stddev": "stddev_samp({})", "min": "min({})", "max": "max({})",
             "25%": "quantile_cont(CAST({} AS DOUBLE), 0.25)", "50%": "quantile_cont(CAST({} AS DOUBLE), 0.5)",
             "75%": "quantile_cont(CAST({} AS DOUBLE), 0.75)"}
    return " UNION ALL ".join("SELECT '" + n + "' AS summary, " + ", ".join(
        f"round(CAST({f.format(c)} AS DOUBLE), 4) AS {c}" for c in cols) + " FROM orders" for n, f in parts.items())


register("describe_summary", _describe_sql())(q_describe)


def q_synthetic_cap(spark, sf_dir):
    """SRC9 + SNK1: a synthetic table written as Parquet, read back capped at 500 rows (RND7, seed 42)."""
    path = ST.scratch(spark, "synthetic")
    syn = G.marginal(keyed(spark, sf_dir, "customer"), GEN_COLS, 1000, SEED).withColumn("row_key", F.col("draw_id").cast("string"))
    SK.write_parquet(syn, path)
    return _round_doubles(RD.read_synthetic(spark, path, max_rows=500))


register("source_synthetic_capped", f"""WITH g AS ({_gen_marginal_sql()})
SELECT draw_id, c_nationkey, c_acctbal, c_mktsegment, row_key FROM (
  SELECT *, CAST(draw_id AS VARCHAR) AS row_key, row_number() OVER (ORDER BY {sql_hash(42, 'cap', 'CAST(draw_id AS VARCHAR)')}) AS rn FROM g)
WHERE rn <= 500""")(q_synthetic_cap)


def q_ledger_roundtrip(spark, sf_dir):
    """SNK4/SNK5: experiments of seed 100 appended to a Parquet ledger, failures to the error
    ledger; the work list is the perfect grid minus both ledgers."""
    path = ST.scratch(spark, "ledger")
    g = GR.perfect_grid(_datasets(spark, sf_dir))
    done = g.where("random_seed = 100").select(
        "experiment_id", "experiment_type", "dataset_name", "random_seed", "data_perfectness", "data_error",
        F.col("error_rate").cast("string").alias("error_rate"), "generator",
        F.lit(0).cast("bigint").alias("training_size"), F.lit(0).cast("bigint").alias("synthetic_size"),
        F.lit(0.0).alias("execution_time"), F.array().cast("array<string>").alias("corrupted_rows"),
        F.array().cast("array<string>").alias("corrupted_cols"), F.lit("local").alias("execution_profile"),
        F.current_timestamp().alias("created_at"))
    GR.append_ledger(done, path, "experiments")
    failed = g.where("generator = 'great'").select(F.lit(0).cast("bigint").alias("id"), "experiment_id",
                                                  F.lit(None).cast("string").alias("file_path"),
                                                  F.lit("failed").alias("error_message"), F.lit("local").alias("execution_profile"),
                                                  F.current_timestamp().alias("created_at"))
    GR.append_ledger(failed, path, "errors")
    return GR.pending_experiments(g, GR.read_ledger(spark, path, "experiments"), GR.read_ledger(spark, path, "errors"),
                                  GR.read_ledger(spark, path, "skipped_computations"))


register("ledger_roundtrip", f"""WITH g AS ({_SQL_PERFECT})
SELECT * FROM g WHERE NOT (random_seed = 100 OR generator = 'great')""")(q_ledger_roundtrip)
