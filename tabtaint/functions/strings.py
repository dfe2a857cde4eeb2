"""String functions: typo variants (STR1-STR3), id codecs (STR4-STR6), FD text (STR9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabtaint.functions.rng import hash_hex, sql_hash, sql_uniform_of, uniform_of

NULL_MARKER = "NULL"


def typo(value: Column, seed, tag: str) -> Column:
    """One typo variant per distinct value: doubled, missing or swapped letter.

    The variant and the position are hash draws on (seed, tag, value), so every copy of a
    value gets the same typo without a value table or a join.  Non-strings are cast to
    string; a swap on fewer than 2 letters doubles a letter instead; '' stays ''.
    """
    v = value.cast("string")
    n = F.char_length(v)
    kind = F.floor(uniform_of(hash_hex(seed, tag + ":kind", v)) * 3)
    u = uniform_of(hash_hex(seed, tag + ":pos", v))
    p = F.floor(u * n).cast("int")                     # 0-based letter index
    s = F.floor(u * (n - 1)).cast("int")               # 0-based left index of the swap
    one = F.lit(1)
    doubled = F.concat(_sub(v, one, p), _sub(v, p + 1, one), _sub(v, p + 1, one), _tail(v, p + 2))
    missing = F.concat(_sub(v, one, p), _tail(v, p + 2))
    swapped = F.concat(_sub(v, one, s), _sub(v, s + 2, one), _sub(v, s + 1, one), _tail(v, s + 3))
    return (F.when(v.isNull(), v)
            .when(n == 0, v)
            .when(kind == 0, doubled)
            .when(kind == 1, missing)
            .when(n < 2, doubled)
            .otherwise(swapped))


def _sub(v: Column, start: Column, length: Column) -> Column:
    """1-based substring with column start/length."""
    return F.call_function("substr", v, start, length)


def _tail(v: Column, start: Column) -> Column:
    """substring from 1-based ``start`` to the end (empty past the end)."""
    return F.when(start > F.char_length(v), F.lit("")).otherwise(F.call_function("substr", v, start))


def sql_typo(v_sql: str, seed, tag: str) -> str:
    """DuckDB twin of :func:`typo`."""
    v = f"CAST({v_sql} AS VARCHAR)"
    n = f"length({v})"
    kind = f"floor({sql_uniform_of(sql_hash(seed, tag + ':kind', v))} * 3)"
    u = sql_uniform_of(sql_hash(seed, tag + ':pos', v))
    p = f"CAST(floor({u} * {n}) AS INTEGER)"
    s = f"CAST(floor({u} * ({n} - 1)) AS INTEGER)"

    def tail(start):
        return f"(CASE WHEN {start} > {n} THEN '' ELSE substr({v}, {start}) END)"

    doubled = f"(substr({v}, 1, {p}) || substr({v}, {p} + 1, 1) || substr({v}, {p} + 1, 1) || {tail(f'{p} + 2')})"
    missing = f"(substr({v}, 1, {p}) || {tail(f'{p} + 2')})"
    swapped = (f"(substr({v}, 1, {s}) || substr({v}, {s} + 2, 1) || substr({v}, {s} + 1, 1) || "
               f"{tail(f'{s} + 3')})")
    return (f"(CASE WHEN {v} IS NULL THEN NULL WHEN {n} = 0 THEN {v} WHEN {kind} = 0 THEN {doubled} "
            f"WHEN {kind} = 1 THEN {missing} WHEN {n} < 2 THEN {doubled} ELSE {swapped} END)")


# ---------------- experiment / evaluation ids (STR4-STR6) ----------------

EXPERIMENT_PARTS = ["experiment_type", "dataset_name", "random_seed", "data_perfectness",
                    "data_error", "error_rate", "generator"]
EVALUATION_PARTS = ["method", "first_target", "second_target"]


def rate_percent(rate: Column) -> Column:
    """Error rate -> integer percent (rounded; the reference truncates, Q15)."""
    return F.round(rate.cast("double") * 100).cast("int")


def experiment_id(experiment_type, dataset, seed, perfectness, error, rate, generator) -> Column:
    """STR4: ``type#dataset#seed#perfectness#error#ratePercent#generator``, NULL marker for absent parts."""
    parts = [experiment_type, dataset, seed.cast("string"), perfectness, error,
             rate_percent(rate).cast("string"), generator]
    return F.concat_ws("#", *[F.coalesce(p.cast("string"), F.lit(NULL_MARKER)) for p in parts])


def decode_experiment_id(eid: Column) -> list[Column]:
    """STR5: id -> typed columns (NULL marker -> null, rate percent -> fraction)."""
    s = F.split(eid, "#")
    cols = []
    for i, name in enumerate(EXPERIMENT_PARTS):
        raw = F.nullif(s.getItem(i), F.lit(NULL_MARKER))
        if name == "random_seed":
            raw = raw.cast("bigint")
        elif name == "error_rate":
            raw = (raw.cast("int") / F.lit(100.0))
        cols.append(raw.alias(name))
    return cols


def evaluation_id(method, first, second) -> Column:
    """STR6 encode: ``method#target1#target2``."""
    return F.concat_ws("#", *[F.coalesce(p.cast("string"), F.lit(NULL_MARKER)) for p in (method, first, second)])


def decode_evaluation_id(eid: Column) -> list[Column]:
    s = F.split(eid, "#")
    return [F.nullif(s.getItem(i), F.lit(NULL_MARKER)).alias(n) for i, n in enumerate(EVALUATION_PARTS)]


def fd_text(lhs: Column, rhs: Column) -> Column:
    """STR9: ``A,B -> C``."""
    return F.concat(F.concat_ws(",", lhs), F.lit(" -> "), rhs)
