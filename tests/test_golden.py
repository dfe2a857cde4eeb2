"""(e) the null report's arithmetic: 1,078,695 nulls in a 76,000 x 171 table is 8.30%,
with 75,244 rows holding at least one null."""

from pyspark.sql import functions as F

from tabtaint.operators.profile import column_null_profile, null_profile


def test_null_report_arithmetic(spark):
    rows, cols, nulls, rows_any = 76_000, 171, 1_078_695, 75_244
    rest = nulls - rows_any                       # column 0 is null on every "any-null" row
    per, last = divmod(rest, cols - 1)
    counts = [rows_any] + [per] * (cols - 2) + [per + last]
    assert sum(counts) == nulls and max(counts) <= rows_any
    base = spark.range(rows)
    df = base.select(*[F.when(F.col("id") < n, F.lit(None)).otherwise(F.col("id").cast("double")).alias(f"c{i}")
                       for i, n in enumerate(counts)])
    r = null_profile(df, "APSFailure").first()
    assert (r["n_rows"], r["n_columns"], r["n_cells"], r["n_nulls"], r["rows_with_nulls"]) == \
        (rows, cols, rows * cols, nulls, rows_any)
    assert round(r["null_pct"], 2) == 8.30
    per_col = column_null_profile(df)
    assert per_col.count() == cols and per_col.agg(F.sum("null_count")).first()[0] == nulls
