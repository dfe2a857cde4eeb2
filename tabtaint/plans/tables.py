"""Test-table loading and the TableSpecs used by the query catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabtaint.session import stored
from tabtaint.spec import TableSpec, with_row_key

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
        "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id",
        "embeddings": "vec_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id"}

SPECS = {
    "customer": TableSpec("customer", target="c_mktsegment", categorical=("c_nationkey", "c_mktsegment"),
                          numeric=("c_acctbal",)),
    "part": TableSpec("part", target=None, categorical=("p_name", "p_brand", "p_type"),
                      numeric=("p_size", "p_retailprice")),
    "orders": TableSpec("orders", target="o_totalprice", problem_type="regression",
                        categorical=("o_orderstatus", "o_orderpriority"), numeric=("o_custkey",)),
    "lineitem": TableSpec("lineitem", target="l_returnflag",
                          categorical=("l_returnflag", "l_linestatus"),
                          numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "supplier": TableSpec("supplier", categorical=("s_nationkey",), numeric=("s_acctbal",)),
    "events": TableSpec("events", target="event_type", categorical=("event_type",), numeric=("value", "user_id")),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; an input that arrives in fewer splits than the cluster has cores (one
    row group per test file) is spread round-robin, so hashing and per-row work use every
    core.  On a large table (thousands of splits) this is a no-op."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores and name in SPREAD:
        df = df.repartition(cores)
    return df


SPREAD = {"lineitem", "orders", "events", "documents", "pages", "conversations", "embeddings"}


def keyed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table with its ``row_key`` (declared key, or content hash for ``lineitem``).

    A content-hash key is a derived table: it is written once, as Parquet in the shared folder, so that the
    several jobs of an operator read the columns they need instead of hashing every row again.
    """
    if name in KEYS:
        return with_row_key(load(spark, sf_dir, name), KEYS[name])
    return stored(with_row_key(load(spark, sf_dir, name)), f"keyed-{name}")


def sql_keyed(name: str) -> str:
    """DuckDB twin of :func:`keyed` (a subquery)."""
    from tabtaint.spec import sql_content_key
    if name in KEYS:
        return f"(SELECT *, CAST({KEYS[name]} AS VARCHAR) AS row_key FROM {name})"
    cols = LINEITEM_COLS if name == "lineitem" else None
    return f"(SELECT *, {sql_content_key(cols)} AS row_key FROM {name})"


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
