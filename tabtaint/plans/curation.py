"""CUR5: curation of all datasets of a folder, with their metadata (SRC1, SRC5, SNK6, PRJ5, PRJ7).

A dataset is a data file and a YAML file of the same stem.  Each is read, given its column roles, curated
by distributed jobs and written; what comes out is one report row a dataset, in the result and as JSON
beside the tables.  Datasets are independent: a few are worked on at a time, and one that fails
leaves its message instead of its counts.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.operators import clean as CL
from tabtaint.operators import columns as CO
from tabtaint.sources import readers as RD
from tabtaint.sources import sinks as SK
from tabtaint.spec import TableSpec, infer_spec, sdtype_table

REPORT = ("dataset string, initial_rows long, initial_columns long, final_rows long, final_columns long, "
          "dropped_columns string, error string")
AT_A_TIME = 4


def read_dataset(spark: SparkSession, data_path: str, meta_path: str) -> tuple[DataFrame, TableSpec]:
    """A CSV file with the roles that its metadata gives; a single categorical column may be a plain name."""
    meta = RD.read_yaml_metadata(spark, meta_path)
    df = RD.read_csv(spark, data_path)
    cats = meta.get("categorical_features")
    cats = [cats] if isinstance(cats, str) else cats
    return df, infer_spec(df, meta["name"], meta.get("target_feature"), cats, meta.get("problem_type") or "classification")


def curate_batch(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Curates every complete dataset among ``paths`` into ``out/<name>``; ``out/metadata`` gets their metadata
    rows and ``out/reports`` the reports."""
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    stems = [r["stem"] for r in CO.pair_dataset_files(listing).where("complete").collect()]   # one row a dataset
    place = {p.rsplit("/", 1)[-1]: p for p in paths}

    def one(stem: str) -> tuple[tuple, TableSpec | None]:
        try:
            df, spec = read_dataset(spark, place[f"{stem}.csv"], place[f"{stem}.yaml"])
            curated, kept, dropped = CL.curate(df, spec)
            folder = spark.range(1).select(SK.safe_table_name(F.lit(spec.name))).first()[0]
            curated.write.mode("overwrite").parquet(f"{out}/{folder}")
            done = spark.read.parquet(f"{out}/{folder}")
            return (stem, df.count(), len(df.columns), done.count(), len(done.columns), ",".join(dropped), None), kept
        except Exception as e:  # noqa: BLE001 — the failure is the dataset's report, the batch goes on
            return (stem, None, None, None, None, None, str(e)), None

    with ThreadPoolExecutor(max_workers=AT_A_TIME) as pool:
        found = list(pool.map(one, sorted(stems)))
    report = spark.createDataFrame([r for r, _ in found], REPORT)
    SK.metadata_rows(spark, {r[0]: s for r, s in found if s is not None}).write.mode("overwrite").parquet(f"{out}/metadata")
    SK.write_json(report, f"{out}/reports")
    return report


def roles(spark: SparkSession, out: str) -> DataFrame:
    """``dataset, column, sdtype`` of the curated datasets, from their stored metadata."""
    meta = spark.read.schema("dataset string, key string, value string").parquet(f"{out}/metadata")
    table = None
    for dataset, spec in sorted(RD.specs_from_metadata(meta).items()):   # one spec a dataset
        folder = spark.range(1).select(SK.safe_table_name(F.lit(spec.name))).first()[0]
        df = spark.read.parquet(f"{out}/{folder}")
        own = infer_spec(df, spec.name, spec.target, list(spec.categorical), spec.problem_type)
        part = sdtype_table(spark, own).select(F.lit(dataset).alias("dataset"), "column", "sdtype")
        table = part if table is None else table.unionByName(part)
    return table
