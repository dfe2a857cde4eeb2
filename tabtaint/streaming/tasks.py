"""STM1: the evaluation-task stream.

Task records ``{evaluation_id, experiment_id, params}`` arrive as JSON files.  The stream
drops duplicate tasks (state keyed by the ledger's primary key), removes tasks already in
the static evaluations ledger (stream-static left anti join) and routes each micro-batch
into ``pending`` / ``done`` folders with ``foreachBatch`` (idempotent per batch id).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.session import checkpoint_dir

TASK_SCHEMA = "evaluation_id string, experiment_id string, params map<string,string>"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def task_stream(spark: SparkSession, source_dir: str, ledger: DataFrame, event_time: str | None = None,
                delay: str = "1 day") -> DataFrame:
    """Deduplicated task stream marked ``done`` / ``pending`` against the static ledger.

    Without ``event_time`` the dedup state holds one key per distinct task (bounded by the
    grid that publishes them); with it, state older than the watermark is dropped
    (``dropDuplicatesWithinWatermark``), which bounds it on an endless source.
    """
    schema = TASK_SCHEMA + (f", {event_time} timestamp" if event_time else "")
    tasks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(source_dir)
    keys = ["evaluation_id", "experiment_id"]
    dedup = (tasks.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time
             else tasks.dropDuplicates(keys))
    done = ledger.select("evaluation_id", "experiment_id").withColumn("_done", F.lit(True))
    return dedup.join(done, ["evaluation_id", "experiment_id"], "left").withColumn(
        "state", F.when(F.col("_done"), F.lit("done")).otherwise(F.lit("pending"))).drop("_done")


def run_task_stream(spark: SparkSession, source_dir: str, ledger: DataFrame, out_dir: str, ckpt_dir: str,
                    event_time: str | None = None):
    """Process everything available now; rows land in ``out_dir/batch_id=<n>/state=<state>/``, so a
    retried batch replaces what it wrote before."""
    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").partitionBy("state").parquet(f"{out_dir}/batch_id={batch_id}")
    q = (task_stream(spark, source_dir, ledger, event_time).writeStream.foreachBatch(sink)
         .option("checkpointLocation", ckpt_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
