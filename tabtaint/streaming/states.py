"""STM1: the life of an evaluation task as a stateful stream.

Events ``{evaluation_id, experiment_id, event}`` arrive as JSON files, in any order and more than once.  Each
task has one state: ``pending`` once it is published, then ``skipped``, ``failed`` or ``finished``.  The
state of the highest rank that an event has named counts, so neither the order of events nor a replayed
batch changes the outcome.  With a ``timeout`` a task that stays pending so long (processing time, a
timer in the state store) is ``failed``.  A changed state is a row of the micro-batch, and
lands in the batch's folder by state; a retried batch replaces its folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "evaluation_id string, experiment_id string, event string"
CHANGE_SCHEMA = "evaluation_id string, experiment_id string, state string, place int"
#: Events with the state that each one names, from the lowest rank to the highest.
STATES = {"published": "pending", "skipped": "skipped", "failed": "failed", "finished": "finished"}
KEYS = ["evaluation_id", "experiment_id"]


class TaskStates(StatefulProcessor):
    def __init__(self, timeout_ms: int | None = None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "place int")

    def _changed(self, key, place: int) -> pd.DataFrame:
        self.place.update((place,))
        return pd.DataFrame([(*key, list(STATES.values())[place], place)], columns=[*KEYS, "state", "place"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = list(STATES)
        seen = max((names.index(e) for pdf in rows for e in pdf["event"] if e in STATES), default=-1)
        now = self.place.get()[0] if self.place.exists() else -1
        if seen > now:
            if self.timeout_ms is not None and seen == 0:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            yield self._changed(key, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.place.exists() and self.place.get()[0] == 0:
            yield self._changed(key, list(STATES).index("failed"))

    def close(self) -> None:
        pass


def state_changes(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Changes of state of a stream of events."""
    return events.groupBy(*KEYS).transformWithStateInPandas(
        TaskStates(timeout_ms), CHANGE_SCHEMA, "Update", "None" if timeout_ms is None else "ProcessingTime")


def run_task_states(spark: SparkSession, source_dir: str, out_dir: str, ckpt_dir: str, timeout_ms: int | None = None,
                    files_per_batch: int = 64, seconds: float | None = None):
    """Takes in all events there are (or, with ``seconds``, runs so long); changes land in
    ``out_dir/batch_id=<n>/state=<state>/``.  The state store keeps a row for each task; it needs the
    RocksDB provider, set for this query alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source_dir)

        def sink(batch: DataFrame, batch_id: int):
            batch.write.mode("overwrite").partitionBy("state").parquet(f"{out_dir}/batch_id={batch_id}")

        writer = state_changes(events, timeout_ms).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt_dir)
        q = (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime="1 second")).start()
        if seconds is None:
            q.awaitTermination()
        else:
            q.awaitTermination(seconds)
            q.stop()
        return q
    finally:
        spark.conf.set(name, before)


def current_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """Each task's state from the changes of all batches."""
    changes = spark.read.schema(f"{CHANGE_SCHEMA}, batch_id long").parquet(out_dir)
    return changes.groupBy(*KEYS).agg(F.max_by("state", "place").alias("state"))
