"""Request change feed -> newly approved requests, each linked once.

A stateful operator (``transformWithState``, RocksDB state store) keeps two values for each request id: the latest change
(by time, then sequence number) and whether the request was linked. After the changes of a micro-batch, an id whose latest status is
approved and that was not linked is emitted and its flag set, all in one state version: a batch that is run again
after a failure starts from the same state and emits the same ids. Nothing that earlier batches linked is read again. The state of an
id is dropped ``retention`` after its last change, by an event-time timer, so the store holds the active ids only; a change that comes
later than ``lateness`` behind the newest one is dropped by the watermark.

``foreachBatch`` joins the emitted ids with the requests and writes the task rows and link records into a folder named by the batch id,
with overwrite, so a replayed batch rewrites the same folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matforge.operators.requests import request_task_rows
from matforge.session import path_exists

FEED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()),
])
TASK_SCHEMA = "id bigint, MasterItemNo string, ItemDescription string, QtyShipped bigint, needed_by_date string, batch_id bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long after its last change a request's state is kept, and how far a change may be behind the newest one.
RETENTION_DAYS, LATENESS = 365, "30 days"
_DAY_MS = 86_400_000


class LinkOnce(StatefulProcessor):
    """Emits an id when its latest status is approved for the first time."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms long, seq long, status string")
        self.linked = handle.getValueState("linked", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.latest.get()
        ms, seq, status = old if old is not None else (None, None, None)
        for pdf in rows:
            top = pdf.sort_values(["ms", "seq", "status"]).iloc[-1]
            if ms is None or (int(top["ms"]), int(top["seq"])) >= (ms, seq):
                ms, seq, status = int(top["ms"]), int(top["seq"]), top["status"]
        if old is None or (ms, seq, status) != tuple(old):
            if old is not None:
                self.handle.deleteTimer(old[0] + self.retention_ms)
            self.latest.update((ms, seq, status))
            self.handle.registerTimer(ms + self.retention_ms)
        if status is not None and status.strip().lower() == "approved" and not self.linked.exists():
            self.linked.update((ms,))
            yield pd.DataFrame({"id": [key[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        self.linked.clear()
        return iter(())

    def close(self) -> None:
        pass


def newly_approved(feed: DataFrame, retention_days: float = RETENTION_DAYS, lateness: str = LATENESS) -> DataFrame:
    """Stream of ids (one column ``id``), each when its latest status first is approved. Changes without an id or a time are left out."""
    timed = feed.where(F.col("id").isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    held = timed.select("id", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("status", F.lit("")).alias("status"))
    return held.groupBy("id").transformWithStateInPandas(LinkOnce(int(retention_days * _DAY_MS)), outputStructType="id bigint", outputMode="Update", timeMode="EventTime")


def link_batch(requests: DataFrame, root: str):
    """foreachBatch body: newly approved ids -> task rows + link records, one folder per batch, overwritten as a whole."""

    def run(ids: DataFrame, batch_id: int) -> None:
        rows = request_task_rows(requests.join(ids, "id", "left_semi")).persist()
        rows.write.mode("overwrite").parquet(f"{root}/tasks/batch_id={batch_id}")
        rows.select("id").write.mode("overwrite").parquet(f"{root}/links/batch_id={batch_id}")
        rows.unpersist()

    return run


def run_request_stream(spark: SparkSession, feed_dir: str, requests: DataFrame, root: str, max_files_per_trigger: int | None = None,
                       retention_days: float = RETENTION_DAYS, lateness: str = LATENESS, state_partitions: int | None = None) -> DataFrame:
    """Process every file in ``feed_dir`` that earlier runs have not (availableNow) and return all linked task rows.

    The state is dealt to ``state_partitions`` stores (default: the session's shuffle partitions) when the stream first runs; later runs keep it.
    """
    reader = spark.readStream.schema(FEED_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ids = newly_approved(reader.parquet(feed_dir), retention_days, lateness)
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = (ids.writeStream.outputMode("update").option("checkpointLocation", f"{root}/_checkpoint")
             .foreachBatch(link_batch(requests, root)).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if not path_exists(spark, f"{root}/tasks"):  # no batch has run yet
        return spark.createDataFrame([], TASK_SCHEMA)
    return spark.read.schema(TASK_SCHEMA).parquet(f"{root}/tasks")
