"""Structured Streaming flows: windows over late events, insert-if-absent ingestion, the request limiter as keyed state.

A flow is a streaming DataFrame; `drained` runs one over what lies in its source now and returns the result as a table.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumine.operators import chunking, state
from vellumine.session import shared_folder


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A table's files as a stream, `files` to a batch."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # a stream's path must be a folder


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the flow makes of its source's present content; each batch is committed once, through the checkpoint."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, n: int) -> None:  # complete mode: the last batch holds everything
        batch.write.mode("overwrite").parquet(f"{root}/out/{n:06d}")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{last:06d}")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by type in tumbling windows; events later than `late` are dropped once state has moved on."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "events")


def ingest(pages: DataFrame) -> Callable[[str, str], DataFrame]:
    """A runner (table path, checkpoint path) -> table: page batches become chunks, inserted if their id is not there yet.

    A batch writes a partition of its own, batch=N, and looks for known ids in earlier batches' partitions only: one run
    again after a failure finds what it found the first time and replaces its own output with the same.
    """

    def run(path: str, log: str) -> DataFrame:
        spark = pages.sparkSession

        def take(batch: DataFrame, n: int) -> None:
            fresh = chunking.chunks(batch)
            if n > 0:
                try:
                    earlier = spark.read.parquet(path).where(F.col("batch") < n)  # the partition filter: no later folder is read
                    fresh = state.not_indexed(fresh, earlier)
                except Exception as e:
                    if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                        raise
            fresh.write.mode("overwrite").parquet(f"{path}/batch={n}")

        pages.writeStream.foreachBatch(take).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(path).drop("batch")

    return run


def limited(calls: DataFrame, limit: int = 60, window: float = 60.0, late: str = "1 day") -> DataFrame:
    """Calls (client, ident, at as seconds) with `allowed`: the sliding log of admitted calls as state of each client.

    Event time is the column ts, which has its watermark already, or else `at`, with calls up to `late` out of order.

    Within a batch calls go in time order, admitted by the same rule as state.admitted.  A client's state is at most `limit`
    times, cut to the window at its next call, and dropped once the watermark is a window past its last call.
    """
    most = max(1, limit)
    if "ts" not in calls.columns:
        calls = calls.withColumn("ts", (F.col("at") + 1).cast("timestamp")).withWatermark("ts", late)  # a watermark begins at 0

    def admit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], log: GroupState) -> Iterator[pd.DataFrame]:
        if log.hasTimedOut:
            log.remove()
            return
        held = deque(log.get[0]) if log.exists else deque()
        rows = pd.concat([b[["at", "ident"]] for b in batches]).sort_values(["at", "ident"])
        allowed = [state.admitted(held, at, most, window) for at in rows["at"]]
        log.update((list(held),))
        log.setTimeoutTimestamp(max(int((rows["at"].max() + window) * 1000), log.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "ident": rows["ident"], "allowed": allowed})

    return calls.groupBy("client").applyInPandasWithState(admit, "client string, ident long, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_calls(calls: DataFrame, ident: str, at: str, late: str = "30 days") -> DataFrame:
    """Each redelivered call once, as long as it comes again within `late` of event time; older ids leave the state."""
    return calls.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])
