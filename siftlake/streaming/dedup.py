"""Structured Streaming: one state for all workers, so the same value is a duplicate wherever it arrives.

`distinct` keeps values for ever, `within` for as long as the watermark says, and `leading` for a time to live that starts at the first sight
and isn't extended. Which of equal rows in one micro-batch leads is defined where an order column is given: the least.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DedupConfig
from ..functions import text as T
from ..operators.dedup import number as ranked
from ..operators.dedup import value


def source(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A folder's files as they come; a single file is read from its folder by its name."""
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(path)


def create(spark: SparkSession, data, cfg: DedupConfig, schema=None) -> DataFrame:
    """A deduplicated stream from a streaming DataFrame, a path, or a function that gives one of these."""
    made = data() if callable(data) else data
    if isinstance(made, str):
        made = source(spark, made, schema)
    if not isinstance(made, DataFrame) or not made.isStreaming:
        raise TypeError("not a streaming DataFrame, nor a path or a function that gives one")
    return distinct(made, cfg)


def distinct(stream: DataFrame, cfg: DedupConfig) -> DataFrame:
    return stream.withColumn("object_id", T.object_id(value(cfg))).dropDuplicates(["object_id"])


def within(stream: DataFrame, cfg: DedupConfig, time_column: str, delay: str) -> DataFrame:
    """State is bounded: a value may come again once the watermark has passed it."""
    return stream.withWatermark(time_column, delay).withColumn("object_id", T.object_id(value(cfg))).dropDuplicatesWithinWatermark(["object_id"])


def leading(stream: DataFrame, cfg: DedupConfig, ttl_ms: int = 0) -> DataFrame:
    """(object_id, first, seen): for each batch and value the least order value, and whether it is new; state is written once, at first sight."""

    def fold(key: tuple, rows, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        first = min(int(pdf["o"].min()) for pdf in rows)
        new = not state.exists
        if new:
            state.update((first,))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"object_id": [key[0]], "first": [state.get[0]], "seen": [not new]})

    keyed = stream.select(T.object_id(value(cfg)).alias("object_id"), F.col(cfg.order_column).cast("bigint").alias("o"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return keyed.groupBy("object_id").applyInPandasWithState(fold, "object_id string, first bigint, seen boolean", "first bigint", "update", timeout)


def write_chunks(stream: DataFrame, cfg: DedupConfig, path: str, checkpoint: str, size: int = 10_000, on_chunk: Callable[[DataFrame, int], None] | None = None):
    """Kept rows in Parquet by chunk of exactly so many, in order of the order column within their micro-batch; only a batch's last chunk may be shorter.

    A batch that is run again overwrites its own folder, so each row is written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = ranked(batch, cfg.order_column, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size))
        rows.write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/batch={number}")
        if on_chunk:
            on_chunk(batch, number)

    return distinct(stream, cfg).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Reads all that there is, writes it in Parquet and ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
