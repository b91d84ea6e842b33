"""Incremental ingestion: session logs as they arrive, captured once each; the index follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import provenance as pv
from ..sources.store import Store


def stream_capture(store: Store, folder: str, checkpoint: str, now: int, distill: bool = False, index: bool = True) -> StreamingQuery:
    """Every file that arrives in a folder is captured. A batch that runs twice adds nothing: ids depend on the session alone, and the
    batch is the request under which it is written, so its records and entries are those of its first attempt.

    index: after each batch the store's index gets a version with the batch's records.
    """
    files = store.spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def batch(rows: DataFrame, n: int) -> None:
        if not store.capture(rows, now, distill, request=f"{checkpoint}/{n}").isEmpty() and index:
            store.index()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_logs(events: DataFrame, by: str, root: str, checkpoint: str) -> StreamingQuery:
    """A stream of events becomes the records of their logs (`provenance.chained`), a segment below root for each batch.

    The tails are the stream's state, so a batch reads no record of earlier ones; one that runs again starts from the same tails and
    writes the same segment in place of its own.
    """
    spark = events.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={n}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return pv.chained(events, by).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, with state for a bounded time only: for logs that repeat soon or never."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
