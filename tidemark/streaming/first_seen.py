"""Incremental folds and append-only ingest with Structured Streaming; both resume from their checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.tables import scratch, table


def first_seen(stream: DataFrame, keys: list[str], ts: str, path: str) -> DataFrame:
    """(keys, first_seen, last_seen, n) over all that ever arrived, after what is available now.

    ``path`` holds the checkpoint and a table for each batch with the keys that it changed; a batch
    that is run again after a failure overwrites its own table. State is one row for each
    key, of which a batch writes those it changed. Without any input the result is empty.
    """
    spark = stream.sparkSession
    fold = stream.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("n"))
    spark.createDataFrame([], fold.schema).write.mode("ignore").parquet(f"{path}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = fold.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.groupBy(*keys).agg(F.max(F.struct("batch", "first_seen", "last_seen", "n")).alias("b")).select(*keys, "b.first_seen", "b.last_seen", "b.n")


def append_new(stream: DataFrame, key: str, path: str, ts: str | None = None, delay: str = "7 days") -> DataFrame:
    """All rows ingested so far below ``path``: the first of each key; rows once written are never edited.

    With ``ts`` (a timestamp) a key is remembered for ``delay`` only, enough for reading
    windows that overlap; without it every key is remembered.
    """
    spark = stream.sparkSession
    new = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts else stream.dropDuplicates([key])
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/rows/batch=-1")
    query = new.writeStream.outputMode("append").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    ).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch=*")


def streaming_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """First and last use of each event type by each user, folded from a file stream."""
    schema = table(spark, sf, "events").schema
    # as a pattern: a stream takes a plain path for a folder, and the table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parque[t]")
    return first_seen(stream, ["user_id", "event_type"], "ts", scratch(spark, "first-seen"))


STREAMING = "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1, 2"

QUERIES = {"streaming_first_seen": (streaming_first_seen, STREAMING)}
