"""Streams: rows upserted as they come, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(path)


def upsert_stream(rows: DataFrame, root: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Keeps root's newest version as the latest row of each key. A batch that runs again writes the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        if number:
            new = store.latest_wins(spark.read.parquet(f"{root}/v-{number - 1}"), new, *keys)
        new.write.mode("overwrite").parquet(f"{root}/v-{number}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sums of value by event-time window; state older than `late` is let go."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, length), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), by, "n", "value")
