"""Sharding by bytes: contiguous, balanced shards from global prefix sums.

Documents stand in one global order in which equal texts are neighbours. The order is dealt out to buckets; totals of the
buckets give each bucket's offset, in two levels, so that no task sums up all of them; a running sum within a bucket
gives the document's byte position, and equal targets of bytes cut the order into shards. Equal texts stay in one
shard unless together they are larger than the largest single document; such large groups are cut between rows, since kept whole they
would leave the shards' bytes unequal. Groups of many rows are dealt to buckets of their own by a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hex_bucket, hex_digits, materialise, read

SHARDS = 8
#: Equal texts in a bucket, about, where a large group is dealt to several.
GROUP = 1000


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (place in the shard).

    A document, or a group of equal texts no larger than the largest document, goes where the middle of its
    bytes falls, so a shard differs from the target by one such unit at most. Null texts count as empty ones;
    rows that repeat an id, or have none, count each. No rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("tkey"))
    base = materialise(base, "shard")
    rows, most, total = base.agg(F.count(F.lit(1)), F.max("size"), F.sum("size")).first()
    digits = hex_digits(rows or 0)
    groups = base.groupBy("tkey").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    large = groups.filter(F.col("bytes") > F.lit(most or 0)).select("tkey", F.ceil(F.col("n") / GROUP).alias("parts"))
    base = base.join(large, "tkey", "left").withColumn("small", F.col("parts").isNull())
    # a group of many rows has a stretch of the order to itself
    own = F.coalesce(F.col("parts") > 1, F.lit(False))
    base = base.withColumn("heavy", own).withColumn("b1", F.when(own, F.col("tkey")).otherwise(hex_bucket(F.col("tkey"), digits)))
    base = base.withColumn("dkey", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")))).withColumn("b2", F.when(own, F.pmod("dkey", F.col("parts"))).otherwise(F.lit(0).cast("long"))).drop("parts")
    places = ["heavy", "b1", "b2"]
    buckets = base.groupBy(*places).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # runs of buckets: half of the leading digits, or a heavy group
    buckets = buckets.withColumn("run", F.when(F.col("heavy"), F.col("b1")).otherwise(F.substring("b1", 1, (digits + 1) // 2)))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = buckets.groupBy("heavy", "run").agg(F.sum("bytes").alias("run_bytes"), F.sum("rows").alias("run_rows"))
    sums = lambda name, w: F.coalesce(F.sum(name).over(up_to(w)), F.lit(0))
    outer, inner = Window.orderBy("heavy", "run"), Window.partitionBy("heavy", "run").orderBy("b1", "b2")
    runs = runs.select("heavy", "run", sums("run_bytes", outer).alias("run_bytes"), sums("run_rows", outer).alias("run_rows"))
    buckets = buckets.join(runs, ["heavy", "run"])
    buckets = buckets.select(*places, (F.col("run_bytes") + sums("bytes", inner)).alias("bytes_before"), (F.col("run_rows") + sums("rows", inner)).alias("rows_before"))
    own = Window.partitionBy(*places).orderBy("tkey", "dkey", "doc_id", "size")
    placed = base.join(buckets, places).withColumn("row", F.col("rows_before") + F.row_number().over(own) - 1)
    placed = placed.withColumn("start", F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    group = Window.partitionBy(*places, "tkey")
    low = F.when(F.col("small"), F.min("start").over(group)).otherwise(F.col("start"))
    high = F.when(F.col("small"), F.max(F.col("start") + F.col("size")).over(group)).otherwise(F.col("start") + F.col("size"))
    shard = F.expr(f"((low + high) * {n_shards}) div {2 * (total or 1)}")
    placed = placed.withColumn("low", low).withColumn("high", high).withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))
