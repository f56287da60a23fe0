"""Keyed tables on Parquet: upserts, replaced partitions, appended logs, cascades."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import placed

#: Row shapes of the store's tables.
SCHEMAS = {
    "images": "image_id long, filename string, width int, height int, format string, file_size long, sha1 string, raw_id int, source_title string, source_url string, author string, license string, genus string, group_label string, segmentation string, fg_coverage double, excluded string, ingested_at timestamp",
    "feature_sets": "ordinal int, set_name string, dim int, description string, extractor_version string, metric string, layout array<struct<name:string,dim:int>>",
    "features": "image_id long, set_name string, dim int, vector array<float>",
    "feature_stats": "set_name string, key string, value array<double>",
    "indexes": "name string, kind string, meta map<string,string>, built_at timestamp",
    "image_clusters": "index_name string, image_id long, cluster_id int",
    "query_log": "query_id string, query_path string, backend string, weights map<string,double>, top_k int, results array<struct<rank:int,image_id:long,similarity:double>>, elapsed_ms double, created_at timestamp",
}


def create(spark: SparkSession, root: str, table: str) -> None:
    """Makes an empty table unless there is one."""
    spark.createDataFrame([], SCHEMAS[table]).write.mode("ignore").parquet(f"{root}/{table}")


def upsert_images(old: DataFrame, new: DataFrame, key: str = "filename", id_col: str = "image_id", now=None) -> DataFrame:
    """old with new's rows by key: values that new has replace old ones, nulls don't; ids of known keys stay; new keys get the next ids.

    A column `group` of new is group_label. ingested_at is now, unless given.
    """
    if "group" in new.columns:
        new = new.withColumnRenamed("group", "group_label")
    now = F.current_timestamp() if now is None else now
    new = new.withColumn("__given", F.col("ingested_at") if "ingested_at" in new.columns else F.lit(None).cast("timestamp"))
    fresh = new.select(*[F.col(c).alias(f"__new_{c}") for c in new.columns])
    given = lambda c: F.col(f"__new_{c}") if c in new.columns and c != id_col else F.lit(None)
    stamp = F.coalesce("__new___given", now)
    typed = lambda pick: [pick[c].cast(old.schema[c].dataType).alias(c) for c in old.columns]
    same = F.col(key) == F.col(f"__new_{key}")
    known = old.join(fresh, same, "left")
    known = known.select(*typed({c: F.coalesce(given(c), F.col(c)) for c in old.columns} | {"ingested_at": F.when(F.col(f"__new_{key}").isNull(), F.col("ingested_at")).otherwise(stamp)}))
    most = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__most"))
    added = placed(fresh.join(old.select(key), same, "left_anti"), f"__new_{key}", name="__place").crossJoin(F.broadcast(most))  # one row
    return known.unionByName(added.select(*typed({c: given(c) for c in old.columns} | {id_col: F.col("__most") + F.col("__place"), "ingested_at": stamp})))


def latest_wins(old: DataFrame, new: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """Rows by key, new before old; of several new rows that with the greatest `order`, and of equals that of least hash."""
    tie = [*([F.col(order).desc_nulls_last()] if order else []), F.xxhash64(*new.columns)]
    rows = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__age", *tie))).filter("__n = 1").drop("__n", "__age")


def replace_partition(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """old without the partitions that new has, and new."""
    return old.join(new.select(column).distinct(), column, "left_anti").unionByName(new)


def write_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replaces on disk just the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def swap(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its path: a plan never overwrites what it reads."""
    out = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return out


def append_log(log: DataFrame, path: str) -> None:
    if "query_id" not in log.columns:
        log = log.withColumn("query_id", F.expr("uuid()"))
    log.write.mode("append").parquet(path)


def cascade(dependents: DataFrame, deleted: DataFrame, key: str = "image_id") -> DataFrame:
    return dependents.join(deleted.select(key).distinct(), key, "left_anti")


def summary(images: DataFrame, features: DataFrame, clusters: DataFrame, log: DataFrame) -> DataFrame:
    """what, name, n: counts of images, features by set, clusters by index and logged queries."""
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("name"), "n")
    sets = features.groupBy("set_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("features").alias("what"), F.col("set_name").alias("name"), "n")
    parts = clusters.groupBy("index_name").agg(F.count_distinct("cluster_id").alias("n")).select(F.lit("clusters").alias("what"), F.col("index_name").alias("name"), "n")
    return one(images, "images").unionByName(sets).unionByName(parts).unionByName(one(log, "queries"))


def struct_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def rebuild(spark: SparkSession, root: str) -> None:
    """All tables empty, whatever they held."""
    for table in SCHEMAS:
        spark.createDataFrame([], SCHEMAS[table]).write.mode("overwrite").parquet(f"{root}/{table}")


def feature_sets(catalog: DataFrame) -> DataFrame:
    """Feature sets in the order they were put in; a layout that is JSON text is parsed."""
    if dict(catalog.dtypes)["layout"] == "string":
        catalog = catalog.withColumn("layout", F.from_json("layout", "array<struct<name:string,dim:int>>"))
    return catalog.orderBy("ordinal")


def size_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """table, files, bytes of the folders (or Parquet files) under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    below = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    prefix = "/" + path.split(":", 1)[-1].strip("/") + "/"
    table = F.regexp_replace(F.element_at(F.split(F.substring(below, len(prefix) + 1, 1 << 20), "/"), 1), r"\.parquet$", "")
    return files.groupBy(table.alias("table")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
