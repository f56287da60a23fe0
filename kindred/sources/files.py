"""File sources and sinks: delimited, JSON, images, text reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels

#: Row shapes of the delimited files.
RAW_MANIFEST = "raw_id int, raw_file string, commons_title string, page_url string, download_url string, orig_width int, orig_height int, author string, license string, genus string, `group` string, categories string"
MANIFEST = "image_id long, filename string, width int, height int, format string, file_size long, sha1 string, raw_id int, source_title string, source_url string, author string, license string, genus string, `group` string, orig_width int, orig_height int"


def read_csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ("categories",)) -> DataFrame:
    """A headed file with a stated schema; columns of `lists` become arrays, split at '|'."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")) for c in lists if c in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    df = df.withColumns({c: F.array_join(c, "|") for c, t in df.dtypes if t.startswith("array<")})
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str | None = None, whole_file: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", whole_file)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, pixels (rows of R, G, B bytes). Files that can't be decoded are left out; the JVM decodes."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def read_oriented(spark: SparkSession, path: str) -> DataFrame:
    """read_images with the EXIF orientation of every file, which the JVM's decoder leaves aside."""

    @F.pandas_udf("int")
    def stated(content: pd.Series) -> pd.Series:
        return content.map(lambda x: pixels.orientation(bytes(x)))

    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    raw = read_binary(spark, path).select(key("path").alias("__key"), stated("content").alias("orientation"))
    images = read_images(spark, path)
    return images.withColumn("__key", key("path")).join(raw, "__key").drop("__key")


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """path of the files that can't be decoded."""
    return spark.read.format("image").load(path).filter("image.height < 0").select(F.col("image.origin").alias("path"))


def save_upload(spark: SparkSession, data: bytes, folder: str, name: str) -> str:
    """Writes bytes that a user sent under a folder that executors share; the path."""
    out = f"{folder.rstrip('/')}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return out


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
