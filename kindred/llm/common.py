"""What the operators of this package share: the scratch folder, materialised tables, small expressions."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java / RE2 class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
#: Removes the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder (URI) under the shared folder that the session names in spark.checkpoint.dir.

    Only where that is unset and the session is local, as in tests, a local temporary folder is taken.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark.sparkContext, "_kindred_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="kindred-")
            spark.sparkContext._kindred_scratch = root
    return f"{root.rstrip('/')}/kindred/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the scratch folder and reads it again: cuts lineage and survives lost executors.

    Shuffle files of the job have served once the table is written, so Spark is told to remove them then.
    """
    spark, path, schema = df.sparkSession, scratch(df.sparkSession, name), df.schema
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    out = spark.read.schema(schema).parquet(path)
    out._kindred_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df._kindred_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand Python workers so many rows at a time: for rows of long texts."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def give_back() -> None:
    """Returns to the system what this process's allocators hold but don't use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, for mapInArrow; when a task ends its Python worker, which waits for other tasks beside the JVM's work, gives memory back."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def in_workers(spark: SparkSession, act: Callable[[], None]) -> None:
    """Runs act in the Python workers: several short tasks a core, to which Spark deals idle workers in turn."""
    n = 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        act()
        yield from ()

    spark.range(0, n, 1, n).mapInArrow(run, "id long").collect()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(v) with v bound to the value once, so that lambdas inside body don't evaluate it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hex_bucket(key: Column, digits: int) -> Column:
    return F.substring(key, 1, digits)


def hex_digits(rows: int, per_bucket: int = 20_000) -> int:
    """Leading hexadecimal digits of a hash that part so many rows into buckets of about per_bucket."""
    digits = 1
    while 16**digits * per_bucket < rows and digits < 12:
        digits += 1
    return digits


def in_order(docs: DataFrame, id_col: str, text_col: str, *, descending: bool = False) -> DataFrame:
    """docs with column __doc, the row's number from 0 in the order of ids of any type, nulls last.

    Rows that share an id stand in the order of their texts' first characters, then of a hash of the text. Rows are dealt to
    tasks by range of these; a task's rows are numbered from the number of rows before it. Equal rows may be parted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    by = F.col(id_col).desc_nulls_last() if descending else F.col(id_col).asc_nulls_last()
    order = [by, F.substring(text, 1, 32), F.xxhash64(text), F.monotonically_increasing_id()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order[:3])
    rows = materialise(rows.withColumn("__at", F.monotonically_increasing_id()), "in-order", "zstd")
    part = F.shiftright(F.col("__at"), 33)
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy(part.alias("__part")).count().select("__part", before.alias("__before"))  # a row per task
    out = rows.join(F.broadcast(offsets), part == F.col("__part"))
    return out.select(*docs.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("__doc"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """doc, text with unique numbers in the order of the ids; and, unless ids are numbers already, docs with column __doc (see in_order)."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    keys = docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull())
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") and not keys.limit(1).count():
        return docs.select(F.col(id_col).cast("long").alias("doc"), text), None
    out = in_order(docs, id_col, text_col)
    return out.select(F.col("__doc").alias("doc"), text), out
