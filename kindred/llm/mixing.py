"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are taken in the order of their
keys: the key's leading digits range-partition the source into buckets, totals of the buckets give
each bucket's offset, and a running sum within a bucket gives the document's place in the source's
stream of words. A source's budget is cut out of that stream exactly: whole epochs first, then its
beginning. A source that holds most of the rows is spread over as many buckets as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hex_bucket, hex_digits, materialise, n_words, numbered, read

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, total. Adds target: `share` of all totals dealt by weight, none above `most` times its total.

    Weights are repeated over the sources by code point, null last. Sources are put in the order of cap over
    weight; the running level shows where capping ends, which is the fixed point of dealing the excess again
    and again. A row per source only, so the unpartitioned windows are as long as the list of sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", weight.cast("long")).withColumn("cap", (F.col("total") * most).cast("long")).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    by = Window.orderBy("ratio", "n")
    whole = Window.partitionBy()
    level = (F.sum("total").over(whole).cast("double") * share - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    line = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole)
    target = F.when((F.col("ratio") <= F.col("level")) | line.isNull(), F.col("cap").cast("double")).otherwise(F.col("w") * line)
    return ranked.withColumn("target", target).select("source", "total", "target")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Null texts have size 0, null sources are a source of their own, null ids are one id; rows that repeat
    an id count each. No rows: no rows. Runs agree, as keys depend on the id, the text and the seed alone.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"))
    base = materialise(base, "mix")
    digits = hex_digits(base.count())
    base = base.withColumn("sk", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("bucket", hex_bucket(F.col("key"), digits))
    buckets = base.groupBy("sk", "source", "bucket").agg(F.sum("size").alias("in_bucket"))
    offset = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(base.groupBy("sk", "source").agg(F.sum("size").alias("total")).select("source", "total"), weights, share, most)
    targets = targets.withColumn("sk", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    buckets = buckets.withColumn("offset", offset).join(targets, "sk").select("sk", "bucket", "offset", "total", "target")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("total") > 0, F.expr("floor(target) div total")).otherwise(F.lit(0))
    placed = base.join(buckets, ["sk", "bucket"]).withColumn("at", F.col("offset") + before).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("total"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return placed.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each epoch of a document; the one document of a source that its
    budget cuts through ends after its last taken word. Rows that take no words are not in the mix; documents without
    words have nothing to take and stay as they are. Rows that repeat an id, or have none, are planned each.
    """
    columns = docs.columns
    _, own = numbered(docs, id_col, text_col)
    if own is not None:
        docs, id_col = own, "__doc"
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = plan.groupBy(F.col("doc_id").alias("__id")).agg(F.max("size").alias("__size"), F.max("taken").alias("__taken"))
    rows = docs.join(plan, F.col(id_col).eqNullSafe(F.col("__id")))
    epochs = F.when(F.col("__size") > 0, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumn("__epochs", epochs).filter("__epochs > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__epochs"))))
    left = F.col("__taken") - (F.col("__epoch") - 1) * F.col("__size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left.cast("int")), "")
    whole = (F.col("__size") == 0) | (left >= F.col("__size"))
    rows = rows.withColumn("__text", F.when(whole, F.col(text_col)).otherwise(cut))
    return rows.select(*[F.col("__text").alias(c) if c == text_col else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, [3, 1, 2][((n - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * total AS cap FROM r),
x AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, ((sum(total) OVER ())::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(w) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM x),
t AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS line FROM l),
g AS (SELECT source, total, CASE WHEN ratio <= level OR line IS NULL THEN cap::DOUBLE ELSE w * line END AS target FROM t),
p AS (SELECT doc_id, size, g.total, g.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target)::BIGINT // total ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, total AS source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * total - pos)))::BIGINT AS taken
FROM e
"""
