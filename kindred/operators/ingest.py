"""Ingestion: near-duplicate removal by hash, holdout, renumbering, category traversal."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ordering import cut, placed

#: Fixed value: hashes that differ in so many of 63 bits or fewer are near duplicates.
HAMMING = 6
MIN_IMAGES, HOLDOUT = 500, 10
HASH_BITS = 63


def _agreeing(rows: int, most: int) -> int:
    """How many blocks are compared at once: the fewest whose bits tell so many rows apart, 4 at most."""
    wanted = math.log2(max(2, rows))
    return next((c for c in (1, 2, 3) if c * HASH_BITS / (most + c) >= wanted), 4)


def near_pairs(rows: DataFrame, id_col: str, hash_col: str, most: int = HAMMING, agree: int | None = None) -> DataFrame:
    """a < b, distance of hashes within `most` bits.

    The 63 bits are parted into most + agree blocks; hashes within `most` bits agree in `agree` of them at least, so each choice of so many is
    a key. Unless given, `agree` grows with the number of rows, so that a key holds few; whatever it is, all pairs are found. Equal
    hashes are one hash until its partners are known. Rows without a hash have no pair.
    """
    known = rows.filter(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    firsts = known.select("h").distinct()
    agree = agree or _agreeing(firsts.count(), most)
    edges = [HASH_BITS * i // (most + agree) for i in range(most + agree + 1)]
    block = lambda i: F.shiftrightunsigned(F.col("h"), edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long"))
    choices = rows.sparkSession.createDataFrame([(k, list(c)) for k, c in enumerate(itertools.combinations(range(1, most + agree + 1), agree))], "choice int, some array<int>")
    blocks = firsts.select("h", F.array(*[block(i) for i in range(most + agree)]).alias("blocks"))
    value = F.xxhash64(F.transform("some", lambda i: F.element_at("blocks", i)))
    long = blocks.crossJoin(F.broadcast(choices)).select("h", "choice", value.alias("value"))  # rows by parameters alone
    x, y = long.withColumnRenamed("h", "hx"), long.withColumnRenamed("h", "hy")
    near = x.join(y, ["choice", "value"]).filter((F.col("hx") < F.col("hy")) & (V.hamming(F.col("hx"), F.col("hy")) <= most)).select("hx", "hy").distinct()
    linked = near.unionByName(firsts.select(F.col("h").alias("hx"), F.col("h").alias("hy")))
    one, two = known.select(F.col("id").alias("i"), F.col("h").alias("hx")), known.select(F.col("id").alias("j"), F.col("h").alias("hy"))
    pairs = linked.join(one, "hx").join(two, "hy").filter((F.col("hx") != F.col("hy")) | (F.col("i") < F.col("j")))
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), V.hamming(F.col("hx"), F.col("hy")).cast("int").alias("distance"))


def greedy_dedup(rows: DataFrame, id_col: str, hash_col: str, most: int = HAMMING) -> DataFrame:
    """Rows kept by first come, first kept in the order of ids: a row goes if a kept one before it is near.

    Rows without a hash stay. Equal hashes collapse to their first row beforehand. Then rounds decide every row whose earlier neighbours are all decided: kept
    if none of them is kept. Each round decides the first open row at least; rounds are as many as the longest chain, and each is
    written to the checkpoint folder.
    """
    firsts = rows.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias(id_col))
    pairs = cut(near_pairs(firsts, id_col, hash_col, most))
    state = cut(pairs.select(F.col("b").alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while state.filter("kept is null").limit(1).count():
        seen = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka"), F.lit(True).alias("later")), "a", "left")
        # rows with no earlier neighbour are kept from the start
        ka = F.when(F.col("later").isNull(), F.lit(True)).otherwise(F.col("ka"))
        verdict = seen.groupBy("b").agg(F.max(F.coalesce(ka, F.lit(False))).alias("any_kept"), F.max(ka.isNull()).alias("open"))
        state = cut(state.join(verdict, F.col("id") == F.col("b")).select("id", F.coalesce("kept", F.when(F.col("any_kept"), F.lit(False)).when(~F.col("open"), F.lit(True))).alias("kept")))
    gone = state.filter("not kept").select(F.col("id").alias(id_col))
    kept = rows.join(firsts.select(id_col), id_col, "left_semi").join(gone, id_col, "left_anti")
    return kept.unionByName(rows.filter(F.col(hash_col).isNull()))


def holdout_pick(rows: DataFrame, n: int, order_col: str, labelled) -> DataFrame:
    """n labelled rows evenly spaced in order: places floor(i * (m - 1) / (n - 1))."""
    few = placed(rows.filter(labelled), order_col, name="place").withColumn("place", F.col("place") - 1)
    m = rows.filter(labelled).agg(F.count(F.lit(1)).alias("m"))
    picks = few.sparkSession.range(n).crossJoin(F.broadcast(m)).select(F.floor(F.col("id") * (F.col("m") - 1) / max(1, n - 1)).alias("place")).distinct()
    return few.join(F.broadcast(picks), "place", "left_semi")  # n rows


def split_holdout(rows: DataFrame, n: int, order_col: str, labelled, least: int = MIN_IMAGES) -> tuple[DataFrame, DataFrame]:
    """(kept, held): n labelled rows evenly spaced in order are held, unless fewer than `least` would stay or fewer than n have a label.

    Both get image_id from 1 in order and filename, tree_%04d.jpg or query_%02d.jpg.
    """
    enough = rows.agg(((F.count(F.lit(1)) - n >= least) & (F.count_if(labelled) >= n)).alias("__enough"))  # one row
    held = holdout_pick(rows, n, order_col, labelled).drop("place").crossJoin(F.broadcast(enough)).filter("__enough").drop("__enough")
    kept = rows.join(F.broadcast(held.select(order_col)), order_col, "left_anti").select(*rows.columns)  # n rows
    return renumber(kept, order_col, "image_id", "filename", "tree_%04d.jpg"), renumber(held, order_col, "image_id", "filename", "query_%02d.jpg")


def renumber(rows: DataFrame, order_col: str, id_col: str, name_col: str, pattern: str) -> DataFrame:
    """Numbers from 1 in order and names by a printf pattern."""
    return placed(rows, order_col, name=id_col).withColumn(id_col, F.col(id_col).cast("int")).withColumn(name_col, F.format_string(pattern, F.col(id_col)))


def crawl(edges: DataFrame, seeds: list[tuple[str, int]], bad: str | None = None) -> DataFrame:
    """node, left: what is reached from seeds (name, depth) along edges parent, child, with the most depth left.

    A level-by-level traversal: rounds are bounded by the largest depth; categories whose lower-cased names match `bad` are not entered, seeds
    neither. Where a category is reached in several ways the greatest depth counts, whatever the order of seeds.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame(seeds, "node string, left int")
    if bad:
        start = start.filter(~F.lower("node").rlike(bad))
    reached = start.groupBy("node").agg(F.max("left").alias("left"))
    frontier = reached
    for _ in range(max([d for _, d in seeds], default=0)):
        step = frontier.filter("left > 0").join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), (F.col("left") - 1).alias("left"))
        if bad:
            step = step.filter(~F.lower("node").rlike(bad))
        frontier = step.groupBy("node").agg(F.max("left").alias("left"))
        reached = reached.unionByName(frontier).groupBy("node").agg(F.max("left").alias("left"))
    return reached
