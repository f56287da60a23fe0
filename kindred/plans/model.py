"""The retrieval model laid over the embeddings table, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.space import SET_METRIC, FeatureSpace

#: Places of the sets in a vector, 0-based offset and dimension, and the blocks of the first.
SLICES = {"color": (0, 24), "shape": (24, 16), "texture": (40, 12), "deep": (52, 12)}
LAYOUT = {"color": [("hsv_fg", 8), ("hsv_grid", 8), ("hsv_cum", 4), ("moments", 4)]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = V.doubles(F.col("embedding"))
    return e.select(
        F.col("vec_id").alias("image_id"), "label", F.concat(F.lit("g"), "label").alias("genus"), F.when(F.col("label") < 7, "broadleaf").otherwise("conifer").alias("group_label"),
        F.concat(F.lit("L"), (F.col("vec_id") % 4).cast("string")).alias("license"), F.concat(F.lit("a"), (F.col("vec_id") % 25).cast("string")).alias("author"),
        *[V.block(v, o, d).alias(s) for s, (o, d) in SLICES.items()],
    )


def pairs(rows: DataFrame) -> DataFrame:
    """Pairs by rule: each id with (31 id + 7) modulo the number of rows, unless that is itself."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("image_id").alias("a")).crossJoin(F.broadcast(n)).select("a", ((F.col("a") * 31 + 7) % F.col("n")).alias("b")).filter("a <> b")


def space(spark: SparkSession, sf_dir: str, *, fit: bool = True, sets: tuple[str, ...] = tuple(SLICES), weights: dict | None = None) -> FeatureSpace:
    rows = items(spark, sf_dir)
    out = FeatureSpace(rows, {s: SET_METRIC[s] for s in sets}, layout=LAYOUT, weights=weights or {})
    if not fit:
        return out
    key = (spark.sparkContext.applicationId, sets, *version(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _FITTED:
        fitted = out.fit(pairs(rows))
        _FITTED[key] = fitted.stats, fitted.scales
    out.stats, out.scales = _FITTED[key]
    return out


#: Statistics and scales of the tables that this process has fitted, by session, sets and version of the table: they don't depend on weights.
_FITTED: dict[tuple, tuple[dict, dict]] = {}


def version(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """A table's path, bytes and time of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    files = fs.listStatus(where) if status.isDirectory() else [status]
    return path, sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def query_of(rows: DataFrame, image_id: int) -> dict[str, list[float]]:
    got = rows.filter(F.col("image_id") == image_id).select(*SLICES).first()
    return {s: list(got[s]) for s in SLICES}


# The same as SQL.

BASE = """f AS (SELECT vec_id AS image_id, label, 'g' || label AS genus, CASE WHEN label < 7 THEN 'broadleaf' ELSE 'conifer' END AS group_label,
  'L' || (vec_id % 4) AS license, 'a' || (vec_id % 25) AS author, (embedding::DOUBLE[])[1:24] AS color, (embedding::DOUBLE[])[25:40] AS shape,
  (embedding::DOUBLE[])[41:52] AS texture, (embedding::DOUBLE[])[53:64] AS deep FROM embeddings)"""


def sql_distance(metric: str, a: str, b: str) -> str:
    if metric == "l1":
        return f"list_sum(list_transform({a}, lambda x, i: abs(x - {b}[i])))"
    if metric == "l2":
        return f"list_distance({a}, {b})"
    return f"(1 - list_inner_product({a}, {b}) / ((sqrt(list_inner_product({a}, {a})) + 1e-8) * (sqrt(list_inner_product({b}, {b})) + 1e-8)))"


def sql_stats(s: str, dim: int, source: str = "f", name: str | None = None) -> str:
    return f"""st_{name or s} AS (SELECT list(m ORDER BY d) AS m, list(s ORDER BY d) AS s FROM (
  SELECT d, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0::DOUBLE ELSE stddev_pop(v) END AS s
  FROM (SELECT unnest(range(1, {dim + 1})) AS d, unnest({s}) AS v FROM {source}) GROUP BY d))"""


def sql_z(s: str, name: str | None = None) -> str:
    return f"list_transform({s}, lambda x, i: (x - (SELECT m FROM st_{name or s})[i]) / (SELECT s FROM st_{name or s})[i])"


PREPARED = f"""{BASE}, {sql_stats("shape", 16)}, {sql_stats("texture", 12)},
p AS (SELECT f.image_id, f.label, f.genus, f.group_label, f.license, f.author, f.color, f.deep,
  list_transform(f.shape, lambda x, i: (x - a.m[i]) / a.s[i]) AS shape, list_transform(f.texture, lambda x, i: (x - b.m[i]) / b.s[i]) AS texture
  FROM f, st_shape a, st_texture b)"""

_RAW = {s: sql_distance(SET_METRIC[s], f"x.{s}", f"y.{s}") for s in SLICES}
SCALED = f"""{PREPARED}, pr AS (SELECT image_id AS a, (image_id * 31 + 7) % (SELECT count(*) FROM f) AS b FROM f),
sc AS (SELECT {", ".join(f"greatest(avg({_RAW[s]}), 1e-8) AS {s}" for s in SLICES)}
  FROM pr JOIN p x ON x.image_id = pr.a JOIN p y ON y.image_id = pr.b WHERE a <> b)"""

WEIGHTS = {"color": 0.30, "shape": 0.25, "texture": 0.20, "deep": 0.25}


def sql_combined(x: str = "x", y: str = "y", weights: dict[str, float] | None = None) -> str:
    return " + ".join(f"{w}::DOUBLE * {sql_distance(SET_METRIC[s], f'{x}.{s}', f'{y}.{s}')} / sc.{s}" for s, w in (weights or WEIGHTS).items())


def nearest(weights: dict[str, float] | None = None) -> str:
    """Combined distances of all ordered pairs, and each row's nearest others."""
    return f"""{SCALED}, pw AS (SELECT x.image_id AS qid, y.image_id AS id, {sql_combined("y", "x", weights)} AS distance
  FROM p x, p y, sc WHERE x.image_id <> y.image_id),
nn AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM pw QUALIFY rank <= 5)"""


NEAREST = nearest()
