"""Candidate indexes: principal components, k-means clusters, sort-tile boxes and quadtree cells as columns."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ordering import placed

#: Components of the k-d, R-tree and quadtree backends; leaf sizes and depth; clusters.
PCA_DIMS = {"kdtree": 32, "rtree": 8, "quadtree": 2}
LEAF = 16
QUAD_CAPACITY = 8
QUAD_DEPTH = 16
KMEANS_K = 8
KMEANS_MIN_CLUSTERS = 2
#: Fits that run side by side.
FITS = 5


def fit_pca(items: DataFrame, vector: str, k: int) -> PCAModel:
    """At most k components, no more than dimensions or rows less one. Spark gathers a Gram matrix, not rows."""
    dim = items.select(F.size(vector)).first()[0]
    rows = items.count()
    v = items.select(array_to_vector(F.col(vector)).alias("v"))
    return PCA(k=max(1, min(k, dim, max(1, rows - 1))), inputCol="v", outputCol="z").fit(v)


def project(items: DataFrame, vector: str, model: PCAModel) -> DataFrame:
    """Adds z. Projections aren't centred, which leaves all distances as they are."""
    return model.setInputCol("__v").setOutputCol("__z").transform(items.withColumn("__v", array_to_vector(F.col(vector)))).withColumn("z", vector_to_array("__z")).drop("__v", "__z")


def explained(model: PCAModel, k: int) -> float:
    return float(sum(model.explainedVariance.toArray()[:k]))


def fit_kmeans(items: DataFrame, vector: str, k: int = KMEANS_K, restarts: int = 10, rounds: int = 100) -> KMeansModel:
    """The best of several seeds by cost. Seeds run side by side, as a round of one is a short job."""
    v = items.select(array_to_vector(F.col(vector)).alias("features")).cache()
    try:
        v.count()
        with ThreadPoolExecutor(FITS) as pool:
            fits = list(pool.map(lambda s: KMeans(k=k, seed=s, maxIter=rounds).fit(v), range(restarts)))
    finally:
        v.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def nearest_by_components(items: DataFrame, q: Column, n: int, dims: int, id_col: str = "image_id", z: str = "z") -> DataFrame:
    """The n items nearest in the first `dims` components: what a k-d tree, R-tree or quadtree search returns."""
    cut = lambda v: F.slice(v, 1, dims)
    return items.withColumn("z_distance", V.l2(cut(F.col(z)), cut(q))).orderBy("z_distance", id_col).limit(n)


def cluster_order(centroids: DataFrame, sizes: DataFrame, q: Column, n: int, least: int = KMEANS_MIN_CLUSTERS) -> DataFrame:
    """Clusters to visit by centroid distance until n rows and `least` clusters are in. centroids: cluster_id, center; a row per cluster."""
    by = Window.orderBy("centroid_distance", "cluster_id")
    ranked = centroids.withColumn("centroid_distance", V.l2(F.col("center"), q)).join(sizes, "cluster_id")
    ranked = ranked.withColumn("visit", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.filter((F.col("before") < n) | (F.col("visit") <= least)).select("cluster_id", "visit", "size", "before")


def visited_clusters(assigned: DataFrame, model: KMeansModel, vector: str, n: int, id_col: str = "image_id", least: int = KMEANS_MIN_CLUSTERS) -> DataFrame:
    """qid, cluster_id: cluster_order() for every row of assigned (id, vector, cluster_id)."""
    spark = assigned.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, center array<double>")
    centers = centers.join(cluster_sizes(assigned, len(model.clusterCenters())), "cluster_id")
    by = Window.partitionBy("qid").orderBy("centroid_distance", "cluster_id")
    ranked = assigned.select(F.col(id_col).alias("qid"), F.col(vector).alias("q")).crossJoin(F.broadcast(centers)).select("qid", "cluster_id", "size", V.l2(F.col("center"), F.col("q")).alias("centroid_distance"))  # a row per cluster
    ranked = ranked.withColumn("visit", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.filter((F.col("before") < n) | (F.col("visit") <= least)).select("qid", "cluster_id")


def cluster_candidates(items: DataFrame, visited: DataFrame) -> DataFrame:
    """All rows of the visited clusters; a broadcast join with a row per visited cluster (the number of clusters is a parameter)."""
    return items.join(F.broadcast(visited.select("cluster_id", "visit")), "cluster_id")


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """Rows of every cluster 0 to k - 1, empty ones too."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("size"))


def sort_tiles(items: DataFrame, dims: int, leaf: int = LEAF, id_col: str = "image_id", z: str = "z") -> DataFrame:
    """Adds tile (a string path of slab numbers): sort-tile-recursive packing, one pass of windows per axis.

    A group of n rows with g = ceil(n / leaf) leaves to fill is sorted by the axis and cut into ceil(g ** (1 / axes left))
    slabs of equal size. The first axis orders all rows, by buckets (see placed); later ones order within slabs.
    """
    df = items.withColumn("tile", F.lit("")).withColumn("__place", F.col(id_col))
    for axis in range(dims):
        n = F.col("__n")
        groups = F.ceil(n / leaf)
        slabs = F.greatest(F.lit(1), F.ceil(F.round(F.pow(groups.cast("double"), F.lit(1.0 / (dims - axis))), 9)))
        per = F.ceil(n / slabs) if axis < dims - 1 else F.lit(leaf)
        if axis == 0:
            df = placed(df, F.element_at(z, 1), "__place", name="__rank", total="__n")
        else:
            slab = Window.partitionBy("tile")
            df = df.withColumn("__n", F.count(F.lit(1)).over(slab)).withColumn("__rank", F.row_number().over(slab.orderBy(F.element_at(z, axis + 1), "__place")))
        df = df.withColumn("__per", per)
        small = F.col("__n") <= leaf
        df = df.withColumn("tile", F.when(small, F.col("tile")).otherwise(F.concat("tile", F.lit("/"), F.floor((F.col("__rank") - 1) / F.col("__per")).cast("string"))))
        df = df.withColumn("__place", F.col("__rank").cast("long"))
    return df.drop("__n", "__per", "__rank", "__place")


def tile_boxes(tiled: DataFrame, dims: int, z: str = "z") -> DataFrame:
    """tile, n, low and high corners."""
    low = F.array(*[F.min(F.element_at(z, k + 1)) for k in range(dims)])
    high = F.array(*[F.max(F.element_at(z, k + 1)) for k in range(dims)])
    return tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"))


def pruned_nearest(tiled: DataFrame, boxes: DataFrame, q: Column, n: int, dims: int, id_col: str = "image_id", z: str = "z") -> DataFrame:
    """The n nearest, reading only tiles whose box is no farther than the bound that the nearest boxes' farthest corners give."""
    far = V.norm(F.zip_with(F.zip_with("low", q, lambda lo, x: F.abs(x - lo)), F.zip_with("high", q, lambda hi, x: F.abs(x - hi)), lambda a, b: F.greatest(a, b)))
    b = boxes.withColumn("near", V.mindist(q, F.col("low"), F.col("high"))).withColumn("far", far)
    by = Window.orderBy("far", "tile")  # over n boxes, as each holds a row
    bound = b.orderBy("far", "tile").limit(n).withColumn("held", F.sum("n").over(by)).filter(F.col("held") >= n).agg(F.min("far").alias("bound"))
    some = b.join(F.broadcast(bound), F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select("tile")
    return nearest_by_components(tiled.join(some, "tile", "left_semi"), q, n, dims, id_col, z)


def tree_height(n: int, leaf: int = LEAF) -> int:
    levels, groups = 1, max(1, math.ceil(n / leaf))
    while groups > 1:
        groups, levels = math.ceil(groups / leaf), levels + 1
    return levels


def quad_cells(items: DataFrame, capacity: int = QUAD_CAPACITY, depth: int = QUAD_DEPTH, z: str = "z") -> DataFrame:
    """Adds cell (depth:x:y) of the leaf each row falls in: a cell splits while it holds more than `capacity` rows and is above `depth`.

    The root is the square of the larger extent from the lower corner. One aggregation per level over the rows still to place.
    """
    x, y = F.element_at(z, 1), F.element_at(z, 2)
    corner = items.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("side"))
    df = items.crossJoin(F.broadcast(corner))  # one row
    keys = []
    for d in range(depth + 1):
        at = lambda v, lo, d=d: F.least(F.floor((v - lo) / F.nullif(F.col("side"), F.lit(0.0)) * (1 << d)), F.lit((1 << d) - 1))
        keys.append(F.concat(F.lit(f"{d}:"), F.coalesce(at(x, F.col("x0")), F.lit(0)).cast("string"), F.lit(":"), F.coalesce(at(y, F.col("y0")), F.lit(0)).cast("string")))
    df = df.withColumn("__keys", F.array(*keys)).drop("x0", "y0", "side")
    counts = df.select(F.explode("__keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    long = df.select("*", F.posexplode("__keys").alias("d", "key")).join(counts, "key")
    names = [c for c in items.columns]
    leaf = F.min_by(F.struct(F.col("key").alias("cell"), F.col("n").alias("in_cell")), F.when((F.col("n") <= capacity) | (F.col("d") == depth), F.col("d")))
    return long.groupBy(*names).agg(leaf.alias("leaf")).select(*names, "leaf.cell", "leaf.in_cell")


def lsh_candidates(items: DataFrame, vector: str, q: list[float], n: int, bucket: float = 2.0, tables: int = 4) -> DataFrame:
    """Approximate candidates by random projections, an extra backend."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.linalg import Vectors

    v = items.withColumn("__v", array_to_vector(F.col(vector)))
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=0).fit(v)
    return model.approxNearestNeighbors(v, Vectors.dense(q), n, distCol="z_distance").drop("__v", "__h")
