"""Fitted spaces and candidate indexes kept on disk, so that a query fits nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import index, store
from .space import FeatureSpace


def save_space(space: FeatureSpace, root: str) -> None:
    """Appends a version of feature_stats: mean and std of every set and its scale."""
    rows = [(s, k, v) for s in space.sets for k, v in [*space.stats[s].items(), ("scale", [space.scales[s]])]]
    store.swap(space.items.sparkSession.createDataFrame(rows, store.SCHEMAS["feature_stats"]), f"{root}/feature_stats")


def load_space(items: DataFrame, metrics: dict[str, str], path: str, weights: dict[str, float] | None = None, id_col: str = "image_id", layout=None) -> FeatureSpace:
    """The space of items with the statistics and scales of the table at path; a set that the table lacks is an error."""
    got = {(r["set_name"], r["key"]): list(r["value"]) for r in items.sparkSession.read.parquet(path).collect()}  # a row per set and key
    out = FeatureSpace(items, metrics, id_col, layout or {}, weights or {})
    if absent := [s for s in out.sets if (s, "scale") not in got]:
        raise ValueError(f"no statistics of {', '.join(absent)}")
    out.stats = {s: {k: got[s, k] for k in ("mean", "std")} for s in out.sets}
    out.scales = {s: max(got[s, "scale"][0], V.EPS) for s in out.sets}
    return out


def put_index(spark: SparkSession, root: str, name: str, kind: str, meta: dict[str, object], data: DataFrame) -> None:
    """Writes an index's rows as a new version and what is known of it as a row of `indexes`; the latest row of a name counts."""
    path = store.swap(data, f"{root}/index_{name}")
    texts = {k: str(v) for k, v in meta.items()} | {"path": path}
    row = spark.createDataFrame([(name, kind, texts)], "name string, kind string, meta map<string,string>").withColumn("built_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{root}/indexes")


def get_index(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows and what is known of an index; a name without one is an error."""
    row = spark.read.schema(store.SCHEMAS["indexes"]).parquet(f"{root}/indexes").filter(F.col("name") == name).orderBy(F.desc("built_at")).first()
    if row is None:
        raise KeyError(name)
    return spark.read.parquet(row["meta"]["path"]), row["meta"] | {"kind": row["kind"]}


def build_indexes(space: FeatureSpace, root: str, k: int = index.KMEANS_K, dims: int = index.PCA_DIMS["kdtree"]) -> dict[str, dict[str, object]]:
    """Components (k-d tree, R-tree, quadtree), tiles, cells and clusters over the weighted embedding, written below root; what is known of each."""
    spark = space.items.sparkSession
    rows = space.items.select(space.id_col, space.embedding().alias("v"))
    pca = index.fit_pca(rows, "v", dims)
    found, common = pca.getK(), {"sets": ",".join(space.sets), "weights": space.weights}
    z = index.project(rows, "v", pca).select(space.id_col, "z")
    n = space.items.count()
    metas: dict[str, dict[str, object]] = {}
    for kind, most in index.PCA_DIMS.items():
        d = min(most, dims, found)
        metas[kind] = common | {"pca_dim": d, "explained_variance": index.explained(pca, d), "n": n}
        own = z.select(space.id_col, F.slice("z", 1, d).alias("z"))
        if kind == "rtree":
            own = index.sort_tiles(own, d, id_col=space.id_col)
            metas[kind]["height"] = index.tree_height(n)
        elif kind == "quadtree" and d == 2:
            own = index.quad_cells(own)
        put_index(spark, root, f"pca_{kind}", kind, metas[kind], own)
    model = index.fit_kmeans(rows, "v", min(k, n))
    assigned = model.transform(rows.withColumn("features", index.array_to_vector(F.col("v")))).select(F.lit("kmeans").alias("index_name"), space.id_col, F.col("prediction").alias("cluster_id"))
    metas["kmeans"] = common | {"k": len(model.clusterCenters()), "inertia": float(model.summary.trainingCost), "sizes": list(model.summary.clusterSizes), "n": n}
    put_index(spark, root, "kmeans", "kmeans", metas["kmeans"], assigned)
    return metas
