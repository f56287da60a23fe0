"""Named queries over the test tables, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ingest_rules as rules
from ..functions import vectors as V
from ..operators import analysis, evaluate, feedback, index, ingest, search, store
from ..operators.ordering import cut, placed
from ..operators.space import SET_METRIC, FeatureSpace
from . import model as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
R = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rnd(c: str) -> F.Column:
    return F.round(F.col(c), R).alias(c)


# Scans, lookups and counts.


@query("scan_by_set", f"WITH {M.BASE} SELECT image_id, d::INT AS dim, value FROM (SELECT image_id, unnest(range(1, 25)) AS d, unnest(color) AS value FROM f)")
def scan_by_set(spark, d):
    return M.items(spark, d).select("image_id", F.posexplode("color").alias("p", "value")).select("image_id", (F.col("p") + 1).alias("dim"), "value")


@query("point_lookup", f"WITH {M.BASE} SELECT image_id, genus, license, author FROM f WHERE image_id = 7")
def point_lookup(spark, d):
    return M.items(spark, d).filter("image_id = 7").select("image_id", "genus", "license", "author")


@query("in_list_lookup", f"WITH {M.BASE} SELECT image_id, genus FROM f WHERE image_id IN (3, 5, 8, 13, 99999999)")
def in_list_lookup(spark, d):
    return M.items(spark, d).filter(F.col("image_id").isin(3, 5, 8, 13, 99999999)).select("image_id", "genus")


@query("count_images", "SELECT count(*) AS n FROM embeddings")
def count_images(spark, d):
    return M.items(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("store_summary", """SELECT 'images' AS what, '' AS name, count(*) AS n FROM embeddings
UNION ALL SELECT 'features', s, count(*) FROM embeddings, (VALUES ('color'), ('shape'), ('texture'), ('deep')) t(s) GROUP BY s
UNION ALL SELECT 'clusters', 'by_label', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'queries', '', count(*) FROM events""")
def store_summary(spark, d):
    rows = M.items(spark, d)
    features = rows.select("image_id", F.explode(F.array(*map(F.lit, M.SLICES))).alias("set_name"))
    clusters = rows.select(F.lit("by_label").alias("index_name"), "image_id", F.col("label").alias("cluster_id"))
    return store.summary(rows, features, clusters, M.table(spark, d, "events"))


@query("filter_metadata", f"WITH {M.BASE} SELECT image_id, genus, license FROM f WHERE genus IN ('g1', 'g4') AND license IN ('L0', 'L3')")
def filter_metadata(spark, d):
    return M.items(spark, d).filter(search.matches({"genus": ["g1", "g4"], "license": ["L0", "L3"], "group_label": []})).select("image_id", "genus", "license")


@query("filter_values", f"WITH {M.BASE} SELECT DISTINCT genus FROM f WHERE genus <> ''")
def filter_values(spark, d):
    return search.filter_values(M.items(spark, d), "genus")


@query("exclude_ids", f"WITH {M.BASE} SELECT image_id FROM f WHERE image_id % 10 <> 0")
def exclude_ids(spark, d):
    rows = M.items(spark, d).select("image_id")
    return rows.join(rows.filter("image_id % 10 = 0"), "image_id", "left_anti")


@query("block_projection", f"WITH {M.BASE}, b AS (SELECT image_id, color[1:8] AS a, color[9:16] AS b, color[17:20] AS c, color[21:24] AS d FROM f) SELECT image_id, round(list_sum(a), 6) AS hsv_fg, round(list_sum(b), 6) AS hsv_grid, round(list_sum(c), 6) AS hsv_cum, round(list_sum(d), 6) AS moments FROM b")
def block_projection(spark, d):
    out, at = [F.col("image_id")], 0
    for name, dim in M.LAYOUT["color"]:
        out.append(F.round(V.total(V.block(F.col("color"), at, dim)), R).alias(name))
        at += dim
    return M.items(spark, d).select(*out)


@query("feature_lookup", f"WITH {M.BASE} SELECT d::INT AS dim, round(v, 6) AS value FROM (SELECT unnest(range(1, 17)) AS d, unnest(shape) AS v FROM f WHERE image_id = 7)")
def feature_lookup(spark, d):
    """A vector by image and set."""
    rows = M.items(spark, d).select("image_id", F.inline(F.array(*[F.struct(F.lit(s).alias("set_name"), F.col(s).alias("vector")) for s in M.SLICES])))
    return rows.filter("image_id = 7 and set_name = 'shape'").select(F.posexplode("vector").alias("p", "value")).select((F.col("p") + 1).alias("dim"), rnd("value"))


@query("cluster_lookup", "SELECT vec_id AS image_id, label AS cluster_id FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 7)")
def cluster_lookup(spark, d):
    """The cluster of an image and its members."""
    rows = M.items(spark, d).select("image_id", F.col("label").alias("cluster_id"))
    own = rows.filter("image_id = 7").select("cluster_id")
    return rows.join(F.broadcast(own), "cluster_id", "left_semi").select("image_id", "cluster_id")  # one row


@query("feature_catalog", " UNION ALL ".join(f"SELECT {i} AS ordinal, '{s}' AS set_name, {n} AS dim, '{b}' AS block, {k} AS block_dim" for i, (s, (_, n)) in enumerate(M.SLICES.items()) for b, k in M.LAYOUT.get(s, [(s, n)])))
def feature_catalog(spark, d):
    """The feature sets in the order they were put in, a row per block of their layouts."""
    rows = [(i, s, n, json.dumps([{"name": b, "dim": k} for b, k in M.LAYOUT.get(s, [(s, n)])])) for i, (s, (_, n)) in enumerate(M.SLICES.items())]
    sets = store.feature_sets(spark.createDataFrame(rows[::-1], "ordinal int, set_name string, dim int, layout string"))
    return sets.select("ordinal", "set_name", "dim", F.explode("layout").alias("b")).select("ordinal", "set_name", "dim", F.col("b.name").alias("block"), F.col("b.dim").alias("block_dim"))


@query("seeded_sample", f"WITH {M.BASE} SELECT image_id, genus FROM f ORDER BY md5('42:' || image_id), image_id LIMIT 30")
def seeded_sample(spark, d):
    return search.pick_rows(M.items(spark, d).select("image_id", "genus"), "image_id", 30)


@query("figure_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, greatest(1, count(*) OVER () // 5) AS step FROM labels) WHERE place % step = 0 AND place < 5 * step")
def figure_rows(spark, d):
    return search.every_step(M.table(spark, d, "labels").select("doc_id"), "doc_id")


# Distances and statistics.


def _one_distance(metric: str, s: str) -> None:
    sql = f"WITH {M.BASE} SELECT y.image_id, round({M.sql_distance(metric, f'y.{s}', f'x.{s}')}, 6) AS d FROM f x, f y WHERE x.image_id = 7"

    @query(f"dist_{metric}", sql)
    def run(spark, d):
        rows = M.items(spark, d)
        q = V.literal(M.query_of(rows, 7)[s])
        return rows.select("image_id", F.round(V.distance(metric, F.col(s), q), R).alias("d"))


_one_distance("l1", "color")
_one_distance("l2", "shape")
_one_distance("cosine", "deep")


@query("stats_mean_std", f"""WITH {M.BASE}, u AS ({" UNION ALL ".join(f"SELECT '{s}' AS set_name, unnest(range(1, {n + 1})) AS dim, unnest({s}) AS v FROM f" for s, (_, n) in M.SLICES.items())})
SELECT set_name, dim::INT AS dim, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END, 6) AS std FROM u GROUP BY set_name, dim""")
def stats_mean_std(spark, d):
    return M.space(spark, d, fit=False).mean_std().select("set_name", "dim", rnd("mean"), rnd("std"))


@query("stats_scale_pairs", f"WITH {M.SCALED} SELECT {', '.join(f'round({s}, 6) AS {s}' for s in M.SLICES)} FROM sc")
def stats_scale_pairs(spark, d):
    space = M.space(spark, d)
    return space.pair_scales(M.pairs(space.items)).select(*[rnd(s) for s in M.SLICES])


@query("weights_normalized", "SELECT * FROM (VALUES ('color', 1.0::DOUBLE), ('shape', 0.0)) t(set_name, weight)")
def weights_normalized(spark, d):
    w = FeatureSpace(M.items(spark, d), {"color": "l1", "shape": "l2", "absent": "l2"}, weights={"color": 3.0}).weights
    return spark.createDataFrame(list(w.items()), "set_name string, weight double")


@query("embed_concat_norm", f"""WITH {M.SCALED} SELECT image_id, round(sqrt(0.3 / (sc.color * sc.color) * list_inner_product(p.color, p.color) + 0.25 / (sc.shape * sc.shape) * list_inner_product(p.shape, p.shape)
 + 0.2 / (sc.texture * sc.texture) * list_inner_product(p.texture, p.texture) + 0.25 / (sc.deep * sc.deep) * list_inner_product(p.deep, p.deep) / power(sqrt(list_inner_product(p.deep, p.deep)) + 1e-8, 2)), 6) AS norm FROM p, sc""")
def embed_concat_norm(spark, d):
    space = M.space(spark, d)
    return space.items.select("image_id", F.round(V.norm(space.embedding()), R).alias("norm"))


# Search.


_TOP = "SELECT row_number() OVER (ORDER BY round(distance, 9), image_id)::INT AS rank, image_id, genus, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM t ORDER BY rank LIMIT 5"


@query("combined_topk", f"WITH {M.SCALED}, t AS (SELECT y.image_id, y.genus, {M.sql_combined('y', 'x')} AS distance FROM p x, p y, sc WHERE x.image_id = 7 AND y.image_id <> 7) {_TOP}")
def combined_topk(spark, d):
    space = M.space(spark, d)
    return search.top_k(space, M.query_of(space.items, 7), exclude=[7]).select("rank", "image_id", "genus", rnd("distance"), rnd("similarity"))


@query("reranked_topk", f"""WITH {M.SCALED}, c AS (SELECT y.image_id FROM f x, f y WHERE x.image_id = 7 ORDER BY round(list_distance(y.deep[1:8], x.deep[1:8]), 9), y.image_id LIMIT 60),
t AS (SELECT y.image_id, y.genus, {M.sql_combined('y', 'x')} AS distance FROM p x, p y, sc WHERE x.image_id = 7 AND y.image_id <> 7 AND y.image_id IN (SELECT image_id FROM c)) {_TOP}""")
def reranked_topk(spark, d):
    """An index's candidates ranked by the combined distance."""
    space = M.space(spark, d)
    asked = M.query_of(space.items, 7)
    found = index.nearest_by_components(space.items, V.literal(asked["deep"]), 60, 8, z="deep")
    return search.top_k(space, asked, exclude=[7], candidates=found).select("rank", "image_id", "genus", rnd("distance"), rnd("similarity"))


@query("filtered_topk", f"WITH {M.SCALED}, t AS (SELECT y.image_id, y.genus, {M.sql_combined('y', 'x')} AS distance FROM p x, p y, sc WHERE x.image_id = 7 AND y.image_id <> 7 AND y.license IN ('L1', 'L2') AND y.group_label = 'conifer') {_TOP}")
def filtered_topk(spark, d):
    space = M.space(spark, d)
    out = search.top_k(space, M.query_of(space.items, 7), filters={"license": ["L1", "L2"], "group_label": ["conifer"]}, exclude=[7])
    return out.select("rank", "image_id", "genus", rnd("distance"), rnd("similarity"))


@query("per_set_contrib", f"""WITH {M.SCALED}, t AS (SELECT y.*, {M.sql_combined('y', 'x')} AS distance, {', '.join(f"{M.sql_distance(SET_METRIC[s], f'y.{s}', f'x.{s}')} AS raw_{s}" for s in M.SLICES)} FROM p x, p y, sc WHERE x.image_id = 7 AND y.image_id <> 7),
k AS (SELECT *, row_number() OVER (ORDER BY round(distance, 9), image_id)::INT AS rank FROM t QUALIFY rank <= 5)
{' UNION ALL '.join(f"SELECT rank, image_id, '{s}' AS set_name, round(raw_{s}, 6) AS raw, round(raw_{s} / sc.{s}, 6) AS norm, {w}::DOUBLE AS weight, round({w} * raw_{s} / sc.{s}, 6) AS contrib FROM k, sc" for s, w in M.WEIGHTS.items())}""")
def per_set_contrib(spark, d):
    space = M.space(spark, d)
    rows = search.per_set(space, search.top_k(space, M.query_of(space.items, 7), exclude=[7]))
    return rows.select("rank", "image_id", "set_name", rnd("raw"), rnd("norm"), F.round("weight", R).alias("weight"), rnd("contrib"))


def leave_one_out(spark: SparkSession, d: str, **options) -> tuple[FeatureSpace, DataFrame]:
    space = M.space(spark, d, **options)
    return space, search.batch_top_k(space, space.items.withColumnRenamed("image_id", "qid"))


@query("leave_one_out_topk", f"WITH {M.NEAREST} SELECT qid, rank::INT AS rank, id, round(distance, 6) AS distance FROM nn")
def leave_one_out_topk(spark, d):
    return leave_one_out(spark, d)[1].select("qid", "rank", "id", rnd("distance"))


for _n in (12, 8, 2):

    def _knn(n: int) -> None:
        sql = f"""WITH {M.BASE}, t AS (SELECT y.image_id, list_distance(y.deep[1:{n}], x.deep[1:{n}]) AS z FROM f x, f y WHERE x.image_id = 7)
SELECT image_id, round(z, 6) AS z_distance FROM t ORDER BY round(z, 9), image_id LIMIT 60"""

        @query(f"knn_slice{n}", sql)
        def run(spark, d):
            rows = M.items(spark, d)
            q = V.literal(M.query_of(rows, 7)["deep"])
            return index.nearest_by_components(rows, q, 60, n, z="deep").select("image_id", rnd("z_distance"))

    _knn(_n)


_CENTERS = "c AS (SELECT label AS cluster_id, count(*) AS size, list(m ORDER BY k) AS center FROM (SELECT label, k, avg(v) AS m FROM (SELECT label, unnest(range(1, 13)) AS k, unnest(deep) AS v FROM f) GROUP BY label, k) JOIN (SELECT label, image_id FROM f) USING (label) GROUP BY label)"


def _centers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    long = rows.select(F.col("label").alias("cluster_id"), F.posexplode("deep").alias("k", "v")).groupBy("cluster_id", "k").agg(F.avg("v").alias("m"))
    centers = long.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("x")).select("cluster_id", F.transform("x", lambda e: e["m"]).alias("center"))
    return centers, index.cluster_sizes(rows.withColumnRenamed("label", "cluster_id"), 10)


@query("kmeans_candidates_fixed", f"""WITH {M.BASE}, m AS (SELECT label, k, avg(v) AS m FROM (SELECT label, unnest(range(1, 13)) AS k, unnest(deep) AS v FROM f) GROUP BY label, k),
c AS (SELECT label AS cluster_id, list(m ORDER BY k) AS center FROM m GROUP BY label), z AS (SELECT label AS cluster_id, count(*) AS size FROM f GROUP BY label),
o AS (SELECT cluster_id, size, list_distance(center, (SELECT deep FROM f WHERE image_id = 7)) AS cd FROM c JOIN z USING (cluster_id)),
v AS (SELECT cluster_id, size, row_number() OVER (ORDER BY cd, cluster_id) AS visit, coalesce(sum(size) OVER (ORDER BY cd, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT f.image_id, v.visit::INT AS visit FROM f JOIN v ON f.label = v.cluster_id WHERE before < 60 OR visit <= 2""")
def kmeans_candidates_fixed(spark, d):
    rows = M.items(spark, d)
    centers, sizes = _centers(rows)
    q = V.literal(M.query_of(rows, 7)["deep"])
    visited = index.cluster_order(centers, sizes, q, 60)
    return index.cluster_candidates(rows.withColumnRenamed("label", "cluster_id"), visited).select("image_id", "visit")


@query("cluster_sizes", "SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return _centers(M.items(spark, d))[1]


@query("widened_pool", f"""WITH {M.BASE}, t AS (SELECT y.image_id, y.license, y.genus, row_number() OVER (ORDER BY round(list_distance(y.deep[1:2], x.deep[1:2]), 9), y.image_id) AS rank FROM f x, f y WHERE x.image_id = 7),
h AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM t WHERE genus = 'g3' AND license = 'L1' AND image_id <> 7),
b AS (SELECT max(rank) AS last, count(*) AS n FROM h WHERE k <= 6),
s AS (SELECT CASE WHEN n < 6 THEN NULL ELSE 61 * power(2, greatest(0, ceil(log2(last / 61.0)))) END AS pool FROM b)
SELECT image_id, rank::INT AS rank FROM h, s WHERE pool IS NULL OR rank <= pool""")
def widened_pool(spark, d):
    rows = M.items(spark, d)
    q = V.literal(M.query_of(rows, 7)["deep"])
    cut = lambda v: F.slice(v, 1, 2)
    ranked = placed(rows, F.round(V.l2(cut(F.col("deep")), cut(q)), 9), "image_id", name="rank").withColumn("rank", F.col("rank").cast("int"))
    passes = search.matches({"genus": ["g3"], "license": ["L1"]}) & (F.col("image_id") != 7)
    return search.widened_pool(ranked, passes, 5, 1).select("image_id", "rank")


@query("str_tiles", """WITH b AS (SELECT vec_id AS image_id, embedding[53]::DOUBLE AS x, embedding[54]::DOUBLE AS y FROM embeddings),
s AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY x, image_id) AS rx FROM b),
t AS (SELECT *, ceil(n / ceil(round(sqrt(ceil(n / 16.0)), 9)))::BIGINT AS per FROM s),
u AS (SELECT *, (rx - 1) // per AS slab FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY y, rx) AS ry FROM u)
SELECT image_id, '/' || slab || '/' || ((ry - 1) // 16) AS tile FROM v""")
def str_tiles(spark, d):
    return index.sort_tiles(M.items(spark, d), 2, z="deep").select("image_id", "tile")


@query("tile_mbr", """WITH b AS (SELECT vec_id AS image_id, embedding[53]::DOUBLE AS x, embedding[54]::DOUBLE AS y FROM embeddings),
s AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY x, image_id) AS rx FROM b),
u AS (SELECT *, (rx - 1) // ceil(n / ceil(round(sqrt(ceil(n / 16.0)), 9)))::BIGINT AS slab FROM s),
v AS (SELECT *, '/' || slab || '/' || ((row_number() OVER (PARTITION BY slab ORDER BY y, rx) - 1) // 16) AS tile FROM u)
SELECT tile, count(*) AS n, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM v GROUP BY tile""")
def tile_mbr(spark, d):
    boxes = index.tile_boxes(index.sort_tiles(M.items(spark, d), 2, z="deep"), 2, z="deep")
    at = lambda c, k, n: F.round(F.element_at(c, k), R).alias(n)
    return boxes.select("tile", "n", at("low", 1, "x0"), at("low", 2, "y0"), at("high", 1, "x1"), at("high", 2, "y1"))


@query("mindist_prune", f"""WITH {M.BASE}, t AS (SELECT y.image_id, list_distance(y.deep[1:2], x.deep[1:2]) AS z FROM f x, f y WHERE x.image_id = 7)
SELECT image_id, round(z, 6) AS z_distance FROM t ORDER BY round(z, 9), image_id LIMIT 20""")
def mindist_prune(spark, d):
    rows = M.items(spark, d)
    tiled = index.sort_tiles(rows, 2, z="deep").select("image_id", "tile", F.slice("deep", 1, 2).alias("z"))
    q = V.literal(M.query_of(rows, 7)["deep"][:2])
    return index.pruned_nearest(tiled, index.tile_boxes(tiled, 2), q, 20, 2).select("image_id", rnd("z_distance"))


@query("quad_cells", """WITH b AS (SELECT vec_id AS image_id, embedding[53]::DOUBLE AS x, embedding[54]::DOUBLE AS y FROM embeddings),
r AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM b),
k AS (SELECT image_id, d, d || ':' || least(floor((x - x0) / side * (1 << d)), (1 << d) - 1)::BIGINT || ':' || least(floor((y - y0) / side * (1 << d)), (1 << d) - 1)::BIGINT AS cell FROM b, r, range(17) t(d)),
n AS (SELECT *, count(*) OVER (PARTITION BY cell) AS in_cell FROM k)
SELECT image_id, arg_min(cell, d) AS cell, arg_min(in_cell, d) AS in_cell FROM n WHERE in_cell <= 8 OR d = 16 GROUP BY image_id""")
def quad_cells(spark, d):
    rows = M.items(spark, d).select("image_id", F.slice("deep", 1, 2).alias("z"))
    return index.quad_cells(rows).select("image_id", "cell", "in_cell")


@query("pca_knn_recall")
def pca_knn_recall(spark, d):
    """Share of exact nearest rows in the whole vector that eight components find for item 7."""
    rows = M.items(spark, d).withColumn("v", F.concat(*M.SLICES))
    z = index.project(rows, "v", index.fit_pca(rows, "v", 8)).select("image_id", "v", "z")
    got = z.filter("image_id = 7").first()
    pool = index.nearest_by_components(z, V.literal(got["z"]), 60, 8)
    exact = index.nearest_by_components(z, V.literal(got["v"]), 5, 64, z="v").select("image_id")
    return exact.join(pool.select("image_id", F.lit(1).alias("hit")), "image_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("kmeans_objective")
def kmeans_objective(spark, d):
    rows = M.items(spark, d).withColumn("v", F.concat(*M.SLICES))
    fit = index.fit_kmeans(rows, "v")
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(fit.summary.clusterSizes)], "cluster_id int, size long").withColumn("inertia", F.lit(float(fit.summary.trainingCost)))


# Evaluation.


_METRICS = f"""{M.NEAREST}, r AS (SELECT qid, rank, (a.genus = b.genus)::INT AS rel, (a.group_label = b.group_label)::INT AS grel FROM nn JOIN f a ON a.image_id = qid JOIN f b ON b.image_id = id),
h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM r),
q AS (SELECT qid, avg(rel) AS p_at_k, max(CASE WHEN rank = 1 THEN rel END)::DOUBLE AS p_at_1, coalesce(avg(CASE WHEN rel = 1 THEN hits / rank END), 0) AS ap_at_k, avg(grel) AS group_p_at_k FROM h GROUP BY qid)"""
_NAMES = ("p_at_k", "p_at_1", "ap_at_k", "group_p_at_k")


@query("precision_ap", f"WITH {_METRICS} SELECT qid, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM q")
def precision_ap(spark, d):
    space, found = leave_one_out(spark, d)
    return evaluate.query_metrics(found, space.items).select("qid", *map(rnd, _NAMES))


@query("eval_configs", f"WITH {_METRICS} SELECT 'combined' AS config, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)}, count(*) AS n_queries FROM q")
def eval_configs(spark, d):
    space, found = leave_one_out(spark, d)
    return evaluate.mean_metrics(evaluate.query_metrics(found, space.items).withColumn("config", F.lit("combined")), "config").select("config", *map(rnd, _NAMES), "n_queries")


def _alone_sql(s: str) -> str:
    return f"(WITH {_METRICS.replace(M.NEAREST, M.nearest({s: 1.0}))} SELECT '{s}' AS config, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)}, count(*) AS n_queries FROM q)"


@query("eval_each_set", " UNION ALL ".join(f"SELECT * FROM {_alone_sql(s)}" for s in M.SLICES))
def eval_each_set(spark, d):
    """The same for each set alone."""
    out = None
    for s in M.SLICES:
        space, found = leave_one_out(spark, d, weights={s: 1.0})
        one = evaluate.mean_metrics(evaluate.query_metrics(found, space.items).withColumn("config", F.lit(s)), "config")
        out = one if out is None else out.unionByName(one)
    return out.select("config", *map(rnd, _NAMES), "n_queries")


@query("random_baseline", f"WITH {M.BASE}, c AS (SELECT genus, count(*) AS c FROM f GROUP BY genus) SELECT round(sum(c * (c - 1)) / sum(c) / (sum(c) - 1), 6) AS baseline FROM c")
def random_baseline(spark, d):
    return evaluate.random_baseline(M.items(spark, d), "genus").select(rnd("baseline"))


@query("group_baseline", f"WITH {M.BASE}, c AS (SELECT group_label, count(*) AS c FROM f GROUP BY 1) SELECT round(sum(c * (c - 1)) / sum(c) / (sum(c) - 1), 6) AS baseline FROM c")
def group_baseline(spark, d):
    return evaluate.random_baseline(M.items(spark, d), "group_label").select(rnd("baseline"))


@query("recall_at_k", f"""WITH {M.NEAREST}, dn AS (SELECT x.image_id AS qid, y.image_id AS id, row_number() OVER (PARTITION BY x.image_id ORDER BY round({M.sql_distance("cosine", "y.deep", "x.deep")}, 9), y.image_id) AS rank FROM p x, p y WHERE x.image_id <> y.image_id QUALIFY rank <= 5)
SELECT round(avg(r), 6) AS recall FROM (SELECT nn.qid, count(dn.id) / 5.0 AS r FROM nn LEFT JOIN dn USING (qid, id) GROUP BY nn.qid)""")
def recall_at_k(spark, d):
    """How much of the combined result the deep set alone finds."""
    exact = leave_one_out(spark, d)[1]
    found = leave_one_out(spark, d, weights={"deep": 1.0})[1]
    return evaluate.recall(found, exact).select(rnd("recall"))


def backends(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The exact results of all rows, and those of each candidate index over the weighted embedding, re-ranked by the combined distance."""
    space, exact = leave_one_out(spark, d)
    exact, rows = cut(exact), cut(space.items.select("image_id", space.embedding().alias("v")))
    z = cut(index.project(rows, "v", index.fit_pca(rows, "v", max(index.PCA_DIMS.values()))).select("image_id", "z"))
    found = {name: search.component_top_k(space, z, dims) for name, dims in index.PCA_DIMS.items()}
    model = index.fit_kmeans(rows, "v")
    assigned = cut(model.transform(rows.withColumn("features", index.array_to_vector(F.col("v")))).select("image_id", "v", F.col("prediction").alias("cluster_id")))
    visited = index.visited_clusters(assigned, model, "v", search.CANDIDATE_POOL)
    return exact, found | {"kmeans": search.cluster_top_k(space, assigned.select("image_id", "cluster_id"), visited)}


@query("backend_recall")
def backend_recall(spark, d):
    """Share of each row's exact nearest by the combined distance that each candidate index finds."""
    exact, found = backends(spark, d)
    out = None
    for name, near in found.items():
        one = evaluate.recall(near, exact).select(F.lit(name).alias("backend"), rnd("recall"))
        out = one if out is None else out.unionByName(one)
    return out


# Feedback.


_MARKS = "mk AS (SELECT image_id, image_id < 12 AS relevant FROM f WHERE image_id BETWEEN 8 AND 14)"


def _marks(rows: DataFrame) -> DataFrame:
    return rows.filter("image_id between 8 and 14").select("image_id", (F.col("image_id") < 12).alias("relevant"))


def _rocchio_sql(s: str, n: int) -> str:
    return f"SELECT '{s}' AS set_name, d, (q + 0.75 * g - 0.25 * b) / 1.5 AS v FROM (SELECT k AS d, max(CASE WHEN image_id = 7 THEN x END) AS q, avg(x) FILTER (WHERE image_id BETWEEN 8 AND 11) AS g, avg(x) FILTER (WHERE image_id BETWEEN 12 AND 14) AS b FROM (SELECT image_id, unnest(range(1, {n + 1})) AS k, unnest({s}) AS x FROM f WHERE image_id BETWEEN 7 AND 14) GROUP BY k)"


@query("rocchio_vector", f"WITH {M.BASE} SELECT set_name, d::INT AS dim, round(v, 6) AS value FROM ({' UNION ALL '.join(_rocchio_sql(s, n) for s, (_, n) in M.SLICES.items())})")
def rocchio_vector(spark, d):
    space = M.space(spark, d, fit=False)
    out = feedback.rocchio(space, M.query_of(space.items, 7), _marks(space.items))
    return out.select("set_name", F.posexplode("vector").alias("p", "value")).select("set_name", (F.col("p") + 1).alias("dim"), rnd("value"))


@query("rocchio_renorm", f"""WITH {M.BASE}, v AS ({_rocchio_sql('color', 24)}), c AS (SELECT d, greatest(v, 0) AS c, v, CASE WHEN d <= 8 THEN 1 WHEN d <= 16 THEN 2 WHEN d <= 20 THEN 3 ELSE 4 END AS b FROM v)
SELECT d::INT AS dim, round(CASE WHEN b = 4 THEN v WHEN sum(c) OVER (PARTITION BY b) > 0 THEN c / sum(c) OVER (PARTITION BY b) ELSE c END, 6) AS value FROM c""")
def rocchio_renorm(spark, d):
    space = M.space(spark, d, fit=False)
    out = feedback.with_histograms(space, feedback.rocchio(space, M.query_of(space.items, 7), _marks(space.items))).filter("set_name = 'color'")
    return out.select(F.posexplode("vector").alias("p", "value")).select((F.col("p") + 1).alias("dim"), rnd("value"))


@query("refine_topk")
def refine_topk(spark, d):
    space = M.space(spark, d)
    return feedback.refine(space, M.query_of(space.items, 7), _marks(space.items), exclude=[7])[0].select("rank", "image_id", rnd("distance"))


def _moved_sql(s: str, n: int) -> str:
    return f"""mean_{s} AS (SELECT qid, k, avg(x) FILTER (WHERE rel) AS g, avg(x) FILTER (WHERE NOT rel) AS b FROM (SELECT qid, rel, unnest(range(1, {n + 1})) AS k, unnest({s}) AS x FROM mk JOIN f ON id = image_id) GROUP BY qid, k),
long_{s} AS (SELECT qid, k, (x + 0.75 * coalesce(g, 0) - 0.25 * coalesce(b, 0)) / (1 + CASE WHEN g IS NULL THEN 0 ELSE 0.75 END - CASE WHEN b IS NULL THEN 0 ELSE 0.25 END) AS v
 FROM (SELECT image_id AS qid, unnest(range(1, {n + 1})) AS k, unnest({s}) AS x FROM f) LEFT JOIN mean_{s} USING (qid, k))"""


_BLOCK = "CASE WHEN k <= 8 THEN 1 WHEN k <= 16 THEN 2 WHEN k <= 20 THEN 3 ELSE 4 END"
_GAIN = f"""WITH {M.NEAREST}, mk AS (SELECT qid, id, a.genus = b.genus AS rel FROM nn JOIN f a ON a.image_id = qid JOIN f b ON b.image_id = id), {', '.join(_moved_sql(s, n) for s, (_, n) in M.SLICES.items())},
cut AS (SELECT qid, k, {_BLOCK} AS b, CASE WHEN k <= 20 THEN greatest(v, 0) ELSE v END AS v FROM long_color),
hist AS (SELECT qid, k, CASE WHEN b < 4 AND sum(v) OVER (PARTITION BY qid, b) > 0 THEN v / sum(v) OVER (PARTITION BY qid, b) ELSE v END AS v FROM cut),
m AS (SELECT * FROM (SELECT qid, list(v ORDER BY k) AS color FROM hist GROUP BY qid) JOIN (SELECT qid, list((v - a.m[k]) / a.s[k] ORDER BY k) AS shape FROM long_shape, st_shape a GROUP BY qid) USING (qid)
 JOIN (SELECT qid, list((v - a.m[k]) / a.s[k] ORDER BY k) AS texture FROM long_texture, st_texture a GROUP BY qid) USING (qid) JOIN (SELECT qid, list(v ORDER BY k) AS deep FROM long_deep GROUP BY qid) USING (qid)),
again AS (SELECT x.qid, y.image_id AS id, row_number() OVER (PARTITION BY x.qid ORDER BY round({M.sql_combined('y', 'x')}, 9), y.image_id) AS rank FROM m x, p y, sc WHERE x.qid <> y.image_id QUALIFY rank <= 5),
share AS (SELECT qid, count(*) FILTER (WHERE rel) / 5.0 AS before FROM mk GROUP BY qid), after AS (SELECT qid, count(*) FILTER (WHERE a.genus = b.genus) / 5.0 AS after FROM again JOIN f a ON a.image_id = qid JOIN f b ON b.image_id = id GROUP BY qid)
SELECT count(*) AS n_queries, round(avg(before), 6) AS p_at_k_before, round(avg(after), 6) AS p_at_k_after FROM share JOIN after USING (qid)"""


@query("feedback_gain", _GAIN)
def feedback_gain(spark, d):
    """Precision of all rows as queries before and after a round of feedback."""
    space = M.space(spark, d)
    return feedback.feedback_gain(space, space.items.select("image_id", "genus")).select("n_queries", rnd("p_at_k_before"), rnd("p_at_k_after"))


# Analysis.


@query("fisher_ratio", f"""WITH {M.BASE}, {M.sql_stats("color", 24)}, z AS (SELECT genus, k, (v - a.m[k]) / a.s[k] AS v FROM (SELECT genus, unnest(range(1, 25)) AS k, unnest(color) AS v FROM f), st_color a),
g AS (SELECT k, genus, count(*) AS n, avg(v) AS m, var_pop(v) AS w, sum(v) AS s FROM z GROUP BY k, genus), t AS (SELECT k, sum(s) / sum(n) AS mean FROM g GROUP BY k),
d AS (SELECT g.k, sum(n * power(m - mean, 2)) AS b, sum(n * w) AS w FROM g JOIN t USING (k) GROUP BY g.k) SELECT round(avg(b / w), 6) AS fisher FROM d WHERE w > 1e-9""")
def fisher_ratio(spark, d):
    return analysis.fisher_ratio(M.items(spark, d), "color", "genus").select(rnd("fisher"))


_DEEP = M.sql_distance("cosine", "x.deep", "y.deep")
_PAIRS = f"{M.BASE}, pw AS (SELECT x.image_id AS a, y.image_id AS b, x.genus AS ga, y.genus AS gb, x.author AS aa, y.author AS ab, {_DEEP} AS d FROM f x, f y WHERE x.image_id <> y.image_id)"


@query("sep_ratio", f"WITH {_PAIRS}, q AS (SELECT avg(d) FILTER (WHERE ga = gb) AS intra, avg(d) FILTER (WHERE ga <> gb) AS inter FROM pw) SELECT round(intra, 6) AS intra, round(inter, 6) AS inter, round(inter / greatest(intra, 1e-9), 6) AS sep_ratio FROM q")
def sep_ratio(spark, d):
    return analysis.cosine_separation(M.items(spark, d), "deep", "genus").select(rnd("intra"), rnd("inter"), rnd("sep_ratio"))


@query("nn1_accuracy", f"WITH {_PAIRS}, k AS (SELECT a, ga, arg_min(gb, (d, b)) AS gb FROM pw GROUP BY a, ga) SELECT round(avg((ga = gb)::INT), 6) AS nn1_acc FROM k")
def nn1_accuracy(spark, d):
    return analysis.nearest_label_accuracy(M.items(spark, d), "deep", "cosine", "image_id", "genus").select(rnd("nn1_acc"))


@query("medoid", f"WITH {_PAIRS}, m AS (SELECT ga, a, round(avg(d), 9) AS d FROM pw WHERE ga = gb GROUP BY ga, a) SELECT ga AS genus, arg_min(a, (d, a)) AS medoid, round(min(d), 6) AS mean_d FROM m GROUP BY ga")
def medoid(spark, d):
    return analysis.cosine_medoids(M.items(spark, d), "deep", "image_id", "genus").select("genus", "medoid", rnd("mean_d"))


@query("closest_pair", f"WITH {_PAIRS}, m AS (SELECT ga, a, b, round(d, 9) AS d FROM pw WHERE ga = gb AND a < b AND aa <> ab) SELECT ga AS genus, arg_min(a, (d, a, b)) AS a, arg_min(b, (d, a, b)) AS b, round(min(d), 6) AS d FROM m GROUP BY ga")
def closest_pair(spark, d):
    return analysis.closest_pair_of_all(M.items(spark, d), "deep", "cosine", "image_id", "genus", "author").select("genus", "a", "b", rnd("d"))


@query("example_triplet", f"""WITH {M.PREPARED}, ab AS (SELECT x.image_id AS a, y.image_id AS b FROM p x JOIN p y ON x.image_id < y.image_id AND x.author <> y.author WHERE x.genus = 'g3' AND y.genus = 'g3' ORDER BY round(list_distance(x.shape, y.shape), 9), a, b LIMIT 1),
mid AS (SELECT x.image_id AS c FROM p x, p y WHERE x.genus = 'g5' AND y.genus = 'g5' GROUP BY x.image_id ORDER BY round(avg(list_distance(x.shape, y.shape)), 9), c LIMIT 1),
t AS (SELECT a, b, c FROM ab, mid) {' UNION ALL '.join(f"SELECT a, b, c, '{s}' AS set_name, " + ', '.join(f"round({M.sql_distance(m, f'{x}.{s}', f'{y}.{s}')}, 6) AS {n}" for n, x, y in (('ab', 'pa', 'pb'), ('ac', 'pa', 'pc'), ('bc', 'pb', 'pc'))) + " FROM t JOIN p pa ON pa.image_id = a JOIN p pb ON pb.image_id = b JOIN p pc ON pc.image_id = c" for s, m in SET_METRIC.items())}""")
def example_triplet(spark, d):
    """Two alike of one class, and the most typical of another."""
    out = analysis.example_triplet(M.items(spark, d), SET_METRIC, "shape", "g3", "g5", "image_id", "genus", "author")
    return out.select("a", "b", "c", "set_name", rnd("ab"), rnd("ac"), rnd("bc"))


@query("chance_level", "WITH c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label) SELECT round(sum(power(c, 2)) / power(sum(c), 2), 6) AS chance FROM c")
def chance_level(spark, d):
    return analysis.chance_level(M.items(spark, d), "genus").select(rnd("chance"))


@query("genus_profile", f"""WITH {M.BASE} SELECT coalesce(genus, '__all__') AS label, count(*) AS n, round(avg(color[1] * 100), 6) AS c_mean, round(stddev_pop(color[1] * 100), 6) AS c_std, round(avg(shape[3]), 6) AS s_mean, round(stddev_pop(shape[3]), 6) AS s_std FROM f GROUP BY ROLLUP (genus)""")
def genus_profile(spark, d):
    out = analysis.profile(M.items(spark, d), "genus", {"c": ("color", 1, 100.0), "s": ("shape", 3, 1.0)})
    return out.select("label", "n", *map(rnd, ("c_mean", "c_std", "s_mean", "s_std")))


@query("min_count_groups", f"WITH {M.BASE} SELECT image_id FROM f WHERE genus IN (SELECT genus FROM f GROUP BY genus HAVING count(*) >= 50)")
def min_count_groups(spark, d):
    return evaluate.labelled(M.items(spark, d), "genus", 50).select("image_id")


@query("histogram_bins", "SELECT least(greatest(floor(value / 20), -1), 30)::INT AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram_bins(spark, d):
    return M.table(spark, d, "events").groupBy(F.least(F.greatest(F.floor(F.col("value") / 20), F.lit(-1)), F.lit(30)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("quartiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type")
def quartiles(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return M.table(spark, d, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", *[F.round(F.col("q")[k], R).alias(f"q{k + 1}") for k in range(3)])


@query("top_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_counts(spark, d):
    return M.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("upper_median", "SELECT lang, quantile_disc(n_chars, 0.5) AS lower_median, min(n_chars) AS low, max(n_chars) AS high, count(*) AS n FROM documents GROUP BY lang")
def upper_median(spark, d):
    return M.table(spark, d, "documents").groupBy("lang").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("lower_median"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.count(F.lit(1)).alias("n"))


@query("best_of_groups", "SELECT arg_max(event_type, (a, event_type)) AS best, arg_min(event_type, (a, event_type)) AS worst FROM (SELECT event_type, round(avg(value), 6) AS a FROM events GROUP BY event_type)")
def best_of_groups(spark, d):
    a = M.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), R).alias("a"))
    return a.agg(F.max_by("event_type", F.struct("a", "event_type")).alias("best"), F.min_by("event_type", F.struct("a", "event_type")).alias("worst"))


# Ingestion.


def _records(spark, d):
    p = M.table(spark, d, "pages")
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)</title>", 1)
    n = F.length(F.coalesce("html", F.lit("")))
    return p.select("page_id", title.alias("title"), F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 7 == 1, "image/gif").otherwise("image/jpeg").alias("mime"), (F.lit(500) + n % 1500).cast("int").alias("w"), (F.lit(600) + n % 700).cast("int").alias("h"), F.array(F.concat(F.lit("Category:"), F.when(F.col("page_id") % 5 == 0, "Bark of ").otherwise("Solitary "), F.when(F.col("page_id") % 3 == 0, "Cocos").otherwise("Quercus"))).alias("cats"))


_RECORDS = r"""r AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 'image/gif' ELSE 'image/jpeg' END AS mime,
 (500 + length(coalesce(html, '')) % 1500)::INT AS w, (600 + length(coalesce(html, '')) % 700)::INT AS h, 'Category:' || CASE WHEN page_id % 5 = 0 THEN 'Bark of ' ELSE 'Solitary ' END || CASE WHEN page_id % 3 = 0 THEN 'Cocos' ELSE 'Quercus' END AS cat FROM pages)"""
_REASON = f"""CASE WHEN mime IS NULL THEN 'no-imageinfo' WHEN mime NOT IN ('image/jpeg', 'image/png') THEN 'mime' WHEN least(w, h) < 640 THEN 'small' WHEN NOT (w / h BETWEEN 0.65 AND 1.6) THEN 'aspect'
 WHEN regexp_matches(lower(title), '{rules.any_of(rules.BAD_WORDS).replace(chr(92) + " ", " ")}') THEN 'badword' WHEN regexp_matches(lower(cat), '{rules.any_of(rules.BAD_CATEGORIES).replace(chr(92) + " ", " ")}') THEN 'badcat'
 WHEN page_id % 3 = 0 AND NOT regexp_matches(title, '{rules.GENUS_PATTERN}') THEN 'palm' ELSE 'ok' END"""


@query("accept_reason", f"WITH {_RECORDS} SELECT page_id, {_REASON} AS reason FROM r")
def accept_reason(spark, d):
    return _records(spark, d).select("page_id", rules.accept_reason(F.col("title"), F.col("mime"), F.col("w"), F.col("h"), F.col("cats")).alias("reason"))


@query("reason_counts", f"WITH {_RECORDS} SELECT {_REASON} AS reason, count(*) AS n FROM r GROUP BY 1")
def reason_counts(spark, d):
    return accept_reason(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("source_priority", f"WITH {_RECORDS} SELECT page_id, CASE WHEN cat LIKE '%Category:Solitary %' THEN 0 ELSE 4 END AS priority FROM r")
def source_priority(spark, d):
    return _records(spark, d).select("page_id", rules.source_priority(F.col("cats")).alias("priority"))


@query("priority_limit", f"WITH {_RECORDS} SELECT page_id, CASE WHEN cat LIKE '%Category:Solitary %' THEN 0 ELSE 4 END AS priority FROM r ORDER BY priority, title, page_id LIMIT 40")
def priority_limit(spark, d):
    return _records(spark, d).select("page_id", "title", rules.source_priority(F.col("cats")).alias("priority")).orderBy("priority", "title", "page_id").limit(40).select("page_id", "priority")


@query("genus_mode", f"WITH {_RECORDS} SELECT CASE WHEN page_id % 3 = 0 THEN 'Cocos' ELSE 'Quercus' END AS genus, CASE WHEN page_id % 3 = 0 THEN 'palm' ELSE 'broadleaf' END AS group_label, count(*) AS n FROM r GROUP BY 1, 2")
def genus_mode(spark, d):
    g = _records(spark, d).select(rules.main_genus(rules.genera(F.col("title"), F.col("cats"))).alias("genus"))
    return g.select("genus", rules.group_of(F.col("genus")).alias("group_label")).groupBy("genus", "group_label").agg(F.count(F.lit(1)).alias("n"))


@query("strip_html_truncate", "SELECT page_id, substring(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 120) AS text FROM pages")
def strip_html_truncate(spark, d):
    return M.table(spark, d, "pages").select("page_id", rules.strip_html(F.col("html")).alias("text"))


@query("anti_exclude", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_exclude(spark, d):
    bad = M.table(spark, d, "labels").filter("quality = 0").select("doc_id")
    return M.table(spark, d, "documents").select("doc_id").join(bad, "doc_id", "left_anti")


@query("semi_labelled", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labelled(spark, d):
    return M.table(spark, d, "documents").select("doc_id", "lang").join(M.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("gate_reason", """WITH g AS (SELECT vec_id AS image_id, abs(embedding[1]::DOUBLE) * 4 AS c, embedding[2]::DOUBLE * 2 AS x, embedding[3]::DOUBLE * 2 AS y, CASE WHEN vec_id % 11 = 0 THEN 'default_rect' ELSE 'segformer' END AS m FROM embeddings)
SELECT image_id, CASE WHEN c BETWEEN 0.04 AND 0.9 AND abs(x) <= 0.3 AND abs(y) <= 0.3 AND m <> 'default_rect' THEN NULL WHEN m = 'default_rect' THEN 'no-tree' WHEN NOT (c BETWEEN 0.04 AND 0.9) THEN 'coverage' ELSE 'off-center' END AS reason FROM g""")
def gate_reason(spark, d):
    v = V.doubles(F.col("embedding"))
    e = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.abs(v[0]) * 4).alias("c"), (v[1] * 2).alias("x"), (v[2] * 2).alias("y"), F.when(F.col("vec_id") % 11 == 0, "default_rect").otherwise("segformer").alias("m"))
    return e.select("image_id", rules.gate_reason(F.col("c"), F.col("x"), F.col("y"), F.col("m")).alias("reason"))


@query("method_counts", """WITH g AS (SELECT CASE WHEN vec_id % 11 = 0 THEN 'default_rect' ELSE 'segformer' END AS method, abs(embedding[1]::DOUBLE) * 4 AS c, embedding[2]::DOUBLE * 2 AS x, embedding[3]::DOUBLE * 2 AS y FROM embeddings)
SELECT method, count(*) AS n, count(*) FILTER (WHERE c BETWEEN 0.04 AND 0.9 AND abs(x) <= 0.3 AND abs(y) <= 0.3 AND method <> 'default_rect') AS kept FROM g GROUP BY method""")
def method_counts(spark, d):
    """How images were segmented, and how many of each pass the gate."""
    rows = gate_reason(spark, d).select(F.when(F.col("image_id") % 11 == 0, "default_rect").otherwise("segformer").alias("method"), "reason")
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("kept"))


_HASH = "h AS (SELECT vec_id AS id, list_sum(list_transform(embedding[1:63], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT AS h FROM embeddings)"


def _hashes(spark, d):
    """63 signs of a vector as a hash."""
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 63), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("h"))


@query("hamming_pairs", f"WITH {_HASH} SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM h x JOIN h y ON x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 8")
def hamming_pairs(spark, d):
    return ingest.near_pairs(_hashes(spark, d), "id", "h", 8)


@query("greedy_dedup")
def greedy_dedup(spark, d):
    return ingest.greedy_dedup(_hashes(spark, d), "id", "h", 12).select("id")


@query("holdout_pick", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS m FROM labels), k AS (SELECT DISTINCT floor(i * (m - 1) / 9)::BIGINT AS place FROM range(10) t(i), (SELECT count(*) AS m FROM labels))
SELECT doc_id FROM r WHERE place IN (SELECT place FROM k)""")
def holdout_pick(spark, d):
    return ingest.holdout_pick(M.table(spark, d, "labels"), 10, "doc_id", F.lit(True)).select("doc_id")


@query("split_holdout", """WITH r AS (SELECT doc_id, lang = 'en' AS l FROM documents WHERE lang IS NOT NULL), q AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS m FROM r WHERE l),
h AS (SELECT doc_id FROM q WHERE place IN (SELECT floor(i * (m - 1) / 9)::BIGINT FROM range(10) t(i), (SELECT max(m) AS m FROM q)) AND (SELECT count(*) FROM r) - 10 >= 150),
b AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM h) AS held FROM r), n AS (SELECT doc_id, held, row_number() OVER (PARTITION BY held ORDER BY doc_id)::INT AS image_id FROM b)
SELECT doc_id, image_id, CASE WHEN held THEN printf('query_%02d.jpg', image_id) ELSE printf('tree_%04d.jpg', image_id) END AS filename FROM n""")
def split_holdout(spark, d):
    rows = M.table(spark, d, "documents").filter("lang is not null").select("doc_id", "lang")
    kept, held = ingest.split_holdout(rows, 10, "doc_id", F.col("lang") == "en", least=150)
    return kept.unionByName(held).select("doc_id", "image_id", "filename")


@query("renumber", "SELECT doc_id, row_number() OVER (ORDER BY doc_id)::INT AS image_id, printf('tree_%04d', row_number() OVER (ORDER BY doc_id)) AS filename FROM labels WHERE quality = 0")
def renumber(spark, d):
    return ingest.renumber(M.table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "image_id", "filename", "tree_%04d")


@query("category_recursion", """WITH RECURSIVE e AS (SELECT 'world' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT 'world' AS node, 2 AS left_ UNION ALL SELECT child, left_ - 1 FROM c JOIN e ON node = parent WHERE left_ > 0) SELECT node, max(left_)::INT AS "left" FROM c GROUP BY node""")
def category_recursion(spark, d):
    r, n = M.table(spark, d, "region"), M.table(spark, d, "nation")
    edges = r.select(F.lit("world").alias("parent"), F.col("r_name").alias("child")).unionByName(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    return ingest.crawl(edges, [("world", 2)])


# Store.


@query("upsert_images", """WITH o AS (SELECT p_partkey AS image_id, p_name AS filename, p_brand AS license FROM part), n AS (SELECT p_name AS filename, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END AS license FROM part WHERE p_partkey % 10 = 0 AND p_partkey > 3)
SELECT o.image_id, o.filename, coalesce(n.license, o.license) AS license FROM (SELECT min(image_id) AS image_id, filename, min(license) AS license FROM o GROUP BY filename) o LEFT JOIN (SELECT filename, min(license) AS license FROM n GROUP BY filename) n USING (filename)""")
def upsert_images(spark, d):
    part = M.table(spark, d, "part")
    old = part.groupBy(F.col("p_name").alias("filename")).agg(F.min("p_partkey").alias("image_id"), F.min("p_brand").alias("license")).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    new = part.filter("p_partkey % 10 = 0 and p_partkey > 3").groupBy(F.col("p_name").alias("filename")).agg(F.min(F.when(F.col("p_partkey") % 2 != 0, F.col("p_type"))).alias("license"))
    return store.upsert_images(old, new).select("image_id", "filename", "license")


@query("upsert_latest_wins", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' ELSE p_brand END AS p_brand FROM part")
def upsert_latest_wins(spark, d):
    part = M.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return store.latest_wins(part, part.filter("p_size > 25").withColumn("p_brand", F.lit("new")), "p_partkey").select("p_partkey", "p_brand")


@query("replace_partition", "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def replace_partition(spark, d):
    c = M.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return store.replace_partition(c, c.filter("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0)), "c_mktsegment")


@query("cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    gone = M.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.cascade(M.table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query("log_stats_by_backend", "SELECT event_type AS backend, count(*) AS n, round(avg(value), 6) AS ms FROM events GROUP BY event_type")
def log_stats_by_backend(spark, d):
    return M.table(spark, d, "events").groupBy(F.col("event_type").alias("backend")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), R).alias("ms"))


@query("json_roundtrip", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_roundtrip(spark, d):
    e = M.table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.from_json(F.to_json("p"), "k int")["k"].alias("k"))


@query("category_union", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS cats FROM orders GROUP BY o_custkey")
def category_union(spark, d):
    return M.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("cats"))


@query("bags", "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS bag FROM orders GROUP BY o_custkey")
def bags(spark, d):
    """Everything seen per key, repeats included, in order."""
    seen = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    return seen.select("o_custkey", F.array_join(F.col("x.o_orderpriority"), "|").alias("bag"))


@query("moments_skew", f"WITH {M.BASE}, m AS (SELECT image_id, color, list_avg(color) AS mean, list_stddev_pop(color) AS std FROM f) SELECT image_id, round(mean, 6) AS mean, round(std, 6) AS std, round(list_avg(list_transform(color, lambda x: power(x - mean, 3))) / (power(std, 3) + 1e-6), 6) AS skew FROM m")
def moments_skew(spark, d):
    m = V.moments(F.col("color"))
    return M.items(spark, d).select("image_id", m.alias("m")).select("image_id", *[F.round(F.col(f"m.{n}"), R).alias(n) for n in ("mean", "std", "skew")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_topk(spark, sf_dir)
