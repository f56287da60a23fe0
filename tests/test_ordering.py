import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import analysis, catalog, feedback, index, ingest, search
from kindred.operators.ordering import placed
from kindred.operators.space import FeatureSpace
from kindred.plans import model as M

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 3, 2000])
def test_places(spark, n):
    rng = random.Random(n)
    rows = [(i, None if rng.random() < 0.1 else 5 if rng.random() < 0.4 else rng.randrange(-100, 1 << 40), f"s{rng.randrange(9)}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k long, s string").repartition(5)
    want = {r[0]: p + 1 for p, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0])))}
    got = placed(df, "k", "s", "id", name="at", total="all", parts=7)
    assert got.columns == ["id", "k", "s", "at", "all"]
    assert {r["id"]: r["at"] for r in got.collect()} == want
    assert all(r["all"] == n for r in got.collect())


def test_places_use_no_single_task(spark):
    plan = placed(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 3  # the sample's bounds, and the counts of buckets twice


@pytest.mark.parametrize("agree", [None, 1, 2, 3])
def test_near_pairs(spark, agree):
    rng = random.Random(3)
    hashes = [rng.getrandbits(63) for _ in range(40)]
    for h in hashes[:20]:
        near = h
        for b in rng.sample(range(63), rng.randrange(0, 10)):
            near ^= 1 << b
        hashes.append(near)
    rows = [*enumerate(hashes), (90, hashes[0]), (91, hashes[0]), (92, None)]
    want = {(a, b, (x ^ y).bit_count()) for (a, x), (b, y) in itertools.combinations(rows[:-1], 2) if (x ^ y).bit_count() <= 6}
    got = ingest.near_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", agree=agree).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_greedy_dedup(spark):
    rng = random.Random(5)
    rows = [(i, rng.getrandbits(8)) for i in range(60)] + [(70, None), (71, None)]
    kept = []
    for i, h in rows[:60]:
        if all((h ^ k).bit_count() > 1 for _, k in kept):
            kept.append((i, h))
    got = {r["id"] for r in ingest.greedy_dedup(spark.createDataFrame(rows, "id long, h long"), "id", "h", 1).collect()}
    assert got == {i for i, _ in kept} | {70, 71}


def test_split_holdout(spark):
    rows = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 2 == 0).alias("l"))
    kept, held = ingest.split_holdout(rows, 4, "k", F.col("l"), least=20)
    assert [r["k"] for r in held.orderBy("image_id").collect()] == [0, 8, 18, 28] and held.orderBy("image_id").first()["filename"] == "query_01.jpg"
    assert kept.count() == 26 and kept.filter("k = 1").first()["image_id"] == 1
    kept, held = ingest.split_holdout(rows, 4, "k", F.col("l"), least=27)
    assert held.count() == 0 and kept.count() == 30


def test_picks(spark):
    rows = spark.range(103).withColumnRenamed("id", "k")
    assert [r["k"] for r in search.every_step(rows, "k").orderBy("k").collect()] == [0, 20, 40, 60, 80]
    assert [r["k"] for r in search.every_step(rows.limit(3), "k").orderBy("k").collect()] == [0, 1, 2]
    one, two = ({r["k"] for r in search.pick_rows(rows.repartition(n), "k", 30).collect()} for n in (1, 7))
    assert one == two and len(one) == 30 and one != {r["k"] for r in search.pick_rows(rows, "k", 30, seed=7).collect()}
    assert search.parse_filters(genus="a,b", license=None, group_label="") == {"genus": {"a", "b"}}


def test_saved_space_and_indexes(spark, tmp_path):
    root, space = str(tmp_path), M.space(spark, SF)
    catalog.save_space(space, root)
    path = str(next((tmp_path / "feature_stats").iterdir()))
    again = catalog.load_space(space.items, space.metrics, path, layout=M.LAYOUT)
    assert again.scales == space.scales and again.stats == space.stats
    with pytest.raises(ValueError, match="other"):
        catalog.load_space(space.items.withColumn("other", F.col("deep")), {"other": "l2"}, path)
    metas = catalog.build_indexes(space, root)
    assert [metas[k]["pca_dim"] for k in ("kdtree", "rtree", "quadtree")] == [32, 8, 2] and sum(metas["kmeans"]["sizes"]) == space.items.count()
    vectors = np.array([r["v"] for r in space.items.select(space.embedding().alias("v")).collect()])
    s = np.linalg.svd(vectors - vectors.mean(0), compute_uv=False) ** 2
    for kind, d in index.PCA_DIMS.items():
        data, meta = catalog.get_index(spark, root, f"pca_{kind}")
        assert data.count() == len(vectors) and float(meta["explained_variance"]) == pytest.approx(s[:d].sum() / s.sum())
    data, meta = catalog.get_index(spark, root, "kmeans")
    assert meta["kind"] == "kmeans" and data.count() == len(vectors)
    with pytest.raises(KeyError):
        catalog.get_index(spark, root, "none")


def test_moved_queries(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [5.0, 4.0])], "image_id long, v array<double>")
    space = FeatureSpace(items, {"v": "l2"})
    marks = spark.createDataFrame([(9, 1, True), (9, 2, True), (9, 3, False), (9, 77, True), (8, 3, False)], "qid long, id long, relevant boolean")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [0.0, 1.0])], "qid long, v array<double>")
    got = {r["qid"]: r["v"] for r in feedback.moved_queries(space, queries, marks).collect()}
    assert got[7] == [1, 1]
    assert got[8] == pytest.approx([(2 - 0.25 * 5) / 0.75, (2 - 0.25 * 4) / 0.75])
    assert got[9] == pytest.approx([(0.75 * 2 - 0.25 * 5) / 1.5, (1 + 0.75 - 0.25 * 4) / 1.5])


def test_medoid(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 3))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    d = np.linalg.norm(v[:, None] - v[None], axis=-1).mean(1)
    got = analysis.medoid_of(rows, "v", "l2", "id", query_block=16).first()
    assert got["medoid"] == d.argmin() and got["mean_d"] == pytest.approx(d.min(), abs=1e-8)
