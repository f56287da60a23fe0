import random

import pytest

from kindred.operators import analysis
from kindred.plans import model as M
from kindred.plans import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """320 rows with ids from 0, copies among them, a label of one row and a zero vector."""
    rng, d = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    rows = [(i, [rng.gauss(i % 3 == k % 3, 1) for k in range(64)], i % 3) for i in range(320)]
    rows += [(320, rows[290][1], rows[290][2]), (321, rows[300][1], 1), (322, [0.0] * 64, 2), (323, rows[1][1][::-1], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_pair_queries_cover_all_rows(spark, folder):
    rows = M.items(spark, folder)
    pairs = analysis.pair_distances(rows, "deep", "cosine", "image_id", "genus").cache()
    flat = lambda df: sorted(tuple(pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = {n: sorted(map(tuple, queries.QUERIES[n](spark, folder).collect())) for n in ("sep_ratio", "nn1_accuracy", "medoid", "closest_pair")}
    assert got["sep_ratio"] == flat(analysis.separation(pairs))
    assert got["nn1_accuracy"] == flat(analysis.nearest_accuracy(pairs))
    assert got["medoid"] == flat(analysis.medoids(pairs))
    assert got["closest_pair"] == flat(analysis.closest_pair(pairs, rows, "image_id", "author"))
    # several blocks give the same
    assert flat(analysis.nearest_label_accuracy(rows, "deep", "cosine", "image_id", "genus", query_block=50)) == flat(analysis.nearest_accuracy(pairs))
    assert flat(analysis.closest_pair_of_all(rows, "deep", "cosine", "image_id", "genus", "author", query_block=50)) == flat(analysis.closest_pair(pairs, rows, "image_id", "author"))
    pairs.unpersist()


def test_pair_queries_of_few_rows(spark):
    rows = spark.createDataFrame([(1, "g", "x", [1.0, 0.0])], "image_id long, genus string, author string, deep array<double>")
    for few in (rows, rows.limit(0)):
        assert analysis.cosine_separation(few, "deep", "genus").first()["intra"] is None
        assert analysis.nearest_label_accuracy(few, "deep", "cosine", "image_id", "genus").first()["nn1_acc"] is None
        assert not analysis.cosine_medoids(few, "deep", "image_id", "genus").count()
        assert not analysis.closest_pair_of_all(few, "deep", "cosine", "image_id", "genus", "author").count()


def test_kmeans_takes_all_restarts(spark, folder, monkeypatch):
    import inspect

    fit, asked = queries.index.fit_kmeans, []
    monkeypatch.setattr(queries.index, "fit_kmeans", lambda *a, **b: asked.append(inspect.signature(fit).bind(*a, **b)) or fit(*a, **b))
    assert sum(r["size"] for r in queries.kmeans_objective(spark, folder).collect()) == 324
    asked[0].apply_defaults()
    assert asked[0].arguments["restarts"] == 10


def test_backends_rerank_their_candidates(spark, folder):
    exact, found = queries.backends(spark, folder)
    best = {(r["qid"], r["id"]): r["distance"] for r in exact.collect()}
    assert set(found) == {"kdtree", "rtree", "quadtree", "kmeans"}
    recall = {}
    for name, near in found.items():
        rows = near.collect()
        assert len(rows) == 5 * 324 and all(r["qid"] != r["id"] for r in rows)
        hits = [r for r in rows if (r["qid"], r["id"]) in best]
        assert all(r["distance"] == pytest.approx(best[r["qid"], r["id"]], abs=1e-6) for r in hits)
        recall[name] = len(hits) / len(best)
    got = {r["backend"]: r["recall"] for r in queries.backend_recall(spark, folder).collect()}
    assert got == pytest.approx(recall, abs=1e-4) and got["kdtree"] > got["quadtree"]
