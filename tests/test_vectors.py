import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import ingest_rules as rules
from kindred.functions import vectors as V
from kindred.operators import evaluate, feedback, index, ingest, search, space, store


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_distances(spark):
    assert value(spark, V.l1(vec(1, 2), vec(3, 1))) == 3
    assert value(spark, V.l2(vec(0, 0), vec(3, 4))) == 5
    assert value(spark, V.cosine(vec(0, 0), vec(3, 4))) == 1
    with pytest.raises(ValueError):
        V.distance("l3", vec(1), vec(1))
    assert value(spark, V.similarity(F.lit(0.712))) == pytest.approx(0.584, abs=5e-4)


def test_renormalised(spark):
    assert value(spark, V.renormalised(vec(0.5, -0.1, 0.1))) == pytest.approx([5 / 6, 0, 1 / 6])
    assert value(spark, V.renormalised(vec(0, -1))) == [0, 0]


def test_mindist_and_cumulative(spark):
    assert value(spark, V.mindist(vec(0, 0), vec(3, -1), vec(5, 4))) == 3
    assert value(spark, V.cumulative(vec(1, 1, 2))) == pytest.approx([1 / 3, 2 / 3, 4 / 3])


def test_weights():
    assert space.normalised_weights({"color": 1.0}, ["color", "shape"]) == {"color": 1.0, "shape": 0.0}
    assert space.normalised_weights({"a": 0}, list("abcd")) == dict.fromkeys("abcd", 0.25)
    assert space.parse_weights("color=.4,shape=.6") == {"color": 0.4, "shape": 0.6}


def small_space(spark, weights=None):
    rows = spark.createDataFrame([(i, f"g{i % 2}", "b", None if i == 3 else "L", [float(i), 1.0], [float(i % 3), float(i)]) for i in range(12)], "image_id long, genus string, group_label string, license string, a array<double>, b array<double>")
    return space.FeatureSpace(rows, {"a": "l1", "b": "l2", "absent": "l1"}, weights=weights or {"a": 0.5, "b": 0.5}).fit()


def test_space_and_search(spark):
    s = small_space(spark)
    assert s.sets == ["a", "b"]
    assert s.stats["a"]["std"][1] == 1.0  # a constant dimension
    got = search.top_k(s, {"a": [2.0, 1.0], "b": [2.0, 2.0]}, k=50, exclude=[2]).collect()
    assert len(got) == 11 and [r["rank"] for r in got] == list(range(1, 12))
    assert [r["distance"] for r in got] == sorted(r["distance"] for r in got)
    assert search.top_k(s, {"a": [2.0, 1.0]}, filters={"license": [""]}).first()["image_id"] == 3
    assert search.top_k(s, {"a": [2.0, 1.0]}, filters={"genus": ["none"]}).count() == 0
    assert search.per_set(s, search.top_k(s, {"a": [2.0, 1.0]})).count() == 5
    assert set(search.results_table(s, search.top_k(s, {"a": [2.0, 1.0]})).columns) == {"rank", "image_id", "similarity", "distance", "a"}
    assert "sim=" in search.explain_text(s, search.top_k(s, {"a": [2.0, 1.0]})).first()["line"]
    with pytest.raises(ValueError):
        space.FeatureSpace(s.items, {"absent": "l1"})
    with pytest.raises(ValueError):
        s.checked(spark.createDataFrame([(1, 2.0)], "image_id long, c double"))


def test_batch_agrees_with_single(spark):
    s = small_space(spark)
    rows = {(r["qid"], r["rank"]): r["id"] for r in search.batch_top_k(s, s.items.withColumnRenamed("image_id", "qid"), 3, query_block=5).collect()}
    for r in s.items.collect():
        one = search.top_k(s, {"a": r["a"], "b": r["b"]}, 3, exclude=[r["image_id"]]).collect()
        assert [rows[r["image_id"], k + 1] for k in range(3)] == [x["image_id"] for x in one]


def test_metrics(spark):
    labels = spark.createDataFrame([(0, "x", "p"), (1, "x", "p"), (2, "y", None), (3, "x", "p"), (4, "y", "p"), (5, "y", "p")], "image_id long, genus string, group_label string")
    found = spark.createDataFrame([(0, k + 1, i) for k, i in enumerate([1, 2, 3, 4, 5])], "qid long, rank int, id long")
    m = evaluate.query_metrics(found, labels).first()
    assert m["ap_at_k"] == pytest.approx((1 + 2 / 3) / 2) and m["p_at_k"] == 0.4 and m["p_at_1"] == 1


def test_rocchio(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "image_id long, a array<double>")
    s = space.FeatureSpace(rows, {"a": "l2"})
    marks = spark.createDataFrame([(0, True), (1, False), (77, True)], "image_id long, relevant boolean")
    assert feedback.rocchio(s, {"a": [1.0, 0.0]}, marks).first()["vector"] == pytest.approx([0.5, 1 / 3])
    assert feedback.rocchio(s, {"a": [1.0, 0.0]}, marks.filter("relevant")).first()["vector"] == pytest.approx([1 / 1.75, 0.75 / 1.75])


def test_tiles(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)]) for i in range(100)], "image_id long, z array<double>")
    n = sorted(r["n"] for r in index.tile_boxes(index.sort_tiles(rows, 2), 2).collect())
    assert n == [2, 2] + [16] * 6
    assert index.tree_height(627) == 3
    few = index.sort_tiles(rows.filter("image_id < 20"), 2)
    assert sorted(r["n"] for r in index.tile_boxes(few, 2).collect()) == [10, 10]


def test_quad(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "image_id long, z array<double>")
    assert {r["cell"].split(":")[0] for r in index.quad_cells(same).collect()} == {"16"}
    spread = spark.createDataFrame([(i, [float(i % 3), float(i // 3)]) for i in range(9)], "image_id long, z array<double>")
    assert {r["cell"].split(":")[0] for r in index.quad_cells(spread).collect()} == {"1"}


def test_cluster_order(spark):
    sizes = spark.createDataFrame(list(enumerate([3, 2, 70, 5])), "cluster_id int, size long")
    centers = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "cluster_id int, center array<double>")
    got = index.cluster_order(centers, sizes, vec(0), 60).collect()
    assert len(got) == 3 and sum(r["size"] for r in got) == 75


def test_rules(spark):
    def reason(title, w, h, mime="image/jpeg", cats=()):
        c = F.array(*map(F.lit, cats)) if cats else F.array().cast("array<string>")
        return value(spark, rules.accept_reason(F.lit(title), F.lit(mime), F.lit(w), F.lit(h), c))

    assert reason("A tree", 1600, 1000) == "ok"
    assert reason("A tree", 639, 900) == "small"
    assert reason("A palm tree", 900, 900) == "badword"
    assert reason("A tree", 900, 900, "image/gif") == "mime"
    assert reason("A tree", 900, 900, None) == "no-imageinfo"
    assert reason("A tree", 2000, 900) == "aspect"
    assert reason("Cocos", 900, 900) == "palm"

    def priority(*cats):
        return value(spark, rules.source_priority(F.array(*map(F.lit, cats))))

    assert priority("Category:Solitary Quercus robur") == 0
    assert priority("Category:Solitary trees") == 2
    assert priority("Category:Solitary trees by country") == 0
    assert priority("Category:Named individual trees by species") == 4
    gate = lambda c, x, y, m: value(spark, rules.gate_reason(F.lit(c), F.lit(x), F.lit(y), F.lit(m)))
    assert gate(0.04, 0.30, -0.30, "segformer") is None
    assert gate(0.01, 0.0, 0.0, "default_rect") == "no-tree"
    assert gate(0.01, 0.0, 0.0, "segformer") == "coverage"


def test_greedy_dedup(spark):
    base = 0b1010101
    chain = [base, base ^ 0b111111 << 10, base ^ 0b111111 << 10 ^ 0b111111 << 30]
    rows = spark.createDataFrame(list(enumerate([*chain, base])), "id long, h long")
    assert sorted(r["id"] for r in ingest.greedy_dedup(rows, "id", "h").collect()) == [0, 2]


def test_holdout(spark):
    rows = spark.range(25).withColumnRenamed("id", "k")
    assert [r["k"] for r in ingest.holdout_pick(rows, 10, "k", F.lit(True)).orderBy("k").collect()] == [math.floor(i * 24 / 9) for i in range(10)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "CC0", None), (2, "b", None, None)], "image_id long, filename string, license string, ingested_at timestamp")
    new = spark.createDataFrame([("a", None), ("c", "BY")], "filename string, license string")
    got = {r["filename"]: r for r in store.upsert_images(old, new).collect()}
    assert got["a"]["license"] == "CC0" and got["a"]["ingested_at"] is not None and got["a"]["image_id"] == 1
    assert got["b"]["ingested_at"] is None and got["c"]["image_id"] == 3


def test_rocchio_takes_all_marks(spark):
    rows = spark.range(120_000).select(F.col("id").alias("image_id"), F.array(F.col("id").cast("double")).alias("a"))
    s = space.FeatureSpace(rows, {"a": "l1"}, weights={"a": 1.0})
    marks = rows.select("image_id", (F.col("image_id") % 2 == 0).alias("relevant"))
    good, bad = 119_998 / 2, 120_000 / 2
    assert feedback.rocchio(s, {"a": [1.0]}, marks).first()["vector"] == pytest.approx([(1 + 0.75 * good - 0.25 * bad) / 1.5])


def test_bounds_leave_the_nearest(spark):
    """The search that bounds distances finds what all distances give, in far more than one tile: copies, ties, far and zero rows among them."""
    rng = np.random.default_rng(3)
    n, dims = 3000, {"a": 24, "b": 16, "c": 12}
    v = {s: rng.normal(size=(n, d)) + np.arange(n)[:, None] % 3 for s, d in dims.items()}
    for x in v.values():
        x[1000:1100], x[2000:2200], x[7], x[8] = x[:100], x[5], 0, x[8] * 1e6
    rows = spark.createDataFrame([(i, *(v[s][i].tolist() for s in dims)) for i in range(n)], "image_id long, a array<double>, b array<double>, c array<double>")
    for weights in ({"a": 0.3, "b": 0.3, "c": 0.4}, {"a": 1.0}, {"c": 1.0}, {"a": 1.5, "c": -0.5}):
        plain = {"b": {"mean": [0.5] * 16, "std": [2.0] * 16}}
        s = space.FeatureSpace(rows, {"a": "l1", "b": "l2", "c": "cosine"}, weights=weights, stats=plain, scales={"a": 27.0, "b": 5.0, "c": 1.0})
        asked = rows.filter("image_id % 10 = 7 or image_id in (5, 8, 1005)").withColumnRenamed("image_id", "qid")
        got = {(r["qid"], r["rank"]): (r["id"], r["distance"]) for r in search.batch_top_k(s, asked, 6, query_block=100).collect()}
        assert len(got) == 6 * 303
        for q in {q for q, _ in got}:
            z = v["b"] / 2
            cos = 1 - v["c"] @ v["c"][q] / ((np.linalg.norm(v["c"], axis=1) + 1e-8) * (np.linalg.norm(v["c"][q]) + 1e-8))
            d = s.weights["a"] * np.abs(v["a"] - v["a"][q]).sum(1) / 27 + s.weights["b"] * np.sqrt(np.square(z - z[q]).sum(1)) / 5 + s.weights["c"] * cos
            d[q] = np.inf
            best = np.lexsort((np.arange(n), np.round(d, 9)))[:6]
            assert [got[q, r + 1][1] for r in range(6)] == pytest.approx(d[best].tolist(), abs=1e-8)
            assert all(got[q, r + 1][0] == i or abs(d[got[q, r + 1][0]] - d[i]) < 2e-9 for r, i in enumerate(best))


def test_sets_of_no_weight_are_not_compared(spark):
    rows = spark.createDataFrame([(i, [float(i)], [float("nan")]) for i in range(9)], "image_id long, a array<double>, b array<double>")
    s = space.FeatureSpace(rows, {"a": "l1", "b": "l1"}, weights={"a": 1.0}, scales={"a": 1.0, "b": 1.0})
    got = {r["qid"]: (r["id"], r["distance"]) for r in search.batch_top_k(s, rows.withColumnRenamed("image_id", "qid"), 1).collect()}
    assert got == {i: (max(0, i - 1) if i else 1, 1.0) for i in range(9)}


def test_candidates_are_ranked_in_one_pass(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(150)], "image_id long, a array<double>")
    s = space.FeatureSpace(rows, {"a": "l1"}, weights={"a": 1.0}, scales={"a": 1.0})
    got = {(r["qid"], r["rank"]): r["id"] for r in search.component_top_k(s, rows.withColumnRenamed("a", "z"), 2, 3, 10).collect()}
    v = {r[0]: r[1] for r in rows.collect()}
    for q in v:
        pool = sorted((sum((x - y) ** 2 for x, y in zip(v[q][:2], v[i][:2], strict=True)), i) for i in v if i != q)[:10]
        near = sorted((sum(abs(x - y) for x, y in zip(v[q], v[i], strict=True)), i) for _, i in pool)[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [i for _, i in near]


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
@pytest.mark.parametrize("dims", [1, 3, 24, 30])
def test_one_set_alone_against_brute_force(metric, dims):
    """Bounds of a set alone lose no neighbour: near copies, ties, outliers on either side, tiles and queries of odd numbers, steps of four dimensions and less."""
    rng = np.random.default_rng(dims)
    x = np.concatenate([c + 0.02 * rng.normal(size=(1100, dims)) for c in rng.normal(size=(3, dims))] + [rng.normal(size=(37, dims)) * 50, np.zeros((3, dims)), np.full((1, dims), 1e6)])
    x = np.concatenate([x, x[:400], x[100:300]])[rng.permutation(len(x) + 600)]
    q = np.concatenate([x[:130], x[:20] + 0.001, rng.normal(size=(5, dims)) * 3])
    ids, qid = rng.permutation(len(x)), np.arange(len(q)) + 10**6
    table = lambda name, at, v: pa.table({name: pa.array(at), "s": pa.array(list(v), pa.list_(pa.float64()))})
    near = search.Bounded({"s": metric}, {"s": 1.7}, {"s": (np.zeros(dims), np.ones(dims))} if metric == "l2" else {})
    for own in (slice(0, len(q)), slice(0, 61)):
        (got,) = search._nearest(table("qid", qid, q)[own], [near], 5, True)(iter(table("id", ids, x).to_batches(1500)))
        want = []
        for k in range(len(q))[own]:
            d = near.exact({"s": q}, {"s": x}, np.full(len(x), k), np.arange(len(x)))
            want += [(qid[k], ids[j]) for j in np.lexsort((ids, np.round(d, search.TIE)))[:5]]
        assert [tuple(r.values()) for r in got.select(["qid", "id"]).to_pylist()] == want


def test_items_are_read_once_for_many_queries(spark):
    """5,000 queries are one block, so items pass once."""
    items = spark.range(5000).select(F.col("id").alias("image_id"), F.array(*[F.rand(k) for k in range(3)]).alias("color"))
    alone = space.FeatureSpace(items, {"color": "l1"}, weights={"color": 1.0}, scales={"color": 1.0})
    plan = search._streamed(alone, items.withColumnRenamed("image_id", "qid"), 5)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1
