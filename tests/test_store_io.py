import json

from pyspark.sql import functions as F

from kindred.operators import ingest, store
from kindred.sources import files, paged
from kindred.streaming import ingest as streaming


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    for t in store.SCHEMAS:
        store.create(spark, root, t)
        store.create(spark, root, t)
        assert spark.read.parquet(f"{root}/{t}").schema == store.struct_of(t)


def test_partitions(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "index_name string, image_id long")
    new = spark.createDataFrame([("x", 9)], "index_name string, image_id long")
    assert sorted(map(tuple, store.replace_partition(a, new, "index_name").collect())) == [("x", 9), ("y", 3)]
    path = str(tmp_path / "t")
    store.write_partitions(a, path, "index_name")
    store.write_partitions(new, path, "index_name")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("index_name", "image_id").collect()) == [("x", 9), ("y", 3)]
    assert store.cascade(a, new.select("image_id").union(a.select("image_id").limit(1))).count() == 2


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.createDataFrame([("linear", 1.0)], "backend string, elapsed_ms double")
    store.append_log(log, path)
    store.append_log(log, path)
    assert spark.read.parquet(path).select("query_id").distinct().count() == 2


def test_csv_and_json(spark, tmp_path):
    row = (1, "f", "t", "p", "d", 10, 20, "au, \"q\"", "CC0", "Quercus", "broadleaf", ["a", "b"])
    df = spark.createDataFrame([row], files.RAW_MANIFEST.replace("categories string", "categories array<string>"))
    files.write_csv(df, str(tmp_path / "csv"))
    assert tuple(files.read_csv(spark, str(tmp_path / "csv"), files.RAW_MANIFEST).first()) == row
    files.write_json(df, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), whole_file=False).first()["categories"] == ["a", "b"]


def test_paged_members():
    answers = [{"query": {"categorymembers": [{"title": "a"}]}, "continue": {"cmcontinue": "1"}}, {"query": {"categorymembers": [{"title": "b"}]}}]
    asked = []

    def fetch(p):
        asked.append(p)
        return answers[len(asked) - 1]

    assert list(paged.members(fetch, "Category:X", "file")) == ["a", "b"]
    assert asked[1]["cmcontinue"] == "1"


def test_lookup(spark):
    def _fetch(p):
        return {"query": {"pages": {str(i): {"title": t, "n": len(t)} for i, t in enumerate(p["titles"].split("|")) if t != "none"}}}

    got = {r["title"]: r["info"] for r in paged.lookup(spark.createDataFrame([("aa",), ("none",)], "title string"), _fetch).collect()}
    assert '"n": 2' in got["aa"] and got["none"] is None


def test_lookup_that_continues(spark):
    def _fetch(p):
        assert "categories" in p["prop"]
        c = "c2" if "clcontinue" in p else "c1"
        page = {"title": "aa", "categories": [{"title": c}]} | ({} if c == "c2" else {"imageinfo": [{"width": 5}]})
        return {"query": {"pages": {"1": page}}} | ({"continue": {"clcontinue": "x", "continue": "-"}} if c == "c1" else {})

    info = json.loads(paged.lookup(spark.createDataFrame([("aa",)], "title string"), _fetch).first()["info"])
    assert [c["title"] for c in info["categories"]] == ["c1", "c2"] and info["imageinfo"] == [{"width": 5}]


def test_crawl_enters_no_bad_seeds(spark):
    edges = spark.createDataFrame([("a", "b"), ("Museum x", "c"), ("b", "museum y")], "parent string, child string")
    got = {r["node"]: r["left"] for r in ingest.crawl(edges, [("a", 2), ("Museum x", 2)], bad="museum").collect()}
    assert got == {"a": 2, "b": 1}


def test_latest_wins_is_determined(spark):
    old = spark.createDataFrame([(1, "x", 0)], "k long, v string, t int")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "k long, v string, t int").repartition(3)
    assert store.latest_wins(old, new, "k", order="t").first()["v"] == "b"


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(src)
    q = streaming.upsert_stream(streaming.file_stream(spark, src, "k long, v string"), str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    q.awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string").write.mode("append").parquet(src)
    q = streaming.upsert_stream(streaming.file_stream(spark, src, "k long, v string"), str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "v-1")).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "v", 1.0), ("2024-01-01 00:50:00", "v", 2.0), ("2024-01-01 01:00:00", "v", 4.0)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r["n"], r["value"]) for r in streaming.windowed_counts(e, "ts", "k").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]


def test_many_partitions_are_replaced(spark):
    old = spark.range(120_000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    new = spark.range(5, 120_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    got = store.replace_partition(old, new, "k").groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {0: 5, 1: 119_995}


def test_upserts_number_new_keys(spark):
    old = spark.createDataFrame([(7, "b", "x", None), (3, "a", None, None)], "image_id long, filename string, license string, ingested_at timestamp")
    new = spark.createDataFrame([("z", "n"), ("a", None), ("c", None), ("b", "y")], "filename string, license string")
    got = {r["filename"]: (r["image_id"], r["license"], r["ingested_at"] is not None) for r in store.upsert_images(old, new).collect()}
    assert got == {"a": (3, None, True), "b": (7, "y", True), "c": (8, None, True), "z": (9, "n", True)}
    assert store.upsert_images(old.limit(0), new).count() == 4


def test_rebuild_and_sizes(spark, tmp_path):
    root = str(tmp_path)
    spark.range(5).select(F.col("id").alias("image_id")).write.parquet(f"{root}/images")
    store.rebuild(spark, root)
    assert spark.read.parquet(f"{root}/images").count() == 0
    sizes = {r["table"]: (r["files"], r["bytes"]) for r in store.size_on_disk(spark, root).collect()}
    held = [p for p in (tmp_path / "images").iterdir() if p.suffix == ".parquet"]
    assert set(sizes) == set(store.SCHEMAS) and sizes["images"] == (len(held), sum(p.stat().st_size for p in held))


def test_download(spark, tmp_path):
    (tmp_path / "there").write_bytes(b"x" * 11_000)
    (tmp_path / "short").write_bytes(b"x")
    rows = [(f"http://host/{n}", str(tmp_path / n)) for n in ("there", "short", "bad")]

    def _fetch(url):
        if url.endswith("bad"):
            raise OSError(url)
        return b"new"

    got = {r["url"][12:]: r["done"] for r in paged.download(spark.createDataFrame(rows, "url string, file string"), _fetch, pause=0).collect()}
    assert got == {"there": True, "short": True, "bad": False}
    assert len((tmp_path / "there").read_bytes()) == 11_000 and (tmp_path / "short").read_bytes() == b"new" and not (tmp_path / "bad").exists()
