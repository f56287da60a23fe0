import pyarrow as pa

import corpus_pipeline as P
from kindred.llm import common, packing, quality

from .test_dedup import linked, removed


def test_stages_against_brute_force(spark, tmp_path):
    d = str(tmp_path)
    clean = [(i, f"{' '.join(f'w{i}x{k}' for k in range(80))}", "en", "ab"[i % 2], 0) for i in range(40)]
    passage = " ".join(f"p{k}" for k in range(60))
    clean += [(50 + i, f"{' '.join(f'u{i}x{k}' for k in range(200))} {passage}", "en", "a", 0) for i in range(4)]
    copies = [(100 + i, clean[i][1], "en", "b", 0) for i in range(3)] + [(110, clean[5][1] + " tail", "en", None, 0)]
    junk = [(200 + i, " ".join(f"j{i}x{k}***" for k in range(60)), "en", "a", 0) for i in range(20)] + [(300, None, "en", "a", 0), (301, "", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(clean + copies + junk, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in clean] + [(r[0], 0) for r in junk], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    docs = common.read(spark, d, "documents")
    one = common.materialise(P.quality_rules(spark, docs, d), "t")
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(r[0] for r in clean + copies)
    two = common.materialise(P.near_duplicates(spark, one, d), "t")
    groups = linked([(r[0], r[1]) for r in clean + copies], 5, 80)
    kept = sorted(k for k, (_, c) in groups.items() if k == c)
    assert sorted(r["doc_id"] for r in two.collect()) == kept == sorted(r[0] for r in clean)
    three = common.materialise(P.repeated_passages(spark, two, d), "t")
    want = removed([(r[0], r[1]) for r in clean], 100)
    assert {r["doc_id"]: len(r["text"].encode()) for r in three.collect()} == {k: v[0] - v[1] for k, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in three.filter("doc_id > 50").collect())
    four = common.materialise(P.mixed_sources(spark, three, d), "t")
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    words = sum(len(r["text"].split()) for r in three.collect())
    assert abs(sum(len(r["text"].split()) for r in four.collect()) - 1.5 * words) <= 2
    five = P.packed_sequences(spark, four, d).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in five}) == len(five) and max(r["offset"] + r["length"] for r in five) <= 1024
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None and quality.BASE


def test_verdicts_are_of_rows(spark, tmp_path):
    """Rows that repeat an id, and several null ids, stay or go one by one."""
    d = str(tmp_path)
    text = lambda x, n=80: " ".join(f"w{x}y{k}" for k in range(n))
    junk = " ".join(f"j{k}***" for k in range(5))
    data = [(7, text(7)), (7, text(7)), (8, text(8)), (8, text(9)), (9, text(10)), (9, junk), (None, text(11)), (None, text(8) + " tail"), (None, text(11)), (None, None), (None, junk)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(8, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    flat = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()), key=str)
    one = common.materialise(P.quality_rules(spark, docs, d), "t")
    assert flat(one) == sorted([(i or 0, t) for i, t in data if t and t != junk], key=str)
    two = P.near_duplicates(spark, one, d)
    assert flat(two) == sorted([(7, text(7)), (8, text(8)), (8, text(9)), (9, text(10)), (0, text(11))], key=str)
    assert docs.columns == one.columns == two.columns


def test_workers_forget_words(spark):
    """Once documents are packed, no Python worker holds the tokeniser and its cached words."""
    docs = spark.createDataFrame([(i, f"of {i} words and more {i * i}") for i in range(400)], "doc_id long, text string").repartition(8)
    assert packing.pack_documents(docs, packing.vocabulary()).count() == 400

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing.word_cache.cache_info().currsize] * b.num_rows, pa.int64())], ["n"])

    assert {r["n"] for r in spark.range(0, 32, 1, 32).mapInArrow(held, "n long").collect()} == {0}
