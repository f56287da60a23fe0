import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import fingerprints, licenses, mixing, packing, quality, sharding, warc

from .helpers import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>" + "x" * 200 + "</p>"] * 3 + [None, "", "short", "short", "<b>日本</b>" * 50] + ["y%d" % i * 90 for i in range(20)]
    pages = spark.createDataFrame([(i, f"http://a/{i} é%", h, "d", 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest string, first int").repartition(3)
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    for split in (97, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_warc(spark, files, split_bytes=split).collect()}
        assert len(got) == len(html)
        for i, h in enumerate(html):
            revisit = i in (1, 2)
            assert got[i]["record_type"] == ("revisit" if revisit else "response") and got[i]["refers_to"] == (0 if revisit else None)
            assert got[i]["payload_bytes"] == len((h or "").encode()) and got[i]["url"] == f"http://a/{i} é%"
            assert revisit or got[i]["payload"] == (h or "").encode()
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/none") is not None
    assert warc.read_warc(spark, []).count() == 0


def test_warc_odd_ids_and_urls(spark, tmp_path):
    long = "z" * 150
    data = [(None, "http://a/\u00a0", long), (3, "http://b/\u3000", long), (3, " \t", long), (1, "http://c/\x85", ""), (1, None, None), (7, "", "q" * 100)]
    files = warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["record_type"], r["refers_to"] or 0) for r in warc.read_warc(spark, files, split_bytes=300).collect()))
    assert got == sorted([(0, data[0][1], "revisit", 3), (3, data[1][1], "response", 0), (3, " \t", "response", 0), (1, data[3][1], "response", 0), (1, "", "response", 0), (7, "", "response", 0)])


def test_warc_chance_magic(tmp_path):
    records = [warc.encode_record(i, None, bytes([0x1F, 0x8B, 0x08]) * 50 + np.random.default_rng(i).bytes(5000), "d", None, False) for i in range(5)]
    data = warc.MAGIC + b"junk" + b"".join(records)
    (tmp_path / "a").write_bytes(data)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(f"file://{tmp_path}/a")
    with store.open_input_file(name) as f:
        ids = [r["named"]["warc-record-id"] for at in range(0, len(data), 501) for r in warc.scan_range(f, len(data), at, min(len(data), at + 501))]
    assert ids == [f"<urn:page:{i}>" for i in range(5)]


def test_mixing(spark):
    data = rows()
    got = mixing.mix_plan(frame(spark, data)).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in data}
    assert {r["doc_id"]: r["size"] for r in got} == size
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for v in by.values():
        assert sum(r["taken"] for r in v) == int(v[0]["target"]) and v[0]["target"] <= 2 * v[0]["source_size"]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * sum(size.values()))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(frame(spark, data[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    mixed = mixing.mix_documents(frame(spark, data))
    assert mixed.columns == frame(spark, data).columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in words.items() if v} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mixing_repeated_and_null_ids(spark):
    data = [(1, "a b c d", "s"), (1, "e f", "s"), (None, "g h i", "s"), (None, None, None), (None, "j", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    assert sorted(r["size"] for r in plan) == [0, 1, 2, 3, 4]
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns and sum(len((r["text"] or "").split()) for r in got.collect()) == sum(r["taken"] for r in plan)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_sharding_many_pairs_and_null_ids(spark):
    data = [(i // 2 if i % 3 else None, f"document {i // 2:04d}") for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 3000 and len({(r["shard"], r["slot"]) for r in got}) == 3000
    sizes, rows_ = Counter(), Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        rows_[r["shard"]] = max(rows_[r["shard"]], r["slot"] + 1)
    assert sum(rows_.values()) == 3000 and max(sizes.values()) - min(sizes.values()) <= 2 * 14 * 2
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_targets(spark):
    t = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 100)], "source string, total long")).collect()}
    assert t == {"a": 20.0, "b": pytest.approx(1445.0), None: 200.0}


def test_sharding(spark):
    data = rows() + [(500 + i, "same text again", "", "", "", "", 0) for i in range(300)]
    got = {r["doc_id"]: r for r in sharding.shard_documents(frame(spark, data)).collect()}
    sizes = [0] * 8
    slots = [[] for _ in range(8)]
    for d, t, *_ in data:
        r = got[d]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    most = max(r["size"] for r in got.values())
    assert max(abs(s - sum(sizes) / 8) for s in sizes) <= most
    homes = {}
    for d, t, *_ in data[:60]:
        homes.setdefault(t, []).append(got[d])
    together = [v for v in homes.values() if sum(r["size"] for r in v) <= most]
    assert any(len(v) > 1 for v in together) and all(len({r["shard"] for r in v}) == 1 for v in together)


def test_statistics(spark):
    again = "a b c d e f g h i j"
    data = rows() + [(900, f"{again} x {again}\n{again}\nq\n\nq\n #|", "", "", "", "", 0)]

    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = set()
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    got = {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in quality.text_statistics(frame(spark, data)).collect()}
    assert got == {r[0]: brute(r[1]) for r in data}


def test_rules_are_learned(spark):
    good = dict.fromkeys(quality.FEATURES, 0.5)
    sample = [good | {"symbol_ratio": 0.01 * (i % 5), "bad": False} for i in range(300)] + [good | {"symbol_ratio": 0.3, "upper_ratio": 0.1 * (i % 3), "bad": True} for i in range(60)]
    rules = quality.learn_rules(sample)
    assert len(rules) == 1 and all(rules[0].covers(r) == r["bad"] for r in sample)
    assert quality.learn_rules([]) == [] and quality.learn_rules(sample[:300]) == []


def test_quality_verdicts(spark):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(60)), "", "", "", "", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"word{i}x{k}***" for k in range(60)), "", "", "", "", 0) for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)] + [(None, 0), (5000, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(frame(spark, clean + junk + [(999, None, "", "", "", "", 0)]), labels).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk) and got[999] is False
    assert quality.judge_quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_fingerprints(spark):
    data = [*rows(), (7, "one", "", "", "", "", 0), (None, "z", "", "", "", "", 0)]
    got = fingerprints.fingerprint_with_next(frame(spark, data)).collect()
    assert len(got) == len(data)
    order = sorted(data, key=lambda r: (-(r[0] if r[0] is not None else -1), (r[1] or "").encode()))
    want = Counter()
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        want[r[0], len(t), t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    seen = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["n_chars"] <= 1:
            assert r["near_edited"] == 1
    texts = {r[0]: r[1] or "" for r in data if r[0] is not None and r[0] != 7}
    for r in got:
        if r["doc_id"] in texts:
            assert seen.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_follow_edits(spark):
    words = [f"w{i % 90}" for i in range(400)]
    edits = [" ".join(words), " ".join([*words[:200], "new", *words[201:]]), " ".join(words[200:] + words[:200]), " ".join(sorted(words)), " ".join(f"v{i}" for i in range(400))]
    df = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(edits)), "i int, t string"), "t", "fp").orderBy("i")
    base = df.filter("i = 0").select(F.col("fp").alias("b"))
    near = [r["x"] for r in df.crossJoin(base).select("i", fingerprints.likeness(F.col("fp"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert near[0] == 1 and 0.8 < near[1] <= 1 and near[2] < near[1] and near[3] < near[2] and near[4] == 0


def signature(text):
    """Order MinHash by the plain rule: per slot the two k-mers that follow its point, in the order of the text."""
    words = WORD.findall(text)
    if any(len(w) > 64 for w in words):
        words = [x for w in words for x in ([w[i : i + 8] for i in range(len(w) - 7)] if len(w) > 64 else [w])]

    def hashed(*parts):
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else int(x).to_bytes(8, "little", signed=True), seed=h)
        return h

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    names = [signed(hashed(a, b)) >> 24 for a, b in zip(words, words[1:], strict=False)] or ([signed(hashed(text)) >> 24] if text else [])
    seen, ranked = Counter(), []
    for place, name in enumerate(names):
        ranked.append(((hashed(name, seen[name]) >> 25 << 24) + place, place))
        seen[name] += 1
    ranked.sort()
    out = []
    for slot in range(64) if ranked else ():
        i = next((k for k, (r, _) in enumerate(ranked) if r >> 57 >= slot), 0)
        pair = sorted((ranked[i], ranked[(i + 1) % len(ranked)]), key=lambda x: x[1])
        out.append((slot << 32) + (hashed(*[r >> 24 for r, _ in pair]) & 0xFFFFFFFF))
    return out


def test_signatures_against_the_rule(spark):
    rng = np.random.default_rng(6)
    texts = [r[1] for r in rows(20)] + ["a b", "a a a a", " ", "x" * 300, " ".join(f"w{k}" for k in rng.integers(0, 40, 900)), "".join(map(chr, rng.integers(97, 123, 200))) + " tail"]
    got = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "fp").collect()
    assert {r["i"]: r["fp"] for r in got} == {i: signature(t or "") for i, t in enumerate(texts)}


def test_fingerprints_of_text_without_spaces(spark):
    t = "".join(map(chr, np.random.default_rng(8).integers(97, 123, 3000)))
    df = fingerprints.with_fingerprint(spark.createDataFrame([(t, "x" + t)], "t string, u string"), "t", "a")
    assert fingerprints.with_fingerprint(df, "u", "b").select(fingerprints.likeness(F.col("a"), F.col("b"))).first()[0] >= 0.8


@pytest.mark.parametrize("ids", [[*range(1200), 1 << 40], [f"d{i:05d}" for i in range(1300)], [None] * 700 + [5] * 600])
def test_next_documents_by_any_ids(spark, ids):
    kind = "string" if isinstance(ids[0], str) else "long"
    docs = spark.createDataFrame([(d, f"{i:05d} text") for i, d in enumerate(ids)], f"doc_id {kind}, text string")
    got = Counter((r["doc_id"], r["edited"]) for r in fingerprints.fingerprint_with_next(docs).collect())
    order = sorted(enumerate(ids), key=lambda x: (x[1] is not None, x[1] if x[1] is not None else 0), reverse=True)
    if ids[0] is None:
        order = sorted(enumerate(ids), key=lambda x: (x[1] is None, x[0]))
    want = Counter((d, f"{i:05d} text"[:5] + f"{order[(k + 1) % len(order)][0]:05d} text"[:5]) for k, (i, d) in enumerate(order))
    assert got == want


def test_fingerprints_empty(spark):
    assert fingerprints.fingerprint_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licenses(spark):
    texts = ["Nothing here", None, "", "x " * 50 + "Released under the MIT License. " + "y " * 30, "ALL RIGHTS reserved!", "licensed under cc by-nc 4.0", "under the MIT", licenses.TEMPLATES["BSD-text"].replace("binary", "b")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(frame(spark, [(i, t, "", "", "", "", 0) for i, t in enumerate(texts)])).collect()}
    assert set(got) == {(3, "MIT"), (4, "reserved"), (5, "CC-BY-NC-4.0"), (7, "BSD-text")}
    assert got[3, "MIT"]["first_word"] == 50 and 0.8 <= got[7, "BSD-text"]["containment"] < 1
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    assert licenses.scan_licenses(frame(spark, rows()), {}).count() == 0


def test_packing(spark):
    path = packing.vocabulary()
    data = [*rows(), (901, "word " * 3000, "", "", "", "", 0), (902, "a\x1cb <|endoftext|> it's 12 日本語  \n\n x", "", "", "", "", 0)]
    got = packing.pack_documents(frame(spark, data), path, keep_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    by, held = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, text, *_ in data:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[d], key=lambda r: r["piece"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == ids
        assert all(r["length"] == 1024 for r in pieces[1:]) and pieces[0]["length"] <= 1024
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in pieces)
    for v in held.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = dict(Counter(np.clip(rng.lognormal(5.2 + seed / 4, 1, 4000).astype(int), 1, 1024).tolist()))
    plan = packing.plan_packing(histogram)
    held = Counter()
    for lengths, m in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            held[n] += m
    assert held == Counter(histogram)
    assert sum(m for _, m in plan) <= 1.02 * sum(n * m for n, m in histogram.items()) / 1024 + 2


@pytest.mark.parametrize("histogram", [{s: 1 for s in range(3, 1024, 3)}, {341: 100, 683: 100, 500: 10}, {700: 500, 600: 500, 5: 3000, 9: 1000}, {1: 7}, {400: 1000, 300: 1000, 324: 1000}])
def test_plans_come_near_the_bound(histogram):
    """As few sequences as all tokens, or all pieces beyond half a sequence, need."""
    plan = packing.plan_packing(histogram)
    assert sum(m for _, m in plan) == max(-(-sum(n * m for n, m in histogram.items()) // 1024), sum(m for n, m in histogram.items() if n > 512))


def test_configurations_bound():
    """Fractional uses lie between the lower bound and little more, and keep to the counts."""
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 1024, 60))
    counts = rng.integers(1, 500, len(sizes))
    used, bound = packing.solve_configurations(sizes, counts, 1024)
    configs = np.array([np.frombuffer(k, np.int16) for k in used], np.int64)
    covered = np.array(list(used.values())) @ configs / counts
    assert (configs @ sizes <= 1024).all() and (configs <= counts).all()
    assert bound >= (sizes * counts).sum() / 1024 * 0.99 and bound <= sum(used.values()) / covered.min() <= 1.15 * bound


@pytest.mark.parametrize(("histogram", "most"), [({1: 100_000}, 98), ({5: 50_000}, 248), ({9: 50_000}, 445), ({600: 3000, 200: 6000}, 3000), ({600: 10, 200: 15}, 10)])
def test_plans_fill_gaps(histogram, most):
    plan = packing.plan_packing(histogram)
    held = Counter()
    for lengths, m in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            held[n] += m
    assert held == Counter(histogram)
    assert sum(m for _, m in plan) <= most


def test_licenses_by_brute_force(spark):
    """Templates back to back, in pieces and edited: the windows compared one by one, and each planted place that keeps enough."""
    rng = random.Random(4)
    words = {n: re.findall(r"[^\W_]+", t.lower()) for n, t in licenses.TEMPLATES.items()}
    shingles = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    texts, planted = [], []
    for doc in range(150):
        out = []
        for _ in range(rng.randrange(1, 7)):
            name = rng.choice(list(words))
            own = words[name][:]
            for _ in range(rng.randrange(0, 1 + len(own) // 8)):
                own[rng.randrange(len(own))] = rng.choice(["edited", "license", "the"])
            if len(set(shingles(own)) & set(shingles(words[name]))) >= 0.8 * len(set(shingles(words[name]))):
                planted.append((doc, name))
            out += own + ["filler"] * rng.choice([0, 0, 1, 9, 40])
        texts.append(" ".join(out))
    want = {}
    for doc, text in enumerate(texts):
        h = shingles(text.split())
        for name, w in words.items():
            known, width = set(shingles(w)), 1 << max(2, (len(w) - 1).bit_length())
            for s in range(0, len(h) + 1, width):
                window = h[s : s + 2 * width]
                share = len(known & set(window)) / len(known)
                if share >= 0.8:
                    at = s + next(i for i, x in enumerate(window) if x in known)
                    best = want.get((doc, name), (0, 0))
                    want[doc, name] = max(best, (share, -at)) if best != (0, 0) else (share, -at)
    got = {(r["doc_id"], r["license"]): (r["containment"], -r["first_word"]) for r in licenses.scan_licenses(frame(spark, [(i, t, "", "", "", "", 0) for i, t in enumerate(texts)])).collect()}
    assert got == want and set(planted) <= set(got) and len(planted) > 200
