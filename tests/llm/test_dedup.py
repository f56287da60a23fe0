import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import components, jaccard_join, suffix_dedup

from .helpers import SCHEMA, frame, rows


def removed(data, length):
    seen, out = set(), {}
    for d, t in sorted(data):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_removed_bytes(spark, crowd):
    data = rows()
    got = suffix_dedup.remove_repeats(frame(spark, data), length=40, gram=8, crowd=crowd)
    got = got.withColumn("sha", F.sha2(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.coalesce("text", F.lit("")).cast("binary")), 256))
    want = removed([(r[0], r[1]) for r in data], 40)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in got.collect()} == want


def test_long_documents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONGEST", 200)
    rng = random.Random(1)
    x = np.array([rng.randint(97, 99) for _ in range(3000)], np.uint8)
    found = []
    for i, low, high, ends in suffix_dedup._pieces(np.array([0, 3000]), 30):
        first, n, _, _ = suffix_dedup.contexts_of(x[low:high], ends, 30, 6)
        found += [low + a + k for a, m in zip(first, n, strict=True) for k in range(m)]
    assert sorted(found) == list(range(3000 - 29))


def test_repeated_and_null_ids(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    data = [(1, t, "", "", "", "", 0), (1, t, "", "", "", "", 0), (None, t, "", "", "", "", 0), (0, "short", "", "", "", "", 0)]
    got = suffix_dedup.remove_repeats(frame(spark, data), length=50, gram=8).select("doc_id", "n_removed").collect()
    assert sorted((r["n_removed"], r["doc_id"] is None) for r in got) == [(0, False), (0, False), (90, False), (90, True)]


def test_backward_extension():
    rng = random.Random(2)
    for length in (2, 5, 9, 30):
        x = np.array([rng.randint(0, 2) for _ in range(200)])
        order, number = suffix_dedup.extend_backwards(x, length)
        groups = {}
        for r, i in zip(order, number, strict=True):
            if r + length <= 200:
                groups.setdefault(i, set()).add(tuple(x[r : r + length]))
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len({tuple(x[p : p + length]) for p in range(200 - length + 1)})


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(data, size, percent):
    sets = {d: shingles(t, size) for d, t in data}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize(("size", "percent", "small"), [(3, 90, 8), (5, 80, 2)])
def test_components_of_links(spark, monkeypatch, size, percent, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    rng = random.Random(4)
    data = [(r[0], r[1]) for r in rows()]
    base = [f"w{i}" for i in range(150)]
    for i in range(60):  # a large group of near copies at all distances
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        data.append((1000 + i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    df = frame(spark, [(d, t, "", "", "", "", 0) for d, t in data])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, size=size, percent=percent).collect()}
    assert got == linked(data, size, percent)


def test_schemes_guarantee_a_common_block():
    rng = random.Random(5)
    for percent in (80, 90):
        for n in (1, 2, 9, 30, 200, 900):
            for _ in range(20):
                a = {rng.getrandbits(64) for _ in range(n)}
                b = set(a)
                while True:
                    c = set(b)
                    if rng.random() < 0.5 and c:
                        c.remove(rng.choice(sorted(c)))
                    else:
                        c.add(rng.getrandbits(64))
                    if not c or 100 * len(a & c) < percent * len(a | c):
                        break
                    b = c
                sets = [np.array(sorted(s), np.uint64) for s in (a, b)]
                which, key = jaccard_join.block_keys(sets, percent)
                assert set(key[which == 0]) & set(key[which == 1])


def test_candidates_across_blocks():
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in (0, 1, 5000, 2)]
    sketches = np.array([np.frombuffer(jaccard_join.parity(s), np.uint64) for s in sets])
    n = np.array([100] * 4)
    assert jaccard_join.candidates_across(sketches, n, np.array([0, 0, 2, 3]), 90, 9) == ([(1, 3), (0, 3)], False)
    assert jaccard_join.candidates_across(sketches, n, np.array([0, 0, 2, 3]), 90, 1) == ([(1, 3)], True)
    assert jaccard_join.candidates_across(sketches, n, np.array([0, 1, 2, 3]), 90, 9, cut=1) == ([(0, 1), (0, 3)], False)
    rng = random.Random(3)
    for _ in range(50):
        a, b = ({rng.randrange(500) for _ in range(rng.randrange(300))} for _ in range(2))
        x, y = (np.frombuffer(jaccard_join.parity(np.array(sorted(s), np.uint64)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_keys_travel_packed():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(800)]
    texts += [t + " end" for t in texts[::4]] + ["", "one"]
    docs = [7 * i - 1000 for i in range(len(texts))]
    out = list(jaccard_join._sketched(3, 90)(iter([pa.RecordBatch.from_arrays([pa.array(docs), pa.array(texts)], ["doc", "text"])])))
    sets = [jaccard_join.shingle_set(t, jaccard_join.Names()) for t in texts]
    which, key, back, _ = jaccard_join.blocks_of(sets, 90)
    assert sum(b.nbytes - b["sketch"].nbytes for b in out) < 16 * len(key)
    met = pa.Table.from_batches(jaccard_join._met(iter(pa.Table.from_batches(out).sort_by("span").to_batches())))
    assert sorted((r["doc"], r["n"], r["rep"]) for r in met.to_pylist() if r["rep"] is not None) == [(d, len(s), d) for d, s in zip(docs, sets, strict=True)]
    by = {}
    for i, k, b in zip(which.tolist(), (key >> np.uint64(12)).tolist(), back.tolist(), strict=True):
        by.setdefault(k, []).append((docs[i], -len(sets[i]) if b else len(sets[i])))
    want = sorted((k, d, n, min(v)[0], abs(min(v)[1])) for k, v in by.items() if len(v) > 1 for d, n in v)
    assert len(want) > 1000
    assert sorted((r["key"], r["doc"], r["n"], r["first"], r["n1"]) for r in met.to_pylist() if r["rep"] is None) == want


@pytest.mark.parametrize("lot", [1, 50, 10_000])
def test_repeated_keys_in_lots(monkeypatch, lot):
    monkeypatch.setattr(jaccard_join, "LOT", lot)
    monkeypatch.setattr(jaccard_join, "PACKED", 20)
    rng = random.Random(7)
    data = [(rng.choice([rng.randrange(30), -(2**63), 2**63 - 1, rng.randrange(-(2**62), 2**62)]), rng.choice([rng.getrandbits(64), 1 << 60, rng.randrange(9) << 50]), rng.randrange(70_000)) for _ in range(900)]
    columns = [np.array(v, t) for v, t in zip(zip(*data, strict=True), (np.int64, np.uint64, np.int64), strict=True)]
    rows, found, out = [], jaccard_join.Repeats(), []
    for span, packed in jaccard_join.packed_keys(*columns):
        rows.append(jaccard_join.unpacked_keys(span, packed))
        if found.add(*rows[-1]):
            out.append(found.take())
    out.append(found.take())
    rows = [r for v in rows for r in zip(*(c.tolist() for c in v), strict=True)]
    assert sorted(rows) == sorted((d, k >> 12, t) for d, k, t in data)
    keys = [r[1] for r in rows]
    out = [r for v in out for r in zip(*(c.tolist() for c in v), strict=True)]
    assert sorted(r[:3] for r in out) == sorted(r for r in rows if keys.count(r[1]) > 1)
    firsts = {(r[1], r[3:]) for r in out}
    assert len(firsts) == len({k for k, _ in firsts})
    assert {(d, k, t) for k, (d, t) in firsts} <= set(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    assert {r["component"] for r in components.components(path).collect()} == {0, 21}
