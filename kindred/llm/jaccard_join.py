"""N-gram Jaccard join by parity sketches.

A document's set of word shingles becomes a parity sketch: each shingle flips one bit of one of k
blocks. Sets whose similarity is at least the threshold differ in few shingles, and each of these changes one block at most;
so with k blocks, more than the greatest difference in a band of sizes, similar sets agree in
k - d blocks or more. Blocks are very wide and sparse, so each is kept as the XOR of 64-bit names of its set bits.
Equal blocks under one scheme meet in a bucket. Most keys occur once, and all of them have to be shuffled to find those that don't; so they
travel packed, by ranges of keys, and only repeated ones become rows.

Each set also has a narrow parity sketch of two to four bits for each shingle, whose Hamming distance bounds the
difference of two sets from below: it rules out nearly all pairs that aren't linked before any text moves.
First the others of a bucket are paired with its first, and each document is tested against the nearest of these, which links most of a
group of near copies with as many tests as it has members. Only buckets that still hold two components or more go on. Of small ones
the pairs across components are tested. Similar sets agree in several blocks, so a document can do without some of its large
buckets, and drops the largest. Members of the rest meet in blocks of bounded size; of two components the nearest
pairs are tested first, and more in each round until no pair is left that could join two components. What is tested is compared
shingle by shingle, so the ways of small and large buckets give one result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lean, materialise, numbered, read, small_batches
from .components import components

SHINGLE = 3
#: Similarity in hundredths.
PERCENT = 90
#: Members of a bucket up to which pairs are tested one by one.
SMALL = 8
#: Documents in a block of a large bucket, and bits of a sketch where none are given.
BLOCK_ROWS, BITS = 1024, 2048
#: Pairs of one first document that are tested together.
GROUP = 256
#: Rows of three numbers that are broadcast at most.
SENT = 200_000
#: Ranges of keys (a power of two, in bits) and bytes of a key within its range; two keys that these confuse cost a test at most.
RANGE_BITS, KEY_BYTES = 12, 5
#: Keys that a task holds before it packs them or looks for repeated ones, and most of a packed row.
LOT, PACKED = 1 << 20, 1 << 14
#: Documents, and characters, whose shingles are held at once (a longer text is alone).
CHUNK, CHUNK_CHARS = 500, 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Names(dict):
    """A cache of word hashes that starts anew when it is large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def trim(self) -> None:
        if len(self) > 1_000_000:
            self.clear()


def shingle_set(text: str | None, names: Names, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles; A-Z lower-cased, words parted by ASCII white space.

    Texts of fewer words than a shingle have one shingle, the whole; texts without words have none. names: a cache.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = _mix(out) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(out))


@functools.cache
def bands(percent: int, most: int) -> np.ndarray:
    """Least sizes of the bands up to that of `most`; similar sets lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def scheme(percent: int, top: int) -> tuple[int, int, int]:
    """Blocks, blocks beyond what must agree, and the shingles up to which a block is weak, where the smaller set has up to `top`.

    Weak blocks agree by chance. Sets that have no more of them than the spare ones don't need theirs, as similar sets
    agree in a block that isn't weak, too.
    """
    d = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    if not d:
        return 1, 0, 0
    part, weak = (8, 2) if top >= 7 * d else (3, 0)
    spare = -(-(d + 1) // part)
    return d + 1 + spare, spare, weak


def _band_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    most = int(n.max(initial=1))
    edges = bands(percent, 1 << max(4, most.bit_length()))
    return np.searchsorted(edges, n, "right") - 1, edges


def block_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which set, key) of the blocks by which similar sets are sure to meet."""
    return blocks_of(sets, percent)[:2]


def blocks_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which set, key, back) of the blocks by which similar sets are sure to meet: those of the set's own band of sizes, and with
    back = 1 those of the band before, for smaller sets. And the slack of each set for back 0 and 1: sets similar to it agree with it
    in more than so many of the blocks that both give."""
    n = np.array([len(s) for s in sets])
    slack = np.zeros((len(sets), 2), np.int64)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), slack
    band, edges = _band_sizes(n, percent)
    flat = np.concatenate(sets)
    which_out, key_out, back_out = [], [], []
    for back in (0, 1):
        own = band - back  # the band of the smaller of a pair
        plans = {b: scheme(percent, int(edges[b + 1]) - 1) for b in set(own.tolist()) if b >= 0}
        k = np.array([plans[b][0] if b >= 0 else 0 for b in own])
        spare = np.array([plans[b][1] if b >= 0 else 0 for b in own])
        few = np.array([plans[b][2] if b >= 0 else 0 for b in own])
        base = np.cumsum(k) - k
        live = np.repeat(k > 0, n)
        which = np.repeat(np.arange(len(n)), n)[live]
        h = flat[live]
        if not len(h):
            continue
        block = base[which] + ((_mix(h) >> np.uint64(20)) % k[which].astype(np.uint64)).astype(np.int64)
        count = np.bincount(block, minlength=int(k.sum()))
        order = np.argsort(block, kind="stable")
        at = np.cumsum(count) - count
        full = count > 0
        sketch = np.zeros(len(count), np.uint64)
        sketch[full] = np.bitwise_xor.reduceat(_mix(h[order] + np.uint64(0x51)), at[full])
        owner = np.repeat(np.arange(len(n)), k)
        weak = count <= few[owner]
        n_weak = np.bincount(owner[weak], minlength=len(n))
        many = n_weak > spare
        slack[:, back] = np.where(many, 0, spare - n_weak)
        emit = ~weak | many[owner]
        number = np.arange(len(count)) - base[owner]
        salt = _mix((own[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        which_out.append(owner[emit])
        key_out.append(_mix(sketch[emit] ^ salt[emit]))
        back_out.append(np.full(len(which_out[-1]), back))
    return np.concatenate(which_out), np.concatenate(key_out), np.concatenate(back_out), slack


def _chunks(order: list[int], sizes: list[int]) -> Iterator[list[int]]:
    out, held = [], 0
    for i in order:
        if out and (len(out) >= CHUNK or held + sizes[i] > CHUNK_CHARS):
            yield out
            out, held = [], 0
        out.append(i)
        held += sizes[i]
    if out:
        yield out


def _bits(n: int) -> int:
    """Bits of the sketch of a set of n shingles: a power of two, twice as many as it has shingles or more."""
    return 1 << max(6, (n - 1).bit_length() + 1)


def parity(s: np.ndarray, bits: int = BITS) -> bytes:
    """A sketch of bits, of which each shingle flips one: two sets differ in as many shingles as their sketches in bits, or more."""
    return np.packbits(np.bincount((_mix(s + np.uint64(0x77)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer 64-bit words: bits that are half its length apart become one."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each, all lowest ones first: upper bytes that are alike compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def packed_keys(doc: np.ndarray, key: np.ndarray, tag: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, packed) of rows doc (long), key (unsigned, of which the highest RANGE_BITS + 8 * KEY_BYTES bits count), tag (0 or more).

    Rows of a range stand by document, so that ids are short steps from the one before.
    """
    span = (key >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    order = np.lexsort((doc, span))
    span, doc, tag = span[order], doc[order], tag[order].astype(np.uint64)
    key = key[order] >> np.uint64(64 - RANGE_BITS - 8 * KEY_BYTES)
    ends = np.append(np.flatnonzero(np.diff(span)) + 1, len(span)).tolist() if len(span) else []
    for start, end in zip([0, *ends], ends, strict=False):
        for low in range(start, end, PACKED):
            high = min(end, low + PACKED)
            step = np.diff(doc[low:high], prepend=doc[low]).view(np.uint64)  # differences wrap around, and so do sums
            widths = [max(1, (int(v.max()).bit_length() + 7) // 8) for v in (step, tag[low:high])]
            head = np.array([doc[low]], "<i8").tobytes() + bytes(widths)
            yield int(span[low]), head + _planes(key[low:high], KEY_BYTES) + _planes(step, widths[0]) + _planes(tag[low:high], widths[1])


def unpacked_keys(span: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, key (as many bits as count), tag of what packed_keys made."""
    data = np.frombuffer(packed, np.uint8)
    w = (KEY_BYTES, int(data[8]), int(data[9]))
    m = (len(data) - 10) // sum(w)
    key, step, tag = (_from_planes(v, k) for v, k in zip(np.split(data[10:], np.cumsum(w)[:2] * m), w, strict=True))
    doc = (np.cumsum(step, dtype=np.uint64) + data[:8].view("<u8")[0]).view(np.int64)
    return doc, key | (np.uint64(span) << np.uint64(8 * KEY_BYTES)), tag


def _sketched(size: int, percent: int):
    """(span, doc, n, rep, sketch, slack, keys): a row per document with its representative among equal sets of the batch and, for a
    representative, its parity sketch and slacks (that of back 1 in the high half); and rows of packed block keys, which have
    none of these: their tag is 2 n + back."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["span", "doc", "n", "rep", "sketch", "slack", "keys"])

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = list(packed_keys(*(np.concatenate(v) for v in zip(*held, strict=True)))) if held else []
        for k in range(0, len(found), CHUNK):
            spans, keys = zip(*found[k : k + CHUNK], strict=True)
            none = pa.nulls(len(keys), pa.int64())
            yield rows(spans, none, none, none, pa.nulls(len(keys), pa.binary()), none, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        held: list[tuple] = []
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            first: dict[bytes, int] = {}
            sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
            for chunk in _chunks(sorted(range(len(docs)), key=docs.__getitem__), sizes):
                own, sets = [], []
                out: list[list] = [[], [], [], []]
                for i in chunk:
                    s = shingle_set(texts[i].as_py(), names, size)
                    rep, sketch = docs[i], None
                    if len(s):
                        rep = first.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), rep)
                        if rep == docs[i]:
                            own.append(rep)
                            sets.append(s)
                            sketch = parity(s, _bits(len(s)))
                    for column, value in zip(out, (docs[i], len(s), rep, sketch), strict=True):
                        column.append(value)
                names.trim()
                which, key, back, slack = blocks_of(sets, percent)
                slacks = dict(zip(own, (slack[:, 0] + (slack[:, 1] << 32)).tolist(), strict=True))
                span = (_mix(np.array(out[0], np.int64).view(np.uint64)) >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
                yield rows(span, *out, [slacks.get(d) if d == r else None for d, r in zip(out[0], out[2], strict=True)], pa.nulls(len(span), pa.binary()))
                if len(which):
                    n = np.array([len(s) for s in sets], np.int64)[which]
                    held.append((np.array(own, np.int64)[which], key, 2 * n + back))
                if sum(len(v[0]) for v in held) >= LOT:
                    yield from packed(held)
                    held = []
        yield from packed(held)

    return run


class Repeats:
    """Finds the keys of a range that more than one row has, in lots: memory holds a row per key besides a lot, however many rows one key has."""

    def __init__(self) -> None:
        self.lot: list[tuple] = []
        self.rows = 0
        self.seen = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))

    def add(self, doc: np.ndarray, key: np.ndarray, tag: np.ndarray) -> bool:
        """Whether it is time to take."""
        self.lot.append((doc, key, tag))
        self.rows += len(doc)
        return self.rows >= max(LOT, len(self.seen[0]))

    def take(self) -> list[np.ndarray]:
        """doc, key, tag, first, tag of the first: rows since the last call whose key is repeated, and those before that have become so. first: one
        row of the key, the same each time; of one lot, the least document's."""
        new = [np.concatenate(v) for v in zip(*self.lot, strict=True)] if self.lot else [v[:0] for v in self.seen[:3]]
        doc, key, tag = (np.concatenate(v) for v in zip(self.seen[:3], new, strict=True))
        fresh = np.arange(len(doc)) >= len(self.seen[0])
        sent = np.append(self.seen[3], np.zeros(len(new[0]), bool))
        self.lot, self.rows = [], 0
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        many = np.append(same, False) | np.append(False, same)[: len(order)]
        alone, order = order[~many[: len(order)]], order[many[: len(order)]]
        order = order[np.lexsort((doc[order], fresh[order], key[order]))]
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
        first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
        due = ~sent[order]
        sent[order[starts]] = True
        left = np.append(alone, order[starts])
        self.seen = (doc[left], key[left], tag[left], sent[left])
        order, first = order[due], first[due]
        return [doc[order], key[order], tag[order], doc[first], tag[first]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of _sketched's rows in order of span: doc, n, rep, key, first, n1, sketch, slack. Rows of documents as they are, and a row for each
    document of a key that several have: n below 0 for back 1, and the key's first document with its size."""
    names = ["doc", "n", "rep", "key", "first", "n1", "sketch", "slack"]
    span, found = None, Repeats()

    def rows(doc: np.ndarray, key: np.ndarray, tag: np.ndarray, first: np.ndarray, tag1: np.ndarray) -> pa.RecordBatch:
        n, none = (tag >> np.uint64(1)).astype(np.int64), pa.nulls(len(doc), pa.int64())
        n1 = (tag1 >> np.uint64(1)).astype(np.int64)
        columns = (doc, np.where(tag & np.uint64(1), -n, n), none, key.view(np.int64), first, n1, pa.nulls(len(doc), pa.binary()), none)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    for batch in batches:
        docs = batch.filter(pc.is_valid(batch.column("rep")))
        none = pa.nulls(len(docs), pa.int64())
        yield pa.RecordBatch.from_arrays([docs["doc"], docs["n"], docs["rep"], none, none, none, docs["sketch"], docs["slack"]], names)
        keys = batch.filter(pc.is_valid(batch.column("keys")))
        for s, packed in zip(keys["span"].to_pylist(), keys["keys"].to_pylist(), strict=True):
            if s != span:
                if found.lot:
                    yield rows(*found.take())
                span, found = s, Repeats()
            if found.add(*unpacked_keys(s, packed)):
                yield rows(*found.take())
    if found.lot:
        yield rows(*found.take())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct names."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _near(percent: int):
    """Of rows a, b, na, nb, sa, sb the pairs whose sketches allow a link, and how far apart these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_s, b_s, na, nb = (batch.column(k).to_pylist() for k in range(4))
            out: list[list] = [[], [], []]
            for i in range(len(a_s)):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                words = min(len(x), len(y))
                far = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                if far * (100 + percent) <= (na[i] + nb[i]) * (100 - percent):
                    for column, value in zip(out, (a_s[i], b_s[i], far), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b", "far"])

    return run


def _allowed(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b, far: those of distinct pairs a, b whose sketches allow a link. sketches: doc, n, sketch."""
    one = sketches.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(lean(_near(percent)), "a long, b long, far long")


def _verified(size: int, percent: int):
    """Rows g, part, doc, text by group, of which the first is doc g itself: whether each other one is linked with g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, (g, part, doc) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                s = shingle_set(batch.column(3)[i].as_py(), names, size)
                if (g, part) != at:
                    at, own = (g, part), s
                    continue
                for column, value in zip(out, (g, doc, similar(own, s, percent)), strict=True):
                    column.append(value)
                names.trim()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "linked"])

    return run


def _tested(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, linked of distinct pairs a, b. A text goes once to each group of up to about GROUP pairs that share their first document."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = pairs.join(many, "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    wanted = dealt.select("g", "part", F.col("g").alias("doc")).distinct().unionByName(dealt.select("g", "part", F.col("b").alias("doc")))
    wanted = materialise(wanted, "jaccard-wanted")
    # a short list of documents goes to the texts; beyond that both are shuffled
    rows = (F.broadcast(wanted) if wanted.count() <= SENT else wanted).join(texts, "doc").select("g", "part", "doc", "text")
    rows = rows.repartition("g", "part").sortWithinPartitions("g", "part", F.col("doc") != F.col("g"))
    return rows.mapInArrow(lean(_verified(size, percent)), "a long, b long, linked boolean")


def candidates_across(sketches: np.ndarray, n: np.ndarray, labels: np.ndarray, percent: int, most: int, cut: int = 0) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (places) of different labels whose sketches and sizes allow a link: of two labels the `most` pairs of least
    distance, and whether there are more. cut > 0: only pairs of one before and one from place `cut`. sketches: rows of 64-bit words."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    m = len(n)
    for low in range(0, cut or m, 32):
        high = min(cut or m, low + 32)
        since = cut or low + 1
        far = np.bitwise_count(sketches[low:high, None, :] ^ sketches[None, since:, :]).sum(2, dtype=np.int64)
        sums = n[low:high, None] + n[None, since:]
        ok = (far * (100 + percent) <= sums * (100 - percent)) & (labels[low:high, None] != labels[None, since:])
        ok &= np.minimum(n[low:high, None], n[None, since:]) * 100 >= np.maximum(n[low:high, None], n[None, since:]) * percent
        for i, j in zip(*np.nonzero(ok), strict=True):
            x, y = low + int(i), since + int(j)
            if x < y:
                pair = (int(labels[x]), int(labels[y]))
                found.setdefault((min(pair), max(pair)), []).append((int(far[i, j]), x, y))
    out = [(x, y) for v in found.values() for _, x, y in sorted(v)[:most]]
    return out, any(len(v) > most for v in found.values())


def _crossed(percent: int, most: int):
    """Rows of blocks (key, x, y, block, doc, n, component, sketch) in order: candidate pairs a, b, each once of a task as far as it remembers;
    and keys that hold more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        seen: set[tuple[int, int]] = set()

        def pairs() -> pa.RecordBatch:
            cut = sum(r[0] == at[1] for r in held) if at[1] != at[2] else 0
            found, more = [], False
            if len(held) > 1 and cut < len(held):
                words = min(len(r[4]) for r in held) // 8
                sketches = np.stack([folded(np.frombuffer(r[4], np.uint64), words) for r in held])
                found, more = candidates_across(sketches, np.array([r[2] for r in held]), np.array([r[3] for r in held]), percent, most, cut)
            ends = [p for p in {(min(p), max(p)) for p in ((held[i][1], held[j][1]) for i, j in found)} if p not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(ends)
            rows = [(*p, None) for p in ends] + [(None, None, at[0])] * more
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "key"])

        for batch in batches:
            for key, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, x, y) != at:
                    if held:
                        yield pairs()
                    held, at = [], (key, x, y)
                held.append(tuple(row))
        if held:
            yield pairs()

    return run


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of pairs a, b those that labels don't join already."""
    ends = pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _linked(rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """rows: doc (unique), text. doc, n, rep of all; node, component of representatives that have links."""
    sketched = rows.mapInArrow(lean(_sketched(size, percent)), "span int, doc long, n long, rep long, sketch binary, slack long, keys binary")
    # rows of documents go through the same shuffle under spans of their own
    dealt = sketched.repartition("span").sortWithinPartitions("span")
    with small_batches(rows.sparkSession):
        found = materialise(dealt.mapInArrow(lean(_met), "doc long, n long, rep long, key long, first long, n1 long, sketch binary, slack long"), "jaccard-found")
    base = materialise(found.filter("rep is not null").select("doc", "n", "rep"), "jaccard-base")
    sketches = found.filter("sketch is not null").select("doc", "n", "sketch")
    members = found.filter("rep is null").select("key", "doc", F.abs("n").alias("n"), (F.col("n") < 0).alias("back"), "first", "n1")
    sized = lambda p, q: F.least(p, q) * 100 >= F.greatest(p, q) * percent
    pairs = members.filter((F.col("doc") != F.col("first")) & sized(F.col("n"), F.col("n1"))).select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    with_first = materialise(_allowed(pairs, sketches, percent), "jaccard-first")
    nearest = with_first.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    tested = materialise(_tested(nearest, rows, size, percent), "jaccard-tested")
    labels = components(tested.filter("linked").select("a", "b"), "jaccard-components")
    by = Window.partitionBy("key")
    left = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", "back", F.coalesce("component", "doc").alias("component"))
    left = left.withColumn("low", F.min("component").over(by)).withColumn("high", F.max("component").over(by)).withColumn("m", F.count(F.lit(1)).over(by))
    left = materialise(left.filter("low < high").drop("low", "high"), "jaccard-left")
    small = left.filter(F.col("m") <= SMALL)
    other = small.select("key", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = small.join(other, "key").filter((F.col("doc") < F.col("b")) & (F.col("cb") != F.col("component")) & sized(F.col("n"), F.col("nb")))
    pairs = _allowed(pairs.select(F.col("doc").alias("a"), "b").distinct().join(with_first, ["a", "b"], "left_anti"), sketches, percent)
    pairs = _across(with_first.unionByName(pairs), labels).join(tested, ["a", "b"], "left_anti")
    old, again = tested, materialise(pairs, "jaccard-small")
    if again.limit(1).count():
        tested = materialise(tested.unionByName(_tested(again, rows, size, percent)), "jaccard-tested")
        labels = components(tested.filter("linked").select("a", "b"), "jaccard-components")
        discard(old)
    discard(again, with_first)
    # sets alike agree in more blocks than each one's slack; so each may do without so many of its unsettled large buckets, the largest
    # ones, as the smallest in which they agree is left to both
    slack = found.filter("slack is not null").select("doc", F.col("slack").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("s0"), F.shiftright("slack", 32).alias("s1"))
    large = left.filter(F.col("m") > SMALL).join(slack, "doc").withColumn("place", F.row_number().over(Window.partitionBy("doc", "back").orderBy(F.col("m").desc(), "key")))
    large = large.filter(F.col("place") > F.when(F.col("back"), F.col("s1")).otherwise(F.col("s0"))).select("key", "doc", "n", "component")
    large = large.withColumn("low", F.min("component").over(by)).withColumn("high", F.max("component").over(by)).withColumn("m", F.count(F.lit(1)).over(by))
    # in the others every two blocks of members meet
    large = large.filter("low < high").withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    large = materialise(large.select("key", "doc", "n", "blocks", "block"), "jaccard-large")
    sketches = materialise(sketches.select("doc", "sketch").join(large.select("doc").distinct(), "doc", "left_semi"), "jaccard-sketches")
    discard(left, found)
    most, open_ = 4, large
    while True:
        now = open_.join(sketches, "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        now = now.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc", "n", F.coalesce("component", "doc").alias("component"), "sketch")
        now = now.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "block")
        found = materialise(now.mapInArrow(lean(_crossed(percent, most)), "a long, b long, key long").distinct(), "jaccard-candidates")
        new = materialise(found.filter("a is not null").select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-new")
        if new.limit(1).count():
            old, tested = tested, materialise(tested.unionByName(_tested(new, rows, size, percent)), "jaccard-tested")
            labels = components(tested.filter("linked").select("a", "b"), "jaccard-components")
            discard(old)
        # buckets that held more pairs than were asked for are looked at once more
        more = materialise(found.filter("key is not null").select("key").distinct(), "jaccard-more")
        again = more.limit(1).count()
        old, open_ = open_, materialise(open_.join(more, "key", "left_semi"), "jaccard-open") if again else large
        discard(found, new, more)
        if old is not large:
            discard(old)
        if not again:
            discard(large, sketches, tested)
            return base, labels
        most *= 16


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id among the documents reachable by links of similarity >= percent / 100.

    Documents without words link with nothing. Rows that repeat an id are documents of their own (equal ones are
    linked); a null id comes last. No rows: no rows.
    """
    rows, own = numbered(docs, id_col, text_col)
    base, labels = _linked(rows, size, percent)
    # a representative without links of its own still stands for its copies
    out = base.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    if own is None:
        return out.select(F.col("doc").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    ids = own.select(F.col("__doc").alias("doc"), F.col(id_col))
    out = out.join(ids, "doc").join(ids.select(F.col("doc").alias("component"), F.col(id_col).alias("component_id")), "component")
    return out.select(id_col, "n_shingles", "component_id")


def first_of_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each of jaccard_components' groups the first row alone, so of rows that share an id, or have none, no more than links allow."""
    rows, own = numbered(docs, id_col, text_col)
    base, labels = _linked(rows, size, percent)
    out = base.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    first = out.filter(F.col("doc") == F.coalesce("component", "rep")).select(F.col("doc").alias("__first"))
    if own is None:
        return docs.join(first, docs[id_col] == F.col("__first"), "left_semi")
    return own.join(first, own["__doc"] == F.col("__first"), "left_semi").drop("__doc")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))

