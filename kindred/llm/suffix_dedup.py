"""Suffix-array deduplication: removal of every byte covered by a long string that also starts earlier.

1. Each start of a string of LENGTH bytes is assigned to the smallest hashed GRAM-gram in it. Equal strings
   choose equal grams, so all occurrences of a string share the gram's key. Consecutive starts with one gram form
   a context; contexts equal in all bytes are told by hashes and collapse at once, within a batch before the shuffle and
   after it by key: all but the earliest are repeats throughout. Keys with one context are done.
2. Contexts that share a key but differ are cut out of their texts and brought together by key. Those that have
   no string a little shorter than LENGTH in common with another of their key are done; the others are
   put, key by key, into blocks of bounded size. A block's Burrows-Wheeler transform is extended backwards breadth first: the
   intervals of prefixes of length l + 1 follow from those of length l, so common prefixes come to
   light in increasing order, and the extension stops at LENGTH. Starts still in one interval begin equal strings; all but
   the earliest are repeats.
   A key with more than `crowd` differing contexts doesn't go to one block: its strings are keyed one by one instead,
   spread over all tasks, and equal ones collapse as contexts do.
3. Repeated starts are joined to the texts of the documents that have any, and their bytes cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, numbered, read

LENGTH = 100
GRAM = 20
#: Differing contexts under one key beyond which they are compared string by string.
CROWD = 20_000
BLOCK = 1 << 20
#: Strings around a gram by which contexts that share less than LENGTH bytes are told apart beforehand.
PARTS = 4
LONGEST = 1 << 23

_TABLE = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _rolling(x: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of `width` bytes, by doubling."""
    parts: list[tuple[int, np.ndarray]] = []
    level, size, need = _TABLE[x], 1, width
    while True:
        if need & size:
            parts.append((size, level))
        if size * 2 > width:
            break
        level = level[:-size] * _power(base, size) + level[size:]
        size *= 2
    n, at = len(x) - width + 1, 0
    total = np.zeros(n, np.uint64)
    for size, level in reversed(parts):
        total = total * _power(base, size) + level[at : at + n]
        at += size
    return total


def _span_hashes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of x[low:high), from prefix sums of bytes times powers of an odd base."""
    n = len(x)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_B), -1, 1 << 64)))]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[x] * powers[:-1], dtype=np.uint64)])
    return _mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64) * _A)


def contexts_of(x: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of bytes x, in which documents end at `ends`: first start, number of starts, key and hash of each context."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(x) - length + 1
    if n < 1:
        return empty
    grams = _rolling(x, gram, _A)
    bits = max(1, int(len(grams) - 1).bit_length())
    keep = np.uint64(((1 << 64) - 1) >> bits << bits)
    low = (_mix(grams) & keep) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low[:n] & ~keep).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    marks = np.zeros(len(x) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(marks, starts[long], 1)
    np.add.at(marks, ends[long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(marks[:n]))
    if not len(valid):
        return empty
    a = anchor[valid]
    cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
    first, last = valid[np.concatenate([[0], cuts])], valid[np.concatenate([cuts - 1, [len(valid) - 1]])]
    key = _mix(grams[anchor[first]] + _A)
    return first, last - first + 1, key.view(np.int64), _span_hashes(x, first, last + length).view(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and where each value ends, null as empty."""
    values = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if values.null_count:
        values = values.fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if values.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First document, and the bytes from and to, of blocks of whole documents; documents beyond LONGEST in overlapping pieces."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if j == i + 1 and high - low > LONGEST:
            for at in range(low, max(low + 1, high - length + 1), LONGEST):
                to = min(high, at + LONGEST + length - 1)
                yield i, at, to, np.array([to - at])
        else:
            yield i, low, high, offsets[i + 1 : j + 1] - low
        i = j


ROWS = "doc long, p int, n int, key long, ctx long"


def _ranges(doc: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins adjoining or overlapping runs of starts, given in the order of doc and p."""
    if not len(doc):
        return doc, p, n
    end = p + n
    # within a document ends are made to run, so that contained runs join too
    shift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) << 40
    top = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (p + shift)[1:] > top[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(doc) - 1]])
    return doc[at], p[at], (top - shift)[last] - p[at]


def _batch(doc, p, n, key, ctx) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), key, ctx], ["doc", "p", "n", "key", "ctx"])


def _collapsed(doc, p, n, key, ctx) -> Iterator[pa.RecordBatch]:
    """The earliest of each set of equal contexts with its key, and the others as repeated starts with none."""
    order = np.lexsort((p, doc, n, ctx, key))
    doc, p, n, key, ctx = (v[order] for v in (doc, p, n, key, ctx))
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (n[1:] == n[:-1])]) if len(doc) else np.zeros(0, bool)
    first = ~again
    if first.any():
        yield _batch(doc[first], p[first], n[first], pa.array(key[first]), pa.array(ctx[first]))
    if again.any():
        d, q, m = doc[again], p[again], n[again]
        order = np.lexsort((q, d))
        d, q, m = _ranges(d[order], q[order], m[order])
        none = pa.nulls(len(d), pa.int64())
        yield _batch(d, q, m, none, none)


def _contexts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = _bytes(batch.column(1))
            found = []
            for i, low, high, ends in _pieces(offsets, length):
                first, n, key, ctx = contexts_of(data[low:high], ends, length, gram)
                at = i + np.searchsorted(ends, first, "right")
                found.append((docs[at], first + low - offsets[at], n, key, ctx))
            if found:
                yield from _collapsed(*(np.concatenate(v) for v in zip(*found, strict=True)))

    return run


def _reduced(rows: DataFrame) -> DataFrame:
    """Of keyed contexts: all but the earliest of equal ones as repeats (key null), those that differ from
    others of their key with the key and the number of such (crowd); contexts alone under their key go."""
    equal = Window.partitionBy("key", "ctx", "n").orderBy("doc", "p")
    of_key = Window.partitionBy("key")
    keyed = rows.filter("key is not null").withColumn("rank", F.row_number().over(equal)).withColumn("crowd", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(of_key))
    keyed = keyed.filter("rank > 1 or crowd > 1").select("doc", "p", "n", F.when(F.col("rank") == 1, F.col("key")).alias("key"), F.when(F.col("rank") == 1, F.col("crowd")).alias("crowd"))
    return keyed.unionByName(rows.filter("key is null").select("doc", "p", "n", "key", F.lit(None).cast("long").alias("crowd")))


def _order(symbols: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Order of the suffixes of symbols below 512 by their first `depth` symbols at least.

    The first sort is by as many symbols as a number holds; each further one doubles them and touches only the suffixes
    that aren't alone yet. A rank is the place of the first suffix of its group.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(6, np.uint64)])
    packed = padded[:n].copy()
    for k in range(1, 7):
        packed <<= np.uint64(9)
        packed |= padded[k : k + n]
    order = np.argsort(packed).astype(np.int32)
    line = packed[order]
    begins = np.concatenate([[True], line[1:] != line[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n, dtype=np.int32), 0))
    while width < depth:
        at = np.flatnonzero(~(begins & np.concatenate([begins[1:], [True]])))
        if not len(at):
            break
        where = order[at]
        behind = where + np.int32(width)
        key = (rank[where].astype(np.int64) << 32) | np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        line = np.argsort(key)
        where, key = where[line], key[line]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        order[at], begins[at] = where, fresh
        rank[where] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        width *= 2
    return order


def extend_backwards(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a text of symbols below 511 and its end, and for each row of it the number of its interval of common prefixes of `length` symbols.

    The transform's rows with one symbol, in order, are the rows that follow from extending their prefixes by it, so row r begins a new
    interval of length l + 1 where the rows before and at r extend different intervals of length l: where one of the rows that begin
    at length l lies between the two, or is the latter. Where the two are neighbours, that row alone decides, and leads to r; the other
    rows not yet begun are looked at level by level.
    """
    symbols = np.concatenate([symbols.astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)])  # ends with a least symbol of its own
    n = len(symbols)
    order = _order(symbols, length, 7)
    transform = symbols[order - 1]
    source = np.argsort(transform, kind="stable").astype(np.int32)  # the row that row r extends
    extended = np.empty(n, np.int32)  # and the row that extends it
    extended[source] = np.arange(n, dtype=np.int32)
    begins = np.zeros(n, bool)
    c = transform[source]
    new = np.flatnonzero(c[1:] != c[:-1]) + 1
    begins[0] = True
    begins[new] = True
    led = np.zeros(n, bool)
    led[1:] = source[1:] == source[:-1] + 1
    left = np.flatnonzero(~begins & ~led)
    here, before = source[left], source[left - 1]
    for _ in range(1, length):
        if not len(new):
            break
        found = extended[new]
        found = found[led[found] & ~begins[found]]
        if len(left):
            if 20 * len(left) > n:
                number = np.cumsum(begins, dtype=np.int32)
                parted = number[here] != number[before]
            else:
                line = np.sort(new)
                parted = np.searchsorted(line, here, "right") != np.searchsorted(line, before, "right")
            found = np.concatenate([found, left[parted]])
            stay = ~parted
            left, here, before = left[stay], here[stay], before[stay]
        new = found
        begins[new] = True
    return order, np.cumsum(begins, dtype=np.int32)


def _repeats_in(block: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """block: (key, doc, p, n, bytes) of contexts. The starts whose string another start has earlier."""
    joined = np.frombuffer(b"".join(x[4] for x in block), np.uint8)
    sizes = np.array([len(x[4]) for x in block])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(at[-1], np.uint16)  # 0 parts the contexts
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    symbols[inside] = joined.astype(np.uint16) + np.uint16(1)
    order, interval = extend_backwards(symbols, length)
    number = np.empty(len(order), np.int32)
    number[order] = interval
    n = np.array([x[3] for x in block])
    which = np.repeat(np.arange(len(block)), n)
    shift = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    own = number[at[:-1][which] + shift]
    shared = np.bincount(own)[own] > 1
    which, shift, own = which[shared], shift[shared], own[shared]
    doc = np.array([x[1] for x in block], np.int64)[which]
    p = np.array([x[2] for x in block], np.int64)[which] + shift
    line = np.lexsort((p, doc, own))
    doc, p, own = doc[line], p[line], own[line]
    again = np.concatenate([[False], own[1:] == own[:-1]]) if len(own) else np.zeros(0, bool)
    doc, p = doc[again], p[again]
    line = np.lexsort((p, doc))
    doc, p, n = _ranges(doc[line], p[line], np.ones(len(line), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "p", "n"])


def may_share(block: list[tuple], length: int, gram: int) -> np.ndarray:
    """block: (key, doc, p, n, bytes) of whole keys' contexts. Which of them may share a string of `length` bytes with another of their key.

    Such a string has the key's gram, and PARTS bands of the bytes beside it: with so many bytes before the gram, or the
    next number of them, it holds one of PARTS strings that lie at fixed places around the gram and are a
    band shorter. A context none of whose strings occurs in another can't share more.
    """
    x = np.frombuffer(b"".join(r[4] for r in block), np.uint8)
    sizes = np.array([len(r[4]) for r in block])
    at = np.cumsum(sizes) - sizes
    key = np.array([r[0] for r in block], np.int64)
    band = -(-(length - gram) // PARTS)
    width = length - band
    owner = np.repeat(np.arange(len(block)), sizes)
    grams = _mix(_rolling(x, gram, _A) + _A).view(np.int64)
    hit = np.flatnonzero(grams == key[owner[: len(grams)]])
    hit = hit[hit + gram <= (at + sizes)[owner[hit]]]
    _, first = np.unique(owner[hit], return_index=True)
    place = hit[first]  # the first of its grams made the context
    if width < gram or len(place) < len(block):
        return np.ones(len(block), bool)
    names = _rolling(x, width, _B)
    out = np.zeros(len(block), bool)
    for k in range(PARTS):
        low = place - k * band
        inside = np.flatnonzero((low >= at) & (low + width <= at + sizes))
        name = _mix(names[low[inside]]) ^ _mix(key[inside].view(np.uint64))
        order = np.argsort(name)
        same = name[order][1:] == name[order][:-1]
        out[inside[order[1:][same]]] = True
        out[inside[order[:-1][same]]] = True
    return out


def _compared(length: int, gram: int):
    """Rows key, doc, p, n, context in order of keys: repeated starts. Blocks hold whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[tuple] = []
        block: list[tuple] = []
        size, held, last = 0, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= BLOCK:
                    kept = [r for r, keep in zip(read, may_share(read, length, gram), strict=True) if keep]
                    block, held = block + kept, held + sum(len(r[4]) for r in kept)
                    read, size = [], 0
                    if held >= BLOCK:
                        yield from _repeats_in(block, length)
                        block, held = [], 0
                read.append(row)
                size, last = size + len(row[4]), row[0]
        if read:
            block += [r for r, keep in zip(read, may_share(read, length, gram), strict=True) if keep]
        if block:
            yield from _repeats_in(block, length)

    return run


def _cut_out(length: int):
    """Contexts' bytes out of texts: the rows are doc, text, needs(p, n, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for doc, text, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for x in needs:
                    piece = raw[x["p"] : x["p"] + x["n"] + length - 1]
                    size += len(piece)
                    for column, value in zip(out, (x["key"], doc, x["p"], x["n"], piece), strict=True):
                        column.append(value)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "doc", "p", "n", "context"])
                    out, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "doc", "p", "n", "context"])

    return run


def _one_by_one(length: int):
    """Contexts of crowded keys as a keyed row for each of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ps, ns = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
            data, offsets = _bytes(batch.column(4))
            for low in range(0, len(docs), 2000):
                high = min(len(docs), low + 2000)
                x, n = data[offsets[low] : offsets[high]], ns[low:high]
                which = np.repeat(np.arange(high - low), n)
                shift = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = (offsets[low:high] - offsets[low])[which] + shift
                key = _mix(_rolling(x, length, _A)[at]).view(np.int64)
                ctx = _span_hashes(x, at, at + length).view(np.int64)
                yield from _collapsed(docs[low:high][which], ps[low:high][which] + shift, np.ones(len(which), np.int64), key, ctx)

    return run


def _spans(length: int):
    """The rows are doc, text, starts(p, n): removed bytes merged, the rest kept; text keeps characters whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                for low, high in sorted((x["p"], x["p"] + x["n"] + length - 1) for x in starts):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                kept, whole, at, held = [], [], 0, 0
                for low, high in spans:
                    kept.append(raw[at:low])
                    at = high
                    while low < high and raw[low] & 0xC0 == 0x80:
                        low += 1
                    while high > low and high < len(raw) and raw[high] & 0xC0 == 0x80:
                        high -= 1
                    whole.append(raw[held:low])
                    held = high
                kept.append(raw[at:])
                whole.append(raw[held:])
                for column, value in zip(out, (doc, sum(b - a for a, b in spans), len(spans), b"".join(kept), b"".join(whole).decode()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc", "n_removed", "n_spans", "kept", "kept_text"])

    return run


def _cut(rows: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """rows: doc (unique), text. doc, n_removed, n_spans, kept (bytes), kept_text of the documents that lose bytes."""
    found = materialise(_reduced(rows.mapInArrow(lean(_contexts(length, gram)), ROWS)), "suffix-found")
    # of a document: starts known as repeats, and contexts to compare
    known = F.filter("all", lambda x: x["key"].isNull())
    needs = F.filter("all", lambda x: x["key"].isNotNull())
    touched = found.groupBy("doc").agg(F.collect_list(F.struct("p", "n", "key", "crowd")).alias("all"))
    touched = materialise(rows.join(touched, "doc").select("doc", "text", known.alias("known"), needs.alias("needs")), "suffix-texts")
    wanted = touched.filter(F.size("needs") > 0)
    shape = "key long, doc long, p int, n int, context binary"
    calm = wanted.select("doc", "text", F.filter("needs", lambda x: x["crowd"] <= crowd).alias("needs")).mapInArrow(lean(_cut_out(length)), shape)
    new = calm.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_compared(length, gram)), "doc long, p int, n int")
    if found.filter(F.col("crowd") > crowd).limit(1).count():
        crowded = wanted.select("doc", "text", F.filter("needs", lambda x: x["crowd"] > crowd).alias("needs")).mapInArrow(lean(_cut_out(length)), shape)
        new = new.unionByName(_reduced(crowded.mapInArrow(lean(_one_by_one(length)), ROWS)).filter("key is null").select("doc", "p", "n"))
    new = new.groupBy("doc").agg(F.collect_list(F.struct("p", "n")).alias("new"))
    none = F.array().cast("array<struct<p:int,n:int>>")
    starts = F.concat(F.transform("known", lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n"))), F.coalesce("new", none))
    out = touched.join(new, "doc", "left").withColumn("starts", starts).filter(F.size("starts") > 0).select("doc", "text", "starts")
    return out.mapInArrow(lean(_spans(length)), "doc long, n_removed long, n_spans long, kept binary, kept_text string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs with columns n_bytes, n_removed, n_spans, kept (the bytes that remain) and kept_text (the same, with characters
    that a span cuts through kept whole) added; kept and kept_text are null where nothing is removed.

    A byte goes if a string of `length` bytes covers it that also starts earlier, in a document with a smaller
    id or in the same document. Null texts are empty. Rows that repeat an id are documents of their own, in the order of their
    texts; a null id comes last. No rows: no rows. Columns of docs that have the names of added ones are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_text", "__doc")
    rows, own = numbered(docs, id_col, text_col)
    cut = _cut(rows, length, gram, crowd).withColumnRenamed("doc", "__doc")
    base = own if own is not None else docs.withColumn("__doc", F.col(id_col).cast("long"))
    out = base.join(cut, "__doc", "left").withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_removed", "n_spans")}).drop("__doc")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document: texts that lose nothing are hashed where they are read, and only numbers are joined."""
    rows, own = numbered(read(spark, sf_dir, "documents"), "doc_id", "text")
    cut = _cut(rows, LENGTH, GRAM, CROWD).select("doc", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    base = rows.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = base.join(cut, "doc", "left")
    out = out.select("doc", "n_bytes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")], F.coalesce("sha", "whole").alias("kept_sha256"))
    if own is None:
        return out.withColumnRenamed("doc", "doc_id")
    return out.join(own.select(F.col("__doc").alias("doc"), "doc_id"), "doc").drop("doc")
