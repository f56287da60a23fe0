"""Best-fit packing of token sequences.

Texts are tokenised and cut into pieces of at most the sequence length. The histogram of the pieces'
lengths, a bounded table whatever the corpus, goes to the driver. There the configuration linear program (which combinations of
lengths fill a sequence, and how often to use each) is solved by multiplicative weights: lengths not yet covered gain weight, and a
knapsack dynamic program finds the configurations of most weight. Rounded down, the solution places most pieces; what is left is
solved and rounded again until nothing is. A plan is a list of (length, ranks, first sequence, offset) ranges, so
a piece finds its place from its rank among pieces of its length, which prefix sums over buckets give.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, in_workers, lean, materialise, read

LENGTH = 1024
END = 2
#: Rounds of the multiplicative weights in one solution, at least; few sizes get more.
ROUNDS = 40
#: Cached words of the tokeniser in one Python worker.
CACHE = 800_000
#: Bytes of new words that are encoded together.
JOINED = 8000


class WordCache(dict):
    """Ids of words that follow a space, as little-endian bytes. The vocabulary's file is opened where it is used."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a byte is one character of a token's string
        known = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(known.values()) + 1, np.int64)
        for token, number in known.items():
            self.widths[number] = len(token)

    def encoded(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without nulls, each followed by `end`, in a row, and where each text's begin.

        A space before anything but white space begins a new word, so texts are cut there, equal cuts are
        found by Arrow, and ids are gathered. A text with a space before white space is left to the tokeniser.
        """
        cut = pc.split_pattern(texts, " ")
        edges = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        edges, place = edges - edges[0], coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        heads = [words[k] for k in place[edges[:-1]].tolist()]
        blank = pc.or_(pc.equal(pc.binary_length(coded.dictionary), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, 0, 1)))
        odd = blank.to_numpy(zero_copy_only=False)
        texts_odd = np.flatnonzero(np.add.reduceat(odd[place], edges[:-1]) > odd[place[edges[:-1]]]) if len(heads) else np.zeros(0, np.int64)
        for k in texts_odd.tolist():
            heads[k] = texts[k].as_py()
        found = list(map(self.get, words))
        new = [k for k, x in enumerate(found) if x is None and not odd[k]]
        if len(self) + len(new) > CACHE:
            self.clear()
        for k, ids in zip(new, self.learned([words[k] for k in new]), strict=True):
            found[k] = ids
        entries = [x or b"" for x in found]
        entries += [np.array(got.ids, "<u4").tobytes() for got in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]
        entries.append(np.array([end], "<u4").tobytes())
        # a text is its head, its other words and the end
        place = place.copy()
        place[edges[:-1]] = len(words) + np.arange(len(heads))
        for k in texts_odd.tolist():
            place[edges[k] + 1 : edges[k + 1]] = len(entries) - 1
        sizes = np.fromiter(map(len, entries), np.int32, len(entries)) // 4
        place = np.insert(place, edges[1:], len(entries) - 1)
        count = sizes[place]
        bounds = edges + np.arange(len(edges))
        for k in texts_odd.tolist():
            count[bounds[k] + 1 : bounds[k + 1] - 1] = 0
        stops = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        flat = np.frombuffer(b"".join(entries), "<u4")
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        at = np.repeat(starts[place] - stops[:-1], count)
        at += np.arange(stops[-1])
        return flat[at], stops[bounds]

    def learned(self, new: list[str]) -> list[bytes]:
        """The ids of words that follow a space, which are kept. Such words begin anew wherever they stand, so many are encoded as one text
        and told apart by their tokens' widths."""
        ends = np.cumsum([len(w.encode()) + 1 for w in new], dtype=np.int64)
        low = 0
        out: list[bytes] = []
        while low < len(new):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + JOINED, "right")))
            (got,) = self.tokenizer.encode_batch_fast([" " + " ".join(new[low:high])], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            raw = ids.tobytes()
            cuts = (4 * (np.searchsorted(np.cumsum(self.widths[ids]), ends[low:high] - before) + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            low = high
        self.update(zip(new, out, strict=True))
        return out


@functools.cache
def word_cache(path: str) -> WordCache:
    """One cache for all tasks that a Python worker runs."""
    return WordCache(path)


def forget() -> None:
    """Drops this worker's cache."""
    word_cache.cache_clear()
    give_back()


def _groups(sizes: list[int], rows: int = 1 << 14, chars: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size; a longer text is alone."""
    low = held = 0
    for i, n in enumerate(sizes):
        if i > low and (i - low >= rows or held + n > chars):
            yield low, i
            low, held = i, 0
        held += n
    if low < len(sizes):
        yield low, len(sizes)


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of every document's pieces.

    A document is its ids and `end`; null texts are empty, so are one id. Longer ones are cut so that all pieces but the first are full.
    """
    fields = [("piece", "int", pa.int32()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64())] + [("ids", "binary", pa.binary())] * keep_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for low, high in _groups(pc.binary_length(texts).to_pylist()):
                tokens, edges = cache.encoded(texts.slice(low, high - low), end)
                at: list[int] = []
                out: list[list] = [[] for _ in fields]
                raw = memoryview(tokens.astype("<u4")).cast("B")
                for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
                    first = (b - a) % length or length
                    for k, to in enumerate(range(a + first, b + 1, length)):
                        since = to - length if k else a
                        part = raw[4 * since : 4 * to]
                        at.append(low + i)
                        for column, value in zip(out, (k, since - a, to - since, zlib.crc32(part), part), strict=False):
                            column.append(value)
                if keep_ids:
                    out[-1] = [bytes(x) for x in out[-1]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(v, f[2]) for v, f in zip(out, fields, strict=True)]], ["doc_id", *[f[0] for f in fields]])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lean(run), ", ".join([f"doc_id {kind}", *[f"{a} {b}" for a, b, _ in fields]]))


def price_configurations(prices: np.ndarray, sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest worth of a configuration, and configurations as rows of copies of each size: for each size the one of most
    worth that has it, and the best of all. No row has more copies of a size than counts says.

    A knapsack program with bounded copies: a size enters in bundles of 1, 2, 4, .. copies, each taken once or not.
    """
    bundles = []
    for i, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        left, k = min(n, capacity // size), 1
        while left:
            k = min(k, left)
            bundles.append((i, k, k * size))
            left, k = left - k, 2 * k
    best, taken = np.zeros(capacity + 1), np.zeros((len(bundles), capacity + 1), bool)
    for j, (i, k, weight) in enumerate(bundles):
        worth = best[:-weight] + k * prices[i]
        taken[j, weight:] = worth > best[weight:]
        np.maximum(best[weight:], worth, out=best[weight:])
    room = np.concatenate([capacity - sizes, [capacity]])
    rows = np.zeros((len(room), len(sizes)), np.int16)
    rows[np.arange(len(sizes)), np.arange(len(sizes))] = 1
    for j in range(len(bundles) - 1, -1, -1):
        i, k, weight = bundles[j]
        take = taken[j][room]
        if take.any():
            rows[:, i] += k * take
            room = room - weight * take
    return float(best[capacity]), np.minimum(rows, counts).astype(np.int16)


def solve_configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, *, rounds: int | None = None, near: float = 0.02, step: float = 0.15, gap: float = 0.001) -> tuple[dict[bytes, float], float]:
    """Fractional uses of configurations (copies of each size, as 16-bit numbers) that cover counts pieces of sizes, and a lower bound of their number.

    Multiplicative weights: a round prices sizes by weight over count, takes the configurations worth nearly as much as
    the best, each as often as its size is wanted, `step` (less in later rounds) of the most covered size at most, and lowers the
    weights of what they cover. It ends when uses and bound differ by `gap`, or after `rounds`; the uses of the first half are not kept. Uses are scaled to cover 1 / 1.3
    of all tokens, so few sizes are covered more than once; rounding sees to those.
    """
    rounds = rounds or max(ROUNDS, min(1000, 20_000 // len(sizes)))
    mass = (sizes * counts).astype(float)
    weights = mass / mass.sum()
    used: dict[bytes, float] = {}
    covered, total, bound = np.zeros(len(sizes)), 0.0, 0.0
    for turn in range(rounds):
        if turn == rounds // 2:  # uses at prices far from the last ones are forgotten
            used, covered, total = {}, np.zeros(len(sizes)), 0.0
        prices = weights / counts
        top, rows = price_configurations(prices, sizes, counts, capacity)
        bound = max(bound, weights.sum() / top)
        worth = rows @ prices
        fit = worth >= (1 - near) * top
        rows = rows[fit]
        amount = np.concatenate([counts.astype(float), [0.0 if fit[:-1].any() else 1.0]])[fit] / rows.max(1)
        share = (amount @ rows) / counts
        scale = step * max(0.1, 1 - turn / rounds) / share.max()
        for row, x in zip(rows, (amount * scale).tolist(), strict=True):
            if x:
                key = row.tobytes()
                used[key] = used.get(key, 0.0) + x
        covered += share * scale
        total += amount.sum() * scale
        weights = weights * np.exp(-share * scale)
        weights /= weights.sum()
        if covered.min() and total / covered.min() <= (1 + gap) * bound:
            break
    most = 1.3 * float(covered @ mass / mass.sum())
    return {k: v / most for k, v in used.items()}, bound


def _rounded(histogram: dict[int, int], length: int) -> dict[tuple[int, ...], int]:
    """Lengths in one sequence, and how many such sequences; holds every piece once.

    The program is solved, its uses are rounded down and taken while pieces last; if that takes less than half, each configuration
    is taken once more while its pieces last. What is left is solved again until nothing is, so the
    program places every piece, few or many.
    """
    left = {n: m for n, m in histogram.items() if m and n < length}
    groups: dict[tuple[int, ...], int] = {(length,): histogram[length]} if histogram.get(length) else {}
    while left:
        sizes = np.array(sorted(left))
        counts = np.array([left[n] for n in sizes.tolist()])
        remain = counts.copy()

        def take(row: np.ndarray, most: int) -> None:
            kinds = np.flatnonzero(row)
            m = min(most, int((remain[kinds] // row[kinds]).min()))
            if m:
                remain[kinds] -= m * row[kinds]
                key = tuple(np.repeat(sizes[kinds], row[kinds])[::-1].tolist())
                groups[key] = groups.get(key, 0) + m

        used, _ = solve_configurations(sizes, counts, length)
        ranked = sorted(used.items(), key=lambda u: (-u[1], u[0]))
        for key, x in ranked:
            if x < 1 - 1e-9:
                break
            take(np.frombuffer(key, np.int16).astype(np.int64), int(x + 1e-9))
        if 2 * remain.sum() > counts.sum():
            for key, _ in ranked:
                take(np.frombuffer(key, np.int16).astype(np.int64), 1)
        left = {int(n): int(m) for n, m in zip(sizes, remain, strict=True) if m}
    return groups


def plan_packing(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences); holds every piece once.

    Sequences with more room than most, and as many of those made of the shortest pieces, are planned once more while that saves any.
    """
    groups = _rounded(histogram, length)
    while groups:
        mean = sum(sum(k) * m for k, m in groups.items()) / sum(groups.values())
        pool = {k: m for k, m in groups.items() if sum(k) < mean}
        more = sum(pool.values())
        for key in sorted(groups.keys() - pool.keys(), key=lambda k: (k[0], k)):
            if more > 0:
                pool[key] = min(more, groups[key])
                more -= pool[key]
        pieces: dict[int, int] = {}
        for key, m in pool.items():
            for n in key:
                pieces[n] = pieces.get(n, 0) + m
        new = _rounded(pieces, length)
        if sum(new.values()) >= sum(pool.values()):
            break
        groups = {k: n for k in groups.keys() | new.keys() if (n := groups.get(k, 0) - pool.get(k, 0) + new.get(k, 0))}
    return sorted(groups.items())


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces with sequence_id and offset. Needs doc_id, piece and length (1 to `length`).

    Rows that repeat a document and piece are pieces of their own. No rows: no rows.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 40))
    pieces = materialise(pieces.withColumn("__hash", bucket), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = sum(histogram.values())
    parts = max(1, rows // 100_000)
    pieces = pieces.withColumn("__bucket", F.pmod("__hash", F.lit(parts)))
    counts = pieces.groupBy("length", "__bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "__bucket", before.alias("__before"))
    own = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = pieces.join(counts, ["length", "__bucket"]).withColumn("rank", F.col("__before") + F.row_number().over(own) - 1).drop("__before", "__bucket", "__hash")
    slots: list[tuple[int, int, int, int]] = []
    given: dict[int, int] = {}
    sequence = 0
    for lengths, m in plan_packing(histogram, length):
        offset = 0
        for n in lengths:
            slots.append((n, given.get(n, 0), sequence, offset))
            given[n] = given.get(n, 0) + m
            offset += n
        sequence += m
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            k = batch.schema.get_field_index("rank")
            rank = batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
            row = table[np.searchsorted(keys, (n << 44) + rank, "right") - 1] if len(n) else table[:0]
            columns = [c for i, c in enumerate(batch.columns) if i != k]
            names = [x for i, x in enumerate(batch.schema.names) if i != k]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), kind + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their sequences and places there."""
    packed = pack_pieces(token_pieces(docs, path, id_col=id_col, text_col=text_col, length=length, end=end, keep_ids=keep_ids), length)
    in_workers(docs.sparkSession, forget)  # pieces are on disk by now; workers outlive the stage
    return packed


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary())
