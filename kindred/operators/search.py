"""Filtered, weighted top-k search: one query as expressions, many queries as blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ordering import cut, placed
from .space import CANDIDATE_POOL, TOP_K, FeatureSpace

FILTER_FIELDS = ("genus", "group_label", "license")
#: Decimal places beyond which distances tie, as their last digits depend on the order of sums.
TIE = 9
#: Queries whose vectors go to every task at once; of searches, which hold no row of items per query, more, as items are read once a block.
QUERY_BLOCK, SEARCH_BLOCK = 4096, 16_384
#: Blocks of queries that come to the driver at once.
FETCHED = 8
#: Items and queries whose bounds are held at once, and the error of products in single precision, a dimension.
TILE, ROWS, MARGIN = 2048, 64, 2.0**-22


def matches(filters: Mapping[str, list[str] | set[str]] | None) -> Column:
    """All fields must match, any value of a field will do; no values are no constraint, null counts as ''."""
    tests = [F.coalesce(F.col(k).cast("string"), F.lit("")).isin(sorted(v)) for k, v in (filters or {}).items() if v]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_values(items: DataFrame, field: str) -> DataFrame:
    return items.select(field).filter(F.col(field).isNotNull() & (F.col(field) != "")).distinct().orderBy(field)


def parse_filters(**given: str | None) -> dict[str, set[str]]:
    """Fields with lists split at commas; fields without a list are left out."""
    return {k: set(v.split(",")) for k, v in given.items() if v}


def ranked_scan(space: FeatureSpace, query: Mapping[str, list[float]], filters=None, exclude=(), candidates: DataFrame | None = None) -> DataFrame:
    """Items that pass, with raw_S per set and `distance`. Filters stand before distances, so they reach the scan.

    With candidates (ids that an index found) only those are ranked.
    """
    items = space.items.filter(matches(filters))
    if candidates is not None:
        items = items.join(candidates.select(space.id_col), space.id_col, "left_semi")
    if exclude:
        items = items.filter(~F.col(space.id_col).isin(list(exclude)))
    items = items.withColumns({s: space.prepared(s) for s in space.sets})
    raw = space.distances(query)
    items = items.withColumns({f"raw_{s}": d for s, d in raw.items()})
    return items.withColumn("distance", space.combine({s: F.col(f"raw_{s}") for s in raw})).drop(*space.sets)


def top_k(space: FeatureSpace, query: Mapping[str, list[float]], k: int = TOP_K, filters=None, exclude=(), candidates: DataFrame | None = None) -> DataFrame:
    """rank, id, metadata, distance, similarity, raw_S of the k nearest; ties by id. TakeOrderedAndProject: no full sort."""
    best = ranked_scan(space, query, filters, exclude, candidates).orderBy(F.round("distance", TIE), space.id_col).limit(k)
    by = Window.orderBy(F.round("distance", TIE), space.id_col)  # over k rows
    return best.withColumn("rank", F.row_number().over(by)).withColumn("similarity", V.similarity(F.col("distance")))


def per_set(space: FeatureSpace, results: DataFrame) -> DataFrame:
    """A row per result and set: raw, norm (raw over scale), weight, contribution."""
    rows = [F.struct(F.lit(s).alias("set_name"), F.col(f"raw_{s}").alias("raw"), (F.col(f"raw_{s}") / space.scales[s]).alias("norm"), F.lit(space.weights[s]).alias("weight"), (space.weights[s] * F.col(f"raw_{s}") / space.scales[s]).alias("contrib")) for s in space.sets if f"raw_{s}" in results.columns]
    return results.select("rank", space.id_col, F.explode(F.array(*rows)).alias("x")).select("rank", space.id_col, "x.*")


def results_table(space: FeatureSpace, results: DataFrame, places: int = 4) -> DataFrame:
    """A row per result with its distance, similarity and each set's norm, rounded."""
    norms = [F.round(F.col(f"raw_{s}") / space.scales[s], places).alias(s) for s in space.sets if f"raw_{s}" in results.columns]
    return results.select("rank", space.id_col, F.round("similarity", places).alias("similarity"), F.round("distance", places).alias("distance"), *norms)


def explain_text(space: FeatureSpace, results: DataFrame) -> DataFrame:
    """One text line per result."""
    parts = [F.format_string(f"%s {s}=%.4f", F.lit(""), F.col(f"raw_{s}") / space.scales[s]) for s in space.sets if f"raw_{s}" in results.columns]
    return results.select("rank", F.concat(F.format_string("%2d. %s sim=%.4f D=%.4f", F.col("rank"), F.col(space.id_col).cast("string"), F.col("similarity"), F.col("distance")), *parts).alias("line"))


def to_json(space: FeatureSpace, results: DataFrame, places: int = 5) -> DataFrame:
    named = [F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes]
    return results.select("rank", F.to_json(F.struct(*named)).alias("json"))


def batch_top_k(space: FeatureSpace, queries: DataFrame, k: int = TOP_K, *, exclude_self: bool = True, filters=None, query_block: int = SEARCH_BLOCK) -> DataFrame:
    """qid, rank, id, distance: the k nearest items of every query (columns qid and the sets); ties by id.

    Queries come in blocks of bounded size. A task holds a block and streams its items past it, keeping k per query; what tasks
    kept is merged by a window. Matrix products in single precision bound distances from below, and only pairs that the bound
    doesn't rule out are computed in double precision (see _nearest). So k rows per query and task are shuffled, not a row per
    pair, and the more blocks there are, the fewer tasks share a block's items.
    """
    return _first(_streamed(space, queries, k, exclude_self=exclude_self, filters=filters, query_block=query_block), k)


def _streamed(space: FeatureSpace, queries: DataFrame, k: int, *, exclude_self: bool = True, filters=None, query_block: int = SEARCH_BLOCK, also: FeatureSpace | None = None) -> DataFrame:
    """qid, id, distance: what each task keeps; and `also`, the distance of these in another space, whose sets are columns of items and queries."""
    spaces = [space] if also is None else [space, also]
    # a set that weighs nothing is neither read nor compared
    factors = [{s: x.weights[s] / x.scales[s] for s in x.sets if x.weights[s] / x.scales[s] != 0} for x in spaces]
    sets = [s for f in factors for s in f]
    items = space.items.filter(matches(filters)).select(F.col(space.id_col).cast("long").alias("id"), *sets)
    asked = queries.withColumns({s: x.prepared(s) for x, f in zip(spaces, factors, strict=True) for s in f}).select(F.col("qid").cast("long").alias("qid"), *sets)
    parts = [Bounded.of(x, f) for x, f in zip(spaces, factors, strict=True)]
    schema, blocks = "qid long, id long, distance double" + (", also double" if also else ""), list(_blocks(asked, query_block))
    out, per_block = None, max(1, -(-2 * items.sparkSession.sparkContext.defaultParallelism // max(1, len(blocks))))
    for block in blocks:
        near = items.coalesce(per_block).mapInArrow(_nearest(block, parts, k, exclude_self), schema)
        out = near if out is None else out.unionByName(near)
    return items.sparkSession.createDataFrame([], schema) if out is None else out


def _blocks(asked: DataFrame, size: int) -> Iterator[pa.Table]:
    """The queries in blocks of at most `size` rows; about FETCHED blocks come to the driver at once."""
    n = asked.count()
    parts = max(1, -(-n // max(1, size * FETCHED * 3 // 4)))
    for b in range(parts):
        got = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == b)).toArrow()
        step = -(-got.num_rows // max(1, -(-got.num_rows // size)))
        for low in range(0, got.num_rows, max(1, step)):
            yield got.slice(low, step)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pairwise(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "l1":
        out = np.zeros((len(q), len(x)))
        for j in range(q.shape[1]):
            out += np.abs(q[:, j, None] - x[None, :, j])
        return out
    if metric == "l2":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0))
    return 1 - (q @ x.T) / ((np.linalg.norm(q, axis=1) + V.EPS)[:, None] * (np.linalg.norm(x, axis=1) + V.EPS)[None, :])


@dataclass
class Bounded:
    """The weighted sum of distances of a space: exact, and from below by matrix products in single precision.

    With norms it takes, a product errs by a share MARGIN * (dimensions + 8) of the sum of its terms' sizes at most, which is
    subtracted. An l1 distance is no less than the l2 distance, nor than that of vectors cut to a range and rounded to whole steps, less a step a dimension.
    """

    metrics: dict[str, str]
    factor: dict[str, float]
    stats: dict[str, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, space: FeatureSpace, factor: dict[str, float]) -> Bounded:
        stats = {s: (np.array(space.stats[s]["mean"], np.float64), np.array(space.stats[s]["std"], np.float64)) for s in factor if space.metrics[s] == "l2"}
        return cls({s: space.metrics[s] for s in factor}, factor, stats)

    def rows(self, table: pa.Table | pa.RecordBatch, prepared: bool) -> dict[str, np.ndarray]:
        """The vectors of each set; z-scores of l2 sets, unless those are given."""
        out = {s: _matrix(table.column(table.schema.get_field_index(s))) for s in self.factor}
        return out if prepared else {s: (v - self.stats[s][0]) / self.stats[s][1] if s in self.stats else v for s, v in out.items()}

    def exact(self, q: dict[str, np.ndarray], x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the pairs of rows i of q and j of x."""
        out = np.zeros(len(i))
        for low in range(0, len(i), 1 << 13):
            own, d = slice(low, low + (1 << 13)), 0.0
            for s, f in self.factor.items():
                a, b = q[s][i[own]], x[s][j[own]]
                if self.metrics[s] == "cosine":
                    one = 1 - np.einsum("ij,ij->i", a, b) / ((np.linalg.norm(a, axis=1) + V.EPS) * (np.linalg.norm(b, axis=1) + V.EPS))
                else:
                    one = np.abs(a - b).sum(1) if self.metrics[s] == "l1" else np.sqrt(np.square(a - b).sum(1))
                d = d + f * one
            out[own] = d
        return out

    def factors(self, v: dict[str, np.ndarray], query: bool) -> dict[str, np.ndarray]:
        """One side of each set's product, of which cosine gives the distance and others its square."""
        out = {}
        for s, f in self.factor.items():
            x = v[s]
            keep, one = 1 - MARGIN * (x.shape[1] + 8), np.ones((len(x), 1))
            if self.metrics[s] == "cosine":
                unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + V.EPS)
                cols = [-f * unit, f * keep * one] if query else [unit, one]
            else:
                square = np.square(x).sum(1, keepdims=True) * keep
                cols = [-2 * f * f * x, f * f * square, f * f * one] if query else [x, one, square]
            out[s] = np.ascontiguousarray(np.hstack(cols).astype(np.float32) if query else np.hstack(cols).astype(np.float32).T)
        return out

    def within(self, q: dict[str, np.ndarray], most: np.ndarray) -> np.ndarray:
        """The only set's side of the queries, as factors() gives it, with a column that takes `most` (or its square) away: products of 0 or less are within it."""
        ((s, side),) = q.items()
        size = most.astype(np.float64) * (1 + MARGIN * (side.shape[1] + 9))
        size = np.minimum(size if self.metrics[s] == "cosine" else size * size, np.finfo(np.float32).max)
        return np.hstack([side, -size[:, None].astype(np.float32)])

    def below(self, q: dict[str, np.ndarray], x: dict[str, np.ndarray], own: slice, without: str | None = None) -> np.ndarray:
        """Lower bounds for rows `own` of the queries and all of x; both as factors() gives them."""
        out = None
        for s in self.factor:
            if s == without:
                continue
            one = q[s][own] @ x[s]
            if self.metrics[s] != "cosine":
                np.sqrt(np.maximum(one, 0, out=one), out=one)
            out = one if out is None else np.add(out, one, out=out)
        return np.zeros((len(q[s][own]), x[s].shape[1]), np.float32) if out is None else out


class Steps:
    """Vectors cut to the range of some queries and rounded down to whole steps, so few that sums of them fit 16 bits."""

    def __init__(self, q: np.ndarray) -> None:
        self.low, high = (float(q.min()), float(q.max())) if q.size and np.isfinite(q).all() else (0.0, 0.0)
        self.step = (high - self.low) / max(1, 65535 // max(1, q.shape[1]) - 1)
        self.live = np.isfinite(self.step) and self.step > 0 and q.shape[1] < 4096

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row per dimension, and each vector's sum."""
        most = 65535 // v.shape[1] - 1
        out = np.clip(np.nan_to_num((v - self.low) / self.step, nan=0.0), 0, most).astype(np.uint16).T
        return np.ascontiguousarray(out), out.sum(0, dtype=np.float32)

    def below(self, q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], own: slice) -> np.ndarray:
        """Lower bounds of l1 distances."""
        total = np.zeros((len(q[1][own]), len(x[1])), np.uint16)
        larger = np.empty_like(total)
        for a, b in zip(q[0], x[0], strict=True):
            # rows filled first: numpy's maximum is fast on rows, not on a row and a number
            np.copyto(larger, a[own][:, None])
            np.add(total, np.maximum(larger, b[None, :], out=larger), out=total)
        out = total.astype(np.float32)
        out *= 2
        out -= q[1][own][:, None] + np.float32(len(q[0]))
        out -= x[1][None, :]
        np.maximum(out, 0, out=out)
        out *= np.float32(self.step * (1 - 1e-5))
        return out


class Coarse:
    """As Steps, but so few steps that four dimensions' fit a byte, and compared as whole numbers: cheaper, and leaves some more pairs."""

    DIMS, MOST = 4, 63

    def __init__(self, q: np.ndarray) -> None:
        finite = q.size > 0 and bool(np.isfinite(q).all())
        self.low = q.min(0) if finite else np.zeros(q.shape[1])
        self.step = float((q.max(0) - self.low).max()) / (self.MOST + 1) if finite else 0.0
        self.live = np.isfinite(self.step) and self.step > 0 and q.shape[1] <= 256

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row per dimension, and each vector's sum."""
        out = np.clip(np.nan_to_num((v - self.low) / self.step, nan=0.0), 0, self.MOST).astype(np.uint8).T
        return np.ascontiguousarray(out), out.sum(0, dtype=np.int64)

    def near(self, q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], own: slice, most: np.ndarray) -> np.ndarray:
        """Which l1 distances may be `most` (a row's) or less. They are more than (2 m - a - b - dimensions) steps: m sums the larger of both sides, a and b are sums."""
        total = np.zeros((len(most), len(x[1])), np.uint16)
        part, larger = np.empty(total.shape, np.uint8), np.empty(total.shape, np.uint8)
        for k, (a, b) in enumerate(zip(q[0], x[0], strict=True)):
            into = larger if k % self.DIMS else part
            np.copyto(into, a[own][:, None])
            np.maximum(into, b[None, :], out=into)
            if k % self.DIMS:
                np.add(part, larger, out=part)
            if k % self.DIMS == self.DIMS - 1 or k == len(q[0]) - 1:
                np.add(total, part, out=total)
        # no sum exceeds 256 * MOST, so what is cut off from a large `most` leaves all pairs
        room = np.minimum(most.astype(np.float64) / self.step * (1 + 1e-5) + q[1][own] + len(q[0]), 80_000) / 2 + 1
        return total <= (room.astype(np.uint16)[:, None] + ((x[1] + 1) // 2).astype(np.uint16)[None, :])


def _places(live: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true: by eights first."""
    flat = live.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _nearest(block: pa.Table, spaces: list[Bounded], k: int, exclude_self: bool):
    """The k nearest by the first of spaces among a task's items, for each query of the block; and their distances by the second, if given.

    Tiles of few queries by TILE items are bounded from below; pairs whose bound isn't above the query's k-th distance so far
    are computed. Where the bounds leave many, an l1 set is bounded by Steps; alone, by Coarse before. Of a set alone the bound goes into
    the product. Tiles begin small, so that k-th distances are known early.
    """
    qid = block.column("qid").to_numpy().astype(np.int64)
    near = spaces[0]
    l1 = next((s for s, m in near.metrics.items() if m == "l1"), None)
    # a negative weight has no lower bound
    bounded = all(not f < 0 for f in near.factor.values())
    alone = bounded and len(near.factor) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = [x.rows(block, True) for x in spaces]
        best = [np.full((len(qid), k), np.inf) for _ in spaces]
        best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
        q_side = near.factors(q[0], True) if bounded else {}
        steps = Steps(q[0][l1]) if l1 else None
        q_steps = steps.of(q[0][l1]) if steps and steps.live else None
        coarse = Coarse(q[0][l1]) if q_steps and alone else None
        q_coarse = coarse.of(q[0][l1]) if coarse and coarse.live else None
        width = 64
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part = batch.slice(low, width)
                low, width = low + width, min(TILE, width * 2)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = [s.rows(part, False) for s in spaces]
                x_side = near.factors(x[0], False) if bounded else {}
                x_steps, x_coarse, found, many = None, None, [], False
                most = best[0][:, -1]
                bound = ((np.round(most, TIE) + 2 * 10.0**-TIE) * (1 + 1e-5)).astype(np.float32)
                if alone:
                    q_within = near.within(q_side, bound)
                    ((_, side),) = x_side.items()
                    x_within = np.vstack([side, np.ones((1, len(ids)), np.float32)])
                for top in range(0, len(qid), ROWS):
                    own = slice(top, top + ROWS)
                    if bounded:
                        if not many:
                            live = ~(q_within[own] @ x_within > 0) if alone else ~(near.below(q_side, x_side, own) > bound[own][:, None])
                            many = q_steps is not None and np.count_nonzero(live) * 16 > live.size and bool(np.isfinite(most[own]).all())
                        left = many
                        if many and q_coarse is not None:
                            x_coarse = x_coarse or coarse.of(x[0][l1])
                            live = coarse.near(q_coarse, x_coarse, own, bound[own] / near.factor[l1])
                            left = np.count_nonzero(live) * 64 > live.size
                        if left:
                            x_steps = x_steps or steps.of(x[0][l1])
                            ahead = near.below(q_side, x_side, own, l1)
                            ahead += np.float32(near.factor[l1]) * steps.below(q_steps, x_steps, own)
                            live = ~(ahead > bound[own][:, None])
                        at = _places(live)
                        i, j = at // len(ids) + top, at % len(ids)
                    else:
                        i, j = (v.ravel() for v in np.meshgrid(np.arange(top, min(top + ROWS, len(qid))), np.arange(len(ids)), indexing="ij"))
                    if exclude_self:
                        others = qid[i] != ids[j]
                        i, j = i[others], j[others]
                    if len(i):
                        d = near.exact(q[0], x[0], i, j)
                        short, last = np.round(d, TIE), np.round(most[i], TIE)
                        ok = (short < last) | ((short == last) & (ids[j] < best_i[i, -1]))
                        found.append((i[ok], j[ok], d[ok]))
                    if found and ((top + ROWS) % QUERY_BLOCK == 0 or top + ROWS >= len(qid)):
                        i, j, d = (np.concatenate(v) for v in zip(*found, strict=True))
                        new = [d] + [s.exact(a, b, i, j) for s, a, b in zip(spaces[1:], q[1:], x[1:], strict=True)]
                        _merge(best, best_i, i, ids[j], new)
                        found = []
        rows, cols = np.nonzero(np.isfinite(best[0]))
        names = ["qid", "id", "distance", "also"][: 2 + len(spaces)]
        yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(best_i[rows, cols]), *[pa.array(b[rows, cols]) for b in best]], names)

    return run


def _merge(best: list[np.ndarray], best_i: np.ndarray, i: np.ndarray, ids: np.ndarray, new: list[np.ndarray]) -> None:
    """Takes new rows (place of the query, id, distances) into the k best of each query, in the order of distance and id."""
    k, (hit, at, many) = best_i.shape[1], np.unique(i, return_inverse=True, return_counts=True)
    if not len(hit):
        return
    order = np.argsort(at, kind="stable")
    column = k + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    wide = (len(hit), k + int(many.max()))
    all_i = np.full(wide, np.iinfo(np.int64).max)
    all_i[:, :k], all_i[at[order], column] = best_i[hit], ids[order]
    every = []
    for b, v in zip(best, new, strict=True):
        every.append(np.full(wide, np.inf))
        every[-1][:, :k], every[-1][at[order], column] = b[hit], v[order]
    short = np.round(every[0], TIE)
    take = np.argsort(short, axis=1)
    near = np.take_along_axis(short, take, 1)
    tied = np.flatnonzero(((near[:, 1:] == near[:, :-1]) & np.isfinite(near[:, 1:])).any(1))
    take[tied] = np.lexsort((all_i[tied], short[tied]), axis=1)
    take = take[:, :k]
    best_i[hit] = np.take_along_axis(all_i, take, 1)
    for b, v in zip(best, every, strict=True):
        b[hit] = np.take_along_axis(v, take, 1)


def component_top_k(space: FeatureSpace, z: DataFrame, dims: int, k: int = TOP_K, n: int = CANDIDATE_POOL, z_col: str = "z") -> DataFrame:
    """qid, rank, id, distance: of each row's n nearest others in the first `dims` components, what a k-d tree, R-tree or quadtree gives, the
    k nearest by the combined distance; ties by id. z: ids and components of all items. Both distances come from one pass over the items."""
    rows = cut(space.items.select(space.id_col, *space.sets).join(z.select(space.id_col, F.slice(z_col, 1, dims).alias("__z")), space.id_col))
    size = rows.select(F.size("__z")).first()
    plain = {"mean": [0.0] * (size[0] if size else 0), "std": [1.0] * (size[0] if size else 0)}
    flat = FeatureSpace(rows, {"__z": "l2"}, space.id_col, weights={"__z": 1.0}, stats={"__z": plain}, scales={"__z": 1.0})
    pool = _first(_streamed(flat, rows.withColumnRenamed(space.id_col, "qid"), n, also=space), n)
    return _first(pool.select("qid", "id", F.col("also").alias("distance")), k)


def cluster_top_k(space: FeatureSpace, assigned: DataFrame, visited: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k nearest by the combined distance among the rows of the clusters that each query visits, a cluster at a time.

    assigned: id, cluster_id of all items. visited: qid, cluster_id. Rows are streamed as in batch_top_k, without a row per pair.
    """
    items, visited = cut(space.items.select(space.id_col, *space.sets).join(assigned, space.id_col)), cut(visited)
    asked = cut(items.drop("cluster_id").withColumnRenamed(space.id_col, "qid").join(visited, "qid"))  # as many rows a query as clusters it visits
    out = None
    for (c,) in visited.select("cluster_id").distinct().collect():  # as many as clusters, a parameter
        own = replace(space, items=items.filter(F.col("cluster_id") == c).drop("cluster_id"))
        near = _streamed(own, asked.filter(F.col("cluster_id") == c).drop("cluster_id"), k)
        out = near if out is None else out.unionByName(near)
    return _first(items.sparkSession.createDataFrame([], "qid long, id long, distance double") if out is None else out, k)


def _first(near: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.round("distance", TIE), "id")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def pick_rows(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that looks random and that the seed alone decides."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return rows.orderBy(key, id_col).limit(n)


def every_step(rows: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """The first n of the rows at places 0, s, 2 s, ... in order, where s is the number of rows divided by n, 1 at least."""
    at = placed(rows, order_col, name="__place", total="__n")
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / n))
    return at.filter(((F.col("__place") - 1) % step == 0) & (F.col("__place") <= step * n)).drop("__place", "__n")


def widened_pool(ranked: DataFrame, passes: Column, top_k: int = TOP_K, excluded: int = 0, pool: int = CANDIDATE_POOL) -> DataFrame:
    """Candidates of an index under filters, without a loop. ranked: rank (1-based, by the index) and what `passes` needs.

    The pool starts at `pool` + excluded and doubles until it holds top_k + excluded rows that pass, or all rows. The rank at
    which enough have passed tells how often it doubles.
    """
    start, need = pool + excluded, top_k + excluded
    hits = ranked.filter(passes)
    enough = hits.orderBy("rank").limit(need).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    size = F.when(F.col("n") < need, F.lit(None)).otherwise(F.lit(start) * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("last") / start)).cast("double"))))
    bound = enough.select(size.cast("long").alias("pool"))  # one row
    return hits.join(F.broadcast(bound), F.col("pool").isNull() | (F.col("rank") <= F.col("pool")), "inner")
