"""How well vectors part classes: Fisher ratio, separation, nearest neighbours, profiles, medoids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ordering import cut
from .search import QUERY_BLOCK, TIE, _blocks, _matrix, _pairwise


def standardised(rows: DataFrame, vector: str) -> DataFrame:
    """z-scores by the rows' own statistics: two passes, a row of statistics per dimension."""
    long = rows.select(F.posexplode(vector).alias("d", "v"))
    std = F.stddev_pop("v")
    stats = long.groupBy("d").agg(F.avg("v").alias("m"), F.when(std < V.STD_FLOOR, F.lit(1.0)).otherwise(std).alias("s"))
    line = stats.agg(F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("x")).select(F.transform("x", lambda e: e["m"]).alias("__m"), F.transform("x", lambda e: e["s"]).alias("__s"))
    return rows.crossJoin(F.broadcast(line)).withColumn(vector, V.zscore(F.col(vector), F.col("__m"), F.col("__s"))).drop("__m", "__s")  # one row


def fisher_ratio(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean over dimensions of the sum of squares between classes over that within, dimensions with 1e-9 or less within left out."""
    z = standardised(rows, vector).select(label, F.posexplode(vector).alias("d", "v"))
    by_class = z.groupBy("d", label).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.sum("v").alias("sum"), F.var_pop("v").alias("var"))
    whole = Window.partitionBy("d")
    by_class = by_class.withColumn("mean", F.sum("sum").over(whole) / F.sum("n").over(whole))
    per = by_class.groupBy("d").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2.0))).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    return per.filter(F.col("within") > 1e-9).agg(F.avg(F.col("between") / F.col("within")).alias("fisher"))


def pair_distances(rows: DataFrame, vector: str, metric: str, id_col: str, label: str) -> DataFrame:
    """All ordered pairs of different rows with their distance. The result is as large as the square of the rows; it is what the
    separation ratio is defined on."""
    a = rows.select(F.col(id_col).alias("a"), F.col(label).alias("label_a"), F.col(vector).alias("va"))
    b = rows.select(F.col(id_col).alias("b"), F.col(label).alias("label_b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", "label_a", "label_b", V.distance(metric, F.col("va"), F.col("vb")).alias("d"))


def separation(pairs: DataFrame) -> DataFrame:
    same = F.col("label_a") == F.col("label_b")
    out = pairs.agg(F.avg(F.when(same, F.col("d"))).alias("intra"), F.avg(F.when(~same, F.col("d"))).alias("inter"))
    return out.withColumn("sep_ratio", F.col("inter") / F.greatest(F.col("intra"), F.lit(1e-9)))


def nearest_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of rows whose nearest other row has their label; ties to the smallest id. A partial aggregation, no sort."""
    best = pairs.groupBy("a", "label_a").agg(F.min(F.struct("d", "b", "label_b")).alias("x"))
    return best.agg(F.avg((F.col("x.label_b") == F.col("label_a")).cast("int")).alias("nn1_acc"))


def chance_level(rows: DataFrame, label: str) -> DataFrame:
    """The expected match of shuffled labels: the sum of squared shares."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return c.agg((F.sum(F.pow(F.col("c").cast("double"), F.lit(2.0))) / F.pow(F.sum("c").cast("double"), F.lit(2.0))).alias("chance"))


def profile(rows: DataFrame, label: str, named: dict[str, tuple[str, int, float]]) -> DataFrame:
    """Per label and for '__all__' rows: n, mean and population deviation of named dimensions (column, 1-based place, factor)."""
    values = [(F.element_at(c, k) * f).alias(n) for n, (c, k, f) in named.items()]
    rows = rows.select(F.col(label).alias("label"), *values)
    aggs = [x for n in named for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))]
    grouped = rows.rollup("label").agg(F.grouping("label").alias("g"), F.count(F.lit(1)).alias("n"), *aggs)
    return grouped.withColumn("label", F.when(F.col("g") == 1, F.lit("__all__")).otherwise(F.col("label"))).drop("g")


def medoids(pairs: DataFrame) -> DataFrame:
    """Per label the row nearest to its fellows on average."""
    near = pairs.filter(F.col("label_a") == F.col("label_b")).groupBy("label_a", "a").agg(F.round(F.avg("d"), 9).alias("mean_d"))
    return near.groupBy("label_a").agg(F.min(F.struct("mean_d", "a")).alias("x")).select(F.col("label_a").alias("genus"), F.col("x.a").alias("medoid"), F.col("x.mean_d").alias("mean_d"))


def closest_pair(pairs: DataFrame, items: DataFrame, id_col: str, author: str) -> DataFrame:
    """Per label the closest pair by different authors."""
    who = items.select(F.col(id_col).alias("k"), F.col(author).alias("author"))
    rows = pairs.filter((F.col("label_a") == F.col("label_b")) & (F.col("a") < F.col("b"))).join(who.select(F.col("k").alias("a"), F.col("author").alias("author_a")), "a").join(who.select(F.col("k").alias("b"), F.col("author").alias("author_b")), "b")
    best = rows.filter(F.col("author_a") != F.col("author_b")).groupBy("label_a").agg(F.min(F.struct(F.round("d", 9).alias("d"), "a", "b")).alias("x"))
    return best.select(F.col("label_a").alias("genus"), "x.a", "x.b", F.col("x.d").alias("d"))


def example_triplet(rows: DataFrame, metrics: dict[str, str], by: str, near: str, far: str, id_col: str, label: str, author: str) -> DataFrame:
    """a, b, c and, per set, the distances AB, AC, BC: a and b the closest two of label `near` by different authors, c the medoid of label `far`,
    both by set `by`. Vectors of l2 sets are standardised over all rows; distances to c's fellows include that to itself.

    The closest pair comes from streamed blocks; the medoid's means take a row per pair within a block only.
    """
    z = rows
    for s, m in metrics.items():
        z = standardised(z, s) if m == "l2" else z
    z = cut(z.select(id_col, label, author, *metrics))
    pair = closest_pair_of_all(z.filter(F.col(label) == near), by, metrics[by], id_col, label, author).select("a", "b")
    middle = medoid_of(z.filter(F.col(label) == far), by, metrics[by], id_col).select(F.col("medoid").alias("c"))
    found = pair.crossJoin(middle)  # one row
    of = lambda k: z.select(F.col(id_col).cast("long").alias(k), *[F.col(s).alias(f"{s}_{k}") for s in metrics])
    for k in "abc":
        found = found.join(of(k), k)
    far_apart = lambda s, x, y: V.distance(metrics[s], F.col(f"{s}_{x}"), F.col(f"{s}_{y}"))
    each = [F.struct(F.lit(s).alias("set_name"), *[far_apart(s, x, y).alias(f"{x}{y}") for x, y in ("ab", "ac", "bc")]) for s in metrics]
    return found.select("a", "b", "c", F.inline(F.array(*each)))


def medoid_of(rows: DataFrame, vector: str, metric: str, id_col: str, query_block: int = QUERY_BLOCK) -> DataFrame:
    """medoid, mean_d: the row with the least mean distance to all rows, itself included, in streamed blocks; ties to the smallest id."""
    items = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vector).alias("v"))

    def kernel(block: pa.Table):
        qid, q = block.column("qid").to_numpy(), _matrix(block.column("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(len(qid)), 0
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    d = _pairwise(metric, q, _matrix(part.column(1)))
                    d[qid[:, None] == part.column(0).to_numpy(zero_copy_only=False)[None, :]] = 0
                    sums, n = sums + d.sum(1), n + part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(sums), pa.array(np.full(len(qid), n))], ["id", "s", "n"])

        return run

    sums = _streamed(items, items, kernel, "id long, s double, n long", query_block).groupBy("id").agg((F.sum("s") / F.sum("n")).alias("d"))
    return sums.agg(F.min(F.struct(F.round("d", TIE).alias("d"), "id")).alias("x")).select(F.col("x.id").alias("medoid"), F.col("x.d").alias("mean_d"))


# The same over whole tables, without a row per pair. Ids are unique; rows without a label or vector have no part.


def _class_sums(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """label, d, n, s, q: counts, sums and sums of squares of the vectors divided by norm + EPS."""
    long = rows.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(V.unit(F.col(vector))).alias("d", "v"))
    return long.groupBy("label", "d").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def cosine_separation(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """separation() of all pairs by cosine: sums over pairs of products are squares of class sums, less the rows' own squares."""
    n, s = F.col("n").cast("double"), F.col("s")
    by_dim = _class_sums(rows, vector, label).groupBy("d").agg(F.sum(s * s).alias("own"), F.sum(s).alias("s"), F.sum("q").alias("q"), F.sum(n * (n - 1)).alias("same"), (F.pow(F.sum(n), F.lit(2.0)) - F.sum(n * n)).alias("other"))
    one = by_dim.agg(F.sum("own").alias("own"), F.sum(s * s).alias("all"), F.sum("q").alias("q"), F.max("same").alias("same"), F.max("other").alias("other"))
    mean = lambda x, pairs: 1 - x / F.nullif(F.col(pairs), F.lit(0.0))
    out = one.select(mean(F.col("own") - F.col("q"), "same").alias("intra"), mean(F.col("all") - F.col("own"), "other").alias("inter"))
    return out.withColumn("sep_ratio", F.col("inter") / F.greatest(F.col("intra"), F.lit(1e-9)))


def cosine_medoids(rows: DataFrame, vector: str, id_col: str, label: str) -> DataFrame:
    """medoids() of all rows by cosine: a row's mean distance follows from its product with its class's sum."""
    sums = _class_sums(rows, vector, label).groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "s"))).alias("x"))
    sums = sums.filter("n > 1").select("label", "n", F.transform("x", lambda e: e["s"]).alias("sum"))
    own = rows.select(F.col(id_col).alias("a"), F.col(label).alias("label"), V.unit(F.col(vector)).alias("v")).filter("v is not null")
    mean = 1 - (V.dot(F.col("v"), F.col("sum")) - V.dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)
    near = own.join(sums, "label").select("label", "a", F.round(mean, 9).alias("mean_d"))
    return near.groupBy("label").agg(F.min(F.struct("mean_d", "a")).alias("x")).select(F.col("label").alias("genus"), F.col("x.a").alias("medoid"), F.col("x.mean_d").alias("mean_d"))


def _streamed(asked: DataFrame, items: DataFrame, kernel, schema: str, query_block: int) -> DataFrame:
    """What kernel(block) makes of items for each block of asked."""
    made = [items.mapInArrow(kernel(block), schema) for block in _blocks(asked, query_block)]
    return reduce(DataFrame.unionByName, made) if made else items.sparkSession.createDataFrame([], schema)


def nearest_label_accuracy(rows: DataFrame, vector: str, metric: str, id_col: str, label: str, query_block: int = QUERY_BLOCK) -> DataFrame:
    """nearest_accuracy() of all rows in streamed blocks: a task keeps the nearest row of each in its block. Distances tie as in searches."""
    items = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vector).alias("v"))

    def kernel(block: pa.Table):
        qid, q = block.column("qid").to_numpy(), _matrix(block.column("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_d, best_i = np.full(len(qid), np.inf), np.full(len(qid), np.iinfo(np.int64).max)
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(ids)
                    ids = ids[order]
                    d = np.round(_pairwise(metric, q, _matrix(part.column(1))[order]), TIE)
                    d[qid[:, None] == ids[None, :]] = np.inf
                    at = d.argmin(1)  # the first, so of the smallest id
                    new_d, new_i = d[np.arange(len(qid)), at], ids[at]
                    better = (new_d < best_d) | (new_d == best_d) & (new_i < best_i)
                    best_d, best_i = np.where(better, new_d, best_d), np.where(better, new_i, best_i)
            got = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(qid[got]), pa.array(best_i[got]), pa.array(best_d[got])], ["a", "b", "d"])

        return run

    near = _streamed(items, items, kernel, "a long, b long, d double", query_block).groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", "x.b")
    of = lambda k: rows.select(F.col(id_col).cast("long").alias(k), F.col(label).alias(f"label_{k}"))
    return near.join(of("a"), "a").join(of("b"), "b").agg(F.avg((F.col("label_b") == F.col("label_a")).cast("int")).alias("nn1_acc"))


def closest_pair_of_all(rows: DataFrame, vector: str, metric: str, id_col: str, label: str, author: str, query_block: int = QUERY_BLOCK) -> DataFrame:
    """closest_pair() of all rows in streamed blocks: a task keeps a pair per label of its block."""
    known = rows.filter(F.col(label).isNotNull() & F.col(author).isNotNull() & F.col(vector).isNotNull())
    items = known.select(F.col(id_col).cast("long").alias("qid"), F.col(label).cast("string").alias("label"), F.col(author).cast("string").alias("author"), F.col(vector).alias("v"))

    def grouped(rows: pa.Table | pa.RecordBatch) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, authors and vectors by label, in order of ids."""
        ids, labels = rows.column(0).to_numpy(), np.array(rows.column(1).to_pylist(), object)
        authors, v = np.array(rows.column(2).to_pylist(), object), _matrix(rows.column(3))
        order = np.argsort(ids)
        return {x: (ids[at], authors[at], v[at]) for x in dict.fromkeys(labels) for at in [order[labels[order] == x]]}

    def kernel(block: pa.Table):
        asked = grouped(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[str, tuple[float, int, int]] = {}
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    for x, (ids, authors, v) in grouped(pa.Table.from_batches([batch.slice(low, 1024)])).items():
                        if x not in asked:
                            continue
                        qid, writers, q = asked[x]
                        d = np.round(_pairwise(metric, q, v), TIE)
                        codes = {w: i for i, w in enumerate({*writers, *authors})}
                        one, two = (np.array([codes[w] for w in y]) for y in (writers, authors))
                        d[(qid[:, None] >= ids[None, :]) | (one[:, None] == two[None, :])] = np.inf
                        i, j = np.unravel_index(d.argmin(), d.shape)  # the first, so of the smallest ids
                        if np.isfinite(d[i, j]):
                            best[x] = min(best.get(x, (np.inf, 0, 0)), (float(d[i, j]), int(qid[i]), int(ids[j])))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), *[pa.array([y[k] for y in best.values()], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]], ["genus", "d", "a", "b"])

        return run

    found = _streamed(items, items, kernel, "genus string, d double, a long, b long", query_block)
    return found.groupBy("genus").agg(F.min(F.struct("d", "a", "b")).alias("x")).select("genus", "x.a", "x.b", "x.d")
