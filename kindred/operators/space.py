"""Feature spaces: several vectors per item, each with a metric, statistics, a scale and a weight."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Default weights and metrics of the sets.
DEFAULT_WEIGHTS = {"color": 0.30, "shape": 0.25, "texture": 0.20, "deep": 0.25}
SET_METRIC = {"color": "l1", "shape": "l2", "texture": "l2", "deep": "cosine"}
#: Blocks that are histograms, kept non-negative with sum 1.
HIST_BLOCKS = ("hsv_grid", "hsv_fg", "hsv_cum", "pwh")
TOP_K = 5
CANDIDATE_POOL = 60


def normalised_weights(weights: Mapping[str, float] | None, sets: list[str]) -> dict[str, float]:
    """Missing sets weigh 0; a total of 0 or less gives equal weights; else weights are divided by their total."""
    given = {s: float((DEFAULT_WEIGHTS if weights is None else weights).get(s, 0.0)) for s in sets}
    sum_ = sum(given.values())
    return {s: 1 / len(sets) for s in sets} if sum_ <= 0 else {s: w / sum_ for s, w in given.items()}


def parse_weights(text: str) -> dict[str, float]:
    """'color=.4,shape=.6' as a dictionary."""
    return {k.strip(): float(v) for k, v in (x.split("=", 1) for x in text.split(",") if x.strip())}


@dataclass
class FeatureSpace:
    """items: id, one array<double> column per set, and any metadata. Sets named but absent are left out; none left is an error."""

    items: DataFrame
    metrics: dict[str, str]
    id_col: str = "image_id"
    layout: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    stats: dict[str, dict[str, list[float]]] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.metrics = {s: m for s, m in self.metrics.items() if s in self.items.columns}
        if not self.metrics:
            raise ValueError("none of the sets is in the items")
        self.weights = normalised_weights(self.weights or None, self.sets)

    @property
    def sets(self) -> list[str]:
        return list(self.metrics)

    def mean_std(self) -> DataFrame:
        """set_name, dim (1-based), mean, std (population, floored): a row per dimension, from one partial aggregation."""
        parts = F.array(*[F.struct(F.lit(s).alias("set_name"), F.col(s).alias("vector")) for s in self.sets])
        rows = self.items.select(F.explode(parts).alias("x")).select("x.set_name", F.posexplode("x.vector").alias("dim", "value"))
        std = F.stddev_pop("value")
        return rows.groupBy("set_name", "dim").agg(F.avg("value").alias("mean"), F.when(std < V.STD_FLOOR, F.lit(1.0)).otherwise(std).alias("std")).select("set_name", (F.col("dim") + 1).alias("dim"), "mean", "std")

    def fit(self, pairs: DataFrame | None = None) -> FeatureSpace:
        """Statistics of every set, then each set's scale: the mean distance over pairs (columns a, b of ids), EPS at least.

        As many numbers as the vectors have dimensions come to the driver, whatever the number of items.
        """
        got: dict[str, dict[int, tuple[float, float]]] = {}
        for r in self.mean_std().collect():
            got.setdefault(r["set_name"], {})[r["dim"]] = (r["mean"], r["std"])
        self.stats = {s: {"mean": [d[k][0] for k in sorted(d)], "std": [d[k][1] for k in sorted(d)]} for s, d in got.items()}
        scales = self.pair_scales(self.default_pairs() if pairs is None else pairs).first()
        self.scales = {s: max(scales[s] if scales[s] is not None else float("nan"), V.EPS) for s in self.sets}
        return self

    def default_pairs(self, most: int = 4000) -> DataFrame:
        """Up to `most` pairs by rule: the items of least hash, each with the item after it in that order."""
        from pyspark.sql import Window

        few = self.items.select(F.col(self.id_col).alias("a")).orderBy(F.xxhash64("a"), "a").limit(most)
        by = Window.orderBy(F.xxhash64("a"), "a")  # over `most` rows
        return few.withColumn("b", F.lead("a").over(by)).dropna()

    def prepared(self, s: str, column: Column | None = None) -> Column:
        """z-scores of l2 sets; others as they are."""
        v = F.col(s) if column is None else column
        if self.metrics[s] != "l2":
            return v
        if s not in self.stats:
            raise ValueError("fit() the space first")
        return V.zscore(v, V.literal(self.stats[s]["mean"]), V.literal(self.stats[s]["std"]))

    def prepared_items(self) -> DataFrame:
        return self.items.withColumns({s: self.prepared(s) for s in self.sets})

    def pair_scales(self, pairs: DataFrame) -> DataFrame:
        """One row: the mean distance of each set over the pairs."""
        p = self.prepared_items().select(self.id_col, *self.sets)
        a = p.select(F.col(self.id_col).alias("a"), *[F.col(s).alias(f"{s}_a") for s in self.sets])
        b = p.select(F.col(self.id_col).alias("b"), *[F.col(s).alias(f"{s}_b") for s in self.sets])
        return pairs.join(a, "a").join(b, "b").agg(*[F.avg(V.distance(m, F.col(f"{s}_a"), F.col(f"{s}_b"))).alias(s) for s, m in self.metrics.items()])

    def distances(self, query: Mapping[str, list[float]]) -> dict[str, Column]:
        """Raw distance columns over prepared items; sets that the query lacks are left out, without new weights."""
        return {s: V.distance(self.metrics[s], F.col(s), self.prepared(s, V.literal(query[s]))) for s in self.sets if s in query}

    def combine(self, raw: Mapping[str, Column]) -> Column:
        out = F.lit(0.0)
        for s, d in raw.items():
            out = out + self.weights[s] * d / self.scales[s]
        return out

    def embedding(self) -> Column:
        """One vector in which Euclidean distance stands for the combined one: sets times the root of weight over scale."""
        parts = []
        for s in self.sets:
            v = V.unit(F.col(s)) if self.metrics[s] == "cosine" else self.prepared(s)
            parts.append(V.scaled(v, F.lit(float(self.weights[s] ** 0.5 / self.scales[s]))))
        return F.concat(*parts)

    def checked(self, other: DataFrame) -> DataFrame:
        """Joins more sets by id; items of either side without a partner are an error."""
        lone = self.items.join(other, self.id_col, "left_anti").limit(1).count() + other.join(self.items, self.id_col, "left_anti").limit(1).count()
        if lone:
            raise ValueError("the sets cover different items")
        return self.items.join(other, self.id_col)
