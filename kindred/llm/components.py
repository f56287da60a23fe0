"""Connected components by propagating least labels and jumping to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: a, b (longs). node, component: the least node that it is connected with. Only nodes with edges.

    Each round a node takes the least label among its own and its neighbours', then the label of that
    label, so paths shorten by halves. Messages to a node are reduced before they are shuffled. Rounds are
    written to the scratch folder. No edges: no rows.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")), name)
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        new = labels.join(near, "a").select("a", F.least("c", "m").alias("m"), F.col("c").alias("was"))
        jump = labels.select(F.col("a").alias("m"), F.col("c").alias("j"))
        old, labels = labels, materialise(new.join(jump, "m", "left").select("a", F.least("m", F.coalesce("j", "m")).alias("c"), "was"), name)
        discard(old)
        if not labels.filter("c <> was").limit(1).count():
            discard(both)
            return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
