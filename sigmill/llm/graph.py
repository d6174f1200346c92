"""Connected components by rounds of least-label exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of `edges` (a, b); component is the least id reachable.

    Each round a node takes the least label among itself and its neighbours and
    then that label's own label, so long chains close in few rounds. Every round
    is written down, so that a lost executor costs one round at most.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(up, "component").select("id", "old", F.least("component", "up").alias("component")))
        if new.filter("component != old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
