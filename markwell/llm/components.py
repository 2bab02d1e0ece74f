"""Connected components of a link table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import stash

MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` ``(a, b)``; a component is named by its smallest node.

    Each round takes the smallest label among the neighbours, then the label of that label, so paths shorten by halves. Every
    step is a join that can be split on hot keys or a minimum that is combined before the shuffle; rounds are written to the
    shared folder. Links with a null end are ignored, repeated links and loops are harmless.
    """
    whole = links.filter("a is not null and b is not null").select("a", "b")
    both = stash(whole.union(whole.select("b", "a")).distinct())
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was")
        )
        lower = stash(lower)
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = stash(lower.join(up, "label").select("node", F.least("upper", "label").alias("label"), "was"))
        labels = jumped.select("node", "label")
        if not jumped.filter("label != was").take(1):
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
