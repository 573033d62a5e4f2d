"""Connected components of a link table: the smallest reachable id of every node, by min-labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(a, b)``, any direction, repeats allowed -> ``(node, label)`` for each node that has a link.

    Every round takes the smallest label among the neighbours (pre-aggregated before its shuffle) and then follows
    labels of labels, so long chains shrink by halves. All joins read stored tables, so that adaptive execution can
    split a hot node or a hot label. Self-links are harmless; an empty table gives an empty one.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both)
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels, both.a == labels.node)
            .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        )
        hooked = scratch.write(
            labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        )
        to = hooked.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = scratch.write(
            hooked.join(to, "label").select("node", "was", F.least("label", "jump").alias("label"))
        )
        changed = jumped.where(F.col("was") != F.col("label")).limit(1).count()
        scratch.drop(labels, hooked)
        labels = jumped
        if not changed:
            scratch.drop(both)
            return labels.select("node", "label")
