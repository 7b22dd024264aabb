"""Connected components of an edge list by smallest-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.llm import store


def components(edges: DataFrame, place: str) -> DataFrame:
    """(node, label) for each node of ``edges`` (columns a and b, long); label is the component's smallest node.

    Each round takes the smallest label of all neighbours (combined before the
    shuffle, so a node with a third of all edges is one row a task), then the
    label's own label.  Tables are written once a round; the driver sees one
    flag a round.  Loops and repeated edges do no harm; no edges, no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store.keep(both.distinct(), f"{place}/edges")
    now = store.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label", F.lit(True).alias("moved")), f"{place}/round0")
    n = 0
    while now.filter("moved").limit(1).count():
        n += 1
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.select("node", "label").join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        of = now.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = step.join(of, "next").select("node", F.least("next", "jump").alias("to"), "label")
        now = store.keep(step.select("node", F.col("to").alias("label"), (F.col("to") < F.col("label")).alias("moved")), f"{place}/round{n}")
    return now.select("node", "label")
