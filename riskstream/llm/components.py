"""Connected components of a graph of long ids, as a few rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges(a, b).

    Each round takes the least of a node and its neighbours, then that one's own least, and puts
    these in the places of the edges' ends; what then joins a node with itself is gone, and so are edges that have become equal.
    So rounds grow with the logarithm of a component's width, and a star is gone after one.  A node with very many
    neighbours is combined before its messages are shuffled, and its join is split by
    the adaptive plan.  Loops and repeated edges do no harm; an empty table gives none.
    """
    spark = edges.sparkSession
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "a"), F.struct(F.col("b").alias("node"), "a"))).alias("e")).select("e.node", F.col("e.a").alias("least"))
        least = written(ends.groupBy("node").agg(F.min("least").alias("least")), "labels")
        jump = least.select(F.col("node").alias("at"), F.col("least").alias("further"))
        step = written(least.join(jump, least.least == jump["at"]).select("node", F.col("further").alias("component")), "labels")
        if labels is None:
            following = step
        else:
            onward = step.select(F.col("node").alias("at"), F.col("component").alias("further"))
            following = written(labels.join(onward, labels.component == onward["at"], "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
        a, b = (step.select(F.col("node").alias(end), F.col("component").alias(f"{end}_to")) for end in "ab")
        to = left.join(a, "a").join(b, "b").where("a_to <> b_to")
        fewer = written(to.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        more = fewer.limit(1).count()
        drop(spark, left, least, *([labels] if labels is not None else []), *([step] if labels is not None else []))
        labels, left = following, fewer
        if not more:
            drop(spark, left)
            return labels
