"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelspark.session import drop_materialised, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); label is the smallest node that can be reached.

    Each round every node points to its smallest neighbour (or itself), pointers are followed
    twice, and edges are redrawn between the targets; equal edges and loops vanish. The smallest node of a
    component never moves, so it is what remains. Rounds grow with the logarithm of the longest
    path. Only the number of edges left comes to the driver. Null nodes are left out.
    """
    edges = materialise(edges.select("a", "b").dropna().filter("a <> b").distinct(), "graph-edges")
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "graph-labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        step = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "graph-step")
        onward = lambda left: (left.join(step.select(F.col("a").alias("to"), F.col("to").alias("next")), "to")
                               .select("a", F.col("next").alias("to")))
        step = materialise(onward(onward(step)), "graph-step")
        target = lambda name: step.select(F.col("a").alias(name), F.col("to").alias(f"{name}_to"))
        before = edges, labels
        edges = materialise(edges.join(target("a"), "a").join(target("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                            .filter("a <> b").distinct(), "graph-edges")
        labels = materialise(labels.join(target("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label")), "graph-labels")
        for old in (*before, step):
            drop_materialised(old)
    return labels
