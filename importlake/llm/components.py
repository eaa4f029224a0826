"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from importlake.llm.common import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """Return (node, component) for each node of ``edges`` (columns ``a``, ``b``); component is the smallest node.

    Each round lets every node take the smallest label among its neighbours, passes that on to the node its label
    names (so whole trees move, not single nodes), and then replaces a label by that label's own. Labels only fall, and
    trees join and flatten at once, so the rounds follow the logarithm of the longest path. Every table that a join
    looks up by a label, where one label may hold a third of all nodes, is a staged scan, which adaptive execution can
    split. When every node's label is the smallest among its neighbours' too, neighbours have one label, and so have components:
    that ends it, before the rest of the round. Rows with a null end and self-loops are no edges; a table without edges gives an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    while True:
        met = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), F.col("label").alias("near"), F.lit(None).cast(labels.schema["label"].dataType).alias("label"))
        own = labels.select("node", F.col("label").alias("near"), "label")
        seen = stage(met.unionByName(own).groupBy("node").agg(F.max("label").alias("label"), F.min("near").alias("near")), "near")
        if seen.where("near <> label").isEmpty():
            discard(both, labels)
            return seen.select("node", F.col("label").alias("component"))
        root = stage(seen.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("to")), "root")
        moved = stage(seen.join(root, seen.label == root.root, "left").select("node", F.least("near", "to").alias("label")), "moved")
        up = moved.select(F.col("node").alias("up"), F.col("label").alias("top"))
        after = stage(moved.join(up, moved.label == up.up, "left").select("node", F.least("label", "top").alias("label")), "labels")
        discard(labels, seen, root, moved)
        labels = after
