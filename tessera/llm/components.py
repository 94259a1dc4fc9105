"""Connected components of a graph given as edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, scratch


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root), root the smallest node that is reachable.

    Each round takes the smallest label among the neighbours, then the label of
    that label, so paths shorten by half, until no label changes; labels only
    ever fall, so that comes. They are written to the shared folder each round;
    nothing but a count comes to the driver. Nodes without edges are not in
    the result.
    """
    with scratch(edges.sparkSession) as result:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
        both = materialize(both.distinct(), "edges")
        labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
        while True:
            near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
            nearer = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
            target = labels.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
            jumped = nearer.join(target, F.col("root") == F.col("r_node"), "left").select("node", "old", F.least("root", "r_root").alias("root"))
            written = materialize(jumped, "labels")
            changed = written.filter("old <> root").limit(1).count()
            labels = written.select("node", "root")
            if not changed:
                return result(labels, "labels")
