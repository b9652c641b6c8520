"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for the nodes of links (a, b).

    Smallest labels spread along links and jump along labels, so rounds grow
    with the logarithm of a component's diameter. Each round is written to the
    shared folder: a lost executor costs one round. Links with a null end, of a
    node to itself, and repeated ones change nothing; no links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = common.cut(both.where("a <> b").distinct())
    labels = common.cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        spread = labels.join(near, "node").select("node", F.least("comp", "m").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        before, labels = labels, common.cut(spread.join(jump, "to", "left").select("node", F.least("to", F.coalesce("next", "to")).alias("comp"), "was"))
        changed = labels.where("comp <> was").limit(1).count()
        common.drop(before)
        labels = labels.select("node", "comp")
        if not changed:
            common.drop(edges)
            return labels
