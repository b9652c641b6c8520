"""The layout of a taxonomy as Spark jobs, for trees that the driver should not hold.

Ways to the root are found by doubling: each node knows a stretch of its way and
the node where that stretch ends, and puts the stretch of that node before its
own. The number of rounds is the logarithm of the tree's height. Numbers in
depth-first order are sums along these ways: a node comes one after its parent
and after the whole subtrees of the siblings before it.

Nothing here is one task or one row for the whole tree. In a round, nodes whose
stretches end at one node meet under one key; the other side of that join has
each key once, so Spark splits a key that is too large for a task. Siblings are
numbered in two steps, within and between ranges of ids, however many there are.
The tables' files are far smaller than their rows in memory, so joins are by
merging: by the size of a file Spark would send one whole through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import NONE, ROOT
from ..sources import shared

#: Siblings whose ids agree above this bit are numbered together.
RANGE_BITS = 16


def ways(start: DataFrame, joined: Callable[[Column, Column], Column], place: str) -> DataFrame:
    """taxon, value: the values on each node's way from the root, joined; nodes off the tree are left out.

    start: taxon, up (parent; anything for the root), value. joined(above, own)
    must be associative. Rounds are written below place.
    """
    spark = start.sparkSession
    root = start.where(F.col("taxon") == ROOT)
    fields = "taxon", "up", "value"
    done = [f"{place}/done0"]
    root.select("taxon", F.lit(NONE).alias("up"), "value").write.parquet(done[0])
    left = shared.written(start.where(F.col("taxon") != ROOT).select(*fields), f"{place}/left0")
    i = 0
    while not left.isEmpty():
        i += 1
        known = spark.read.schema(left.schema).parquet(*done).unionByName(left)
        above = known.select(F.col("taxon").alias("_taxon"), F.col("up").alias("_up"), F.col("value").alias("_value"))
        # most stretches end at the root, which is one row; nodes whose stretch ends at no node of the table are off the tree and leave here
        at_root = left.where(F.col("up") == ROOT).join(F.broadcast(above.where(F.col("_taxon") == ROOT)), F.col("up") == F.col("_taxon"))
        lower = left.where(F.col("up") != ROOT).join(above.hint("merge"), F.col("up") == F.col("_taxon"))
        grown = at_root.unionByName(lower).select("taxon", F.col("_up").alias("up"), joined(F.col("_value"), F.col("value")).alias("value"))
        grown = shared.written(grown, f"{place}/round{i}")
        grown.where(F.col("up") == NONE).write.parquet(f"{place}/done{i}")
        # a round in which no way is finished leaves circles, and what hangs on them, only
        if spark.read.schema(left.schema).parquet(f"{place}/done{i}").isEmpty():
            break
        done.append(f"{place}/done{i}")
        left = grown.where(F.col("up") != NONE)
    return spark.read.schema(left.schema).parquet(*done).select("taxon", "value")


def before_siblings(sizes: DataFrame) -> DataFrame:
    """taxon, before: nodes in the subtrees of the siblings with larger ids. sizes: taxon, parent, size."""
    t = sizes.withColumn("_range", F.shiftright("taxon", RANGE_BITS))
    totals = t.groupBy("parent", "_range").agg(F.sum("size").alias("_all"))
    rows = (Window.unboundedPreceding, -1)
    ranges = totals.select("parent", "_range", F.sum("_all").over(Window.partitionBy("parent").orderBy(F.desc("_range")).rowsBetween(*rows)).alias("_ahead"))
    within = F.sum("size").over(Window.partitionBy("parent", "_range").orderBy(F.desc("taxon")).rowsBetween(*rows))
    t = t.withColumn("_within", within).join(ranges.hint("merge"), ["parent", "_range"])
    return t.select("taxon", (F.coalesce("_within", F.lit(0)) + F.coalesce("_ahead", F.lit(0))).alias("before"))


def laid_out(nodes: DataFrame) -> DataFrame:
    """The columns of Taxonomy.SCHEMA. nodes: taxon, parent, rank, name, own (depth of its rank, null without one); a row a taxon."""
    spark = nodes.sparkSession
    place = shared.folder(spark, "tree")
    nodes = shared.written(nodes, f"{place}/nodes")
    start = nodes.select("taxon", F.col("parent").alias("up"), F.array(F.struct("taxon", "own")).alias("value"))
    paths = shared.written(ways(start, lambda above, own: F.concat(above, own), f"{place}/paths"), f"{place}/ways")

    sizes = paths.select(F.explode("value.taxon").alias("taxon")).groupBy("taxon").agg(F.count(F.lit(1)).alias("size"))
    sizes = shared.written(sizes.join(nodes.select("taxon", "parent").hint("merge"), "taxon"), f"{place}/sizes")
    before = before_siblings(sizes.where(F.col("taxon") != ROOT))
    step = sizes.join(before.hint("merge"), "taxon", "left").select("taxon", F.col("parent").alias("up"), F.when(F.col("taxon") == ROOT, F.lit(0)).otherwise(F.col("before") + 1).cast("bigint").alias("value"))
    pre = ways(step, lambda above, own: above + own, f"{place}/numbers").select("taxon", F.col("value").alias("pre"))

    way, last = F.col("value"), F.size("value") - 1
    depth_after = lambda acc, x: F.concat(acc, F.array(F.coalesce(x["own"], F.element_at(acc, -1))))
    t = nodes.join(paths.hint("merge"), "taxon").join(sizes.select("taxon", "size").hint("merge"), "taxon").join(pre.hint("merge"), "taxon")
    # the root has a rank, so each node has a depth
    t = t.withColumn("depths", F.aggregate(F.slice(way, F.lit(2), F.size(way)), F.array(F.get(way, F.lit(0))["own"]), depth_after))
    t = t.withColumn("depth", F.element_at("depths", -1))
    other = F.array_max(F.transform("depths", lambda d, i: F.when(d != F.col("depth"), i)))
    ranked = F.array_max(F.transform(way, lambda x, i: F.when(x["own"].isNotNull(), i)))
    return shared.written(
        t.select(
            "taxon",
            F.when(F.col("taxon") == ROOT, NONE).otherwise(F.col("parent")).alias("parent"),
            "name",
            "rank",
            "depth",
            (last - 1 - F.coalesce(other, F.lit(-1))).cast("int").alias("sublevel"),
            (last - ranked).cast("int").alias("below_rank"),
            last.alias("level"),
            F.col("value.taxon").alias("path"),
            "depths",
            F.col("pre").cast("int").alias("pre"),
            (F.col("pre") + F.col("size") - 1).cast("int").alias("end"),
            (F.col("size") == 1).alias("leaf"),
        ),
        f"{place}/table",
    )
