"""The taxonomy as a table: every tree question becomes a column or a join.

Nodes are numbered in depth-first order: `pre` is a node's number and `end`
the last number below it, so "a is an ancestor of x" is the range predicate
pre[a] <= pre[x] <= end[a], and the lowest common ancestor of a set is that of
its first and last member. `path` holds the ids from the root down.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import NONE, ROOT
from . import treelayout

# Rank titles, codes and depths of the report format.
RANKS = (
    ("unclassified", "U", -1),
    ("root", "R", 0),
    ("superkingdom", "D", 1),
    ("kingdom", "K", 2),
    ("phylum", "P", 3),
    ("class", "C", 4),
    ("order", "O", 5),
    ("family", "F", 6),
    ("genus", "G", 7),
    ("species", "S", 8),
)
DEPTH = {title: depth for title, _, depth in RANKS}
CODE = {depth: code for _, code, depth in RANKS}
#: Nodes up to which the driver lays out the tree, in less time than Spark's jobs take to start; larger trees are laid out by Spark.
AT_DRIVER = 100_000


def code_of(depth: Column) -> Column:
    return F.get(F.array(*[F.lit(CODE[d]) for d in range(9)]), depth)


def pack(pre: Column, taxon: Column) -> Column:
    """Depth-first number and id in one bigint that sorts by the number."""
    return F.shiftleft(pre.cast("bigint"), 32).bitwiseOR(taxon.cast("bigint"))


def unpack_taxon(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


#: Place of "end" among the table's columns.
END = 11


class Taxonomy:
    """table: taxon, parent, name, rank, depth, sublevel, below_rank, level, path, depths, pre, end, leaf.

    sublevel: ancestors in a row with the same depth; below_rank: steps down
    from the nearest node with a rank.
    """

    SCHEMA = "taxon int, parent int, name string, rank string, depth int, sublevel int, below_rank int, level int, path array<int>, depths array<int>, pre int, end int, leaf boolean"

    def __init__(self, table: DataFrame, merged: DataFrame | None = None):
        self.table, self.merged, self.spark = table, merged, table.sparkSession

    @classmethod
    def from_nodes(cls, nodes: DataFrame, merged: DataFrame | None = None, at_driver: int = AT_DRIVER) -> Taxonomy:
        """nodes: taxon, parent, rank, name. merged: secondary, primary.

        Unknown ranks become null. Nodes off the tree (of unknown parents, on
        circles) and null ids are dropped; of rows with one id the least
        (parent, rank, name) counts. Trees of more than at_driver nodes are laid
        out by Spark, with the same result.
        """
        spark = nodes.sparkSession
        one = F.min(F.struct(F.col("parent").cast("int").alias("parent"), "rank", "name"))
        nodes = nodes.where("taxon IS NOT NULL").groupBy(F.col("taxon").cast("int").alias("taxon")).agg(one.alias("_one")).select("taxon", "_one.*")
        rank = F.when(F.col("taxon") == ROOT, F.lit("root")).when(F.col("rank").isin(*DEPTH), F.col("rank"))
        nodes = nodes.withColumn("rank", rank)
        rows = nodes.limit(at_driver + 1).collect()
        if len(rows) > at_driver:
            depths = F.create_map(*[F.lit(x) for pair in DEPTH.items() for x in pair])
            # paths are larger than the size of their file tells: joins with such a tree must not send it through the driver
            return cls(treelayout.laid_out(nodes.withColumn("own", depths[F.col("rank")])).hint("merge"), merged)
        info = {r[0]: (r[2], r[3]) for r in rows}
        below: dict[int, list[int]] = {}
        for taxon, parent, _, _ in rows:
            if taxon != ROOT:
                below.setdefault(parent, []).append(taxon)
        out: list[list] = []
        if ROOT in info:
            stack = [(ROOT, NONE, (), (), 0, 0)]
            while stack:
                taxon, parent, path, depths, level, under = stack.pop()
                rank, name = info[taxon]
                depth = DEPTH[rank] if rank else depths[-1] if depths else 0
                sub = _same_above(depths, depth)
                under = 0 if rank else under + 1
                path, depths = (*path, taxon), (*depths, depth)
                out.append([taxon, parent, name, rank, depth, sub, under, level, list(path), list(depths), len(out), len(out), not below.get(taxon)])
                # larger ids are popped first: siblings are numbered in descending order of their ids
                stack.extend((c, taxon, path, depths, level + 1, under) for c in sorted(below.get(taxon, ())))
        at = {row[0]: row for row in out}
        for row in reversed(out):
            if row[1] in at:
                at[row[1]][END] = max(at[row[1]][END], row[END])
        names = [f.split()[0] for f in cls.SCHEMA.split(", ")]
        return cls(spark.createDataFrame(pd.DataFrame(out, columns=names), cls.SCHEMA) if out else spark.createDataFrame([], cls.SCHEMA), merged)

    def node(self, prefix: str, *columns: str) -> DataFrame:
        """The table's columns under a prefix, to join with."""
        return self.table.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])

    def defined(self, df: DataFrame, column: str = "taxon") -> DataFrame:
        """Rows whose taxon is in the tree."""
        return df.join(self.node("_", "taxon"), F.col(column) == F.col("_taxon"), "left_semi")

    def unknown(self, df: DataFrame, column: str = "taxon") -> DataFrame:
        return df.join(self.node("_", "taxon"), F.col(column) == F.col("_taxon"), "left_anti")

    def primary(self, df: DataFrame, column: str = "taxon") -> DataFrame:
        """Merged (secondary) ids replaced by their primary ones."""
        if self.merged is None:
            return df
        m = self.merged.select(F.col("secondary").alias("_s"), F.col("primary").alias("_p"))
        return df.join(m, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_p", column)).drop("_s", "_p")

    def leaves(self) -> DataFrame:
        return self.table.where("leaf").select("taxon")

    def children(self) -> DataFrame:
        """taxon, children (descending)."""
        return self.table.where("parent > 0").groupBy(F.col("parent").alias("taxon")).agg(F.sort_array(F.collect_list(F.col("taxon")), asc=False).alias("children"))

    def ancestors(self) -> DataFrame:
        """taxon, ancestor (itself included), steps."""
        t = self.table.select("taxon", F.posexplode(F.reverse("path")).alias("steps", "ancestor"))
        return t.select("taxon", "ancestor", "steps")

    def with_steps(self, pairs: DataFrame, taxon: str, ancestor: str) -> DataFrame:
        """pairs with steps and standard_steps from taxon up to ancestor, -1 where it is none."""
        t = pairs.join(self.node("x_", "taxon", "path", "depth"), F.col(taxon) == F.col("x_taxon"), "left").join(self.node("a_", "taxon", "depth"), F.col(ancestor) == F.col("a_taxon"), "left")
        at = F.coalesce(F.array_position("x_path", F.col(ancestor)), F.lit(0))
        t = t.withColumn("steps", F.when(at > 0, F.size("x_path") - at).otherwise(-1).cast("int"))
        t = t.withColumn("standard_steps", F.when(F.col("steps") >= 0, F.col("x_depth") - F.col("a_depth")).otherwise(-1))
        return t.drop("x_taxon", "x_path", "x_depth", "a_taxon", "a_depth")

    @staticmethod
    def at_level(depth: int) -> Column:
        """Of a table row: the lowest ancestor with just this depth, null if there is none."""
        found = F.filter(F.arrays_zip("path", "depths"), lambda x: x["depths"] == depth)
        return F.when(F.size(found) > 0, F.element_at(found, -1)["path"])

    @staticmethod
    def standard_at_level(depth: int) -> Column:
        """Of a table row: the highest ancestor-or-self that is not above this depth on an unbroken way up, null if it is itself above."""
        over = F.filter(F.transform("depths", lambda d, i: F.when(d < depth, i)), lambda i: i.isNotNull())
        last = F.when(F.size(over) > 0, F.element_at(over, -1)).otherwise(F.lit(-1))
        return F.get("path", last + 1)

    def closure_up(self, taxa: DataFrame, column: str = "taxon", keys: Sequence[str] = ()) -> DataFrame:
        """Distinct taxa with all their ancestors, apart for each value of the keys."""
        own = taxa.select(*keys, F.col(column).alias("_t")).distinct()
        return own.join(self.table.select(F.col("taxon").alias("_t"), "path"), "_t").select(*keys, F.explode("path").alias("taxon")).distinct()

    def closure_down(self, taxa: DataFrame, column: str = "taxon") -> DataFrame:
        """Distinct taxa with all their descendants: nodes one of whose ancestors is among them."""
        wanted = taxa.select(F.col(column).alias("_t")).distinct()
        return self.table.select("taxon", F.explode("path").alias("_t")).join(wanted, "_t", "left_semi").select("taxon").distinct()

    def missing_levels(self) -> DataFrame:
        """taxon, missing: standard levels 1 to 8 that its way to the root lacks."""
        return self.table.select("taxon", F.array_except(F.sequence(F.lit(1), F.lit(8)), F.col("depths")).alias("missing"))

    def lca_of_pairs(self, pairs: DataFrame, a: str, b: str, out: str = "lca") -> DataFrame:
        """Lowest common ancestor of two columns; NONE (0) is the identity."""
        t = pairs.join(self.node("l_", "taxon", "path"), F.col(a) == F.col("l_taxon"), "left").join(self.node("r_", "taxon", "path"), F.col(b) == F.col("r_taxon"), "left")
        shared = F.array_intersect("l_path", "r_path")
        lca = F.when(F.col(a) == NONE, F.col(b)).when(F.col(b) == NONE, F.col(a)).otherwise(F.element_at(shared, -1))
        return t.withColumn(out, lca.cast("int")).drop("l_taxon", "l_path", "r_taxon", "r_path")

    def lca(self, rows: DataFrame, keys: list[str], column: str = "taxon") -> DataFrame:
        """keys, column: the lowest common ancestor of each group.

        Only the first and last member in depth-first order matter, so the
        aggregation is two primitive ones with partial sums on the map side.
        """
        numbered = rows.join(self.node("_", "taxon", "pre"), F.col(column) == F.col("_taxon")).withColumn("_packed", pack(F.col("_pre"), F.col("_taxon")))
        return self.lca_of_packed(numbered, keys, "_packed", column)

    def lca_of_packed(self, rows: DataFrame, keys: list[str], packed: str, column: str = "taxon") -> DataFrame:
        """As lca(), of a column that pack() made."""
        ends = rows.groupBy(*keys).agg(F.min(packed).alias("_lo"), F.max(packed).alias("_hi"))
        # most groups have one taxon; the others share few pairs of ends
        lo = unpack_taxon(F.col("_lo"))
        pairs = ends.where("_lo <> _hi").select(F.col("_lo").alias("_l"), F.col("_hi").alias("_h")).distinct()
        found = self.lca_of_pairs(pairs.withColumn("_a", unpack_taxon(F.col("_l"))).withColumn("_b", unpack_taxon(F.col("_h"))), "_a", "_b", "_lca").drop("_a", "_b")
        # the table of pairs is not sent to the driver, and groups of one taxon are not shuffled to meet it
        several = ends.where(~F.col("_lo").eqNullSafe(F.col("_hi"))).join(found.hint("merge"), (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")), "left")
        return ends.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*keys, lo.alias(column)).unionByName(several.select(*keys, F.col("_lca").cast("int").alias(column)))

    def unifrac(self, first: DataFrame, second: DataFrame) -> DataFrame:
        """n_unique, n_total, distance of two sets of taxa: the share of their trees' nodes that only one has."""
        a = self.closure_up(first).where(F.col("taxon") != ROOT).withColumn("a", F.lit(1))
        b = self.closure_up(second).where(F.col("taxon") != ROOT).withColumn("b", F.lit(1))
        t = a.join(b, "taxon", "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_unique"), F.count(F.lit(1)).alias("n_total"))
        return t.withColumn("distance", F.when(F.col("n_total") > 0, F.col("n_unique") / F.col("n_total")))

    def subset(self, taxa: DataFrame) -> DataFrame:
        """Table rows of the given taxa."""
        return self.table.join(taxa.select("taxon").distinct(), "taxon", "left_semi")


def _same_above(depths: tuple[int, ...], depth: int) -> int:
    """How many ancestors in a row, from the parent up, have this depth."""
    n = 0
    while n < len(depths) and depths[-1 - n] == depth:
        n += 1
    return n


def rank_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c, d) for t, c, d in RANKS], "title string, code string, depth int")
