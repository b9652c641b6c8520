"""Clade roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import NONE, ROOT
from .taxonomy import Taxonomy, code_of


def clade_totals(counts: DataFrame, taxonomy: Taxonomy, keys: list[str] | None = None) -> DataFrame:
    """keys, taxon, clade, own: counts (keys, taxon, n) added to every ancestor; NONE keeps to itself.

    Counts are one row a taxon before they are spread along paths, so this
    grows with the taxa, not with what was counted.
    """
    keys = keys or []
    own = counts.groupBy(*keys, "taxon").agg(F.sum("n").alias("n"))
    spread = own.join(taxonomy.table.select("taxon", "path"), "taxon", "left")
    spread = spread.select(*keys, F.explode(F.when(F.col("taxon") == NONE, F.array(F.lit(NONE))).otherwise(F.col("path"))).alias("above"), "n", F.when(F.col("taxon") == F.col("above"), F.col("n")).otherwise(0).alias("o"))
    return spread.groupBy(*keys, F.col("above").alias("taxon")).agg(F.sum("n").alias("clade"), F.sum("o").alias("own"))


#: Siblings with one clade count whose ids agree above this bit are numbered together.
RANGE_BITS = 16


def rooted_totals(counts: DataFrame, taxonomy: Taxonomy, keys: list[str]) -> DataFrame:
    """As clade_totals(), with a row of the root for each group, also where no taxon of its counts is in the tree."""
    own = counts.groupBy(*keys, "taxon").agg(F.sum("n").cast("bigint").alias("n"))
    if not keys:
        own = own.unionByName(counts.sparkSession.createDataFrame([(ROOT, 0)], "taxon int, n bigint"))
    spread = own.join(taxonomy.table.select("taxon", "path"), "taxon", "left")
    above = F.when(F.col("taxon") == NONE, F.array(F.lit(NONE), F.lit(ROOT))).otherwise(F.coalesce("path", F.array(F.lit(ROOT))))
    spread = spread.select(*keys, F.col("path").isNotNull().alias("_known"), "taxon", "n", F.explode(above).alias("above"))
    n = F.when(F.col("_known") | (F.col("above") == NONE), F.col("n")).otherwise(0)
    return spread.groupBy(*keys, F.col("above").alias("taxon")).agg(F.sum(n).alias("clade"), F.sum(F.when(F.col("taxon") == F.col("above"), n).otherwise(0)).alias("own"))


def lines_ahead(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, ahead: lines of the siblings with larger clades, or as large ones and larger ids. nodes: keys, step, up, clade, lines.

    Siblings are numbered within and between groups of one clade count and a range
    of ids, so those of one parent are not one task; as their clades do not overlap,
    their different counts are few.
    """
    t = nodes.withColumn("_range", F.shiftright("step", RANGE_BITS))
    group = [*keys, "up", "clade", "_range"]
    rows = (Window.unboundedPreceding, -1)
    totals = t.groupBy(*group).agg(F.sum("lines").alias("_all"))
    totals = totals.select(*group, F.sum("_all").over(Window.partitionBy(*keys, "up").orderBy(F.desc("clade"), F.desc("_range")).rowsBetween(*rows)).alias("_between"))
    t = t.withColumn("_within", F.sum("lines").over(Window.partitionBy(*group).orderBy(F.desc("step")).rowsBetween(*rows)))
    t = t.join(totals.hint("merge"), group)
    return t.select(*keys, "step", (F.coalesce("_within", F.lit(0)) + F.coalesce("_between", F.lit(0))).alias("ahead"))


def report_rows(counts: DataFrame, taxonomy: Taxonomy, keys: list[str] | None = None, zeros: bool = False) -> DataFrame:
    """keys, line, percent, clade, own, rank, taxon, name: the report, line by line.

    Children follow their parent, larger clades first, larger ids first among
    equals. A node's line is one after its parent's and after those of the
    siblings before it, so lines are sums along paths and no task sorts a whole
    report. The line of NONE comes first and only if it has counts (or zeros are
    asked for); the root always has a line. Shuffled totals are small and their
    rows are not, so joins are by merging: Spark would send them through the driver.
    """
    keys = keys or []
    totals = rooted_totals(counts, taxonomy, keys)
    nodes = taxonomy.table.select("taxon", "path", "depth", "below_rank", "level", "name")
    if zeros:
        every = nodes.crossJoin(counts.select(*keys).distinct()) if keys else nodes  # a report line for each node and group is what is asked for
        t = every.join(totals.hint("merge"), [*keys, "taxon"], "left").na.fill(0, ["clade", "own"])
    else:
        t = nodes.join(totals.hint("merge"), "taxon")
    along = t.where(F.col("taxon") != ROOT).select(*keys, "taxon", "clade", F.element_at("path", -2).alias("up"), F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("step"))
    own = F.col("taxon") == F.col("step")
    below = along.groupBy(*keys, "step").agg(F.max(F.when(own, F.col("up"))).alias("up"), F.max(F.when(own, F.col("clade"))).alias("clade"), F.count(F.lit(1)).alias("lines"))
    lines = along.select(*keys, "taxon", "step").join(lines_ahead(below, keys).hint("merge"), [*keys, "step"]).groupBy(*keys, "taxon").agg(F.sum(F.col("ahead") + 1).alias("_below_root"))
    t = t.join(lines.hint("merge"), [*keys, "taxon"], "left")
    t = t.select(*keys, "taxon", "clade", "own", F.concat(code_of(F.col("depth")), F.when(F.col("below_rank") > 0, F.col("below_rank").cast("string")).otherwise("")).alias("rank"), F.concat(F.repeat(F.lit("  "), F.col("level")), F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("_below_root", F.lit(0)).alias("_at"))
    none = totals.where(F.col("taxon") == NONE)
    if zeros and not keys:
        none = none.unionByName(totals.sparkSession.createDataFrame([(NONE, 0, 0)], "taxon int, clade bigint, own bigint")).groupBy("taxon").agg(F.max("clade").alias("clade"), F.max("own").alias("own"))
    t = t.unionByName(none.select(*keys, "taxon", "clade", "own", F.lit("U").alias("rank"), F.lit("").alias("name"), F.lit(-1).cast("bigint").alias("_at")))
    # a row for each report
    first = F.lit(1) if zeros and not keys else F.coalesce(F.max(F.when(F.col("taxon") == NONE, 1)), F.lit(0))
    whole = totals.where(F.col("taxon").isin(ROOT, NONE)).groupBy(*keys).agg(F.sum("clade").alias("all"), first.alias("_first")).withColumnsRenamed({k: f"_{k}" for k in keys})
    if keys:
        t = t.join(whole.hint("broadcast"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    else:
        t = t.crossJoin(F.broadcast(whole))
    t = t.withColumn("line", (1 + F.col("_at") + F.col("_first")).cast("int"))
    percent = F.when(F.col("all") > 0, F.round(100.0 * F.col("clade") / F.col("all"), 2)).otherwise(0.0)
    return t.select(*keys, "line", percent.alias("percent"), "clade", "own", "rank", "taxon", "name")


def report_line(headers: bool = True) -> Column:
    """A report row as text."""
    return F.concat_ws("\t", F.format_string("%6.2f", "percent"), "clade", "own", "rank", "taxon", "name")


# Fixed value: the header of the report format.
HEADER = "#Perc\tAggregate\tIn taxon\tRank\tTaxon\tName"


def kmer_averages(sizes: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """taxon, s1, s2, s3: average genome sizes (taxon, size) below each node.

    s1: over all genomes in the clade; s2: over the children's averages (and
    the node's own genome); s3: both, weighted by their numbers.
    """
    own = taxonomy.table.select("taxon", "parent").join(sizes.groupBy("taxon").agg(F.sum("size").alias("own")), "taxon", "left")
    spread = sizes.groupBy("taxon").agg(F.sum("size").alias("size")).join(taxonomy.table.select("taxon", "path"), "taxon").select(F.explode("path").alias("taxon"), "size")
    tree = spread.groupBy("taxon").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    t = own.join(tree, "taxon", "left").na.fill(0, ["total", "n"])
    kids = t.where("parent > 0").groupBy(F.col("parent").alias("taxon")).agg(F.count(F.lit(1)).alias("k"), F.sum("total").alias("kt"), F.sum("n").alias("kn"), F.count_if(F.col("n") > 0).alias("kz"), F.sum(F.when(F.col("n") > 0, F.col("total") / F.col("n"))).alias("ks"))
    t = t.join(kids, "taxon", "left")
    inner = F.col("k").isNotNull()
    has = F.col("own").isNotNull()
    # a leaf with a genome counts it twice in numerator and denominator alike
    total = F.when(inner, F.col("kt")).otherwise(F.col("total")) + F.coalesce("own", F.lit(0))
    number = F.when(inner, F.col("kn")).otherwise(F.col("n")) + F.when(has, 1).otherwise(0)
    s1 = F.when(number > 0, total / number)
    s2 = F.when(inner, F.try_divide(F.coalesce("ks", F.lit(0.0)) + F.coalesce("own", F.lit(0)), F.col("kz") + F.when(has, 1).otherwise(0))).otherwise(F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))
    below = F.when(inner & (F.col("kz") > 0), F.col("kn")).otherwise(F.col("n"))
    weight = F.coalesce("kz", F.lit(0))
    t = t.withColumn("s1", s1).withColumn("s2", s2).withColumn("_b", below).withColumn("_w", weight)
    s3 = F.when(F.col("_b") + F.col("_w") == 0, 0.0).otherwise((F.coalesce("s1", F.lit(0.0)) * F.col("_b") + F.coalesce("s2", F.lit(0.0)) * F.col("_w")) / (F.col("_b") + F.col("_w")))
    return t.select("taxon", "s1", "s2", s3.alias("s3"))


def averages_report(counts: DataFrame, sizes: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Report rows with rounded averages of genome sizes: s1, s2, s3."""
    averages = kmer_averages(sizes, taxonomy).select("taxon", *[F.round(F.coalesce(c, F.lit(0.0))).cast("bigint").alias(c) for c in ("s1", "s2", "s3")])
    return report_rows(counts, taxonomy).join(averages, "taxon", "left")


def index_counts(per_taxon: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """kind, taxon, n of the reports that describe an index, from its minimizers by taxon (taxon, n).

    min: minimizers; genome: one for each taxon that has any; missing: one for
    each labelled taxon that has none.
    """
    t = per_taxon.select(F.explode(F.create_map(F.lit("min"), F.col("n"), F.lit("genome"), F.lit(1).cast("bigint"))).alias("kind", "n"), "taxon").select("kind", "taxon", "n")
    if labels is None:
        return t
    missing = labels.select("taxon").distinct().join(per_taxon.select("taxon"), "taxon", "left_anti")
    return t.unionByName(missing.select(F.lit("missing").alias("kind"), "taxon", F.lit(1).cast("bigint").alias("n")))


def filtered(rows: DataFrame, taxonomy: Taxonomy, depth: int | None = None, least_percent: float = 0.0, clade: int | None = None) -> DataFrame:
    """Report rows down to a depth, of at least a percentage, in the clade of a taxon."""
    t = rows.where(F.col("percent") >= least_percent)
    if depth is not None:
        t = t.join(taxonomy.table.where(F.col("depth") <= depth).select("taxon"), "taxon", "left_semi")
    if clade is not None:
        root = taxonomy.table.where(F.col("taxon") == clade).select(F.col("pre").alias("_p"), F.col("end").alias("_e"))
        below = taxonomy.table.join(F.broadcast(root), F.col("pre").between(F.col("_p"), F.col("_e"))).select("taxon")
        t = t.join(below, "taxon", "left_semi")
    return t


def label_levels(labels: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """level, n: of the labelled taxa, how many lack a standard level on their way to the root."""
    taxa = labels.select("taxon").distinct()
    missing = taxonomy.missing_levels().join(taxa, "taxon", "left_semi").select(F.explode("missing").alias("level"))
    return missing.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def label_stats(labels: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One row: unknown taxa of labels, those inside the tree, valid ones, nodes of the tree they imply."""
    taxa = labels.select("taxon").distinct()
    known = taxa.join(taxonomy.table.select("taxon", "leaf"), "taxon", "left")
    size = taxonomy.closure_up(taxa).agg(F.count(F.lit(1)).alias("tree_size"))
    t = known.agg(F.count_if(F.col("leaf").isNull()).alias("unknown"), F.count_if(~F.col("leaf")).alias("inner_taxa"), F.count("leaf").alias("valid"))
    return t.crossJoin(size)  # one row each
