"""Sequences, labels, reads and taxonomies derived from the benchmark tables.

Each derivation has a twin in oracle.py, in SQL, that gives the same rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Scheme
from ..operators.index import MinimizerIndex
from ..operators.taxonomy import Taxonomy

SCHEME = Scheme()
GENOME, READ = 320, 100
#: Parts of one task: a part's row is small, and so is its file, but not the sequence and the words that come of it.
TASK = 4096
#: Reads of one task, for the same reason.
READS_TASK = 16384


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tasks(spark: SparkSession, sf: str) -> int:
    """Tasks that what comes of the parts is dealt to."""
    return max(1, -(-table(spark, sf, "part").count() // TASK))


def segment(seed: Column) -> Column:
    """32 letters from a seed."""
    return F.translate(F.md5(seed), "0123456789abcdef", "ACGTACGTACGTACGT")


def header() -> Column:
    """Of a part: the header of its genome."""
    return F.concat(F.lit("G"), F.col("p_partkey"))


def parts(spark: SparkSession, sf: str, by: Column | None = None, among: int | None = None) -> DataFrame:
    """p_partkey, name and the taxa on the way to the root: fam, gen, spe, tax.

    Dealt by the header of the part's genome, so that what is asked for by header
    stays in its task; or by another column among some other number of tasks.
    Sizes of files tell nothing of what is derived, so Spark must not choose by
    them what to send to the driver: hence the hint.
    """
    rows = table(spark, sf, "part")
    p = rows.repartition(among or tasks(spark, sf), header() if by is None else by).select("p_partkey", "p_name", F.substr("p_brand", F.lit(7)).cast("int").alias("brand"), "p_type")
    # one row; a hash table of it would take 34 MB of the driver for each use
    types = rows.agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    p = p.crossJoin(F.broadcast(types)).withColumn("typ", F.array_position("types", F.col("p_type")).cast("int")).where("p_type IS NOT NULL")
    p = p.select("p_partkey", F.col("p_name").alias("name"), (10 + F.col("brand") % 5).alias("fam"), (100 + F.col("brand")).alias("gen"), (1000 + F.col("brand") * 10 + F.col("typ")).alias("spe"), (10000 + F.col("p_partkey")).cast("int").alias("tax"))
    return p.hint("merge")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    root = spark.createDataFrame([(1, 1, "root", "root")], "taxon int, parent int, rank string, name string")

    def inner(taxon: str, parent: str | int, rank: str) -> DataFrame:
        up = F.lit(parent) if isinstance(parent, int) else F.col(parent)
        return p.select(F.col(taxon).alias("taxon"), up.alias("parent")).distinct().select("taxon", "parent", F.lit(rank).alias("rank"), F.concat_ws(" ", F.lit(rank), "taxon").alias("name"))

    leaf = p.select(F.col("tax").alias("taxon"), F.col("spe").alias("parent"), F.lit("strain").alias("rank"), "name")
    return root.unionByName(inner("fam", 1, "family")).unionByName(inner("gen", "fam", "genus")).unionByName(inner("spe", "gen", "species")).unionByName(leaf)


@cache
def taxonomy(spark: SparkSession, sf: str) -> Taxonomy:
    return Taxonomy.from_nodes(nodes(spark, sf))


def letters() -> Column:
    """Of a part: its genome, three segments of the genus, three of the species, four of the part."""
    seeds = [F.concat_ws(":", F.lit(c[0]), c, F.lit(i)) for c, n in (("gen", 3), ("spe", 3), ("tax", 4)) for i in range(n)]
    return F.concat(*[segment(s) for s in seeds])


def genomes(spark: SparkSession, sf: str) -> DataFrame:
    """header, location, nucleotides, taxon."""
    return parts(spark, sf).select(header().alias("header"), F.lit(1).cast("bigint").alias("location"), letters().alias("nucleotides"), F.col("tax").alias("taxon"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).select(header().alias("header"), F.col("tax").alias("taxon"))


def reads(spark: SparkSession, sf: str, paired: bool = False) -> DataFrame:
    """header, location, nucleotides (, nucleotides2), truth: one read for each order.

    Orders and parts are dealt by the part before letters are made, so no letter is
    shuffled, and there are as many tasks as reads ask for, whatever their shuffle's size.
    """
    n, orders = table(spark, sf, "part").count(), table(spark, sf, "orders")
    among = max(tasks(spark, sf), -(-orders.count() // READS_TASK))
    g = parts(spark, sf, F.col("p_partkey"), among).select(F.col("p_partkey").alias("at"), letters().alias("g"), F.col("tax").alias("truth"))
    o = orders.select(F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % n).alias("at")).repartition(among, "at")
    t = o.join(g, "at").withColumn("off", ((F.col("o") * 37) % (GENOME - READ + 1) + 1).cast("int"))
    r = F.substr("g", F.col("off"), F.lit(READ))
    r = F.when(F.col("o") % 3 == 1, F.reverse(F.translate(r, "ACGT", "TGCA"))).otherwise(r)
    r = F.when(F.col("o") % 10 == 0, F.concat(F.substr(r, F.lit(1), F.lit(49)), F.lit("N"), F.substr(r, F.lit(51)))).otherwise(r)
    r = F.when(F.col("o") % 20 == 0, F.concat(F.lit("N" * 36), F.substr(r, F.lit(37)))).otherwise(r)
    mate = F.reverse(F.translate(F.substr("g", GENOME - READ + 2 - F.col("off"), F.lit(READ)), "ACGT", "TGCA"))
    header = F.concat(F.lit("S"), F.col("o") % 4, F.lit("R"), F.col("o"))
    return t.select(header.alias("header"), F.lit(1).cast("bigint").alias("location"), r.alias("nucleotides"), *([mate.alias("nucleotides2")] if paired else []), "truth")


def index(spark: SparkSession, sf: str, scheme: Scheme = SCHEME) -> MinimizerIndex:
    return MinimizerIndex.build(genomes(spark, sf), labels(spark, sf), taxonomy(spark, sf), scheme)


@cache
def nation_taxonomy(spark: SparkSession, sf: str) -> Taxonomy:
    """root 1, regions 10 + key, nations 100 + key, customers 1000 + key."""
    root = spark.createDataFrame([(1, 1, "root", "root")], "taxon int, parent int, rank string, name string")
    region = table(spark, sf, "region").select((F.col("r_regionkey") + 10).alias("taxon"), F.lit(1).alias("parent"), F.lit("superkingdom").alias("rank"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("taxon"), (F.col("n_regionkey") + 10).alias("parent"), F.lit("genus").alias("rank"), F.col("n_name").alias("name"))
    customer = table(spark, sf, "customer").select((F.col("c_custkey") + 1000).cast("int").alias("taxon"), (F.col("c_nationkey") + 100).alias("parent"), F.lit("species").alias("rank"), F.col("c_name").alias("name"))
    t = root
    for x in (region, nation, customer):
        t = t.unionByName(x.select(F.col("taxon").cast("int").alias("taxon"), F.col("parent").cast("int").alias("parent"), "rank", "name"))
    return Taxonomy.from_nodes(t)


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """taxon, n: orders of each customer as a taxon; orders with a key that 50 divides count as not classified."""
    taxon = F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(F.col("o_custkey") + 1000).cast("int")
    return table(spark, sf, "orders").select(taxon.alias("taxon")).groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """id, ref_taxon, test_taxon of each line item: its part's taxon, and some taxon near or far from it."""
    p = parts(spark, sf).select(F.col("p_partkey").alias("k"), "tax", "spe", "gen", "fam")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    li = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("x.l_partkey").alias("k"), F.col("x.l_suppkey").alias("s"))
    other = F.col("s") % 7
    test = F.when(other == 0, 0).when(other == 1, 1).when(other == 2, F.col("fam")).when(other == 3, F.col("gen")).when(other == 4, F.col("spe")).when(other == 5, F.col("tax")).otherwise(10000 + F.col("s"))
    return li.join(p, "k").select("id", F.col("tax").alias("ref_taxon"), test.cast("int").alias("test_taxon"))
