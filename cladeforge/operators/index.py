"""The minimizer index: a bucketed table from minimizer to lowest common ancestor."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Scheme
from . import minimizers
from .taxonomy import Taxonomy, pack

KEY = "id1"
VERSION = 1


def id_columns(scheme: Scheme) -> list[str]:
    return [f"id{j + 1}" for j in range(len(scheme.rests))]


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


class MinimizerIndex:
    """records: id1 (bigint, or array<bigint> of wide minimizers), taxon int. Files have a column id1, id2 ... for each word.

    stored: of a wide index, the same records as columns id1, id2 ..., taxon in
    their buckets: an array of them is an expression, by which no bucket is known.
    """

    def __init__(self, records: DataFrame, scheme: Scheme, taxonomy: Taxonomy, stored: DataFrame | None = None):
        self.records, self.scheme, self.taxonomy, self.stored = records, scheme, taxonomy, stored

    def looked_up(self, df: DataFrame, column: str) -> DataFrame:
        """df with the taxon of a minimizer column, null where the index has none; a stored index stays where it lies."""
        if self.stored is None:
            return df.join(self.records.withColumnRenamed(KEY, column), column, "left")
        ids = id_columns(self.scheme)
        words = df.withColumns({f"__{c}": F.get(column, F.lit(j)) for j, c in enumerate(ids)})
        held = self.stored.select(*[F.col(c).alias(f"_{c}") for c in ids], "taxon")
        return words.join(held, [F.col(f"__{c}") == F.col(f"_{c}") for c in ids], "left").drop(*[f"{u}{c}" for u in ("_", "__") for c in ids])

    def in_both(self, other: MinimizerIndex) -> DataFrame:
        """t1, t2: taxa here and there of the minimizers that both have; two stored indexes with as many buckets are joined as they lie."""
        if self.stored is not None and other.stored is not None:
            ids, a, b = id_columns(self.scheme), self.stored, other.stored
        else:
            ids, a, b = [KEY], self.records, other.records
        mine = a.select(*ids, F.col("taxon").alias("t1"))
        theirs = b.select(*[F.col(c).alias(f"_{c}") for c in ids], F.col("taxon").alias("t2"))
        return mine.join(theirs, [F.col(c) == F.col(f"_{c}") for c in ids]).select("t1", "t2")

    # building

    @classmethod
    def build(cls, sequences: DataFrame, labels: DataFrame, taxonomy: Taxonomy, scheme: Scheme | None = None, only: DataFrame | None = None) -> MinimizerIndex:
        """Index of sequences (header, nucleotides) with labels (header, taxon); only: taxa to keep.

        Labels get their depth-first number before sequences are split, so
        the aggregation by minimizer needs no other join.
        """
        scheme = scheme or Scheme()
        labels = labels.select("header", F.col("taxon").cast("int").alias("taxon"))
        if only is not None:
            labels = labels.join(only.select("taxon").distinct(), "taxon", "left_semi")
        numbered = labels.join(taxonomy.table.select("taxon", "pre"), "taxon").select("header", pack(F.col("pre"), F.col("taxon")).alias("packed"))
        found = minimizers.tagged_minimizers(sequences.select("header", "nucleotides").join(numbered, "header"), "packed", scheme)
        records = taxonomy.lca_of_packed(found.withColumnRenamed("minimizer", KEY), [KEY], "packed")
        return cls(records, scheme, taxonomy)

    def respace(self, spaces: int) -> MinimizerIndex:
        """The index with more spaces: minimizers that become equal take their common ancestor."""
        if spaces <= self.scheme.spaces:
            raise ValueError(f"spaces must be over {self.scheme.spaces}")
        scheme = self.scheme.respaced(spaces)
        if scheme.wide:
            masks = F.array(*[F.lit(signed(w)) for w in scheme.space_words])
            key = F.zip_with(KEY, masks, lambda a, b: a.bitwiseAND(b))
        else:
            key = F.col(KEY).bitwiseAND(F.lit(scheme.space_mask))
        masked = self.records.select(key.alias(KEY), "taxon")
        return MinimizerIndex(self.taxonomy.lca(masked, [KEY]), scheme, self.taxonomy)

    # storing

    def write(self, path: str, buckets: int = 200) -> None:
        """Bucketed Parquet at path, and path.json with the scheme."""
        spark = self.records.sparkSession
        name = f"index_{uuid.uuid4().hex}"
        ids = id_columns(self.scheme)
        rows = self.records.select(*[F.get(KEY, F.lit(j)).alias(c) for j, c in enumerate(ids)], "taxon") if self.scheme.wide else self.records
        rows.repartition(buckets, *ids).write.mode("overwrite").option("path", path).bucketBy(buckets, *ids).format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
        text = json.dumps({"version": VERSION, "k": self.scheme.k, "m": self.scheme.m, "spaces": self.scheme.spaces, "canonical": self.scheme.canonical, "toggle": str(self.scheme.toggle), "buckets": buckets})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")

    @classmethod
    def load(cls, spark: SparkSession, path: str, taxonomy: Taxonomy) -> MinimizerIndex:
        """The index at path; its buckets are known to Spark, so a join by minimizer shuffles the other side only."""
        params = json.loads("".join(r.value for r in spark.read.text(f"{path}.json").collect()))
        if params["version"] > VERSION:
            raise ValueError(f"index of version {params['version']}, this is {VERSION}")
        scheme = Scheme(params["k"], params["m"], params["spaces"], params["canonical"], int(params["toggle"]))
        name = f"index_{uuid.uuid4().hex}"
        ids = id_columns(scheme)
        spark.sql(f"CREATE TABLE {name} ({', '.join(f'{c} BIGINT' for c in ids)}, taxon INT) USING PARQUET CLUSTERED BY ({', '.join(ids)}) INTO {params['buckets']} BUCKETS LOCATION '{path}'")
        records = spark.table(name)
        if scheme.wide:
            return cls(records.select(F.array(*ids).alias(KEY), "taxon"), scheme, taxonomy, records)
        return cls(records, scheme, taxonomy)

    def compatible(self, other: MinimizerIndex, strict: bool = True) -> bool:
        a, b = self.scheme, other.scheme
        return (a.k, a.m) == (b.k, b.m) and (not strict or a == b)

    # statistics

    def counts_per_taxon(self) -> DataFrame:
        """taxon, n: minimizers whose ancestor is the taxon."""
        return self.records.groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))

    def depth_histogram(self) -> DataFrame:
        """depth, n of minimizers."""
        return self.counts_per_taxon().join(self.taxonomy.table.select("taxon", "depth"), "taxon").groupBy("depth").agg(F.sum("n").alias("n"))

    def taxon_depth_histogram(self) -> DataFrame:
        """depth, n of distinct taxa."""
        return self.records.select("taxon").distinct().join(self.taxonomy.table.select("taxon", "depth"), "taxon").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))

    def stats(self) -> DataFrame:
        """One row: taxa in the index, leaves among them, tree nodes they imply, minimizers, and those on leaves."""
        per = self.counts_per_taxon().join(self.taxonomy.table.select("taxon", "leaf"), "taxon")
        nodes = self.taxonomy.closure_up(self.records.select("taxon").distinct()).agg(F.count(F.lit(1)).alias("tree_size"))
        out = per.agg(F.count(F.lit(1)).alias("taxa"), F.count_if("leaf").alias("leaf_taxa"), F.coalesce(F.sum("n"), F.lit(0)).alias("minimizers"), F.coalesce(F.sum(F.when(F.col("leaf"), F.col("n"))), F.lit(0)).alias("leaf_minimizers"))
        return out.crossJoin(nodes)  # one row each

    def missing_taxa(self, labels: DataFrame) -> DataFrame:
        """Labelled taxa that no minimizer of the index has."""
        return labels.select("taxon").distinct().join(self.records.select("taxon").distinct(), "taxon", "left_anti")

    def distinct_per_taxon(self, sequences: DataFrame, labels: DataFrame, taxa: DataFrame | None = None) -> DataFrame:
        """taxon, n: distinct minimizers of each taxon's own sequences; of some taxa only, if they are given."""
        if taxa is not None:
            labels = labels.join(taxa.select("taxon").distinct(), "taxon", "left_semi")
        return self.of_genomes(sequences, labels).groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))

    def largest(self, n: int) -> DataFrame:
        """taxon, n of the taxa with most minimizers, most first."""
        return self.counts_per_taxon().orderBy(F.desc("n"), "taxon").limit(n)

    def coverage_summary(self, sequences: DataFrame, labels: DataFrame) -> DataFrame:
        """One row: number, least, mean, deviation, quartiles and most of the fractions of leaf_coverage(); a quartile is one of the fractions."""
        f = F.col("fraction")
        quartiles = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY fraction)").alias(name) for q, name in ((0.25, "quarter"), (0.5, "half"), (0.75, "three_quarters"))]
        return self.leaf_coverage(sequences, labels).agg(F.count(f).alias("taxa"), F.min(f).alias("least"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("deviation"), *quartiles, F.max(f).alias("most"))

    def of_genomes(self, sequences: DataFrame, labels: DataFrame) -> DataFrame:
        """taxon, id1, n, kmers: each taxon's distinct minimizers, with its super-mers and k-mers that have them."""
        tagged = sequences.select("header", "nucleotides").join(labels.select("header", "taxon"), "header")
        found = minimizers.tagged_minimizers(tagged, "taxon", self.scheme, counted=True).withColumnRenamed("minimizer", KEY)
        return found.groupBy("taxon", KEY).agg(F.sum("n").alias("n"), F.sum("kmers").alias("kmers"))

    def genome_sizes(self, sequences: DataFrame, labels: DataFrame) -> DataFrame:
        """taxon, size: k-mers of each taxon's sequences."""
        tagged = sequences.select("header", "nucleotides").join(labels.select("header", "taxon"), "header")
        return minimizers.tagged_minimizers(tagged, "taxon", self.scheme, counted=True).groupBy("taxon").agg(F.sum("kmers").alias("size"))

    def leaf_coverage(self, sequences: DataFrame, labels: DataFrame) -> DataFrame:
        """taxon, total (super-mers), own (those whose ancestor in the index is the taxon itself), fraction."""
        t = self.of_genomes(sequences, labels).join(self.records.withColumnRenamed("taxon", "lca"), KEY, "left")
        t = t.groupBy("taxon").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("lca") == F.col("taxon"), F.col("n")).otherwise(0)).alias("own"))
        return t.withColumn("fraction", F.col("own") / F.col("total"))

    def full_coverage(self, sequences: DataFrame, labels: DataFrame) -> DataFrame:
        """taxon, coverage, distinct_coverage: depth:count of the ancestors of its minimizers, joined by |, by depth."""
        depths = self.taxonomy.table.select(F.col("taxon").alias("lca"), "depth")
        t = self.of_genomes(sequences, labels).join(self.records.withColumnRenamed("taxon", "lca"), KEY)
        # few ancestors of a taxon meet the depths, instead of all its minimizers
        t = t.groupBy("taxon", "lca").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).join(depths, "lca")
        t = t.groupBy("taxon", "depth").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        t = t.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "d"))).alias("a"))
        text = [F.array_join(F.transform("a", f), "|") for f in (lambda x: F.concat_ws(":", x["depth"], x["n"]), lambda x: F.concat_ws(":", x["depth"], x["d"]))]
        return t.select("taxon", text[0].alias("coverage"), text[1].alias("distinct_coverage"))

    def without_minimizers(self, sequences: DataFrame) -> DataFrame:
        """Headers of sequences that give no minimizer."""
        return minimizers.with_any(sequences, self.scheme).groupBy("header").agg(F.bool_or("any").alias("any")).where("NOT any").select("header")

    def migration(self, reference: MinimizerIndex) -> DataFrame:
        """t1, t2, steps for minimizers of both indexes: by how many levels the taxon here is deeper.

        -100 and -200 mark taxa without a depth here and in the reference.
        """
        if not self.compatible(reference, strict=False):
            raise ValueError("the indexes have other k or m")
        t = self.in_both(reference)
        deep = reference.taxonomy.table
        t = t.join(deep.select(F.col("taxon").alias("t1"), F.col("depth").alias("d1")), "t1", "left").join(deep.select(F.col("taxon").alias("t2"), F.col("depth").alias("d2")), "t2", "left")
        steps = F.when(F.col("d1").isNull(), -100).when(F.col("d2").isNull(), -200).otherwise(F.col("d1") - F.col("d2"))
        return t.select("t1", "t2", steps.alias("steps"))
