"""Classification: hits of reads in an index, resolved over the taxonomy.

All of it after the spans is JVM-side: the join with the index, grouping by
read, and the resolution, which is array expressions over the read's hits and
their paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import AMBIGUOUS, AMBIGUOUS_TAXON, BORDER, BORDER_TAXON, NONE, SEQUENCE, Scheme
from . import minimizers
from .index import MinimizerIndex


def find_hits(spans: DataFrame, index: MinimizerIndex, with_minimizer: bool = False) -> DataFrame:
    """title, ordinal, is_distinct, taxon, count (and minimizer): the spans' taxa, 0 where the index has none.

    Ambiguous stretches and borders carry no minimizer; they pass by the join,
    so that they do not gather in one partition.
    """
    more = ["minimizer"] if with_minimizer else []
    sound = index.looked_up(spans.where(F.col("flag") == SEQUENCE), "minimizer")
    sound = sound.select("title", "ordinal", "is_distinct", F.coalesce("taxon", F.lit(NONE)).cast("int").alias("taxon"), F.col("kmers").alias("count"), *more)
    taxon = F.when(F.col("flag") == AMBIGUOUS, AMBIGUOUS_TAXON).when(F.col("flag") == BORDER, BORDER_TAXON)
    other = spans.where(F.col("flag") != SEQUENCE).select("title", "ordinal", "is_distinct", taxon.cast("int").alias("taxon"), F.col("kmers").alias("count"), *more)
    return sound.unionByName(other)


def group_hits(hits: DataFrame) -> DataFrame:
    """title, hits (ordered: ordinal, taxon, count), n_distinct (hit groups)."""
    group = F.array_sort(F.collect_list(F.struct("ordinal", "taxon", "count")))
    return hits.groupBy("title").agg(group.alias("hits"), F.count_if(F.col("is_distinct") & (F.col("taxon") != NONE)).alias("n_distinct"))


def packed_hit(with_ordinal: bool) -> Column:
    """Of a hit: ordinal, whether it counts as a hit group, and count in one bigint."""
    group = F.col("is_distinct") & (F.col("taxon") != NONE)
    place = (F.col("ordinal") if with_ordinal else F.lit(0)).cast("bigint") * 2 + group.cast("bigint")
    return F.shiftleft(place, 32).bitwiseOR(F.col("count").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def packed_count(x: Column) -> Column:
    # the sign of a border's count comes back by shifts
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def gather(hits: DataFrame, index: MinimizerIndex, with_hits: bool) -> DataFrame:
    """title, taxa (taxon, n, path), total, n_distinct and, if asked for, hits: a row for each read.

    Hits are dealt by read once, in two numbers beside the title. They stay
    there; only the taxa of a read, summed, go to the taxonomy for their paths
    and back. Both ways share one shuffle, so nothing may filter it for one of
    them: reads go by a text that is never null, and taxa are told from other
    hits by an aggregate.
    """
    # empty for a title that is null, else with a letter more
    read, title = F.coalesce(F.concat("title", F.lit("+")), F.lit("")), F.when(F.col("_read") != "", F.substr("_read", F.lit(1), F.length("_read") - 1))
    dealt = hits.select(read.alias("_read"), F.coalesce("taxon", F.lit(NONE)).alias("taxon"), packed_hit(with_hits).alias("_x")).repartition("_read")
    count, group = packed_count(F.col("_x")), F.shiftrightunsigned("_x", 32).bitwiseAND(F.lit(1))
    total = F.sum(F.when(F.col("taxon") == BORDER_TAXON, 0).otherwise(count)).alias("total")
    more = [F.collect_list(F.struct(F.shiftrightunsigned("_x", 33).cast("int").alias("ordinal"), "taxon", count.alias("count"))).alias("hits")] if with_hits else []
    reads = dealt.groupBy("_read").agg(total, F.sum(group).alias("n_distinct"), *more)
    # k-mers of no taxon have no path: they keep to their reads instead of meeting under one key
    per = dealt.groupBy("_read", "taxon").agg(F.max("taxon").alias("_own"), F.sum(count).cast("int").alias("n")).where("_own > 0")
    paths = index.taxonomy.table.select(F.col("taxon").alias("_taxon"), "path")
    taxa = per.join(paths, F.col("_own") == F.col("_taxon")).groupBy(F.col("_read").alias("_of")).agg(F.collect_list(F.struct("taxon", "n", "path")).alias("taxa"))
    out = reads.join(taxa.hint("merge"), F.col("_read") == F.col("_of"), "left")
    none = F.array().cast("array<struct<taxon:int,n:int,path:array<int>>>")
    return out.select(title.alias("title"), F.coalesce("taxa", none).alias("taxa"), "total", "n_distinct", *([F.array_sort("hits").alias("hits")] if with_hits else []))


def ladder(taxa: Column) -> Column:
    """The way up from the best taxon of a read: array of (taxon, clade: k-mers at or below it).

    A taxon's score is the number of k-mers on its way to the root. Taxa with
    the best score are joined in their lowest common ancestor.
    """

    def score(path: Column, every: Column) -> Column:
        return F.aggregate(every, F.lit(0), lambda acc, o: acc + F.when(F.array_contains(path, o["taxon"]), o["n"]).otherwise(0))

    def clade(taxon: Column, every: Column) -> Column:
        return F.aggregate(every, F.lit(0), lambda acc, o: acc + F.when(F.array_contains(o["path"], taxon), o["n"]).otherwise(0))

    def way(every: Column) -> Column:
        scored = F.transform(every, lambda x: F.struct(score(x["path"], every).alias("score"), x["path"].alias("path")))
        best = F.aggregate(
            scored,
            F.struct(F.lit(0).alias("score"), F.array().cast("array<int>").alias("path")),
            lambda acc, x: F.when(x["score"] > acc["score"], x).when(x["score"] == acc["score"], F.struct(acc["score"].alias("score"), F.array_intersect(acc["path"], x["path"]).alias("path"))).otherwise(acc),
        )["path"]
        return F.transform(F.reverse(best), lambda t: F.struct(t.alias("taxon"), clade(t, every).alias("clade")))

    return F.get(F.transform(F.array(taxa), way), F.lit(0))


def resolve(steps: Column, required: Column) -> Column:
    """The first taxon on the way up (see ladder) whose clade holds `required` k-mers; NONE (0) if there is none."""
    return F.coalesce(F.get(F.filter(steps, lambda x: x["clade"] >= required), F.lit(0))["taxon"], F.lit(NONE))


def sample_of(title: Column, regex: str | None) -> Column:
    """Sample id: group 1 of the regex in the title, "other" where it does not match, "all" without a regex."""
    if regex is None:
        return F.lit("all")
    return F.when(title.rlike(regex), F.regexp_extract(title, regex, 1)).otherwise(F.lit("other"))


def merged_hits(hits: Column) -> Column:
    """Neighbouring hits of one taxon put together: array of (taxon, count)."""

    def taxon(i: Column) -> Column:
        return F.get(hits, i)["taxon"]

    def runs(heads: Column) -> Column:
        def run(head: Column, j: Column) -> Column:
            part = F.slice(hits, head + 1, F.coalesce(F.get(heads, j + 1), F.size(hits)) - head)
            return F.struct(taxon(head).alias("taxon"), F.aggregate(part, F.lit(0), lambda acc, h: acc + h["count"]).alias("count"))

        return F.transform(heads, run)

    places = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(places, lambda i: (i == 0) | (taxon(i) != taxon(i - 1)))
    # an array of the one array of heads: it would be made anew wherever it is named
    return F.get(F.transform(F.array(heads), runs), F.lit(0))


def details(pairs: Column) -> Column:
    """taxon:count of merged hits joined by blanks; A:n for ambiguous ones, |:| for the border."""
    return F.array_join(F.transform(pairs, lambda p: F.when(p["taxon"] == BORDER_TAXON, F.lit("|:|")).otherwise(F.concat_ws(":", F.when(p["taxon"] == AMBIGUOUS_TAXON, F.lit("A")).otherwise(p["taxon"].cast("string")), p["count"]))), " ")


def lengths(pairs: Column, k: int) -> Column:
    """Length of a read from its k-mers, or first|second for mates; of hits or of merged ones, in one pass over them."""
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(False).alias("mated"))

    def step(acc: Column, p: Column) -> Column:
        border = p["taxon"] == BORDER_TAXON
        first = acc["first"] + F.when(acc["mated"] | border, 0).otherwise(p["count"])
        second = acc["second"] + F.when(acc["mated"], p["count"]).otherwise(0)
        return F.struct(first.alias("first"), second.alias("second"), (acc["mated"] | border).alias("mated"))

    def text(n: Column) -> Column:
        return (n + (k - 1)).cast("string")

    return F.aggregate(pairs, start, step, lambda acc: F.when(acc["mated"], F.concat_ws("|", text(acc["first"]), text(acc["second"]))).otherwise(text(acc["first"])))


def read_lengths(reads: DataFrame, scheme: Scheme) -> DataFrame:
    """title, length: what lengths() tells of the hits of each read, from its own spans: no taxon has a part in it, so nothing is looked up or shuffled."""
    first, second = ((F.col(c) + (scheme.k - 1)).cast("string") for c in ("first", "second"))
    return minimizers.counted_kmers(reads, scheme).select("title", F.concat_ws("|", first, second).alias("length"))


def classify_gathered(gathered: DataFrame, k: int, thresholds: Sequence[float] = (0.0,), min_hit_groups: int = 2, sample_regex: str | None = None, with_details: bool = True) -> DataFrame:
    """title, sample, threshold, classified, taxon (and length, details) for each read and threshold, in one pass."""
    if any(not 0 <= t <= 1 for t in thresholds):
        raise ValueError("confidence must be from 0 to 1")
    # reads with too few hit groups are not resolved; the way up is the same for all thresholds
    enough = F.col("n_distinct") >= min_hit_groups
    t = gathered.withColumn("_steps", F.when(enough, ladder(F.col("taxa"))))
    if with_details:
        pairs = F.col("_pairs")
        t = t.withColumn("_pairs", merged_hits(F.col("hits"))).withColumn("length", lengths(F.col("hits"), k)).withColumn("details", details(pairs)).drop("_pairs")
    t = t.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    taxon = resolve(F.col("_steps"), F.ceil(F.col("threshold") * F.col("total")))
    t = t.withColumn("taxon", taxon.cast("int")).withColumn("classified", F.col("taxon") != NONE).withColumn("sample", sample_of(F.col("title"), sample_regex))
    return t.select("title", "sample", "threshold", "classified", "taxon", *(["length", "details"] if with_details else []))


def classify(reads: DataFrame, index: MinimizerIndex, thresholds: Sequence[float] = (0.0,), min_hit_groups: int = 2, sample_regex: str | None = None, with_details: bool = True, with_unclassified: bool = True) -> DataFrame:
    """Reads (header, nucleotides, nucleotides2 or none) classified by an index."""
    gathered = gather(find_hits(minimizers.spans(reads, index.scheme), index), index, with_details)
    out = classify_gathered(gathered, index.scheme.k, thresholds, min_hit_groups, sample_regex, with_details)
    return out if with_unclassified else out.where("classified")


def output_lines(classified: DataFrame) -> Column:
    """The five columns of the per-read format, joined by tabs."""
    return F.concat_ws("\t", F.when(F.col("classified"), "C").otherwise("U"), "title", "taxon", "length", "details")


def taxon_counts(classified: DataFrame) -> DataFrame:
    """sample, threshold, taxon, n."""
    return classified.groupBy("sample", "threshold", "taxon").agg(F.count(F.lit(1)).alias("n"))


def threshold_texts(thresholds: Sequence[float]) -> list[str]:
    """Thresholds as they stand in file names: all with as many decimals as the longest needs."""
    most = max((len(f"{t:g}".partition(".")[2]) for t in thresholds), default=0)
    return [f"{t:.{max(most, 1)}f}" for t in thresholds]
