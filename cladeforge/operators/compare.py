"""Accuracy of classifications against a reference, and distances of profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import NONE, ROOT
from .taxonomy import DEPTH, Taxonomy


def hit_categories(pairs: DataFrame, taxonomy: Taxonomy, rank: str | None = None) -> DataFrame:
    """pairs (ref_taxon, test_taxon, ...) with category and index.

    TruePos (0): the same taxon, or one below the reference's ancestor at the
    rank. VaguePos (levels above the reference): an ancestor, or the root.
    FalseNeg (9): not classified. FalsePos (9): all else.
    """
    level = Taxonomy.standard_at_level(DEPTH[rank]) if rank else F.col("taxon")
    ref = taxonomy.table.select(F.col("taxon").alias("ref_taxon"), F.col("pre").alias("_rp"), F.col("depth").alias("_rd"), F.coalesce(level, "taxon").alias("_up"))
    up = taxonomy.table.select(F.col("taxon").alias("_up"), F.col("pre").alias("_up_pre"), F.col("end").alias("_up_end"))
    test = taxonomy.table.select(F.col("taxon").alias("test_taxon"), F.col("pre").alias("_tp"), F.col("end").alias("_te"), F.col("depth").alias("_td"))
    t = pairs.join(ref, "ref_taxon", "left").join(up, "_up", "left").join(test, "test_taxon", "left")
    below_up = F.col("_tp").between(F.col("_up_pre"), F.col("_up_end"))
    above_ref = F.col("_rp").between(F.col("_tp"), F.col("_te"))
    category = (
        F.when(F.col("test_taxon") == NONE, "FalseNeg")
        .when(F.col("ref_taxon") == F.col("test_taxon"), "TruePos")
        .when((F.col("_up") != ROOT) & below_up, "TruePos")
        .when((F.col("_up") == ROOT) | above_ref | (F.col("test_taxon") == ROOT), "VaguePos")
        .otherwise("FalsePos")
    )
    steps = F.when(above_ref, F.col("_rd") - F.col("_td")).otherwise(-1)
    t = t.withColumn("category", category)
    t = t.withColumn("index", F.when(F.col("category") == "TruePos", 0).when(F.col("category") == "VaguePos", steps).otherwise(9))
    return t.select(*pairs.columns, "category", "index")


def per_read_metrics(pairs: DataFrame, taxonomy: Taxonomy, rank: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each value of the keys, columns of pairs (one row without keys): reads, classified, tp, fp, vp, fn, ppv, sensitivity, mean_index."""
    t = hit_categories(pairs, taxonomy, rank)

    def n(c: str) -> Column:
        return F.count_if(F.col("category") == c)

    t = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("test_taxon") != NONE).alias("classified"), n("TruePos").alias("tp"), n("FalsePos").alias("fp"), n("VaguePos").alias("vp"), n("FalseNeg").alias("fn"), F.avg("index").alias("mean_index"))
    ppv = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return t.withColumn("ppv", ppv).withColumn("sensitivity", F.try_divide("tp", "reads"))


def per_taxon_metrics(pairs: DataFrame, reference: DataFrame, taxonomy: Taxonomy, rank: str | None = "species", least: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each value of the keys: classified taxa, reference taxa, tp, fp, vp, fn, precision, recall of the taxa at a rank.

    reference: keys and ref_taxon of all reference reads. Ancestors of reference
    taxa are vague: neither right nor wrong.
    """
    level = Taxonomy.standard_at_level(DEPTH[rank]) if rank else F.col("taxon")
    at = taxonomy.table.select(F.col("taxon").alias("_x"), level.alias("at"), F.col("depth").alias("_d"))
    on = [*keys, "taxon"]
    ref = reference.select(*keys, "ref_taxon").distinct().join(at, F.col("ref_taxon") == F.col("_x")).where(F.col("at").isNotNull()).select(*keys, F.col("at").alias("taxon")).distinct()
    vague = taxonomy.closure_up(ref, keys=keys).join(ref, on, "left_anti")
    found = pairs.join(at, F.col("test_taxon") == F.col("_x")).where(F.col("at").isNotNull() & (F.col("at") != NONE)).groupBy(*keys, F.col("at").alias("taxon")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*on)
    if rank is None:
        found = found.join(taxonomy.table.where(F.col("depth") >= DEPTH["species"]).select("taxon"), "taxon", "left_semi")
    t = ref.withColumn("r", F.lit(1)).join(found.withColumn("f", F.lit(1)), on, "full").join(vague.withColumn("v", F.lit(1)), on, "left")
    r, f, v = (F.col(c).isNotNull() for c in "rfv")
    t = t.groupBy(*keys).agg(F.count_if(f).alias("classified_taxa"), F.count_if(r).alias("reference_taxa"), F.count_if(r & f).alias("tp"), F.count_if(f & ~r & ~v).alias("fp"), F.count_if(f & v).alias("vp"), F.count_if(r & ~f).alias("fn"))
    return t.withColumn("precision", F.try_divide(F.col("tp"), F.col("classified_taxa") - F.col("vp"))).withColumn("recall", F.try_divide("tp", "reference_taxa"))


def all_metrics(pairs: DataFrame, reference: DataFrame, taxonomy: Taxonomy, ranks: tuple[str, ...] = ("genus", "species"), least: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The metrics of both kinds, a row for each rank and value of the keys that pairs have."""
    out = None
    for rank in ranks:
        a = per_read_metrics(pairs, taxonomy, rank, keys).withColumnsRenamed({c: f"read_{c}" for c in ("tp", "fp", "vp", "fn")})
        b = per_taxon_metrics(pairs, reference, taxonomy, rank, least, keys).withColumnsRenamed({c: f"taxon_{c}" for c in ("tp", "fp", "vp", "fn")})
        counts = ["classified_taxa", "reference_taxa", *(f"taxon_{c}" for c in ("tp", "fp", "vp", "fn"))]
        both = a.join(b, list(keys), "left").na.fill(0, counts) if keys else a.crossJoin(b)  # without keys, one row each
        row = both.withColumn("rank", F.lit(rank))
        out = row if out is None else out.unionByName(row)
    return out


# Fixed value: how result folders are named, and what their parts are.
TITLE = r"([^/]*)/([^/]*)/([^/]+)_(\d+)_(\d+)_s(\d+)_c([\d.]+)(?:_classified)?/sample=([^/]*)$"
TITLE_FIELDS = ("family", "group", "library", "k", "m", "s", "c", "sample")


def many_metrics(found: DataFrame, reference: DataFrame, taxonomy: Taxonomy, ranks: tuple[str, ...] = ("genus", "species"), least: int = 10) -> DataFrame:
    """all_metrics() of many result folders at once, by title and sample: a fixed number of jobs, however many folders.

    found: title, sample, id, test_taxon; reference: sample, id, ref_taxon, each
    sample's own. Samples without a reference are left out.
    """
    pairs = found.join(reference, ["sample", "id"])
    of_titles = reference.select("sample", "ref_taxon").distinct().join(found.select("title", "sample").distinct(), "sample")
    return all_metrics(pairs, of_titles, taxonomy, ranks, least, ["title", "sample"])


def with_title_fields(metrics: DataFrame, pattern: str = TITLE, fields: Sequence[str] = TITLE_FIELDS) -> DataFrame:
    """metrics with the parts of their titles as columns; rows whose titles do not match are left out."""
    t = metrics.where(F.col("title").rlike(pattern))
    return t.withColumns({f: F.regexp_extract("title", pattern, i) for i, f in enumerate(fields, 1)})


def mapping_report_counts(mapping: DataFrame, taxonomy: Taxonomy, rank: str = "species") -> DataFrame:
    """taxon, n: pairs of mates by their taxon, for reads whose primary taxon is at the rank or below.

    mapping: read id and taxon of each mate; two rows a pair, so counts are halved.
    """
    t = taxonomy.primary(mapping.withColumn("_primary", F.col("taxon")), "_primary")
    deep = taxonomy.table.where(F.col("depth") >= DEPTH[rank]).select(F.col("taxon").alias("_primary"))
    return t.join(deep, "_primary", "left_semi").groupBy("taxon").agg(F.floor(F.count(F.lit(1)) / 2).alias("n"))


def filtered_ids(mapping: DataFrame, taxonomy: Taxonomy, rank: str = "species") -> DataFrame:
    """Distinct ids of a mapping (id, taxon) whose primary taxon is at the rank or below."""
    t = taxonomy.primary(mapping, "taxon")
    deep = taxonomy.table.where(F.col("depth") >= DEPTH[rank]).select(F.col("taxon").alias("_deep"))
    return t.join(deep, F.col("taxon") == F.col("_deep"), "left_semi").select("id").distinct()


def profile_sets(test: DataFrame, reference: DataFrame, column: str = "clade", pattern: str = r"(?:^|\|)s__([^|]+)$") -> DataFrame:
    """One row: tp, fp, fn, precision and recall of the names that the pattern finds in two profiles; other levels are passed."""

    def names(df: DataFrame, mark: str) -> DataFrame:
        return df.where(F.col(column).rlike(pattern)).select(F.regexp_extract(column, pattern, 1).alias("_name")).distinct().withColumn(mark, F.lit(True))

    t = names(test, "_t").join(names(reference, "_r"), "_name", "full")
    out = t.agg(F.count_if(F.col("_t") & F.col("_r")).alias("tp"), F.count_if(F.col("_r").isNull()).alias("fp"), F.count_if(F.col("_t").isNull()).alias("fn"))
    return out.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))


def outer_merge(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, a, b: two profiles side by side, 0 where one has none."""
    left, right = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return left.join(right, keys, "full").na.fill(0, ["a", "b"])


def profile_distance(a: DataFrame, b: DataFrame, value: str = "fraction", floor: float = 1e-6) -> DataFrame:
    """One row: l1, squares, the same of logarithms, and tp, fp, fn of the taxa (a: test, b: reference)."""
    t = outer_merge(a, b, ["taxon"], value)
    d = F.col("a") - F.col("b")
    g = F.log10(F.greatest("a", F.lit(floor))) - F.log10(F.greatest("b", F.lit(floor)))
    return t.agg(F.sum(F.abs(d)).alias("l1"), F.sum(d * d).alias("squares"), F.sum(F.abs(g)).alias("log_l1"), F.sum(g * g).alias("log_squares"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("tp"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("fp"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("fn"))


def weighted_gold(report: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision and recall of a report's taxa (taxon, percent), plain and weighted by percent."""
    t = report.select("taxon", "percent").join(gold.select("taxon").distinct().withColumn("g", F.lit(1)), "taxon", "full").na.fill(0, ["percent"])
    hit = F.col("g").isNotNull() & (F.col("percent") > 0)
    t = t.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("percent") > 0).alias("found"), F.count("g").alias("gold"), F.sum(F.when(hit, F.col("percent")).otherwise(0.0)).alias("w"), F.sum("percent").alias("all"))
    return t.select(F.try_divide("tp", "found").alias("precision"), F.try_divide("tp", "gold").alias("recall"), F.try_divide("w", "all").alias("weighted_precision"))


def pairwise_differences(values: DataFrame, sample: str, group: str, value: str) -> DataFrame:
    """first, second, mean_difference: mean over samples of one group's value less another's."""
    a = values.select(F.col(sample).alias("s"), F.col(group).alias("first"), F.col(value).alias("x"))
    b = values.select(F.col(sample).alias("s"), F.col(group).alias("second"), F.col(value).alias("y"))
    t = a.join(b, "s").where("first < second")
    return t.groupBy("first", "second").agg(F.avg(F.col("x") - F.col("y")).alias("mean_difference"))


def group_ratio(values: DataFrame, sample: str, group: str, value: str) -> DataFrame:
    """sample, group, ratio: each group's share of its sample."""
    per = values.groupBy(sample, group).agg(F.sum(value).alias("x"))
    total = per.groupBy(F.col(sample).alias("_s")).agg(F.sum("x").alias("all"))
    return per.join(total, F.col(sample) == F.col("_s")).select(sample, group, F.try_divide("x", "all").alias("ratio"))


def pivoted(values: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """A row for each `row`, a column for each name, sums of value, 0 where there is none."""
    return values.groupBy(row).pivot(column, names).agg(F.sum(value)).na.fill(0)


def prefer_complete(assemblies: DataFrame, mode: str = "prefer_complete") -> DataFrame:
    """assemblies (taxon, level, ...): all, complete ones, or complete ones and others of taxa without any."""
    complete = assemblies.where(F.col("level").isin("Complete Genome", "Chromosome"))
    if mode == "all":
        return assemblies
    if mode == "complete":
        return complete
    rest = assemblies.join(complete.select("taxon").distinct(), "taxon", "left_anti")
    return complete.unionByName(rest.select(*complete.columns))
