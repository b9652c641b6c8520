"""More queries: over files, which are written as a job would write them and read back, and over words."""

from __future__ import annotations


from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet
from ..operators import bracken, classify, compare, dynamic, minimizers, report
from ..operators.index import MinimizerIndex
from ..sources import sequences, shared, sinks, tables
from ..sources.shared import folder
from . import fixtures as fx
from .catalogue import ORACLE, QUERIES, SUPPORT, query
from .oracle import S, code, resolved


def same_rows(as_query: str):
    """Registers a query that gives the rows of another one by way of files."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = ORACLE[as_query]
        return f

    return put


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


# Sequences

@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides FROM genomes")
def src_fasta_files(spark, sf):
    """Plain and compressed FASTA, named in a list file."""
    at, t = folder(spark, "fasta"), fx.genomes(spark, sf)
    sinks.write_fasta(t.where("taxon % 2 = 0"), f"{at}/even.fna")
    odd = t.where("taxon % 2 = 1").select(F.concat(F.lit(">"), "header", F.lit(" some text\n"), F.substr("nucleotides", F.lit(1), F.lit(90)), F.lit("\r\n"), F.substr("nucleotides", F.lit(91))).alias("value"))
    odd.write.option("compression", "gzip").text(f"{at}/odd.fna")
    write_text(spark, [f"{at}/even.fna", f"{at}/odd.fna"], f"{at}/list.txt")
    return sequences.read(spark, [f"@{at}/list.txt"], fraction=1.0)


@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides, nt2 AS nucleotides2 FROM reads")
def src_fastq_mates(spark, sf):
    """Mates in two compressed FASTQ files."""
    at, t = folder(spark, "fastq"), fx.reads(spark, sf, paired=True)
    for i, c in ((1, "nucleotides"), (2, "nucleotides2")):
        quality = F.repeat(F.lit("@"), F.length(c))
        t.select(F.concat_ws("\n", F.concat(F.lit("@"), "header", F.lit(f"/{i}")), c, F.lit("+"), quality).alias("value")).write.option("compression", "gzip").text(f"{at}/{i}.fastq")
    return sequences.read(spark, [f"{at}/1.fastq", f"{at}/2.fastq"], paired_files=True)


@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides FROM reads")
def src_fastq_split(spark, sf):
    """Plain FASTQ files read in splits of 20 kB, so that records, and lines, lie across their borders."""
    at, t = folder(spark, "fastq"), fx.reads(spark, sf)
    quality = F.repeat(F.lit("@+"), (F.length("nucleotides") / 2).cast("int"))
    t.select(F.concat_ws("\n", F.concat(F.lit("@"), "header", F.lit(" lane 1")), "nucleotides", F.lit("+"), quality).alias("value")).write.text(f"{at}/all.fastq")
    small = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        small.conf.set(key, spark.conf.get(key))
    small.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    return sequences.read(small, [f"{at}/all.fastq"])


@query(f"""SELECT header, CAST(b + 1 AS BIGINT) AS location, substr(nt, CAST(b + 1 AS INTEGER), CAST(least({fx.GENOME}, b + 128 + {S.k - 1}) - b AS INTEGER)) AS nucleotides
    FROM (SELECT header, nt, unnest(range(0, {fx.GENOME - S.k + 1}, 128)) AS b FROM genomes)""")
def src_indexed_fasta(spark, sf):
    """One wrapped FASTA file with a .fai beside it, which is found by its name; long sequences come in overlapping pieces."""
    at, width = folder(spark, "indexed"), 60
    path = f"{at}/all.fna"
    wrapped = F.regexp_replace("nucleotides", f"(.{{{width}}})(?!$)", "$1\n")
    # one file by definition of the format, and a small one here
    t = fx.genomes(spark, sf).select("header", F.concat(F.lit(">"), "header", F.lit("\n"), wrapped).alias("value"), F.length("nucleotides").alias("n")).coalesce(1).sortWithinPartitions("header")
    t.select("value").write.text(path)
    sizes = sorted((r.header, r.n) for r in t.select("header", "n").collect())
    lines, offset = [], 0
    for header, n in sizes:
        start = offset + len(header) + 2
        lines.append(f"{header}\t{n}\t{start}\t{width}\t{width + 1}")
        offset = start + n + -(-n // width)
    write_text(spark, lines, f"{path}.fai")
    return sequences.read(spark, [path], k=S.k, chunk=128)


@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides FROM reads")
def src_dataframe(spark, sf):
    return sequences.from_dataframe(fx.reads(spark, sf).select("truth", "nucleotides", "header"))


# Tables

@query("SELECT 'G' || p_partkey AS header, tax AS taxon FROM parts")
def src_labels_file(spark, sf):
    at = folder(spark, "labels")
    lines = fx.labels(spark, sf).select(F.concat_ws("\t", "header", "taxon").alias("value"))
    lines.unionByName(spark.createDataFrame([("header\tno number",), ("short",)], "value string")).write.text(at)
    return tables.labels(spark, at)


def _dumped(spark, sf):
    """The taxonomy of the parts as read from dump files."""
    at, bar = folder(spark, "dump"), F.lit("\t|\t")
    t = fx.nodes(spark, sf)
    t.select(F.concat(F.col("taxon").cast("string"), bar, F.col("parent").cast("string"), bar, "rank", bar, F.lit("x"), F.lit("\t|")).alias("value")).write.text(f"{at}/nodes.dmp")
    names = [F.concat(F.col("taxon").cast("string"), bar, name, bar, F.lit(""), bar, F.lit(kind), F.lit("\t|")).alias("value") for name, kind in ((F.col("name"), "scientific name"), (F.lit("other"), "synonym"))]
    t.select(F.explode(F.array(*names)).alias("value")).write.text(f"{at}/names.dmp")
    t.where("taxon >= 10000").select(F.concat((F.col("taxon") + 100000).cast("string"), bar, F.col("taxon").cast("string"), F.lit("\t|")).alias("value")).write.text(f"{at}/merged.dmp")
    return tables.taxonomy(spark, at)


@query("SELECT taxon, parent, name, depth, level, taxon NOT IN (SELECT parent FROM nodes) AS leaf FROM tree")
def src_taxonomy_dump(spark, sf):
    return _dumped(spark, sf).table.select("taxon", "parent", "name", "depth", "level", "leaf")


@query("SELECT DISTINCT CAST(10000 + s_suppkey AS INTEGER) AS taxon FROM supplier")
def src_gold_file(spark, sf):
    """Ids one a line, every other one a merged id; blank lines and words are passed."""
    at, k = folder(spark, "gold"), F.col("s_suppkey")
    fx.table(spark, sf, "supplier").select(F.explode(F.array(F.concat(F.lit(" "), (10000 + k + F.when(k % 2 == 0, 100000).otherwise(0)).cast("string")), F.lit(""), F.lit("taxon"))).alias("value")).write.text(at)
    return _dumped(spark, sf).primary(tables.gold(spark, at)).distinct()


@query("SELECT 'r' || id AS id, ref_taxon FROM assigned")
def src_custom_mapping(spark, sf):
    """A reference mapping with a header, its columns in another order, both mates of a read, merged taxa."""
    at, t = folder(spark, "mapping"), fx.assigned(spark, sf)
    name = F.concat(F.lit("r"), F.col("id").cast("string"))
    rows = t.select(F.explode(F.array(*[F.struct((F.col("ref_taxon") + 100000).alias("taxon"), F.lit("x").alias("other"), F.concat(name, F.lit(m)).alias("read")) for m in ("/1", "/2")])).alias("r")).select("r.*")
    rows.write.csv(at, sep="\t", header=True)
    return tables.mapping(spark, at, id_column=3, taxon_column=1, header=True, tax=_dumped(spark, sf))


@query("SELECT CAST(id AS VARCHAR) AS id, ref_taxon AS taxon FROM assigned")
def src_mates_mapping(spark, sf):
    at = folder(spark, "mates")
    fx.assigned(spark, sf).select("id", F.lit("g").alias("genome"), F.col("ref_taxon").alias("tax_id")).write.csv(at, sep="\t", header=True)
    return tables.mates(spark, at)


# Classifications and reports

def _written(spark, sf):
    """Reads classified at two thresholds and written; only those that are classified."""
    at = folder(spark, "classified")
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.15, 0.5], sample_regex="^(S[0-9])", with_unclassified=False)
    sinks.write_classified(t, f"{at}/out", [0.15, 0.5])
    return at


@query("SELECT title AS id, taxon AS test_taxon FROM cls WHERE taxon <> 0", resolved(0.15))
def snk_classifications(spark, sf):
    """Per-read files of four samples, read back as a whole."""
    return tables.classifications(spark, f"{_written(spark, sf)}/out_c0.15/*", fx.taxonomy(spark, sf))


@query("SELECT taxon, count(*) AS n FROM cls WHERE taxon <> 0 AND title LIKE 'S2%' GROUP BY taxon", resolved(0.5))
def snk_written_counts(spark, sf):
    """One sample's counts, from what was written for it."""
    return tables.written_counts(spark, f"{_written(spark, sf)}/out_c0.50/sample=S2")


@query(
    "SELECT substr(title, 1, 2) AS sample, '0.15' AS threshold, taxon, count(*) AS n FROM c1 GROUP BY ALL UNION ALL SELECT substr(title, 1, 2), '0.50', taxon, count(*) FROM c2 GROUP BY ALL",
    resolved(0.15, "c1") | resolved(0.5, "c2"),
)
def snk_sample_reports(spark, sf):
    """Reads of each taxon itself, from the reports of all samples and thresholds, which one job wrote."""
    at = folder(spark, "reports")
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.15, 0.5], sample_regex="^(S[0-9])", with_details=False)
    sinks.write_reports(t, fx.taxonomy(spark, sf), f"{at}/out", [0.15, 0.5])
    part = F.split("value", "\t")
    lines = spark.read.text(f"{at}/out_c*/*_kreport").where(~F.col("value").startswith("#")).withColumn("file", F.col("_metadata.file_path"))
    t = lines.select(F.regexp_extract("file", r"/([^/]*)_kreport/", 1).alias("sample"), F.regexp_extract("file", r"_c([^/]*)/", 1).alias("threshold"), part[4].cast("int").alias("taxon"), part[2].cast("bigint").alias("n"))
    return t.where("n > 0")


NATION_LINES = ORACLE["rpt_nation_rows"]


@query(None)
def snk_report_file(spark, sf):
    """value: the lines of a written report with its header."""
    at = folder(spark, "report")
    sinks.write_lines(sinks.report_text(report.report_rows(fx.order_counts(spark, sf), fx.nation_taxonomy(spark, sf))), at)
    return spark.read.text(at)


ORACLE["snk_report_file"] = (
    NATION_LINES[: NATION_LINES.rindex("\nSELECT")]
    + "\nSELECT printf('%6.2f', percent) || chr(9) || clade || chr(9) || own || chr(9) || rank || chr(9) || taxon || chr(9) || name AS value FROM ("
    + NATION_LINES[NATION_LINES.rindex("\nSELECT") :]
    + ") UNION ALL SELECT '"
    + report.HEADER.replace("\t", "' || chr(9) || '")
    + "'"
)


@same_rows("rpt_nation_rows")
def rpt_zeros(spark, sf):
    """The report that lists all nodes, less the lines of those without counts, numbered anew: the plain report."""
    t = report.report_rows(fx.order_counts(spark, sf), fx.nation_taxonomy(spark, sf), zeros=True)
    return t.where("clade > 0 OR taxon = 1").withColumn("line", F.row_number().over(Window.orderBy("line")))


# Indexes

def _buckets(spark, sf) -> int:
    """Buckets of an index: a bucket is one task where it is written, sorted and joined, so there are more of them for more genomes."""
    return max(8, fx.tasks(spark, sf))


def _stored(spark, sf) -> MinimizerIndex:
    at = folder(spark, "index")
    fx.index(spark, sf).write(at, _buckets(spark, sf))
    return MinimizerIndex.load(spark, at, fx.taxonomy(spark, sf))


@query("SELECT id1, taxon FROM idx")
def idx_write_load(spark, sf):
    return _stored(spark, sf).records


@query("SELECT title, taxon FROM cls", resolved(0.15))
def idx_load_classify(spark, sf):
    """Reads classified by a stored index: its buckets are joined as they lie."""
    return classify.classify(fx.reads(spark, sf), _stored(spark, sf), [0.15], with_details=False).select("title", "taxon")


@same_rows("idx_migration")
def idx_load_migration(spark, sf):
    """As idx_migration, of two stored indexes, whose buckets are joined as they lie."""
    half = MinimizerIndex.build(fx.genomes(spark, sf), fx.labels(spark, sf).where("taxon % 2 = 0"), fx.taxonomy(spark, sf), S)
    at = folder(spark, "half")
    half.write(at, _buckets(spark, sf))
    both = MinimizerIndex.load(spark, at, fx.taxonomy(spark, sf)).migration(_stored(spark, sf))
    return both.groupBy("steps").agg(F.count(F.lit(1)).alias("n"))


@same_rows("idx_depth_histogram")
def snk_depth_histogram(spark, sf):
    at = folder(spark, "histogram")
    sinks.write_table(fx.index(spark, sf).depth_histogram().orderBy(F.desc("depth")), at)
    return spark.read.csv(at, sep="\t", header=True, schema="depth int, n bigint")


@query("""SELECT taxon || '  ' || string_agg(depth || ':' || n, '|' ORDER BY depth) AS value FROM (
    SELECT tax AS taxon, t.depth, count(*) AS n FROM gmin JOIN idx i ON i.id1 = mn JOIN tree t ON t.taxon = i.taxon GROUP BY tax, t.depth) GROUP BY taxon""")
def snk_support_report(spark, sf):
    at = folder(spark, "support")
    sinks.write_support(fx.index(spark, sf).full_coverage(fx.genomes(spark, sf), fx.labels(spark, sf)), at)
    return spark.read.text(at)


def _kinds(spark, at: str):
    """kind, taxon, clade, own from reports at <at>_<kind>; lines of reads of no taxon and headers left out."""
    part = F.split("value", "\t")
    lines = spark.read.text(f"{at}_*").where(~F.col("value").startswith("#")).withColumn("kind", F.regexp_extract(F.col("_metadata.file_path"), r"/out_([^/]*)/", 1))
    return lines.select("kind", part[4].cast("int").alias("taxon"), part[1].cast("bigint").alias("clade"), part[2].cast("bigint").alias("own"))


def _kinds_sql(counts: str) -> str:
    """The same from SQL for kind, taxon, n."""
    return f"""SELECT c.kind, CAST(x.a AS INTEGER) AS taxon, CAST(sum(c.n) AS BIGINT) AS clade, CAST(sum(CASE WHEN c.taxon = x.a THEN c.n ELSE 0 END) AS BIGINT) AS own
        FROM ({counts}) c JOIN anc x ON x.taxon = c.taxon GROUP BY c.kind, x.a"""


@query(
    _kinds_sql("SELECT 'totalKmerCount' AS kind, taxon, kmers AS n FROM sup UNION ALL SELECT 'distinctMinimizerCount', taxon, d FROM sup UNION ALL SELECT 'totalMinimizerCount', taxon, h FROM sup UNION ALL SELECT 'classifiedReadCount', taxon, count(*) FROM cls WHERE taxon <> 0 GROUP BY taxon"),
    resolved(0.0) | {"sup": SUPPORT},
)
def snk_support_counts(spark, sf):
    """The four reports of support for the taxa of an index, written by one job and read back."""
    at, tax = f"{folder(spark, 'support')}/out", fx.taxonomy(spark, sf)
    sinks.write_kinds(report.report_rows(dynamic.support_counts(fx.reads(spark, sf), fx.index(spark, sf)), tax, ["kind"]), at)
    return _kinds(spark, at)


@query(_kinds_sql("SELECT 'min' AS kind, taxon, count(*) AS n FROM idx GROUP BY taxon UNION ALL SELECT DISTINCT 'genome', taxon, 1 FROM idx UNION ALL SELECT 'missing', tax, 1 FROM parts WHERE tax NOT IN (SELECT taxon FROM idx WHERE taxon % 2 = 0)").replace("FROM idx", "FROM half_idx"), {"half_idx": "SELECT * FROM idx WHERE taxon % 2 = 0"})
def snk_index_reports(spark, sf):
    """The three reports on an index: its minimizers, its taxa, and labelled taxa that it lacks. Of the index only taxa with even ids are kept, so that some are missing."""
    at, tax = f"{folder(spark, 'inspect')}/out", fx.taxonomy(spark, sf)
    counts = report.index_counts(fx.index(spark, sf).counts_per_taxon().where("taxon % 2 = 0"), fx.labels(spark, sf))
    sinks.write_kinds(report.report_rows(counts, tax, ["kind"]), at)
    return _kinds(spark, at)


@query("SELECT taxon, n FROM (SELECT taxon, count(*) AS n FROM idx GROUP BY taxon) ORDER BY n DESC, taxon LIMIT 20")
def idx_largest_taxa(spark, sf):
    """The twenty taxa with most minimizers."""
    return fx.index(spark, sf).largest(20)


@query("SELECT tax AS taxon, count(DISTINCT mn) AS n FROM gmin WHERE tax % 5 = 0 GROUP BY tax")
def idx_distinct_of_requested(spark, sf):
    """Distinct minimizers of the taxa that are asked for."""
    asked = fx.labels(spark, sf).where("taxon % 5 = 0").select("taxon")
    return fx.index(spark, sf).distinct_per_taxon(fx.genomes(spark, sf), fx.labels(spark, sf), asked)


@query("""SELECT count(*) AS taxa, min(f) AS least, avg(f) AS mean, stddev_samp(f) AS deviation, quantile_disc(f, 0.25) AS quarter, quantile_disc(f, 0.5) AS half, quantile_disc(f, 0.75) AS three_quarters, max(f) AS most FROM (
    SELECT tax, count(*) FILTER (i.taxon = tax) / CAST(count(*) AS DOUBLE) AS f FROM gmin JOIN idx i ON i.id1 = mn GROUP BY tax)""")
def idx_coverage_summary(spark, sf):
    return fx.index(spark, sf).coverage_summary(fx.genomes(spark, sf), fx.labels(spark, sf))


# Weights

@same_rows("brk_short_reads")
def brk_in_batches(spark, sf):
    """Weights made in batches that are appended to one table, and read back."""
    return bracken.weights_in_batches(fx.genomes(spark, sf), fx.labels(spark, sf), fx.index(spark, sf), folder(spark, "weights"), 40, 2)


@query(None)
def snk_weights_file(spark, sf):
    at = folder(spark, "lines")
    sinks.write_weights(bracken.weights(fx.genomes(spark, sf), fx.labels(spark, sf), fx.index(spark, sf), 40), at)
    return spark.read.text(at)


SHORT = ORACLE["brk_short_reads"]
ORACLE["snk_weights_file"] = (
    SHORT[: SHORT.rindex("\nSELECT")]
    + f",\nwt AS MATERIALIZED ({SHORT[SHORT.rindex(chr(10) + 'SELECT') :]})\n"
    + "SELECT dest || chr(9) || string_agg(source || ':' || n || ':' || total, ' ' ORDER BY source) AS value FROM wt JOIN (SELECT source, sum(n) AS total FROM wt GROUP BY source) USING (source) WHERE dest <> 0 GROUP BY dest"
    + " UNION ALL SELECT '" + bracken.HEADER.replace("\t", "' || chr(9) || '") + "'"
)


# Comparison and taxonomy

@query("""SELECT id, ref_taxon, test_taxon, category FROM cats""")
def cmp_joined_files(spark, sf):
    """Reads and their reference, joined by id as two files hold them."""
    at, t = folder(spark, "compared"), fx.assigned(spark, sf)
    t.select(F.when(F.col("test_taxon") == 0, "U").otherwise("C"), "id", "test_taxon", F.lit("100"), F.lit("")).write.csv(f"{at}/test", sep="\t")
    t.select(F.lit("x"), "id", "ref_taxon").write.csv(f"{at}/ref", sep="\t")
    pairs = tables.classifications(spark, f"{at}/test").join(tables.mapping(spark, f"{at}/ref"), "id")
    return compare.hit_categories(pairs, fx.taxonomy(spark, sf), "species").select(F.col("id").cast("bigint").alias("id"), "ref_taxon", "test_taxon", "category")


@query("""SELECT library, sample, count(*) AS reads, count(*) FILTER (c = 'TruePos') AS tp, count(*) FILTER (c = 'FalsePos') AS fp, count(*) FILTER (c = 'VaguePos') AS vp, count(*) FILTER (c = 'FalseNeg') AS fn FROM (
    SELECT 'all' AS library, CAST(id % 3 AS VARCHAR) AS sample, category AS c FROM cats UNION ALL SELECT 'half', CAST(id % 3 AS VARCHAR), CASE WHEN id % 2 = 1 THEN 'FalseNeg' ELSE category END FROM cats) GROUP BY ALL""")
def cmp_multi_dirs(spark, sf):
    """Two result folders of three samples each, compared at once with the samples' own references."""
    at = folder(spark, "results")
    # the reads are found once for the three writes
    t = shared.written(fx.assigned(spark, sf), f"{at}/assigned").withColumn("sample", (F.col("id") % 3).cast("string"))
    for library, taxon in (("all", F.col("test_taxon")), ("half", F.when(F.col("id") % 2 == 1, 0).otherwise(F.col("test_taxon")))):
        t.select("sample", F.lit("C"), "id", taxon, F.lit("100"), F.lit("")).write.partitionBy("sample").csv(f"{at}/f/g/{library}_35_31_s7_c0.15", sep="\t")
    # a sample's reference is written by all tasks that have its reads
    t.select("sample", F.lit("x"), "id", "ref_taxon").write.partitionBy("sample").csv(f"{at}/written", sep="\t")
    for i in range(3):
        shared.move(spark, f"{at}/written/sample={i}", f"{at}/ref/sample{i}/reads_mapping.tsv")
    found = tables.classifications_of_samples(spark, [f"{at}/f/g/{x}_35_31_s7_c0.15" for x in ("all", "half")])
    m = compare.many_metrics(found, tables.mapping_of_samples(spark, f"{at}/ref"), fx.taxonomy(spark, sf), ("species",))
    return compare.with_title_fields(m).select("library", "sample", "reads", *[F.col(f"read_{c}").alias(c) for c in ("tp", "fp", "vp", "fn")])


@same_rows("cmp_per_read")
def snk_metrics_file(spark, sf):
    """Metrics written with a header line, two files read as one: equal rows once."""
    at = folder(spark, "metrics")
    t = compare.per_read_metrics(fx.assigned(spark, sf), fx.taxonomy(spark, sf), "species")
    for i in (1, 2):
        sinks.write_table(t, f"{at}/{i}")
    return spark.read.csv([f"{at}/1", f"{at}/2"], sep="\t", header=True, schema=t.schema).distinct()


@query("SELECT rank, rd.tp AS read_tp, rd.fn AS read_fn, rd.reads FROM (SELECT 'species' AS rank, count(*) FILTER (category = 'TruePos') AS tp, count(*) FILTER (category = 'FalseNeg') AS fn, count(*) AS reads FROM cats) rd")
def cmp_all_ranks(spark, sf):
    """All metrics, a row for each rank; those of reads at species are shown."""
    t = fx.assigned(spark, sf)
    return compare.all_metrics(t, t.select("ref_taxon"), fx.taxonomy(spark, sf)).where("rank = 'species'").select("rank", "read_tp", "read_fn", "reads")


@query("SELECT CAST(id AS VARCHAR) AS value FROM assigned JOIN tree ON taxon = test_taxon WHERE depth >= 8")
def snk_filtered_ids(spark, sf):
    """Ids of reads whose taxon is a species or below, written one a line."""
    at = folder(spark, "ids")
    ids = compare.filtered_ids(fx.assigned(spark, sf).select("id", F.col("test_taxon").alias("taxon")), fx.taxonomy(spark, sf))
    ids.select(F.col("id").cast("string").alias("value")).write.text(at)
    return spark.read.text(at)


@query("""SELECT tp, fp, fn, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(tp + fn AS DOUBLE) AS recall FROM (SELECT count(*) FILTER (t AND r) AS tp, count(*) FILTER (t AND NOT r) AS fp, count(*) FILTER (r AND NOT t) AS fn FROM (
    SELECT spe, bool_or(tax % 3 = 0) AS t, bool_or(tax % 4 = 0) AS r FROM parts GROUP BY spe))""")
def cmp_profile_sets(spark, sf):
    """Species of two profiles that list all levels."""
    p = fx.parts(spark, sf)
    genus = F.concat(F.lit("f__"), "fam", F.lit("|g__"), "gen")
    species = F.concat(genus, F.lit("|s__"), "spe")
    t = p.select("tax", F.explode(F.array(genus, species, F.concat(species, F.lit("|t__"), "tax"))).alias("clade"))
    return compare.profile_sets(t.where("tax % 3 = 0"), t.where("tax % 4 = 0"))


@query("SELECT taxon, parent, depth FROM tree")
def snk_taxonomy_copy(spark, sf):
    at = folder(spark, "taxonomy")
    sinks.write_taxonomy(fx.taxonomy(spark, sf), at)
    return spark.read.parquet(f"{at}/nodes").select("taxon", "parent", "depth")


@query("SELECT DISTINCT test_taxon AS taxon, test_taxon IN (SELECT taxon FROM nodes) AS defined FROM assigned")
def tax_defined(spark, sf):
    t, tax = fx.assigned(spark, sf).select(F.col("test_taxon").alias("taxon")).distinct(), fx.taxonomy(spark, sf)
    return tax.defined(t).withColumn("defined", F.lit(True)).unionByName(tax.unknown(t).withColumn("defined", F.lit(False)))


@query("SELECT tax AS taxon FROM parts")
def tax_leaves(spark, sf):
    return fx.taxonomy(spark, sf).leaves()


@query("""SELECT 'kraken:taxid|' || tax || '|G' || p_partkey AS id, tax AS taxon, 'G' || p_partkey AS accession FROM parts
    UNION ALL SELECT 'NC_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.1', NULL, 'NC_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') FROM parts""")
def prep_header_entries(spark, sf):
    """Headers of sequences that several entries share."""
    number = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    header = F.concat(F.lit("kraken:taxid|"), "tax", F.lit("|G"), "p_partkey", F.lit(" a name\x01NC_"), number, F.lit(".1 other"))
    return fx.parts(spark, sf).select(F.explode(sequences.header_entries(header)).alias("e")).select("e.*")


# Words and their codes

WORDS = "SELECT header, substr(nt, 1, 12) AS w, substr(nt, 101, 12) AS v FROM genomes"


@query(f"""SELECT header, a & b AS both, a | b AS either, xor(a, b) AS one, (a << 4) & 16777215 AS up, a >> 4 AS down, a < b AS less, a = b AS same, c AS part FROM (
    SELECT header, {code('w')} AS a, {code('v')} AS b, {code('substr(w, 3, 5)')} AS c FROM ({WORDS}))""")
def seq_bit_operations(spark, sf):
    """Codes of words combined, shifted, compared and sliced."""
    t = fx.genomes(spark, sf).select("header", F.substr("nucleotides", F.lit(1), F.lit(12)).alias("w"), F.substr("nucleotides", F.lit(101), F.lit(12)).alias("v"))
    a, b = alphabet.encode(F.col("w")), alphabet.encode(F.col("v"))
    return t.select(
        "header", a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("either"), a.bitwiseXOR(b).alias("one"), F.shiftleft(a, 4).bitwiseAND(F.lit((1 << 24) - 1)).alias("up"),
        F.shiftright(a, 4).alias("down"), (a < b).alias("less"), (a == b).alias("same"), alphabet.encode(F.substr("w", F.lit(3), F.lit(5))).alias("part"),
    )


@query("SELECT header, regexp_full_match(nt, '[ACGTUacgtu]*') AS valid FROM reads")
def seq_is_valid(spark, sf):
    return fx.reads(spark, sf).select("header", alphabet.is_valid(F.col("nucleotides")).alias("valid"))


@query("SELECT title, kmers FROM rspans WHERE flag = 2")
def seq_ambiguous_spans(spark, sf):
    """Stretches without nucleotides, as the super-mer operator reports them."""
    return minimizers.spans(fx.reads(spark, sf), S).where("flag = 2").select("title", "kmers")


@query("SELECT title, CASE WHEN taxon <> 0 THEN 'C' ELSE 'U' END || chr(9) || title || chr(9) || taxon AS line FROM cls", resolved(0.5))
def cls_output_lines(spark, sf):
    """The first three columns of the per-read format."""
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.5])
    return t.select("title", F.substring_index(classify.output_lines(t), "\t", 3).alias("line"))
