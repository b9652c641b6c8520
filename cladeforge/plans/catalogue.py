"""All queries by name, with the SQL text that gives the same rows.

Every query runs over whole derived tables (see fixtures.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet
from ..functions.alphabet import Scheme
from ..operators import bracken, classify, compare, dynamic, kmers as kmer_tables, masking, minimizers, report
from ..operators.taxonomy import DEPTH, Taxonomy, rank_table
from ..sources import sequences
from . import fixtures as fx
from .oracle import S, kmers, renamed, resolved, revcomp, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if sql.startswith("/*plain*/") else with_(sql, extra)
        return f

    return put


def queries() -> dict[str, Query]:
    from . import stored  # noqa: F401  registers itself

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import stored  # noqa: F401

    return dict(ORACLE)


# The taxonomy

@query("SELECT taxon, array_to_string(list(a ORDER BY steps DESC), '.') AS path FROM anc GROUP BY taxon")
def tax_paths(spark, sf):
    return fx.taxonomy(spark, sf).table.select("taxon", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query("SELECT taxon, depth, level FROM tree")
def tax_depths(spark, sf):
    return fx.taxonomy(spark, sf).table.select("taxon", "depth", "level")


@query("""SELECT t.taxon, t.parent, t.depth, t.level, string_agg(a.a, '.' ORDER BY a.steps DESC) AS path, (SELECT count(*) FROM anc d WHERE d.a = t.taxon) AS size
    FROM tree t JOIN anc a USING (taxon) GROUP BY ALL""")
def tax_layout(spark, sf):
    """The tree laid out by Spark's jobs, whatever its size."""
    t = Taxonomy.from_nodes(fx.nodes(spark, sf), at_driver=0).table
    return t.select("taxon", "parent", "depth", "level", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), (F.col("end") - F.col("pre") + 1).cast("bigint").alias("size"))


@query("SELECT parent AS taxon, array_to_string(list(taxon ORDER BY taxon DESC), '.') AS children FROM nodes WHERE parent > 0 GROUP BY parent")
def tax_children(spark, sf):
    return fx.taxonomy(spark, sf).children().select("taxon", F.array_join(F.col("children").cast("array<string>"), ".").alias("children"))


@query("SELECT a AS taxon, count(*) AS n FROM anc GROUP BY a")
def tax_preorder_descendants(spark, sf):
    """Descendants by the numbers alone: each node covers end - pre + 1 of them."""
    return fx.taxonomy(spark, sf).table.select("taxon", (F.col("end") - F.col("pre") + 1).cast("bigint").alias("n"))


@query("SELECT taxon, a AS ancestor, CAST(steps AS INTEGER) AS steps FROM anc")
def tax_ancestors(spark, sf):
    return fx.taxonomy(spark, sf).ancestors()


@query("""SELECT id, ref_taxon, test_taxon, CAST(coalesce(a.steps, -1) AS INTEGER) AS steps, CAST(CASE WHEN a.steps IS NULL THEN -1 ELSE r.depth - t.depth END AS INTEGER) AS standard_steps
    FROM assigned JOIN tree r ON r.taxon = ref_taxon LEFT JOIN tree t ON t.taxon = test_taxon LEFT JOIN anc a ON a.taxon = ref_taxon AND a.a = test_taxon""")
def tax_steps_to_ancestor(spark, sf):
    return fx.taxonomy(spark, sf).with_steps(fx.assigned(spark, sf), "ref_taxon", "test_taxon")


PAIR_LCA = """SELECT x.id, CASE WHEN test_taxon = 0 THEN ref_taxon ELSE arg_max(c.a, t.level) END AS lca FROM assigned x JOIN anc c ON c.taxon = ref_taxon LEFT JOIN anc d ON d.taxon = test_taxon AND d.a = c.a
    JOIN tree t ON t.taxon = c.a WHERE test_taxon = 0 OR d.a IS NOT NULL GROUP BY x.id, ref_taxon, test_taxon"""


@query(PAIR_LCA)
def tax_lca_pairs(spark, sf):
    return fx.taxonomy(spark, sf).lca_of_pairs(fx.assigned(spark, sf), "ref_taxon", "test_taxon").select("id", "lca")


@query("""SELECT s, CAST(CASE WHEN min(tax) = max(tax) THEN min(tax) WHEN min(spe) = max(spe) THEN min(spe) WHEN min(gen) = max(gen) THEN min(gen) WHEN min(fam) = max(fam) THEN min(fam) ELSE 1 END AS INTEGER) AS taxon
    FROM (SELECT l_orderkey AS s, p.* FROM lineitem JOIN parts p ON p_partkey = l_partkey) GROUP BY s""")
def tax_lca_agg(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_partkey") + 10000).cast("int").alias("taxon"))
    return fx.taxonomy(spark, sf).lca(rows, ["s"])


@query("SELECT taxon, CAST(min(a) FILTER (depth = 7) AS INTEGER) AS genus, CAST(arg_max(a, lv) FILTER (depth = 8) AS INTEGER) AS species FROM (SELECT anc.taxon, a, t.depth, t.level AS lv FROM anc JOIN tree t ON t.taxon = a) GROUP BY taxon")
def tax_ancestor_at_level(spark, sf):
    return fx.taxonomy(spark, sf).table.select("taxon", Taxonomy.at_level(7).alias("genus"), Taxonomy.at_level(8).alias("species"))


@query("SELECT taxon, CAST(arg_min(a, lv) FILTER (depth >= 7) AS INTEGER) AS genus, CAST(arg_min(a, lv) FILTER (depth >= 8) AS INTEGER) AS species FROM (SELECT anc.taxon, a, t.depth, t.level AS lv FROM anc JOIN tree t ON t.taxon = a) GROUP BY taxon")
def tax_standard_ancestor(spark, sf):
    return fx.taxonomy(spark, sf).table.select("taxon", Taxonomy.standard_at_level(7).alias("genus"), Taxonomy.standard_at_level(8).alias("species"))


SMALL = "(SELECT DISTINCT CAST(10000 + l_partkey AS INTEGER) AS taxon FROM lineitem WHERE l_quantity >= 49)"


def _small(spark, sf):
    return fx.table(spark, sf, "lineitem").where("l_quantity >= 49").select((F.col("l_partkey") + 10000).cast("int").alias("taxon"))


@query(f"SELECT DISTINCT a AS taxon FROM anc JOIN {SMALL} USING (taxon)")
def tax_closure_up(spark, sf):
    return fx.taxonomy(spark, sf).closure_up(_small(spark, sf))


@query("SELECT DISTINCT anc.taxon FROM anc WHERE a IN (SELECT DISTINCT CAST(100 + s_suppkey % 25 AS INTEGER) FROM supplier WHERE s_acctbal < 0)")
def tax_closure_down(spark, sf):
    wanted = fx.table(spark, sf, "supplier").where("s_acctbal < 0").select((100 + F.col("s_suppkey") % 25).cast("int").alias("taxon"))
    return fx.taxonomy(spark, sf).closure_down(wanted)


@query("SELECT level, count(*) AS n FROM (SELECT taxon, unnest(range(1, 9)) AS level FROM nodes) x WHERE NOT EXISTS (SELECT 1 FROM anc JOIN tree t ON t.taxon = a WHERE anc.taxon = x.taxon AND t.depth = x.level) GROUP BY level")
def tax_missing_levels(spark, sf):
    t = fx.taxonomy(spark, sf).missing_levels().select(F.explode("missing").alias("level"))
    return t.groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) FILTER (f + g = 1) AS n_unique, count(*) AS n_total, count(*) FILTER (f + g = 1) / CAST(count(*) AS DOUBLE) AS distance FROM (
    SELECT a, max(f) AS f, max(g) AS g FROM (SELECT a, 1 AS f, 0 AS g FROM anc JOIN {SMALL} USING (taxon) UNION ALL
    SELECT a, 0, 1 FROM anc JOIN (SELECT DISTINCT CAST(10000 + l_partkey AS INTEGER) AS taxon FROM lineitem WHERE l_quantity <= 2) USING (taxon)) WHERE a <> 1 GROUP BY a)""")
def tax_unifrac(spark, sf):
    other = fx.table(spark, sf, "lineitem").where("l_quantity <= 2").select((F.col("l_partkey") + 10000).cast("int").alias("taxon"))
    return fx.taxonomy(spark, sf).unifrac(_small(spark, sf), other)


@query("SELECT taxon, CAST(level - min(lv) AS INTEGER) AS sublevel FROM (SELECT t.taxon, t.level, u.level AS lv FROM tree t JOIN anc ON anc.taxon = t.taxon JOIN tree u ON u.taxon = a AND u.depth = t.depth) GROUP BY taxon, level")
def tax_sublevel(spark, sf):
    return fx.taxonomy(spark, sf).table.select("taxon", "sublevel")


@query("/*plain*/ SELECT * FROM (VALUES ('unclassified','U',-1),('root','R',0),('superkingdom','D',1),('kingdom','K',2),('phylum','P',3),('class','C',4),('order','O',5),('family','F',6),('genus','G',7),('species','S',8)) t(title, code, depth)")
def tax_ranks(spark, sf):
    return rank_table(spark)


@query("SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(CASE WHEN l_partkey % 5 = 0 THEN 100 + l_partkey % 25 ELSE 90000 + l_partkey END AS INTEGER) AS taxon FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def tax_primary_ids(spark, sf):
    """Merged ids: every fifth part's secondary id has a genus as its primary."""
    merged = fx.table(spark, sf, "part").where("p_partkey % 5 = 0").select((F.col("p_partkey") + 90000).cast("int").alias("secondary"), (F.col("p_partkey") % 25 + 100).cast("int").alias("primary"))
    tax = Taxonomy(fx.taxonomy(spark, sf).table, merged)
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") + 90000).cast("int").alias("taxon"))
    return tax.primary(rows)


# Sequence functions

@query(f"SELECT header, {revcomp('nt')} AS rc FROM genomes")
def seq_revcomp(spark, sf):
    return fx.genomes(spark, sf).select("header", alphabet.reverse_complement(F.col("nucleotides")).alias("rc"))


GW = f"(SELECT header, pos, substr(nt, pos, {S.m}) AS w FROM (SELECT header, nt, unnest(range(1, length(nt) - {S.m} + 2)) AS pos FROM genomes))"


def _words(spark, sf, m=S.m):
    return minimizers.coded_words(fx.genomes(spark, sf), m)


@query(f"SELECT least(w, {revcomp('w')}) AS word, count(*) AS n FROM {GW} GROUP BY 1")
def seq_canonical_mmers(spark, sf):
    return kmer_tables.counts(fx.genomes(spark, sf), S.m)


@query("SELECT word, count(*) AS n FROM (SELECT substr(nt, pos, 8) AS word FROM (SELECT nt, unnest(range(1, length(nt) - 6)) AS pos FROM genomes)) GROUP BY word")
def seq_kmer_counts(spark, sf):
    return kmer_tables.counts(fx.genomes(spark, sf), 8, canonical=False)


@query(f"SELECT word, count(*) AS n FROM (SELECT substr(nt, pos, 9) AS word FROM (SELECT nt, unnest(range(1, length(nt) - 7)) AS pos FROM genomes)) WHERE word <= {revcomp('word')} GROUP BY word")
def seq_kmers_forward(spark, sf):
    t = kmer_tables.coded_kmers(fx.genomes(spark, sf), 9, forward_only=True).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return t.select(alphabet.decode(F.col("code"), 9).alias("word"), "n")


@query("SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS word, CAST(sum(a) AS BIGINT) AS n FROM (SELECT substr(nt, pos, 12) AS w, a FROM (SELECT nt, taxon % 7 + 1 AS a, unnest(range(1, length(nt) - 10)) AS pos FROM genomes)) GROUP BY 1")
def seq_kmer_abundance(spark, sf):
    return kmer_tables.counts(fx.genomes(spark, sf).withColumn("a", F.col("taxon") % 7 + 1), 12, abundance="a")


@query("""SELECT header, pos, CAST(mn AS BIGINT) AS minimizer FROM (SELECT header, pos, min(CASE WHEN substr(w, 1, 1) <> 'A' THEN ascii(substr(w, 2, 1)) * 1000 + ascii(substr(w, 3, 1)) END) OVER q AS mn, count(*) OVER q AS c
    FROM (SELECT header, pos, substr(nt, pos, 3) AS w FROM (SELECT header, nt, unnest(range(1, length(nt) - 1)) AS pos FROM genomes)) WINDOW q AS (PARTITION BY header ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5""")
def seq_minimizers_by_table(spark, sf):
    """A lookup table of the 48 motifs of three letters that do not begin with A."""
    letters = spark.createDataFrame([(x,) for x in "ACGT"], "x string")
    motifs = letters.where("x <> 'A'").select(F.col("x").alias("a")).crossJoin(letters.select(F.col("x").alias("b"))).crossJoin(letters.select(F.col("x").alias("c")))  # 48 rows
    table = motifs.select(F.concat("a", "b", "c").alias("motif"), (F.ascii("b") * 1000 + F.ascii("c")).cast("bigint").alias("rank"))
    return kmer_tables.minimizers_by_table(fx.genomes(spark, sf), table, 7, 3).withColumn("pos", F.col("pos").cast("bigint"))


NOSPACE = Scheme(S.k, S.m, 0)


def _ranks(scheme):
    from .oracle import rank

    return f"SELECT {rank('w', scheme)} AS rank, count(*) AS n FROM {GW} GROUP BY 1"


@query(_ranks(NOSPACE))
def seq_priority_xor(spark, sf):
    return _words(spark, sf).groupBy(alphabet.code_priority(F.col("code"), NOSPACE).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(_ranks(S))
def seq_priority_spaced(spark, sf):
    return _words(spark, sf).groupBy(alphabet.code_priority(F.col("code"), S).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


LEXI = Scheme(9, 5, 0, canonical=False, toggle=0)


@query("SELECT header, location, kmers, kmers + 8 AS length, minimizer FROM (SELECT header, location, kmers, mn AS minimizer FROM lx_spans)", {k: v.replace("least(w, reverse(translate(w, 'ACGT', 'TGCA')))", "w") for k, v in kmers("lx", "genomes", LEXI).items()})
def seq_supermers_lexicographic(spark, sf):
    return minimizers.positions(fx.genomes(spark, sf), LEXI)


@query("SELECT header, pos, mn AS minimizer FROM gk")
def seq_minimizers(spark, sf):
    return minimizers.minimizers_by_window(fx.genomes(spark, sf), S).withColumn("pos", F.col("pos").cast("bigint"))


SUPER = f"SELECT header, location, kmers + {S.k - 1} AS length, kmers, mn AS minimizer FROM gk_spans"


@query(SUPER)
def seq_supermers(spark, sf):
    return minimizers.positions(fx.genomes(spark, sf), S)


@query(SUPER)
def seq_supermers_window(spark, sf):
    return minimizers.supermers_by_window(fx.genomes(spark, sf), S)


@query(f"SELECT header, location, substr(nt, CAST(location + 1 AS BIGINT), kmers + {S.k - 1}) AS letters, mn AS minimizer FROM gk_spans JOIN genomes USING (header)")
def seq_supermers_letters(spark, sf):
    """Super-mers with their letters, packed by the kernel and unpacked here."""
    t = minimizers.supermers_with_letters(fx.genomes(spark, sf), S)
    return t.select("header", "location", alphabet.unpacked(F.col("letters"), F.col("kmers") + (S.k - 1)).alias("letters"), "minimizer")


@query("SELECT word, count(*) AS n FROM (SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS word FROM (SELECT substr(nt, pos, 45) AS w FROM (SELECT nt, unnest(range(1, length(nt) - 43)) AS pos FROM genomes))) GROUP BY word")
def seq_kmer_counts_wide(spark, sf):
    """k-mers of over 31 letters."""
    return kmer_tables.counts(fx.genomes(spark, sf), 45)


@query("SELECT DISTINCT w AS word, reverse(translate(w, 'ACGT', 'TGCA')) AS other FROM (SELECT substr(nt, pos, 23) AS w FROM (SELECT nt, unnest(range(1, length(nt) - 21)) AS pos FROM genomes))")
def seq_code_revcomp(spark, sf):
    """Reverse complements of words as codes."""
    t = _words(spark, sf, 23).select("code").distinct()
    return t.select(alphabet.decode(F.col("code"), 23).alias("word"), alphabet.decode(alphabet.reverse_complement_code(F.col("code"), 23), 23).alias("other"))


@query("SELECT header, CAST(pos AS BIGINT) AS pos, motif FROM (SELECT header, pos, substr(nt, pos, 31) AS motif FROM (SELECT header, nt, unnest(range(1, length(nt) - 29)) AS pos FROM genomes))")
def seq_motif_roundtrip(spark, sf):
    """Words through the priority and back: code and decode, toggled twice."""
    plain = Scheme(S.k, S.m, 0, canonical=False)
    return _words(spark, sf).select("header", F.col("pos").cast("bigint").alias("pos"), alphabet.motif(alphabet.code_priority(F.col("code"), plain), plain).alias("motif"))


@query("SELECT title, ordinal, flag, is_distinct, kmers, minimizer FROM spans")
def seq_spans(spark, sf):
    return minimizers.spans(fx.reads(spark, sf), S)


@query(f"""SELECT title, CAST(row_number() OVER (PARTITION BY title ORDER BY side, location) - 1 AS INTEGER) AS ordinal, flag, CAST(kmers AS INTEGER) AS kmers,
    flag = 1 AND coalesce(lag(mn) OVER (PARTITION BY title, flag ORDER BY side, location) <> mn, true) AS is_distinct, mn AS minimizer FROM (
    SELECT title, 0 AS side, location, flag, kmers, mn FROM rspans UNION ALL SELECT header, 1, 0, 3, {1 - S.k}, NULL FROM reads UNION ALL SELECT header, 2, location, 1, kmers, mn FROM mk_spans)""", kmers("mk", "(SELECT header, nt2 AS nt FROM reads)"))
def seq_spans_paired(spark, sf):
    return minimizers.spans(fx.reads(spark, sf, paired=True), S)


@query("/*plain*/ SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[ACGTUacgtu\\n\\r]+'), lambda x: length(x))), 0) AS BIGINT) AS letters, CAST(len(regexp_extract_all(text, '[ACGTUacgtu\\n\\r]*[ACGTUacgtu][ACGTUacgtu\\n\\r]*')) AS BIGINT) AS stretches FROM documents")
def seq_ambiguity_split(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("header"), F.lit(1).cast("bigint").alias("location"), F.col("text").alias("nucleotides"))
    runs = F.regexp_extract_all("nucleotides", F.lit("[ACGTUacgtu\n\r]+"), F.lit(0))
    letters = d.select(F.col("header").alias("doc_id"), F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("letters"), F.size(F.filter(runs, lambda x: x.rlike("[ACGTUacgtu]"))).cast("bigint").alias("stretches"))
    return letters


@query("SELECT header, p AS location, substr(nt, p + 1, 120) AS nucleotides FROM (SELECT header, nt, CAST(unnest(range(0, length(nt) - 35 + 1, 120 - 34)) AS BIGINT) AS p FROM genomes)")
def seq_fragment_split(spark, sf):
    return bracken.fragments(fx.genomes(spark, sf).select("header", "nucleotides"), 35, 120)


@query("SELECT header, count(DISTINCT mn) AS n FROM gk_spans GROUP BY header")
def seq_distinct_minimizers(spark, sf):
    return minimizers.tagged_minimizers(fx.genomes(spark, sf), "header", S).groupBy("header").agg(F.count_distinct("minimizer").alias("n"))


# Sources

@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides FROM genomes")
def src_fasta_parse(spark, sf):
    """Genomes as FASTA records of several lines, parsed again."""
    g = fx.genomes(spark, sf)
    lines = F.concat_ws("\n", F.concat("header", F.lit(" a description")), F.substr("nucleotides", F.lit(1), F.lit(100)), F.substr("nucleotides", F.lit(101)), F.lit(""))
    return sequences.parse_fasta(g.select(lines.alias("value")))


@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides FROM reads")
def src_fastq_parse(spark, sf):
    """Reads as FASTQ lines, parsed again; files are the headers' first two letters."""
    r = fx.reads(spark, sf)
    lines = F.array(F.concat(F.lit("@"), "header", F.lit(" x")), F.col("nucleotides"), F.lit("+"), F.repeat(F.lit("I"), F.length("nucleotides")))
    t = r.select(F.substr("header", F.lit(1), F.lit(2)).alias("file"), F.substr("header", F.instr("header", "R") + 1).cast("bigint").alias("o"), F.posexplode(lines).alias("i", "value"))
    return sequences.parse_fastq(t.select("file", (F.col("o") * 4 + F.col("i")).alias("at"), "value"), "file", "at")


@query("SELECT header, CAST(1 AS BIGINT) AS location, nt AS nucleotides, nt2 AS nucleotides2 FROM reads")
def src_paired_join(spark, sf):
    r = fx.reads(spark, sf, paired=True)
    one = r.select(F.concat("header", F.lit("/1")).alias("header"), "location", "nucleotides")
    two = r.select(F.concat("header", F.lit("/2")).alias("header"), F.col("nucleotides2").alias("nucleotides"))
    return sequences.paired(one, two)


@query("SELECT header, CAST(1 + len(pre) AS BIGINT) AS location, part AS nucleotides FROM (SELECT header, nt, part, substr(nt, 1, instr(nt, part) - 1) AS pre FROM (SELECT header, nt, unnest(regexp_extract_all(nt, '[ACGT]+')) AS part FROM reads))")
def src_remove_invalid(spark, sf):
    return sequences.without_ambiguous(fx.reads(spark, sf).select("header", "location", "nucleotides"))


@query(f"SELECT header, nt AS nucleotides FROM genomes UNION ALL SELECT header, {revcomp('nt')} FROM genomes")
def src_add_rc(spark, sf):
    return sequences.with_reverse_complements(fx.genomes(spark, sf)).select("header", "nucleotides")


@query("SELECT header FROM reads UNION SELECT header FROM genomes")
def src_titles_union(spark, sf):
    return sequences.titles(fx.reads(spark, sf).select("header").unionByName(fx.genomes(spark, sf).select("header")))


FAI = "(SELECT 'q' || p_partkey AS id, CAST(200 + p_partkey % 977 AS BIGINT) AS length, CAST(10 + p_partkey * 7 AS BIGINT) AS start, CAST(60 AS BIGINT) AS lb, CAST(61 AS BIGINT) AS lw FROM part)"


def _fai(spark, sf):
    return fx.table(spark, sf, "part").select(F.concat(F.lit("q"), "p_partkey").alias("id"), (200 + F.col("p_partkey") % 977).alias("length"), (10 + F.col("p_partkey") * 7).alias("start"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_bytes"))


@query(f"SELECT id, start + length // lb * lw + length % lb - 1 AS last_byte, (500 // lw) * lb + least(500 % lw, lb) + 1 AS position FROM {FAI}")
def src_fai_offsets(spark, sf):
    c = [F.col(x) for x in ("start", "line_bases", "line_bytes")]
    return _fai(spark, sf).select("id", sequences.index_end(F.col("length"), *c).cast("bigint").alias("last_byte"), sequences.position_of_offset(F.col("start") + 500, *c).alias("position"))


@query(f"""SELECT id, p + 1 AS location, least(length, p + 334) - p AS bases, start + p // lb * lw + p % lb AS first_byte FROM (SELECT *, CAST(unnest(range(0, greatest(0, length - 35) + 1, 300)) AS BIGINT) AS p FROM {FAI})""")
def src_fai_chunks(spark, sf):
    return sequences.indexed_chunks(_fai(spark, sf), 35, 300).select("id", "location", "bases", "first_byte")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(100 + p_partkey AS INTEGER) WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS INTEGER) END AS taxon, CASE WHEN p_partkey % 3 = 2 THEN 'NC_' || (1000 + p_partkey) END AS accession FROM part")
def prep_header_taxid(spark, sf):
    k = F.col("p_partkey")
    header = F.when(k % 3 == 0, F.concat(F.lit("x|kraken:taxid|"), 100 + k, F.lit("|y"))).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("NC_"), 1000 + k, F.lit(".1")))
    t = fx.table(spark, sf, "part").select(k.alias("id"), header.alias("h"))
    taxon = sequences.header_taxon(F.col("h"))
    return t.select("id", taxon.alias("taxon"), F.when(taxon.isNull(), sequences.header_accession(F.col("h"))).alias("accession"))


@query("/*plain*/ SELECT 'A' || (c_custkey % 701) AS accession, CAST(arg_min(c_nationkey, c_custkey) AS INTEGER) AS taxon FROM customer GROUP BY 1")
def prep_accession_lookup(spark, sf):
    tables = fx.table(spark, sf, "customer").select(F.concat(F.lit("A"), F.col("c_custkey") % 701).alias("accession"), F.col("c_nationkey").alias("taxon"), F.col("c_custkey").alias("place"))
    wanted = tables.select("accession").unionByName(spark.createDataFrame([("none",)], "accession string"))
    return sequences.accession_taxa(wanted, tables)[0]


@query("""/*plain*/ WITH a AS (SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS taxon, CASE WHEN p_partkey % 11 = 0 THEN 'Complete Genome' WHEN p_partkey % 13 = 0 THEN 'Chromosome' ELSE 'Contig' END AS level FROM part)
    SELECT * FROM a WHERE level <> 'Contig' OR taxon NOT IN (SELECT taxon FROM a WHERE level <> 'Contig')""")
def prep_prefer_complete(spark, sf):
    k = F.col("p_partkey")
    level = F.when(k % 11 == 0, "Complete Genome").when(k % 13 == 0, "Chromosome").otherwise("Contig")
    return compare.prefer_complete(fx.table(spark, sf, "part").select(k.alias("id"), F.col("p_size").alias("taxon"), level.alias("level")))


# The index

@query("SELECT id1, taxon FROM idx")
def idx_build(spark, sf):
    return fx.index(spark, sf).records


@query("SELECT taxon, count(*) AS n FROM idx GROUP BY taxon")
def idx_counts_per_taxon(spark, sf):
    return fx.index(spark, sf).counts_per_taxon()


WIDER = Scheme(S.k, S.m, 11)


@query(f"""SELECT mn & {WIDER.space_mask} AS id1, CAST(CASE WHEN min(tax) = max(tax) THEN min(tax) WHEN min(spe) = max(spe) THEN min(spe) WHEN min(gen) = max(gen) THEN min(gen) WHEN min(fam) = max(fam) THEN min(fam) ELSE 1 END AS INTEGER) AS taxon FROM gmin GROUP BY 1""")
def idx_respace(spark, sf):
    return fx.index(spark, sf).respace(11).records


@query("SELECT depth, count(*) AS n FROM idx JOIN tree USING (taxon) GROUP BY depth")
def idx_depth_histogram(spark, sf):
    return fx.index(spark, sf).depth_histogram()


@query("SELECT depth, count(DISTINCT taxon) AS n FROM idx JOIN tree USING (taxon) GROUP BY depth")
def idx_taxon_depth_histogram(spark, sf):
    return fx.index(spark, sf).taxon_depth_histogram()


@query("SELECT tax AS taxon, count(DISTINCT mn) AS n FROM gmin GROUP BY tax")
def idx_distinct_minimizers(spark, sf):
    return fx.index(spark, sf).distinct_per_taxon(fx.genomes(spark, sf), fx.labels(spark, sf))


@query("""SELECT (SELECT count(DISTINCT taxon) FROM idx) AS taxa, (SELECT count(DISTINCT taxon) FROM idx WHERE taxon >= 10000) AS leaf_taxa, (SELECT count(*) FROM idx) AS minimizers,
    (SELECT count(*) FROM idx WHERE taxon >= 10000) AS leaf_minimizers, (SELECT count(DISTINCT a) FROM idx JOIN anc USING (taxon)) AS tree_size""")
def idx_stats(spark, sf):
    return fx.index(spark, sf).stats()


@query("""SELECT tax AS taxon, count(*) AS total, count(*) FILTER (i.taxon = tax) AS own, count(*) FILTER (i.taxon = tax) / CAST(count(*) AS DOUBLE) AS fraction FROM gmin JOIN idx i ON i.id1 = mn GROUP BY tax""")
def idx_coverage_leaf(spark, sf):
    return fx.index(spark, sf).leaf_coverage(fx.genomes(spark, sf), fx.labels(spark, sf))


@query("""SELECT taxon, string_agg(depth || ':' || n, '|' ORDER BY depth) AS coverage, string_agg(depth || ':' || d, '|' ORDER BY depth) AS distinct_coverage FROM (
    SELECT tax AS taxon, t.depth, count(*) AS n, count(DISTINCT mn) AS d FROM gmin JOIN idx i ON i.id1 = mn JOIN tree t ON t.taxon = i.taxon GROUP BY tax, t.depth) GROUP BY taxon""")
def idx_coverage_full(spark, sf):
    return fx.index(spark, sf).full_coverage(fx.genomes(spark, sf), fx.labels(spark, sf))


@query("SELECT tax AS taxon, CAST(sum(kmers) AS BIGINT) AS size FROM gmin GROUP BY tax")
def idx_genome_sizes(spark, sf):
    return fx.index(spark, sf).genome_sizes(fx.genomes(spark, sf), fx.labels(spark, sf))


@query(f"SELECT header FROM reads WHERE NOT regexp_matches(nt, '[ACGT]{{{S.k}}}')")
def idx_no_minimizers(spark, sf):
    return fx.index(spark, sf).without_minimizers(fx.reads(spark, sf))


@query("SELECT taxon FROM parts p JOIN (SELECT tax AS taxon FROM parts) ON taxon = p.tax WHERE tax NOT IN (SELECT taxon FROM idx)")
def idx_missing_taxa(spark, sf):
    return fx.index(spark, sf).missing_taxa(fx.labels(spark, sf))


# half of the genomes
HALF = "half AS (SELECT * FROM gmin WHERE tax % 2 = 0)"


@query("""SELECT CAST(a.depth - b.depth AS INTEGER) AS steps, count(*) AS n FROM (SELECT mn AS id1, CASE WHEN min(tax) = max(tax) THEN min(tax) WHEN min(spe) = max(spe) THEN min(spe) WHEN min(gen) = max(gen) THEN min(gen) WHEN min(fam) = max(fam) THEN min(fam) ELSE 1 END AS taxon FROM gmin WHERE tax % 2 = 0 GROUP BY mn) h
    JOIN idx USING (id1) JOIN tree a ON a.taxon = h.taxon JOIN tree b ON b.taxon = idx.taxon GROUP BY 1""")
def idx_migration(spark, sf):
    """How taxa of minimizers move when the other half of the genomes is added."""
    from ..operators.index import MinimizerIndex

    half = MinimizerIndex.build(fx.genomes(spark, sf), fx.labels(spark, sf).where("taxon % 2 = 0"), fx.taxonomy(spark, sf), S)
    return half.migration(fx.index(spark, sf)).groupBy("steps").agg(F.count(F.lit(1)).alias("n"))


# Masking

#: A repeat of one to four letters, in the middle of other ones.
REPEATED = "translate(md5('c' || c_custkey), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""WITH s AS (SELECT c_custkey AS k, substr(g, 1, 16) || CASE WHEN c_custkey % 9 = 0 THEN 'N' ELSE '' END || repeat(substr(g, 20, CAST(1 + c_custkey % 4 AS INTEGER)), CAST(c_custkey % 19 AS INTEGER)) || substr(g, 17) AS nt
        FROM (SELECT c_custkey, {REPEATED} AS g FROM customer)),
    t AS (SELECT k, nt, list_transform(range(1, length(nt) - 1), lambda i: substr(nt, i, 3)) AS t FROM s),
    ends AS (SELECT k, a, unnest(range(a + 1, least(len(t), a + 61) + 1)) AS b, t FROM (SELECT k, t, unnest(range(1, len(t) + 1)) AS a FROM t)),
    found AS (SELECT k, a, b, sum(len(list_filter(t[a : b - 1], lambda x: x = t[b])) ) OVER w AS pairs, max(CASE WHEN contains(t[a], 'N') OR contains(t[b], 'N') THEN 1 ELSE 0 END) OVER w AS unsound
        FROM ends WINDOW w AS (PARTITION BY k, a ORDER BY b)),
    high AS (SELECT k, a, b, pairs / (b - a) AS score FROM found WHERE unsound = 0 AND pairs > 2 * (b - a)),
    perfect AS (SELECT DISTINCT k, a, b FROM high AS h WHERE NOT EXISTS (SELECT 1 FROM high AS o WHERE o.k = h.k AND o.a >= h.a AND o.b <= h.b AND o.score > h.score)),
    covered AS (SELECT DISTINCT k, unnest(range(a, b + 3)) AS i FROM perfect),
    letters AS (SELECT k, nt, unnest(range(1, length(nt) + 1)) AS i FROM s)
    SELECT 'C' || k AS header, string_agg(CASE WHEN c.i IS NULL THEN substr(nt, l.i, 1) ELSE 'x' END, '' ORDER BY l.i) AS nucleotides FROM letters AS l LEFT JOIN covered AS c USING (k, i) GROUP BY k""")
def seq_mask_low_complexity(spark, sf):
    c, g = F.col("c_custkey"), fx.segment(F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    t = fx.table(spark, sf, "customer").select(F.concat(F.lit("C"), c).alias("header"), c, g.alias("g"))
    inner = F.repeat(F.substr("g", F.lit(20), (1 + c % 4).cast("int")), (c % 19).cast("int"))
    whole = F.concat(F.substr("g", F.lit(1), F.lit(16)), F.when(c % 9 == 0, "N").otherwise(""), inner, F.substr("g", F.lit(17)))
    return masking.masked(t.select("header", whole.alias("nucleotides")))


# Classification

def _hits(spark, sf):
    return classify.find_hits(minimizers.spans(fx.reads(spark, sf), S), fx.index(spark, sf))


@query("SELECT title, ordinal, is_distinct, taxon, count FROM hits")
def cls_hits(spark, sf):
    return _hits(spark, sf)


@query("SELECT title, string_agg(taxon || ':' || count, ' ' ORDER BY ordinal) AS hits, count(*) FILTER (is_distinct AND taxon <> 0) AS n_distinct FROM hits GROUP BY title")
def cls_grouped_hits(spark, sf):
    g = classify.group_hits(_hits(spark, sf))
    return g.select("title", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["taxon"], h["count"])), " ").alias("hits"), "n_distinct")


# neighbours of one taxon put together
RUNS = {
    "runs": "SELECT title, min(ordinal) AS ordinal, taxon, sum(count) AS count FROM (SELECT *, sum(f) OVER (PARTITION BY title ORDER BY ordinal) AS g FROM (SELECT *, CASE WHEN lag(taxon) OVER (PARTITION BY title ORDER BY ordinal) = taxon THEN 0 ELSE 1 END AS f FROM hits)) GROUP BY title, g, taxon"
}
DETAILS = "SELECT title, string_agg(CASE WHEN taxon = -1 THEN 'A' ELSE CAST(taxon AS VARCHAR) END || ':' || count, ' ' ORDER BY ordinal) AS details"


@query("SELECT c.title, c.taxon <> 0 AS classified, c.taxon, CAST(r.total + 34 AS VARCHAR) AS length, d.details FROM cls c JOIN per_read r USING (title) JOIN dets d USING (title)", resolved(0.0) | RUNS | {"dets": f"{DETAILS} FROM runs GROUP BY title"})
def cls_per_read(spark, sf):
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf))
    return t.select("title", "classified", "taxon", "length", "details")


@query(f"{DETAILS} FROM runs GROUP BY title", RUNS)
def cls_hit_details(spark, sf):
    g = classify.group_hits(_hits(spark, sf))
    return g.select("title", classify.details(classify.merged_hits(F.col("hits"))).alias("details"))


# letters of a stretch give its length less k - 1 k-mers; a first stretch of N that is long enough counts as many
KMERS = f"list_sum(list_transform(string_split({{0}}, 'N'), lambda x: greatest(0, length(x) - {S.k - 1}))) + greatest(0, length(regexp_extract({{0}}, '^N+')) - {S.k - 1})"


@query(f"SELECT header AS title, (CAST({KMERS.format('nt')} AS BIGINT) + {S.k - 1}) || '|' || (CAST({KMERS.format('nt2')} AS BIGINT) + {S.k - 1}) AS length FROM reads")
def cls_length_string_paired(spark, sf):
    return classify.read_lengths(fx.reads(spark, sf, paired=True), S)


@query("SELECT taxon, count(*) AS n FROM cls GROUP BY taxon", resolved(0.15))
def cls_report_only(spark, sf):
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.15], with_details=False)
    return t.groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT threshold, taxon, count(*) AS n FROM (SELECT CAST(0.0 AS DOUBLE) AS threshold, taxon FROM c0 UNION ALL SELECT CAST(0.15 AS DOUBLE), taxon FROM c1 UNION ALL SELECT CAST(0.5 AS DOUBLE), taxon FROM c2) GROUP BY threshold, taxon", resolved(0.0, "c0") | resolved(0.15, "c1") | resolved(0.5, "c2"))
def cls_multi_threshold(spark, sf):
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.0, 0.15, 0.5], with_details=False)
    return t.groupBy("threshold", "taxon").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN title LIKE 'S3%' THEN 'other' ELSE substr(title, 1, 2) END AS sample, taxon, count(*) AS n FROM cls GROUP BY 1, 2", resolved(0.15))
def cls_multi_sample(spark, sf):
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.15], sample_regex="(S[0-2])", with_details=False)
    return t.groupBy("sample", "taxon").agg(F.count(F.lit(1)).alias("n"))


# Reports

@query("SELECT taxon, clade, own FROM nclade")
def rpt_clade_totals(spark, sf):
    return report.clade_totals(fx.order_counts(spark, sf), fx.nation_taxonomy(spark, sf))


@query("""SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS line, CASE WHEN tot > 0 THEN round(100.0 * clade / tot, 2) ELSE 0 END AS percent, clade, own, rank, taxon, name FROM (
    SELECT x.taxon, x.clade, x.own, string_agg(printf('%020d%020d', 1000000000 - y.clade, 1000000000 - y.taxon), '.' ORDER BY c.steps DESC) AS key, ['R', 'D', '', '', '', '', '', 'G', 'S'][n.depth + 1] AS rank,
           repeat('  ', CAST(max(c.steps) AS INTEGER)) || n.name AS name, (SELECT sum(n) FROM ncounts) AS tot
    FROM nclade x JOIN nanc c ON c.taxon = x.taxon JOIN nclade y ON y.taxon = c.a JOIN nnodes n ON n.taxon = x.taxon GROUP BY x.taxon, x.clade, x.own, n.depth, n.name
    UNION ALL SELECT taxon, clade, own, '', 'U', '', (SELECT sum(n) FROM ncounts) FROM nclade WHERE taxon = 0)""")
def rpt_nation_rows(spark, sf):
    return report.report_rows(fx.order_counts(spark, sf), fx.nation_taxonomy(spark, sf))


@query("""SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS line, CASE WHEN tot > 0 THEN round(100.0 * clade / tot, 2) ELSE 0 END AS percent, clade, own, rank, taxon, name FROM (
    SELECT x.taxon, x.clade, x.own, string_agg(printf('%020d%020d', 1000000000 - y.clade, 1000000000 - y.taxon), '.' ORDER BY t.level) AS key,
           ['R', 'D', '', '', '', '', 'F', 'G', 'S'][n.depth + 1] || CASE WHEN n.rank IS NULL THEN '1' ELSE '' END AS rank, repeat('  ', n.level) || n.name AS name, (SELECT count(*) FROM cls) AS tot
    FROM clade x JOIN anc c ON c.taxon = x.taxon JOIN clade y ON y.taxon = c.a JOIN tree n ON n.taxon = x.taxon JOIN tree t ON t.taxon = c.a GROUP BY x.taxon, x.clade, x.own, n.depth, n.name, n.rank, n.level
    UNION ALL SELECT 0, count(*), count(*), '', 'U', '', (SELECT count(*) FROM cls) FROM cls WHERE taxon = 0 HAVING count(*) > 0)""", resolved(0.15) | {
    "clade": "SELECT a AS taxon, count(*) AS clade, count(*) FILTER (a = c.taxon) AS own FROM cls c JOIN anc USING (taxon) GROUP BY a"})
def rpt_kraken_rows(spark, sf):
    """The flagship: genomes to an index, reads to taxa, taxa to a report."""
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.15], with_details=False)
    return report.report_rows(t.groupBy("taxon").agg(F.count(F.lit(1)).alias("n")), fx.taxonomy(spark, sf))


@query("""SELECT n.taxon, s1, CASE WHEN k IS NOT NULL THEN ks / kz ELSE s1 END AS s2, CASE WHEN k IS NOT NULL THEN (s1 * below + ks / kz * kz) / (below + kz) ELSE s1 END AS s3 FROM nodes n
    JOIN (SELECT a AS taxon, sum(size) / CAST(count(*) AS DOUBLE) AS s1, count(*) AS below FROM sizes JOIN anc USING (taxon) GROUP BY a) USING (taxon)
    LEFT JOIN (SELECT parent AS taxon, count(*) AS k, count(*) AS kz, sum(s1) AS ks FROM nodes JOIN (SELECT a AS taxon, sum(size) / CAST(count(*) AS DOUBLE) AS s1 FROM sizes JOIN anc USING (taxon) GROUP BY a) USING (taxon) GROUP BY parent) USING (taxon)""",
    {"sizes": "SELECT CAST(c_custkey % (SELECT count(*) FROM part) + 10000 AS INTEGER) AS taxon, sum(c_custkey % 100 + 1) AS size FROM customer GROUP BY 1"})
def rpt_tkc(spark, sf):
    n = fx.table(spark, sf, "part").count()
    sizes = fx.table(spark, sf, "customer").select((F.col("c_custkey") % n + 10000).cast("int").alias("taxon"), (F.col("c_custkey") % 100 + 1).alias("size"))
    t = report.kmer_averages(sizes, fx.taxonomy(spark, sf)).where("s1 is not null")
    return t.select("taxon", "s1", "s2", "s3")


@query(f"""SELECT t.taxon, c.clade, c.own, CAST(round(t.s1) AS BIGINT) AS s1, CAST(round(t.s2) AS BIGINT) AS s2, CAST(round(t.s3) AS BIGINT) AS s3 FROM ({ORACLE["rpt_tkc"]}) t JOIN (
    SELECT x.a AS taxon, CAST(sum(z.size) AS BIGINT) AS clade, CAST(sum(CASE WHEN z.taxon = x.a THEN z.size ELSE 0 END) AS BIGINT) AS own
    FROM (SELECT CAST(c_custkey % (SELECT count(*) FROM part) + 10000 AS INTEGER) AS taxon, c_custkey % 100 + 1 AS size FROM customer) z JOIN anc x ON x.taxon = z.taxon GROUP BY x.a) c ON c.taxon = t.taxon""")
def rpt_averages(spark, sf):
    """The report of sizes with average sizes of the genomes below each node."""
    n = fx.table(spark, sf, "part").count()
    sizes = fx.table(spark, sf, "customer").select((F.col("c_custkey") % n + 10000).cast("int").alias("taxon"), (F.col("c_custkey") % 100 + 1).alias("size"))
    t = report.averages_report(sizes.withColumnRenamed("size", "n"), sizes, fx.taxonomy(spark, sf))
    return t.select("taxon", "clade", "own", "s1", "s2", "s3")


LABELLED = {"lab": "SELECT DISTINCT CAST(CASE WHEN s_suppkey % 3 = 0 THEN 100 + s_suppkey % 25 WHEN s_suppkey % 3 = 1 THEN 10000 + s_suppkey ELSE 70000 + s_suppkey END AS INTEGER) AS taxon FROM supplier"}


def _labelled(spark, sf):
    k = F.col("s_suppkey")
    return fx.table(spark, sf, "supplier").select(F.when(k % 3 == 0, 100 + k % 25).when(k % 3 == 1, 10000 + k).otherwise(70000 + k).cast("int").alias("taxon")).distinct()


@query("""SELECT (SELECT count(*) FROM lab WHERE taxon NOT IN (SELECT taxon FROM nodes)) AS unknown, (SELECT count(*) FROM lab WHERE taxon IN (SELECT parent FROM nodes)) AS inner_taxa, (SELECT count(*) FROM lab WHERE taxon IN (SELECT taxon FROM nodes)) AS valid,
    (SELECT count(DISTINCT a) FROM lab JOIN anc USING (taxon)) AS tree_size""", LABELLED)
def rpt_label_stats(spark, sf):
    return report.label_stats(_labelled(spark, sf), fx.taxonomy(spark, sf))


@query("SELECT CAST(level AS INTEGER) AS level, count(*) AS n FROM (SELECT taxon, unnest(range(1, 9)) AS level FROM lab JOIN nodes USING (taxon)) x WHERE NOT EXISTS (SELECT 1 FROM anc JOIN tree t ON t.taxon = a WHERE anc.taxon = x.taxon AND t.depth = x.level) GROUP BY level", LABELLED)
def rpt_label_levels(spark, sf):
    return report.label_levels(_labelled(spark, sf), fx.taxonomy(spark, sf))


@query("SELECT CAST(x.a AS INTEGER) AS taxon, count(*) AS clade, count(*) FILTER (c.taxon = x.a) AS own FROM cls c JOIN anc x USING (taxon) WHERE x.a IN (SELECT taxon FROM anc WHERE a = 12) AND x.a IN (SELECT taxon FROM tree WHERE depth <= 7) GROUP BY x.a", resolved(0.15))
def rpt_filtered(spark, sf):
    """The report of one family, down to genus."""
    t = classify.classify(fx.reads(spark, sf), fx.index(spark, sf), [0.15], with_details=False)
    rows = report.report_rows(t.groupBy("taxon").agg(F.count(F.lit(1)).alias("n")), fx.taxonomy(spark, sf))
    return report.filtered(rows, fx.taxonomy(spark, sf), DEPTH["genus"], 0.0, 12).select("taxon", "clade", "own")


# Two steps

SUPPORT = "SELECT taxon, sum(count) AS kmers, count(DISTINCT minimizer) AS d, count(*) AS h FROM hits JOIN tree USING (taxon) WHERE depth >= 8 GROUP BY taxon"


@query("SELECT taxon, CAST(kmers AS BIGINT) AS kmers, d AS distinct_minimizers, h AS hits FROM sup", {"sup": SUPPORT})
def dyn_support(spark, sf):
    return dynamic.support(fx.reads(spark, sf), fx.index(spark, sf))


@query("SELECT taxon, CAST(kmers AS BIGINT) AS kmers, d AS distinct_minimizers, h AS hits, n AS in_index, d / CAST(n AS DOUBLE) AS fraction FROM sup JOIN (SELECT taxon, count(*) AS n FROM idx GROUP BY taxon) USING (taxon)", {"sup": SUPPORT})
def dyn_support_fraction(spark, sf):
    return dynamic.support_report(fx.reads(spark, sf), fx.index(spark, sf))


LEAST = 5
DETECTED = resolved(0.15) | {
    "found": "SELECT taxon, count(*) AS n FROM cls WHERE taxon > 0 GROUP BY taxon",
    "keep": f"SELECT x.taxon FROM found x JOIN tree USING (taxon) WHERE depth >= 8 AND (SELECT sum(f.n) FROM found f JOIN anc c ON c.taxon = f.taxon WHERE c.a = x.taxon) >= {LEAST}",
}
READS = dynamic.Criterion("reads", LEAST, 0.15)


@query("SELECT DISTINCT c.taxon FROM keep k JOIN anc c ON c.a = k.taxon", DETECTED)
def dyn_taxon_set(spark, sf):
    return dynamic.taxon_set(fx.reads(spark, sf), fx.index(spark, sf), READS)


GOLD = {
    "gold": "SELECT DISTINCT CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1000 + (s_suppkey % 25) * 10 + 1 ELSE 10000 + s_suppkey * 3 END AS INTEGER) AS taxon FROM supplier",
    "lib": "SELECT DISTINCT a AS taxon FROM parts JOIN anc ON anc.taxon = tax WHERE tax % 3 = 0",
    "promoted": "SELECT DISTINCT arg_min(a, steps) AS taxon FROM gold g JOIN anc USING (taxon) JOIN lib l ON l.taxon = a WHERE g.taxon NOT IN (SELECT taxon FROM lib) GROUP BY g.taxon",
}


def _gold(spark, sf):
    k = F.col("s_suppkey")
    gold = fx.table(spark, sf, "supplier").select(F.when(k % 4 == 0, 1000 + (k % 25) * 10 + 1).otherwise(10000 + k * 3).cast("int").alias("taxon")).distinct()
    return gold, fx.labels(spark, sf).where("taxon % 3 = 0")


@query("SELECT taxon FROM (SELECT taxon FROM gold UNION SELECT taxon FROM promoted) JOIN tree USING (taxon) WHERE depth >= 8 UNION SELECT taxon FROM promoted JOIN tree USING (taxon) WHERE depth >= 7", GOLD)
def dyn_gold_promote(spark, sf):
    gold, lab = _gold(spark, sf)
    return dynamic.gold_set(gold, lab, fx.taxonomy(spark, sf), promote="genus")


@query("SELECT tp AS true_pos, fp AS false_pos, fn AS false_neg, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS \"precision\", CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall FROM (SELECT count(*) FILTER (f + g = 2) AS tp, count(*) FILTER (g = 0) AS fp, count(*) FILTER (f = 0) AS fn FROM (SELECT taxon, max(f) AS f, max(g) AS g FROM (SELECT taxon, 1 AS f, 0 AS g FROM found UNION ALL SELECT truth, 0, 1 FROM reads) WHERE taxon >= 1000 GROUP BY taxon))", DETECTED)
def dyn_gold_metrics(spark, sf):
    found = dynamic.counts(fx.reads(spark, sf), fx.index(spark, sf), READS).where("taxon >= 1000")
    return dynamic.set_metrics(found, fx.reads(spark, sf).select(F.col("truth").alias("taxon")))


@query("""SELECT mn AS id1, CAST(CASE WHEN min(tax) = max(tax) THEN min(tax) WHEN min(spe) = max(spe) THEN min(spe) WHEN min(gen) = max(gen) THEN min(gen) WHEN min(fam) = max(fam) THEN min(fam) ELSE 1 END AS INTEGER) AS taxon
    FROM gmin WHERE tax IN (SELECT c.taxon FROM keep k JOIN anc c ON c.a = k.taxon) GROUP BY mn""", DETECTED)
def dyn_index(spark, sf):
    base = fx.index(spark, sf)
    taxa = dynamic.taxon_set(fx.reads(spark, sf), base, READS)
    return dynamic.dynamic_index(fx.genomes(spark, sf), fx.labels(spark, sf), base, taxa).records


# the second classification: the same expressions over the second index
SECOND = {
    "idx2": "SELECT mn AS id1, CAST(CASE WHEN min(tax) = max(tax) THEN min(tax) WHEN min(spe) = max(spe) THEN min(spe) WHEN min(gen) = max(gen) THEN min(gen) WHEN min(fam) = max(fam) THEN min(fam) ELSE 1 END AS INTEGER) AS taxon FROM gmin WHERE tax IN (SELECT c.taxon FROM keep k JOIN anc c ON c.a = k.taxon) GROUP BY mn",
    **renamed(("hits", "per_read", "per_taxon", "scores", "tops", "lcas", "lifts"), resolved(0.15), "2", idx="idx2"),
}


@query("SELECT taxon, count(*) AS n FROM cls2 GROUP BY taxon", DETECTED | SECOND)
def dyn_classify(spark, sf):
    t = dynamic.two_step(fx.reads(spark, sf), fx.genomes(spark, sf), fx.labels(spark, sf), fx.index(spark, sf), READS, thresholds=[0.15], with_details=False)
    return t.groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


# Weights

# every window of 40 letters of every genome as a read
WINDOWS = renamed(
    ("rk_w", "rk_p", "rk", "rk_g", "rk_spans", "rspans", "spans", "hits", "per_read", "per_taxon", "scores", "tops", "lcas", "lifts"), resolved(0.0), "w", reads="windows"
) | {"windows": "SELECT taxon || ':' || p AS header, substr(nt, p, 40) AS nt FROM (SELECT taxon, nt, unnest(range(1, length(nt) - 38)) AS p FROM genomes)"}


@query("SELECT taxon AS dest, CAST(split_part(title, ':', 1) AS INTEGER) AS source, count(*) AS n FROM clsw GROUP BY 1, 2", WINDOWS)
def brk_short_reads(spark, sf):
    return bracken.weights(fx.genomes(spark, sf), fx.labels(spark, sf), fx.index(spark, sf), 40)


# windows of 100 letters by the spans that they overlap; those of a genome with equal k-mers by taxon are resolved once
LONG = {
    "ospans": "SELECT g.taxon AS source, s.location AS a, s.location + s.kmers AS z, i.taxon FROM gk_spans s JOIN genomes g USING (header) JOIN idx i ON i.id1 = s.mn",
    "owindows": f"SELECT source, p, taxon, CAST(sum(least(z, p + {101 - S.k}) - greatest(a, p)) AS BIGINT) AS n, count(*) AS groups FROM (SELECT *, unnest(range(greatest(0, a - {100 - S.k}), least(z, {fx.GENOME - 99}))) AS p FROM ospans) GROUP BY source, p, taxon",
    "okinds": "SELECT source, s, ok, count(*) AS times, row_number() OVER () AS title FROM (SELECT source, p, list({'taxon': taxon, 'n': n} ORDER BY taxon) AS s, sum(groups) >= 2 AS ok FROM owindows GROUP BY source, p) GROUP BY source, s, ok",
    **renamed(("scores", "tops", "lcas"), {"per_taxon": "SELECT title, x.taxon AS taxon, x.n AS n FROM (SELECT title, unnest(s) AS x FROM okinds WHERE ok)"}, "o"),
    "oweights": "SELECT CAST(coalesce(l.taxon, 0) AS INTEGER) AS dest, source, CAST(sum(times) AS BIGINT) AS n FROM okinds LEFT JOIN lcaso l USING (title) GROUP BY 1, 2",
}


@query("SELECT dest, source, n FROM oweights", LONG)
def brk_source_dest(spark, sf):
    return bracken.weights(fx.genomes(spark, sf), fx.labels(spark, sf), fx.index(spark, sf), 100)


@query("""SELECT dest, dest || chr(9) || string_agg(source || ':' || n || ':' || total, ' ' ORDER BY source) AS line
    FROM oweights JOIN (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM oweights GROUP BY source) USING (source) WHERE dest <> 0 GROUP BY dest""", LONG)
def brk_distrib_lines(spark, sf):
    return bracken.distribution_lines(bracken.weights(fx.genomes(spark, sf), fx.labels(spark, sf), fx.index(spark, sf), 100))


# Comparison

@query("SELECT id, ref_taxon, test_taxon, category, CAST(idx AS INTEGER) AS index FROM cats")
def cmp_hit_categories(spark, sf):
    return compare.hit_categories(fx.assigned(spark, sf), fx.taxonomy(spark, sf), "species")


@query("""SELECT reads, classified, tp, fp, vp, fn, mean_index, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS ppv, tp / CAST(reads AS DOUBLE) AS sensitivity FROM (
    SELECT count(*) AS reads, count(*) FILTER (test_taxon <> 0) AS classified, count(*) FILTER (category = 'TruePos') AS tp, count(*) FILTER (category = 'FalsePos') AS fp, count(*) FILTER (category = 'VaguePos') AS vp, count(*) FILTER (category = 'FalseNeg') AS fn, avg(idx) AS mean_index FROM cats)""")
def cmp_per_read(spark, sf):
    return compare.per_read_metrics(fx.assigned(spark, sf), fx.taxonomy(spark, sf), "species")


@query("""SELECT cl AS classified_taxa, rf AS reference_taxa, tp, fp, vp, fn, tp / CAST(nullif(cl - vp, 0) AS DOUBLE) AS "precision", tp / CAST(nullif(rf, 0) AS DOUBLE) AS recall FROM (
    SELECT count(*) FILTER (f) AS cl, count(*) FILTER (r) AS rf, count(*) FILTER (f AND r) AS tp, count(*) FILTER (f AND NOT r AND NOT v) AS fp, count(*) FILTER (f AND v) AS vp, count(*) FILTER (r AND NOT f) AS fn FROM (
    SELECT taxon, taxon IN (SELECT taxon FROM fnd) AS f, taxon IN (SELECT taxon FROM rfs) AS r, taxon NOT IN (SELECT taxon FROM rfs) AND taxon IN (SELECT a FROM anc JOIN rfs USING (taxon)) AS v FROM (SELECT taxon FROM fnd UNION SELECT taxon FROM rfs)))""",
    {"fnd": "SELECT a AS taxon FROM (SELECT id, arg_min(a, t.level) AS a FROM assigned JOIN anc c ON c.taxon = test_taxon JOIN tree t ON t.taxon = a WHERE t.depth >= 7 GROUP BY id) GROUP BY a HAVING count(*) >= 10",
     "rfs": "SELECT DISTINCT gen AS taxon FROM assigned JOIN parts ON tax = ref_taxon"})
def cmp_per_taxon(spark, sf):
    t = fx.assigned(spark, sf)
    return compare.per_taxon_metrics(t, t.select("ref_taxon"), fx.taxonomy(spark, sf), "genus")


@query("SELECT CAST(l_partkey % 3 * 2990 + 10000 + l_partkey % 7 AS INTEGER) AS taxon, CAST(floor(count(*) / 2) AS BIGINT) AS n FROM lineitem WHERE CAST(l_partkey % 3 * 2990 + 10000 + l_partkey % 7 AS INTEGER) IN (SELECT taxon FROM tree WHERE depth >= 8) GROUP BY 1")
def cmp_mapping_report(spark, sf):
    k = F.col("l_partkey")
    t = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (k % 3 * 2990 + 10000 + k % 7).cast("int").alias("taxon"))
    return compare.mapping_report_counts(t, fx.taxonomy(spark, sf)).withColumn("n", F.col("n").cast("bigint"))


PROFILES = """WITH a AS (SELECT CAST(c_nationkey AS INTEGER) AS taxon, count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS x FROM customer GROUP BY 1),
    b AS (SELECT CAST(s_nationkey AS INTEGER) AS taxon, count(*) / CAST((SELECT count(*) FROM supplier) AS DOUBLE) AS x FROM supplier GROUP BY 1),
    m AS (SELECT taxon, coalesce(a.x, 0) AS a, coalesce(b.x, 0) AS b FROM a FULL JOIN b USING (taxon))"""


def _profiles(spark, sf):
    def one(name, key):
        t = fx.table(spark, sf, name)
        n = t.agg(F.count(F.lit(1)).alias("all"))
        return t.groupBy(F.col(key).alias("taxon")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("taxon", (F.col("n") / F.col("all")).alias("fraction"))

    return one("customer", "c_nationkey"), one("supplier", "s_nationkey")


@query(f"/*plain*/ {PROFILES} SELECT * FROM m")
def cmp_outer_merge(spark, sf):
    return compare.outer_merge(*_profiles(spark, sf), ["taxon"], "fraction")


@query(f"/*plain*/ {PROFILES} SELECT round(sum(abs(a - b)), 9) AS l1, round(sum((a - b) ** 2), 9) AS squares, round(sum(abs(log10(greatest(a, 1e-6)) - log10(greatest(b, 1e-6)))), 9) AS log_l1, round(sum((log10(greatest(a, 1e-6)) - log10(greatest(b, 1e-6))) ** 2), 9) AS log_squares, count(*) FILTER (a > 0 AND b > 0) AS tp, count(*) FILTER (a > 0 AND b = 0) AS fp, count(*) FILTER (a = 0 AND b > 0) AS fn FROM m")
def cmp_profile_distance(spark, sf):
    t = compare.profile_distance(*_profiles(spark, sf))
    return t.withColumns({c: F.round(c, 9) for c in ("l1", "squares", "log_l1", "log_squares")})


@query(f"/*plain*/ {PROFILES} SELECT round(count(*) FILTER (a > 0 AND b > 0) / CAST(count(*) FILTER (a > 0) AS DOUBLE), 9) AS \"precision\", round(count(*) FILTER (a > 0 AND b > 0) / CAST(count(*) FILTER (b > 0) AS DOUBLE), 9) AS recall, round(sum(CASE WHEN b > 0 THEN a ELSE 0 END) / sum(a), 9) AS weighted_precision FROM m")
def cmp_weighted_gold(spark, sf):
    a, b = _profiles(spark, sf)
    t = compare.weighted_gold(a.withColumnRenamed("fraction", "percent"), b)
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


SHARES = "WITH v AS (SELECT o_custkey % 40 AS sample, o_orderpriority AS g, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2), r AS (SELECT sample, g, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS ratio FROM v)"


def _shares(spark, sf):
    v = fx.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("sample"), F.col("o_orderpriority").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return v, compare.group_ratio(v, "sample", "g", "n")


@query(f"/*plain*/ {SHARES} SELECT sample, g, ratio FROM r")
def cmp_group_ratio(spark, sf):
    return _shares(spark, sf)[1]


@query(f"/*plain*/ {SHARES} SELECT a.g AS first, b.g AS second, round(avg(a.ratio - b.ratio), 9) AS mean_difference FROM r a JOIN r b ON a.sample = b.sample AND a.g < b.g GROUP BY 1, 2")
def cmp_pairwise_diff(spark, sf):
    return compare.pairwise_differences(_shares(spark, sf)[1], "sample", "g", "ratio").withColumn("mean_difference", F.round("mean_difference", 9))


@query("/*plain*/ SELECT o_custkey % 40 AS sample, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def cmp_pivot(spark, sf):
    v = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("sample"), "o_orderstatus", F.lit(1).cast("bigint").alias("n"))
    return compare.pivoted(v, "sample", "o_orderstatus", "n", ["F", "O", "P"])
