"""Command line: python -m cladeforge.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import Scheme
from .operators import bracken, classify, compare, dynamic, report
from .operators.index import MinimizerIndex
from .operators.taxonomy import Taxonomy
from .sources import sequences, sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeforge")
    p.add_argument("--partitions", type=int, default=200, help="shuffle partitions, and buckets of an index")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name)
        c.add_argument("--taxonomy", required=True, help="folder with nodes.dmp, names.dmp")
        for flag, settings in options:
            c.add_argument(flag, **settings)

    index = ("--index", {"required": True})
    library = ("--library", {"required": True})
    output = ("--output", {"required": True})
    confidence = ("--confidence", {"type": float, "nargs": "+", "default": [0.0]})
    reading = [
        ("files", {"nargs": "+"}),
        ("--paired", {"action": "store_true"}),
        ("--min-hits", {"type": int, "default": 2}),
        ("--sample-regex", {}),
        ("--no-unclassified", {"action": "store_true"}),
        ("--no-detailed", {"action": "store_true"}),
        confidence,
        output,
    ]
    command("build", index, library, ("-k", {"type": int, "required": True}), ("-m", {"type": int, "default": 31}), ("--spaces", {"type": int, "default": 7}))
    command("respace", index, output, ("--spaces", {"type": int, "nargs": "+", "required": True}))
    command("classify", index, *reading)
    command(
        "classify2", index, library, *reading,
        ("--rank", {"default": "species"}), ("--min-count", {"type": int}), ("--min-distinct", {"type": int}), ("--min-fraction", {"type": float}), ("--reads", {"type": int}),
        ("--init-confidence", {"type": float, "default": 0.15}), ("--bracken-length", {"type": int}), ("--gold-set", {}), ("--classify-with-gold", {"action": "store_true"}), ("--promote-gold-set", {}), ("--index-reports", {"action": "store_true", "help": "also report what supports the taxa, and the coverage of the library by the index"}),
    )
    command("bracken-build", index, library, output, ("--read-len", {"type": int, "default": 100}))
    command("stats", index, ("--library", {}), ("--histogram", {}))
    command("inspect", index, output, ("--library", {}), ("--labels", {}))
    command("compare-index", index, output, ("--reference", {"required": True}))
    command("compare", output, ("--reference", {"required": True}), ("--id-col", {"type": int, "default": 2}), ("--taxon-col", {"type": int, "default": 3}), ("--header", {"action": "store_true"}), ("--multi-dirs", {"action": "store_true", "help": "files are folders of samples, --reference their folder of mappings"}), ("--title-regex", {"default": compare.TITLE, "help": "groups are the parts of a result folder's name"}), ("--title-fields", {"nargs": "+", "default": compare.TITLE_FIELDS}), ("files", {"nargs": "+"}))
    command("input-check", ("--labels", {"required": True}))
    return p


def _library(spark: SparkSession, folder: str, k: int):
    files, labels = tables.genomes(spark, folder)
    return sequences.read(spark, files, k=k), tables.labels(spark, labels)


def _criterion(a: argparse.Namespace) -> dynamic.Criterion:
    given = [(kind, v) for kind, v in (("total", a.min_count), ("distinct", a.min_distinct), ("fraction", a.min_fraction), ("reads", a.reads)) if v is not None]
    if len(given) > 1:
        raise SystemExit("only one of --min-count, --min-distinct, --min-fraction and --reads")
    kind, least = given[0] if given else ("reads", 100)
    return dynamic.Criterion(kind, least, a.init_confidence)


def _write(classified, tax: Taxonomy, a: argparse.Namespace) -> None:
    # one pass over the reads for all thresholds and files
    classified = classified.persist(StorageLevel.DISK_ONLY)
    if not a.no_detailed:
        sinks.write_classified(classified, a.output, a.confidence)
    sinks.write_reports(classified, tax, a.output, a.confidence)
    classified.unpersist()


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
    tax = tables.taxonomy(spark, a.taxonomy)
    loaded = MinimizerIndex.load(spark, a.index, tax) if getattr(a, "index", None) and a.command != "build" else None
    if a.command == "build":
        scheme = Scheme(a.k, a.m, a.spaces)
        genomes, labels = _library(spark, a.library, scheme.k)
        MinimizerIndex.build(genomes, labels, tax, scheme).write(a.index, a.partitions)
    elif a.command == "respace":
        for s in a.spaces:
            loaded.respace(s).write(f"{a.output}_s{s}", a.partitions)
    elif a.command in ("classify", "classify2"):
        reads = sequences.read(spark, a.files, a.paired)
        options = {"thresholds": a.confidence, "min_hit_groups": a.min_hits, "sample_regex": a.sample_regex, "with_details": not a.no_detailed, "with_unclassified": not a.no_unclassified}
        if a.command == "classify":
            _write(classify.classify(reads, loaded, **options), tax, a)
            return
        genomes, labels = _library(spark, a.library, loaded.scheme.k)
        gold = dynamic.gold_set(tables.gold(spark, a.gold_set), labels, tax, a.rank, a.promote_gold_set) if a.gold_set else None
        kept = gold if a.classify_with_gold and gold is not None else dynamic.supported(dynamic.counts(reads, loaded, _criterion(a), a.rank), tax, _criterion(a), a.rank)
        kept = kept.persist(StorageLevel.DISK_ONLY)
        sinks.write_taxa(kept, f"{a.output}_taxonSet")
        if a.index_reports:
            sinks.write_kinds(report.report_rows(dynamic.support_counts(reads, loaded, a.rank, a.min_hits), tax, ["kind"]), f"{a.output}_support_report")
            coverage = loaded.full_coverage(genomes, labels).persist(StorageLevel.DISK_ONLY)
            sinks.write_support(coverage, f"{a.output}_support_report_minimizerCoverage")
            sinks.write_support(coverage, f"{a.output}_support_report_minimizerDistinctCoverage", "distinct_coverage")
            coverage.unpersist()
        if gold is not None:
            sinks.write_table(dynamic.set_metrics(kept, gold), f"{a.output}_set_metrics")
        second = dynamic.dynamic_index(genomes, labels, loaded, tax.closure_down(kept))
        # read by the weights and by the second classification
        second = MinimizerIndex(second.records.persist(StorageLevel.DISK_ONLY), second.scheme, second.taxonomy)
        if a.bracken_length:
            sinks.write_weights(bracken.weights(genomes, labels, second, a.bracken_length), f"{a.output}_database{a.bracken_length}mers")
        _write(classify.classify(reads, second, **options), tax, a)
    elif a.command == "bracken-build":
        genomes, labels = _library(spark, a.library, loaded.scheme.k)
        sinks.write_weights(bracken.weights_in_batches(genomes, labels, loaded, f"{a.output}_batches", a.read_len), f"{a.output}_database{a.read_len}mers")
    elif a.command == "stats":
        loaded.stats().show(truncate=False)
        loaded.depth_histogram().orderBy("depth").show()
        loaded.taxon_depth_histogram().orderBy("depth").show()
        if a.histogram:
            sinks.write_table(loaded.depth_histogram().orderBy("depth"), a.histogram)
        if a.library:
            loaded.leaf_coverage(*_library(spark, a.library, loaded.scheme.k)).select("fraction", "total").summary().show()
    elif a.command == "inspect":
        labels = tables.labels(spark, a.labels) if a.labels else None
        rows = report.report_rows(report.index_counts(loaded.counts_per_taxon(), labels), tax, ["kind"]).withColumn("kind", F.concat("kind", F.lit("_report")))
        # with a library, the first report tells average sizes of genomes too
        sinks.write_kinds(rows.where("kind <> 'min_report'") if a.library else rows, a.output)
        if a.library:
            genomes, of_genomes = _library(spark, a.library, loaded.scheme.k)
            sizes = loaded.genome_sizes(genomes, of_genomes)
            sinks.write_table(report.kmer_averages(sizes, tax), f"{a.output}_genome_sizes")
            averages = report.averages_report(loaded.counts_per_taxon(), sizes, tax).withColumn("kind", F.lit("min_report"))
            sinks.write_kinds(averages, a.output, ["s1", "s2", "s3"])
    elif a.command == "compare-index":
        moved = loaded.migration(MinimizerIndex.load(spark, a.reference, tax)).groupBy("t1", "t2", "steps").count()
        sinks.write_table(moved.groupBy("steps").agg({"count": "sum"}).orderBy("steps"), f"{a.output}_steps")
        rooted = moved.where("t2 = 1 and t1 <> 1").groupBy("t1").agg({"count": "sum"}).toDF("taxon", "n")
        sinks.write_lines(sinks.report_text(report.report_rows(rooted, tax)), f"{a.output}_taxaToRoot_report")
    elif a.command == "compare" and a.multi_dirs:
        reference = tax.defined(tables.mapping_of_samples(spark, a.reference, a.id_col, a.taxon_col, a.header, tax), "ref_taxon")
        metrics = compare.many_metrics(tables.classifications_of_samples(spark, a.files, tax), reference, tax)
        sinks.write_table(compare.with_title_fields(metrics, a.title_regex, a.title_fields).orderBy("title", "rank"), f"{a.output}_metrics.tsv")
    elif a.command == "compare":
        reference = tax.defined(tables.mapping(spark, a.reference, a.id_col, a.taxon_col, a.header, tax), "ref_taxon")
        for f in a.files:
            pairs = tables.classifications(spark, f, tax).join(reference, "id")
            sinks.write_table(compare.all_metrics(pairs, reference, tax), f"{a.output}_{f.strip('/').split('/')[-1]}_metrics")
    elif a.command == "input-check":
        labels = tables.labels(spark, a.labels)
        tax.unknown(labels).show(truncate=False)
        report.label_stats(labels, tax).show()
        report.label_levels(labels, tax).orderBy("level").show()


if __name__ == "__main__":
    run(SparkSession.builder.appName("cladeforge").getOrCreate())
