"""Files: what is written comes back."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from cladeforge import cli
from cladeforge.sources import sequences, sinks, tables
from cladeforge.streaming import reads as streaming

RNG = random.Random(2)
RECORDS = [(f"seq{i}", "".join(RNG.choice("ACGTN") for _ in range(RNG.randrange(1, 300)))) for i in range(8)]


def fasta_text(end):
    out = ""
    for h, s in RECORDS:
        out += f">{h} some words{end}" + "".join(s[a : a + 60] + end for a in range(0, len(s), 60))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("pack", ["", ".gz", ".bz2"])
def test_fasta_and_fastq(spark, tmp_path, end, pack):
    opened = {"": open, ".gz": gzip.open, ".bz2": bz2.open}[pack]
    with opened(tmp_path / f"a.fna{pack}", "wb") as f:
        f.write(fasta_text(end).encode())
    got = sequences.read(spark, [str(tmp_path / f"a.fna{pack}")])
    assert {(r.header, r.location, r.nucleotides) for r in got.collect()} == {(h, 1, s) for h, s in RECORDS}
    if end != "\r":
        with opened(tmp_path / f"a.fq{pack}", "wb") as f:
            f.write("".join(f"@{h} x{end}{s}{end}+{end}{'@' * len(s)}{end}" for h, s in RECORDS).encode())
        got = sequences.read(spark, [str(tmp_path / f"a.fq{pack}")])
        assert {(r.header, r.nucleotides) for r in got.collect()} == set(RECORDS)


def test_indexed_fasta(spark, tmp_path):
    text, index, at = b"", "", 0
    for h, s in RECORDS:
        head = f">{h}\n".encode()
        body = "".join(s[a : a + 50] + "\n" for a in range(0, len(s), 50)).encode()
        index += f"{h}\t{len(s)}\t{at + len(head)}\t50\t51\n"
        text, at = text + head + body, at + len(head) + len(body)
    (tmp_path / "a.fna").write_bytes(text)
    (tmp_path / "a.fna.fai").write_text(index)
    got = sequences.indexed_fasta(spark, str(tmp_path / "a.fna"), 21, 64).collect()
    kmers = sorted((r.header, r.location + i, r.nucleotides[i : i + 21]) for r in got for i in range(len(r.nucleotides) - 20))
    assert kmers == sorted((h, i + 1, s[i : i + 21]) for h, s in RECORDS for i in range(len(s) - 20))
    ends = {r.id: r.end for r in sequences.fasta_index(spark, str(tmp_path / "a.fna.fai")).collect()}
    assert all(text[ends[h] : ends[h] + 1].decode() == s[-1] for h, s in RECORDS if len(s) % 50)


def test_pairs_lists_and_errors(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"r{n}.fq").write_text("".join(f"@{h}/{n}\n{s}\n+\n{'I' * len(s)}\n" for h, s in RECORDS))
    (tmp_path / "list").write_text(f"{tmp_path}/r1.fq\n{tmp_path}/r2.fq\n")
    got = sequences.read(spark, [f"@{tmp_path}/list"], paired_files=True).collect()
    assert {(r.header, r.nucleotides, r.nucleotides2) for r in got} == {(h, s, s) for h, s in RECORDS}
    with pytest.raises(ValueError, match="even"):
        sequences.read(spark, [f"{tmp_path}/r1.fq"], paired_files=True)


def test_ambiguous_removed(spark):
    df = spark.createDataFrame([("a", 5, "NNACGTNA\nCX"), ("b", 1, "NN"), ("c", 1, "ACGT")], "header string, location bigint, nucleotides string")
    got = {(r.header, r.location, r.nucleotides) for r in sequences.without_ambiguous(df).collect()}
    assert got == {("a", 7, "ACGT"), ("a", 12, "A\nC"), ("c", 1, "ACGT")}


def test_command_line(spark, tmp_path):
    tax = tmp_path / "tax"
    tax.mkdir()
    (tax / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n3\t|\t2\t|\tspecies\t|\n4\t|\t2\t|\tspecies\t|\n")
    (tax / "names.dmp").write_text("".join(f"{t}\t|\t{n}\t|\t\t|\tscientific name\t|\n{t}\t|\tother\t|\t\t|\tsynonym\t|\n" for t, n in ((1, "root"), (2, "Genus"), (3, "One"), (4, "Two"))))
    lib = tmp_path / "lib/library/x"
    lib.mkdir(parents=True)
    g = {t: "".join(RNG.choice("ACGT") for _ in range(800)) for t in (3, 4)}
    (lib / "g.fna").write_text("".join(f">g{t}\n{s}\n" for t, s in g.items()))
    (tmp_path / "lib/seqid2taxid.map").write_text("g3\t3\ng4\t4\nbad\tx\n")
    (tmp_path / "r.fq").write_text("".join(f"@S{t}x{a}\n{g[t][a : a + 100]}\n+\n{'I' * 100}\n" for t in g for a in range(0, 700, 35)))
    common = ["--taxonomy", str(tax), "--index", str(tmp_path / "idx")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        cli.run(spark, ["--partitions", "2", "build", *common, "--library", str(tmp_path / "lib"), "-k", "35"])
        cli.run(spark, ["--partitions", "2", "classify", *common, str(tmp_path / "r.fq"), "--sample-regex", "(S[0-9])", "--confidence", "0", "0.15", "--output", str(tmp_path / "out")])
        cli.run(spark, ["--partitions", "2", "classify2", *common, "--library", str(tmp_path / "lib"), str(tmp_path / "r.fq"), "--reads", "2", "--bracken-length", "100", "--index-reports", "--output", str(tmp_path / "two")])
        cli.run(spark, ["--partitions", "2", "inspect", *common, "--library", str(tmp_path / "lib"), "--labels", str(tmp_path / "lib/seqid2taxid.map"), "--output", str(tmp_path / "ins")])
        cli.run(spark, ["--partitions", "2", "respace", *common, "--spaces", "9", "--output", str(tmp_path / "idx2")])
        cli.run(spark, ["--partitions", "2", "compare-index", *common, "--reference", str(tmp_path / "idx2_s9"), "--output", str(tmp_path / "cmp")])
        cli.run(spark, ["--partitions", "2", "inspect", *common, "--output", str(tmp_path / "bare")])
        cli.run(spark, ["--partitions", "2", "input-check", *common[:2], "--labels", str(tmp_path / "lib/seqid2taxid.map")])
        cli.run(spark, ["--partitions", "2", "stats", *common])
        for sample in ("S3", "S4"):
            (tmp_path / f"ref/sample{sample}").mkdir(parents=True)
            titles = [r.id for r in tables.classifications(spark, str(tmp_path / f"out_c0.15/sample={sample}")).collect()]
            (tmp_path / f"ref/sample{sample}/reads_mapping.tsv").write_text("".join(f"x\t{t}\t{sample[1]}\n" for t in titles))
        many = ["--multi-dirs", "--reference", str(tmp_path / "ref"), "--title-regex", "([^/]*)/sample=([^/]*)$", "--title-fields", "run", "name", "--output", str(tmp_path / "many")]
        cli.run(spark, ["--partitions", "2", "compare", *common[:2], str(tmp_path / "out_c0.00"), str(tmp_path / "out_c0.15"), *many])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out_c0.15/S3_kreport")).collect()]
    assert lines[0].startswith("#Perc") and any(x.split("\t")[4] == "3" and int(x.split("\t")[2]) == 20 for x in lines[1:])
    metrics = spark.read.csv(str(tmp_path / "many_metrics.tsv"), sep="\t", header=True).collect()
    assert {(r.run, r.name, r["rank"]) for r in metrics} == {(f"out_c{c}", s, k) for c in ("0.00", "0.15") for s in ("S3", "S4") for k in ("genus", "species")}
    assert all(int(r.read_tp) == 20 for r in metrics if r["rank"] == "species")
    got = tables.classifications(spark, str(tmp_path / "out_c0.00/sample=S4"))
    assert {r.test_taxon for r in got.collect()} == {4} and got.count() == 20
    assert {r.value for r in spark.read.text(str(tmp_path / "two_taxonSet")).collect()} == {"3", "4"}
    for name in ("totalKmerCount", "distinctMinimizerCount", "totalMinimizerCount", "classifiedReadCount"):
        lines = [r.value for r in spark.read.text(str(tmp_path / f"two_support_report_{name}")).collect()]
        assert lines[0].startswith("#Perc") and {x.split("\t")[4] for x in lines[1:] if int(x.split("\t")[2])} >= {"3", "4"}
    for name in ("minimizerCoverage", "minimizerDistinctCoverage"):
        assert {r.value.split("  ")[0] for r in spark.read.text(str(tmp_path / f"two_support_report_{name}")).collect()} == {"3", "4"}
    averages = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "ins_min_report")).collect()]
    assert averages[0][-3:] == ["s1", "s2", "s3"] and len({len(x) for x in averages}) == 1
    for name in ("ins_genome_report", "bare_genome_report", "bare_min_report"):
        assert len(spark.read.text(str(tmp_path / name)).collect()) > 2
    weights = [r.value for r in spark.read.text(str(tmp_path / "two_database100mers")).collect()]
    assert weights[1] == "3\t3:701:701" and weights[2] == "4\t4:701:701"


def test_reports_of_many_samples(spark, tmp_path):
    from cladeforge.operators import classify, report
    from cladeforge.operators.taxonomy import Taxonomy
    from cladeforge.sources import sinks

    tax = Taxonomy.from_nodes(spark.createDataFrame([(1, 1, "root", ""), *[(2 + i, 1 + i // 3, "genus" if i < 9 else "species", f"n{i}") for i in range(40)]], "taxon int, parent int, rank string, name string"))
    names = [*(f"S{i}" for i in range(23)), "a b:c", "x/y", ""]
    rows = [(f"t{i}", names[i % 26], (0.0, 0.15)[i % 7 == 0], i % 5 > 0, i * i % 41, "100", "d") for i in range(900)]
    t = spark.createDataFrame(rows, "title string, sample string, threshold double, classified boolean, taxon int, length string, details string")
    at = str(tmp_path / "out")
    for _ in range(2):
        # the second time in place of the first
        sinks.write_reports(t, tax, at, [0.0, 0.15, 0.5])
    counts = classify.taxon_counts(t)
    for threshold, text in ((0.0, "0.00"), (0.15, "0.15")):
        for name in names:
            rows = report.report_rows(counts.where((F.col("threshold") == threshold) & (F.col("sample") == name)), tax)
            files = list((tmp_path / f"out_c{text}" / f"{name.replace('/', '%2F')}_kreport").glob("part-*"))
            assert len(files) == 1, (name, files)
            if name in ("S3", "x/y", ""):
                assert files[0].read_text().splitlines() == [r.value for r in sinks.report_text(rows).collect()]
    assert not list(tmp_path.glob("*writing*"))
    sinks.write_classified(t, at, [0.0, 0.15, 0.5], files=2)
    for threshold, text in ((0.0, "0.00"), (0.15, "0.15"), (0.5, "0.50")):
        lines = sorted(r.value for r in spark.read.text(f"{at}_c{text}").collect())
        assert lines == sorted("\t".join(("C" if r[3] else "U", r[0], str(r[4]), r[5], r[6])) for r in t.collect() if r[2] == threshold)
    assert len(list((tmp_path / "out_c0.00/sample=S1").glob("part-*"))) <= 2 and not list(tmp_path.glob("*writing*"))


def test_stream(spark, tmp_path):
    from cladeforge.functions.alphabet import Scheme
    from cladeforge.operators.index import MinimizerIndex
    from cladeforge.operators.taxonomy import Taxonomy

    g = "".join(RNG.choice("ACGT") for _ in range(500))
    tax = Taxonomy.from_nodes(spark.createDataFrame([(1, 1, "root", ""), (2, 1, "species", "")], "taxon int, parent int, rank string, name string"))
    index = MinimizerIndex.build(spark.createDataFrame([("g", g)], "header string, nucleotides string"), spark.createDataFrame([("g", 2)], "header string, taxon int"), tax, Scheme())
    for i in range(2):
        spark.createDataFrame([(f"r{i}{a}", g[a : a + 90]) for a in range(0, 400, 40)], "header string, nucleotides string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("header string, nucleotides string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.classify_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.where("taxon = 2").count() == 20 and out.select("batch").distinct().count() == 2


def test_taxonomy_is_written(spark, tmp_path):
    from cladeforge.operators.taxonomy import Taxonomy

    tax = Taxonomy.from_nodes(spark.createDataFrame([(1, 1, "root", "")], "taxon int, parent int, rank string, name string"), spark.createDataFrame([(7, 1)], "secondary int, primary int"))
    sinks.write_taxonomy(tax, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/nodes")).count() == 1 and spark.read.parquet(str(tmp_path / "t/merged")).count() == 1
    assert tax.primary(spark.createDataFrame([(7,), (1,)], "taxon int")).agg(F.sum("taxon")).first()[0] == 2


@pytest.mark.parametrize(("size", "end"), [(13, "\n"), (64, "\r\n"), (300, "\n"), (1000, "\r\n"), (5000, "\n")])
def test_fastq_in_splits(spark, tmp_path, size, end):
    """Splits smaller than a line or a record, and larger; qualities that look like headers; a file cut short."""
    for name, n in (("a.fq", 9), ("b c.fq", 3), ("empty.fq", 0)):
        text = "".join(f"@{name[0]}{h}{i} x{end}{s}{end}+{h}{end}{'@+'[i % 2] * len(s)}{end}" for i in range(n) for h, s in RECORDS[:4])
        (tmp_path / name).write_bytes((text + (f"@cut{end}ACGT{end}+" if n else "")).encode())
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    small.conf.set("spark.sql.shuffle.partitions", "2")
    read = sequences.fastq(small, [str(tmp_path / n) for n in ("a.fq", "b c.fq", "empty.fq")])
    assert sorted((r.header, r.nucleotides) for r in read.collect()) == sorted([(f"{c}{h}{i}", s) for c, n in (("a", 9), ("b", 3)) for i in range(n) for h, s in RECORDS[:4]] + [("cut", "ACGT")] * 2)
    # two narrow passes, and a window over the edges alone
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Window [") < plan.index("MapInArrow split_edges")


@pytest.mark.parametrize("rows", [1, 3, 10000])
def test_small_splits_share_tasks(spark, tmp_path, monkeypatch, rows):
    """Hundreds of splits are read in a few tasks, also where Arrow batches end within a record."""
    want = [(f"r{i}", "ACGTN"[i % 5] * (i % 90 + 1)) for i in range(400)]
    for part in (0, 1):
        (tmp_path / f"{part}.fq").write_text("".join(f"@{h} x\n{s}\n+\n{'@+'[len(s) % 2] * len(s)}\n" for h, s in want[part::2]))
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "150")
    small.conf.set("spark.sql.shuffle.partitions", "2")
    small.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    read = sequences.fastq(small, [str(tmp_path / "0.fq"), str(tmp_path / "1.fq")])
    assert sorted((r.header, r.nucleotides) for r in read.collect()) == sorted(want)
    assert read.rdd.getNumPartitions() <= small.sparkContext.defaultParallelism + 2
    # tasks grow with the files
    monkeypatch.setattr(sequences, "TASK_BYTES", 2000, raising=False)
    assert sequences.fastq(small, [str(tmp_path / "0.fq"), str(tmp_path / "1.fq")]).rdd.getNumPartitions() > 10
