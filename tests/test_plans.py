"""What is sent to the driver, and how the work is dealt: read off the plans, on the smallest tables."""

from pathlib import Path

import pytest

from cladeforge.operators.index import MinimizerIndex
from cladeforge.operators.taxonomy import Taxonomy
from cladeforge.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def sent(df) -> list[str]:
    """Joins that send a table to the driver; the parts' types are one row, which no hash table is made of."""
    return [line for line in plan(df) if "BroadcastHashJoin" in line]


def test_genomes_are_not_broadcast(spark):
    assert sent(fx.reads(spark, SF)) == []
    assert sent(fx.reads(spark, SF, paired=True)) == []


def test_laid_out_tree_is_not_broadcast(spark):
    tax = Taxonomy.from_nodes(fx.nodes(spark, SF), at_driver=0)
    assert sent(tax.lca_of_pairs(fx.assigned(spark, SF), "ref_taxon", "test_taxon")) == []
    assert sent(MinimizerIndex.build(fx.genomes(spark, SF), fx.labels(spark, SF), tax).records) == []


def test_tasks_grow_with_the_parts(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK", 50)
    assert fx.genomes(spark, SF).rdd.getNumPartitions() == 4


def test_words_stay_with_their_genome(spark):
    from __spark_entry__ import queries

    # the windows over a genome's words take the genome's task: none of its words is shuffled
    for name in ("seq_minimizers", "seq_supermers_window", "seq_minimizers_by_table"):
        assert not [line for line in plan(queries()[name](spark, SF)) if "Exchange hashpartitioning(header#" in line]


def test_no_word_is_sorted(spark):
    from __spark_entry__ import queries

    # minimizers are found within a sequence's row: its words are not sorted as rows
    for name in ("seq_minimizers", "seq_supermers_window"):
        assert not [line for line in plan(queries()[name](spark, SF)) if "Window" in line]


def test_words_are_coded_not_text(spark):
    from __spark_entry__ import queries

    # a number is not made of each word by way of text: what is counted or made distinct is the number
    for name in ("seq_kmers_forward", "seq_priority_xor", "seq_priority_spaced", "seq_code_revcomp"):
        dealt = [line for line in plan(queries()[name](spark, SF)) if "Exchange hashpartitioning(" in line and "pos" not in line]
        assert not [line for line in dealt if "hashpartitioning(word#" in line]
        assert not [line for line in queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "conv(translate(" in line and " 4, 10" in line]


def test_packed_letters(spark):
    from pyspark.sql import functions as F

    from cladeforge.functions import alphabet

    texts = ["", "A", "T" * 32, "T" * 33, "ACGT" * 20 + "CU", "acgtu" * 13, "G" * 31 + "C", "T" + "A" * 63]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", alphabet.packed(F.col("t")))
    plain = [t.upper().replace("U", "T") for t in texts]
    assert [r[0] for r in df.select(alphabet.unpacked(F.col("p"), F.length("t"))).collect()] == plain
    for n in (1, 5, 12, 31):
        rows = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("t")))).select("t", "i", alphabet.decode(alphabet.code_in(F.col("p"), F.col("i"), n), n).alias("w")).collect()
        for r in rows:
            want = r.t.upper().replace("U", "T")[r.i : r.i + n]
            assert len(want) < n or r.w == want


def test_buckets_grow_with_the_parts(spark, monkeypatch):
    from cladeforge.plans import stored

    monkeypatch.setattr(fx, "TASK", 20)
    # one file a bucket
    assert len(stored._stored(spark, SF).records.inputFiles()) == 10


def test_reads_are_dealt_before_their_letters(spark, monkeypatch):
    # tasks go by the number of reads, and neither side's letters are shuffled
    monkeypatch.setattr(fx, "READS_TASK", 100, raising=False)
    df = fx.reads(spark, SF, paired=True)
    assert len([line for line in plan(df) if "Exchange hashpartitioning(" in line]) == 2
    assert df.rdd.getNumPartitions() == -(-fx.table(spark, SF, "orders").count() // 100)


def test_sequences_without_minimizers_are_read_once(spark):
    index = fx.index(spark, SF)
    assert len([line for line in plan(index.without_minimizers(fx.reads(spark, SF))) if "o_orderkey" in line and "FileScan" in line]) == 1
    rows = [("a", "ACGTT" * 9), ("a", "N" * 50), ("b", "N" * 50), ("b", None), ("c", "ACGT"), ("d", "GATTC" * 8)]
    found = index.without_minimizers(spark.createDataFrame(rows, "header string, nucleotides string"))
    assert sorted(r.header for r in found.collect()) == ["b", "c"]


def test_coverage_meets_depths_by_ancestor(spark):
    # a taxon's few ancestors are joined with their depths, not all its minimizers
    index = fx.index(spark, SF)
    assert [line for line in plan(index.full_coverage(fx.genomes(spark, SF), fx.labels(spark, SF))) if "HashAggregate(keys=[taxon#" in line and ", lca#" in line]


def test_hits_are_merged_once(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from cladeforge.functions.alphabet import BORDER_TAXON
    from cladeforge.operators import classify

    random.seed(1)
    reads = [[]] + [[(random.choice((0, 5, 7)), random.randint(1, 9)) for _ in range(random.randint(1, 12))] for _ in range(40)]
    reads += [a + [(BORDER_TAXON, -34)] + b for a, b in zip(reads, reads[5:], strict=False)]
    df = spark.createDataFrame([(i, [(j, *h) for j, h in enumerate(r)]) for i, r in enumerate(reads)], "i int, hits array<struct<ordinal:int,taxon:int,count:int>>")
    both = df.select("i", classify.merged_hits(F.col("hits")).alias("pairs"), classify.lengths(F.col("hits"), 35).alias("length"), classify.lengths(classify.merged_hits(F.col("hits")), 35).alias("same"))
    for row in both.collect():
        hits = reads[row.i]
        assert [tuple(p) for p in row.pairs] == [(t, sum(c for _, c in g)) for t, g in itertools.groupby(hits, lambda h: h[0])]
        at = next((j for j, h in enumerate(hits) if h[0] == BORDER_TAXON), None)
        parts = [hits] if at is None else [hits[:at], hits[at + 1 :]]
        assert row.length == row.same == "|".join(str(sum(c for _, c in p) + 34) for p in parts)
    # each read's hits are gone through once for its length
    text = df.select(classify.lengths(classify.merged_hits(F.col("hits")), 35).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("filter(") == 1


def test_reports_are_numbered_along_paths(spark, monkeypatch):
    import random
    from collections import defaultdict

    from cladeforge.operators import report

    random.seed(4)
    monkeypatch.setattr(report, "RANGE_BITS", 2, raising=False)
    up = {1: 1} | {i: random.choice([1, 2, *range(1, i)]) for i in range(2, 80)}
    tax = Taxonomy.from_nodes(spark.createDataFrame([(t, u, "no rank" if t % 3 else "genus", f"n{t}") for t, u in up.items()], "taxon int, parent int, rank string, name string"), at_driver=0)
    sets = {"a": {t: random.randint(1, 3) for t in random.sample(range(2, 80), 40)} | {0: 5, 999: 2}, "b": {0: 4}, "c": {999: 1}, "d": {t: 1 for t in range(1, 80, 2)}}
    counts = spark.createDataFrame([(k, t, n) for k, x in sets.items() for t, n in x.items()], "kind string, taxon int, n bigint")

    def lines(own: dict, zeros: bool, none: bool) -> list:
        clade, below = defaultdict(int), defaultdict(list)
        for t, u in up.items():
            below[u].append(t)
            at = t
            while t in own or zeros:
                clade[at] += own.get(t, 0)
                if at == 1:
                    break
                at = up[at]
        out = [(0, own.get(0, 0), own.get(0, 0))] if none else []

        def visit(t: int) -> None:
            out.append((t, clade[t], own.get(t, 0)))
            for c in sorted((c for c in below[t] if c != t and c in clade), key=lambda c: (-clade[c], -c)):
                visit(c)

        visit(1)
        return [(i + 1, *x) for i, x in enumerate(out)]

    for zeros in (False, True):
        rows = report.report_rows(counts, tax, ["kind"], zeros)
        found = sorted((r.kind, r.line, r.taxon, r.clade, r.own) for r in rows.collect())
        assert found == [(k, *x) for k, own in sets.items() for x in lines(own, zeros, 0 in own)]
        for k in "ab":
            own = sets[k]
            one = report.report_rows(counts.where(f"kind = '{k}'").drop("kind"), tax, zeros=zeros)
            assert sorted((r.line, r.taxon, r.clade, r.own) for r in one.collect()) == lines(own, zeros, zeros or 0 in own)
    empty = report.report_rows(counts.where("kind = 'no'").drop("kind"), tax)
    assert [tuple(r) for r in empty.collect()] == [(1, 0.0, 0, 0, "R", 1, "n1")]
    # as executed: no table goes through the driver for a hash table (the broadcast rows are one a report), and no window holds a whole report
    one = report.report_rows(counts.where("kind = 'a'").drop("kind"), tax)
    one.collect()
    final = "\n".join(plan(one)).split("Initial Plan")[0]
    assert "BroadcastHashJoin" not in final and "row_number" not in final


def test_pairs_of_ends_are_not_broadcast(spark):
    tax = Taxonomy.from_nodes(fx.nodes(spark, SF), at_driver=0)
    index = MinimizerIndex.build(fx.genomes(spark, SF), fx.labels(spark, SF), tax)
    same = sorted(tuple(r) for r in index.records.collect())
    assert same == sorted(tuple(r) for r in fx.index(spark, SF).records.collect())
    final = "\n".join(plan(index.records)).split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and "BroadcastHashJoin" not in final


def test_lengths_need_no_lookup(spark):
    from __spark_entry__ import queries
    from pyspark.sql import functions as F

    from cladeforge.operators import classify, minimizers

    # lengths come of the reads alone: no hit is dealt by its minimizer or read
    assert not [line for line in plan(queries()["cls_length_string_paired"](spark, SF)) if "Exchange hashpartitioning(" in line and ("title" in line or "minimizer" in line)]
    texts = ["", "ACGT", "GATTC" * 20, "N" * 50, "ACGTT" * 9 + "N" + "GGATC" * 9, "N" * 40 + "AACGT" * 12 + "\n" + "CCA" * 9, None]
    reads = spark.createDataFrame([(f"r{i}.{j}", a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "header string, nucleotides string, nucleotides2 string")
    index = fx.index(spark, SF)
    for rows in (reads, reads.drop("nucleotides2")):
        hits = classify.group_hits(classify.find_hits(minimizers.spans(rows, index.scheme), index))
        want = hits.select("title", classify.lengths(F.col("hits"), index.scheme.k).alias("length"))
        assert sorted(tuple(r) for r in classify.read_lengths(rows, index.scheme).collect()) == sorted(tuple(r) for r in want.collect())


def test_hits_stay_with_their_reads(spark):
    import random
    from types import SimpleNamespace

    from cladeforge.operators import classify

    random.seed(6)
    up = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    tax = Taxonomy.from_nodes(spark.createDataFrame([(t, u, "no rank", f"n{t}") for t, u in up.items()], "taxon int, parent int, rank string, name string"), at_driver=0)
    path = {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 4], 5: [1, 2, 3, 5]}
    # 9 is a taxon that the tree lacks; a title may be missing; an ordinal may be large
    reads = {t: [(i if i < 9 else 2**31 - 10 + i, random.random() < 0.7, random.choice((-1, 0, 1, 3, 4, 5, 9)), random.randint(1, 2**20)) for i in range(random.randint(1, 10))] for t in [None, "", *map(str, range(30))]}
    reads["mates"] = [(0, True, 3, 5), (1, False, -2, -34), (2, True, 0, 7)]
    reads["long"] = [(0, True, 5, 2**31 - 1)]
    hits = spark.createDataFrame([(t, *h) for t, x in reads.items() for h in x], "title string, ordinal int, is_distinct boolean, taxon int, count int")
    for with_hits in (True, False):
        t = classify.gather(hits, SimpleNamespace(taxonomy=tax), with_hits)
        found = {r.title: r for r in t.collect()}
        assert found.keys() == reads.keys()
        for title, x in reads.items():
            r, sums = found[title], {}
            for _, _, taxon, n in x:
                sums[taxon] = sums.get(taxon, 0) + n
            assert sorted((y.taxon, y.n, y.path) for y in r.taxa) == sorted((y, n, path[y]) for y, n in sums.items() if y in path)
            assert r.total == sum(n for y, n in sums.items() if y != -2) and r.n_distinct == sum(d and y != 0 for _, d, y, _ in x)
            assert not with_hits or [tuple(h) for h in r.hits] == [(o, y, n) for o, _, y, n in x]
        # hits are dealt by read once, and none of them goes to the taxonomy and back
        final = "\n".join(plan(t)).split("Initial Plan")[0].splitlines()
        assert len([line for line in final if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]) == 1
        assert [line for line in final if "REPARTITION_BY_COL" in line and "ReusedExchange" in line]
        assert not [line for line in final if "collect_list(struct(ordinal" in line and "_taxon" in line]


def test_reference_of_a_sample_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from cladeforge.plans import stored

    monkeypatch.setattr(stored, "folder", lambda s, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored.cmp_multi_dirs(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i in range(3):
        assert len(list((tmp_path / f"results/ref/sample{i}/reads_mapping.tsv").glob("part-*"))) > 1
