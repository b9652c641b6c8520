"""Taxonomy, minimizers, classification, weights and comparison against plain versions."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from naive import Tree, encode, priority, revcomp, spans, supermers
from pyspark.sql import functions as F

from cladeforge.functions import alphabet
from cladeforge.functions.alphabet import Scheme
from cladeforge.operators import bracken, classify, compare, dynamic, kmers as kmer_tables, masking, minimizers, report
from cladeforge.operators.index import MinimizerIndex
from cladeforge.operators.taxonomy import DEPTH, RANKS, Taxonomy

NODES = "taxon int, parent int, rank string, name string"


def random_nodes(rng, size=60):
    """A tree by levels, some nodes without a rank."""
    titles = [t for t, _, d in RANKS if d > 0]
    out, ids, next_id = [(1, 1, "root", "root")], {0: [1]}, 2
    for level, title in enumerate(titles, 1):
        ids[level] = []
        for _ in range(size // 8 + 1):
            parent = rng.choice([i for x in range(level) for i in ids[x]])
            out.append((next_id, parent, title if rng.random() < 0.8 else "clade", f"n{next_id}"))
            ids[level].append(next_id)
            next_id += 1
    return out


@pytest.fixture(scope="module", params=[1, 2])
def tree(request, spark):
    nodes = random_nodes(random.Random(request.param))
    return nodes, Tree(nodes), Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES))


def test_taxonomy_columns(tree):
    nodes, naive, tax = tree
    rank = {t: r for t, _, r, _ in nodes}
    rows = {r.taxon: r for r in tax.table.collect()}
    assert set(rows) == {n[0] for n in nodes}
    for t, r in rows.items():
        path = naive.path(t)
        depths = [next((DEPTH[rank[x]] for x in naive.path(y) if rank[x] in DEPTH), 0) for y in path]
        assert r.path == path[::-1] and r.depths == depths[::-1] and r.depth == depths[0] and r.level == len(path) - 1
        below = [x for x in rows if t in naive.path(x)]
        assert {x for x in rows if r.pre <= rows[x].pre <= r.end} == set(below)
        assert r.leaf == (len(below) == 1)
        n = 0
        while n < len(path) and depths[n] == depths[0]:
            n += 1
        assert r.sublevel == n - 1


def test_layout_by_spark_equals_the_drivers(tree, spark):
    nodes, _, tax = tree
    laid = Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES), at_driver=0)
    assert laid.table.schema.simpleString() == tax.table.schema.simpleString()
    assert {r.taxon: r for r in laid.table.collect()} == {r.taxon: r for r in tax.table.collect()}


@pytest.mark.parametrize("at_driver", [0, 100])
def test_layout_of_odd_nodes(spark, at_driver):
    """A long chain, ids far apart under one parent, orphans, circles, a node that is its own parent, repeated rows, nulls."""
    chain = [(10 + i, 9 + i if i else 1, "clade", None) for i in range(37)]
    wide = [(2_000_000_000 - i * 70_000, 1, "species", f"w{i}") for i in range(5)]
    off = [(301, 999, "species", "orphan"), (302, 301, None, "below"), (303, 304, None, ""), (304, 303, None, ""), (305, 304, None, ""), (306, 306, None, "self"), (307, None, None, ""), (None, 1, None, "")]
    nodes = [(1, 1, "no rank", "root"), *chain, *wide, *off, (10, 1, "clade", "second"), chain[3]]
    rows = {r.taxon: r for r in Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES), at_driver=at_driver).table.collect()}
    assert set(rows) == {1, *(n[0] for n in chain), *(n[0] for n in wide)}
    assert (rows[1].rank, rows[1].parent, rows[1].pre, rows[1].end) == ("root", 0, 0, 42)
    last = rows[46]
    assert last.path == [1, *range(10, 47)] and last.level == last.below_rank == last.sublevel == 37 and last.leaf and last.name is None
    # siblings in descending order of ids
    assert [rows[n[0]].pre for n in wide] == [1, 2, 3, 4, 5] and rows[10].pre == 6 and last.pre == last.end == 42


@pytest.mark.parametrize("at_driver", [0, 100])
def test_layout_without_a_root(spark, at_driver):
    for nodes in ([], [(5, 1, "species", ""), (6, 5, "species", "")]):
        assert Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES), at_driver=at_driver).table.count() == 0


def test_ancestors_and_closures(tree, spark):
    _, naive, tax = tree
    taxa = sorted(naive.parent)
    got = {r.taxon: (r.g, r.s) for r in tax.table.select("taxon", Taxonomy.at_level(7).alias("g"), Taxonomy.standard_at_level(7).alias("s")).collect()}
    depth = {r.taxon: r.depth for r in tax.table.collect()}
    for t in taxa:
        path = naive.path(t)
        deep = []
        for x in path:
            if depth[x] < 7:
                break
            deep.append(x)
        assert got[t] == (next((x for x in path if depth[x] == 7), None), deep[-1] if deep else None)
    some = spark.createDataFrame([(t,) for t in taxa[::7]], "taxon int")
    assert {r.taxon for r in tax.closure_up(some).collect()} == {x for t in taxa[::7] for x in naive.path(t)}
    assert {r.taxon for r in tax.closure_down(some).collect()} == {x for x in taxa if set(naive.path(x)) & set(taxa[::7])}
    a, b = {x for t in taxa[::7] for x in naive.path(t)} - {1}, {x for t in taxa[::5] for x in naive.path(t)} - {1}
    assert tax.unifrac(some, spark.createDataFrame([(t,) for t in taxa[::5]], "taxon int")).first().distance == len(a ^ b) / len(a | b)


def test_lca(tree, spark):
    _, naive, tax = tree
    rng = random.Random(5)
    taxa = sorted(naive.parent)
    pairs = [(i, rng.choice([0, *taxa]), rng.choice([0, *taxa])) for i in range(300)]
    got = {r.i: r.lca for r in tax.lca_of_pairs(spark.createDataFrame(pairs, "i int, a int, b int"), "a", "b").collect()}
    assert got == {i: naive.lca(a, b) for i, a, b in pairs}
    rows = [(rng.randrange(80), rng.choice(taxa)) for _ in range(250)]
    want = {}
    for k, t in rows:
        want[k] = naive.lca(want.get(k, 0), t)
    assert {r.k: r.taxon for r in tax.lca(spark.createDataFrame(rows, "k int, taxon int"), ["k"]).collect()} == want


def test_words(spark):
    rng = random.Random(3)
    w = ["".join(rng.choice("ACGT") for _ in range(31)) for _ in range(50)]
    s = Scheme()
    df = spark.createDataFrame([(x,) for x in w], "w string")
    for r in df.select("w", alphabet.encode(F.col("w")).alias("e"), alphabet.decode(alphabet.encode(F.col("w")), 31).alias("d"), alphabet.reverse_complement(F.col("w")).alias("r"), alphabet.priority(F.col("w"), s).alias("p")).collect():
        assert (r.e, r.d, r.r, r.p) == (encode(r.w), r.w, revcomp(r.w), priority(r.w, s))
    assert spark.range(1).select(alphabet.reverse_complement(F.lit("acgunX\n")).alias("r")).first().r == "\nNNACGT"


def test_spaced_mask():
    s = Scheme(9, 9, 3)
    seen = "".join("-" if (s.space_mask >> 2 * p) & 3 == 0 else c for p, c in zip(range(8, -1, -1), "TTCTGTGGG", strict=True))
    assert seen == "TTC-G-G-G"


def test_known_split():
    s = Scheme(5, 2, 0, canonical=False, toggle=0)
    seq = "AATTTACTTTAGTTAC"
    got = minimizers.supermers([seq.encode()], s)
    parts = [seq[a : a + n + 4] for a, n in zip(got["location"], got["kmers"], strict=True)]
    assert parts == ["AATTT", "ATTTA", "TTTACTTT", "CTTTA", "TTTAGTTA", "GTTAC"]


@pytest.mark.parametrize("scheme", [Scheme(35, 31, 7), Scheme(9, 5, 2), Scheme(7, 7, 0), Scheme(11, 1, 0), Scheme(21, 13, 3, canonical=False)])
def test_spans_and_positions(spark, scheme):
    rng = random.Random(scheme.k)
    seqs = ["".join(rng.choice("ACGTacgtU" if rng.random() < 0.98 else "NX-") for _ in range(rng.randrange(0, 160))) for _ in range(60)]
    seqs += ["", "N" * 50, "ACGT" * 30, "A" * 100]
    pairs = [(f"r{i}", s, seqs[-i] if i % 3 else None) for i, s in enumerate(seqs)]
    rows = minimizers.spans(spark.createDataFrame(pairs, "header string, nucleotides string, nucleotides2 string"), scheme).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.title, r.ordinal)):
        assert r.ordinal == len(got.setdefault(r.title, []))
        got[r.title].append((r.flag, r.is_distinct, r.kmers, r.minimizer))
    assert got == {h: x for h, a, b in pairs if (x := spans(a, b, scheme))}
    clean = [s.upper().replace("U", "T") for s in seqs if s and set(s.upper()) <= set("ACGTU")]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(clean)], "header string, nucleotides string")
    want = {(f"s{i}", *x) for i, s in enumerate(clean) for x in supermers(s, scheme)}
    assert {(r.header, r.location, r.kmers, r.minimizer) for r in minimizers.positions(df, scheme).collect()} == want
    if scheme.canonical:
        assert {(r.header, r.location, r.kmers, r.minimizer) for r in minimizers.supermers_by_window(df, scheme).collect()} == want


def as_number(words, scheme):
    n = 0
    for w in words:
        n = n << 64 | (w & (1 << 64) - 1)
    return n >> 2 * (32 * len(scheme.rests) - scheme.m)


@pytest.mark.parametrize("m", [32, 33, 47, 64, 91])
def test_wide_minimizers(spark, m, tmp_path):
    scheme = Scheme(m + 8, m, 5)
    rng = random.Random(m)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(60, 220))) for _ in range(12)]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(seqs)], "header string, nucleotides string")
    toggle = as_number(scheme.xor_words, scheme)
    wide = Scheme(m + 8, m, 5, toggle=toggle)
    want = {(f"s{i}", *x) for i, s in enumerate(seqs) for x in supermers(s, wide)}
    assert {(r.header, r.location, r.kmers, as_number(r.minimizer, scheme)) for r in minimizers.positions(df, scheme).collect()} == want
    tax = Taxonomy.from_nodes(spark.createDataFrame([(1, 1, "root", ""), *[(2 + i, 1, "species", "") for i in range(12)]], NODES))
    index = MinimizerIndex.build(df, spark.createDataFrame([(f"s{i}", 2 + i) for i in range(12)], "header string, taxon int"), tax, scheme)
    index.write(str(tmp_path / "i"), 2)
    loaded = MinimizerIndex.load(spark, str(tmp_path / "i"), tax)
    assert loaded.records.count() == len({x[3] for x in want})
    out = classify.classify(df, loaded, min_hit_groups=1).collect()
    assert {r.title: r.taxon for r in out} == {f"s{i}": 2 + i for i, s in enumerate(seqs) if len(s) >= m + 8}
    assert loaded.respace(9).records.count() <= loaded.records.count()


@pytest.mark.parametrize(("k", "canonical"), [(1, True), (4, False), (12, True), (21, False), (31, True), (32, True), (33, False), (70, True)])
def test_counts_through_supermers(spark, k, canonical):
    """k-mers against counting word by word: other letters, lower case, repeats longer than a piece, equal rows, abundances."""
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT" if rng.random() < 0.98 else "NacgU") for _ in range(rng.randrange(0, 300))) for _ in range(40)]
    seqs += ["", "A" * 900, "AT" * 300, "ACG" * 120, "ACG" * 120, None]
    rows = [(f"h{i % 30}", s, i % 4 if i % 9 else None) for i, s in enumerate(seqs)]
    want = Counter()
    for _, s, a in rows:
        text = (s or "").upper().replace("U", "T")
        for i in range(len(text) - k + 1):
            w = text[i : i + k]
            if "N" not in w and a is not None:
                want[min(w, revcomp(w)) if canonical else w] += a
    df = spark.createDataFrame(rows, "header string, nucleotides string, a int")
    got = {r.word: r.n for r in kmer_tables.counts(df, k, canonical, "a").collect()}
    assert {w: n for w, n in got.items() if n} == {w: n for w, n in want.items() if n}
    plain = kmer_tables.counts(df, k, canonical)
    assert plain.count() == plain.select("word").distinct().count()
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_letters_of_supermers(spark):
    scheme = Scheme(9, 5, 2)
    seqs = ["ACGTACGGTTACGACNNACGTTGCAAACCA", "A" * 100, "ACG\nTACGGTT", "ACG", ""]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(seqs)], "header string, nucleotides string")
    got = minimizers.supermers_with_letters(df, scheme).select("header", "location", "kmers", alphabet.unpacked(F.col("letters"), F.col("kmers") + 8).alias("x")).collect()
    for r in got:
        text = seqs[int(r.header[1:])].replace("\n", "")
        assert r.x == text[r.location : r.location + r.kmers + 8]
    assert sum(r.kmers for r in got) == 7 + 5 + 92 + 2


def test_whitespace_is_skipped():
    s = Scheme(9, 5, 2)
    a, b = minimizers.supermers([b"ACGTACGGTTACGAC"], s), minimizers.supermers([b"ACGTA\nCGGTT\r\nACGAC\n"], s)
    assert all((a[c] == b[c]).all() for c in a if c != "words")


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(9)
    nodes = random_nodes(rng, 40)
    naive = Tree(nodes)
    taxa = [t for t, *_ in nodes if t > 20][:12]
    common_part = "".join(rng.choice("ACGT") for _ in range(200))
    genomes = [(f"g{t}", common_part[:150] + "".join(rng.choice("ACGT") for _ in range(300)), t) for t in taxa]
    tax = Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES))
    seqs = spark.createDataFrame([(h, s) for h, s, _ in genomes], "header string, nucleotides string")
    labels = spark.createDataFrame([(h, t) for h, _, t in genomes] + [("g0", 999999)], "header string, taxon int")
    return nodes, naive, tax, genomes, seqs, labels


SMALL = Scheme(21, 15, 3)


def naive_index(genomes, naive):
    out = {}
    for _, s, t in genomes:
        for _, _, rank in supermers(s, SMALL):
            out[rank] = naive.lca(out.get(rank, 0), t)
    return out


def naive_class(seq, mate, index, naive, confidence, groups=2):
    found = spans(seq, mate, SMALL)
    if not found:
        return None
    counts, distinct, total = {}, 0, 0
    for flag, new, n, rank in found:
        if flag == 3:
            continue
        total += n
        taxon = index.get(rank, 0) if flag == 1 else -1
        if taxon >= 0:
            counts[taxon] = counts.get(taxon, 0) + n
        distinct += new and taxon > 0
    return naive.resolve(counts, math.ceil(confidence * total)) if distinct >= groups else 0


def test_build_classify_and_report(spark, library, tmp_path):
    nodes, naive, tax, genomes, seqs, labels = library
    index = MinimizerIndex.build(seqs, labels, tax, SMALL)
    want = naive_index(genomes, naive)
    assert {r.id1: r.taxon for r in index.records.collect()} == want
    rng = random.Random(4)
    reads = []
    for i in range(150):
        _, s, _ = rng.choice(genomes)
        at = rng.randrange(0, 380)
        r = list(s[at : at + 70])
        for _ in range(rng.choice([0, 0, 1, 4])):
            r[rng.randrange(len(r))] = rng.choice("ACGTN")
        reads.append((f"S{i % 3}:{i}", "".join(r), revcomp(s[at : at + 60]) if i % 2 else None))
    reads += [("S0:short", "ACGT", None), ("S1:pair", "ACGT", "ACG"), ("none", "".join(rng.choice("ACGT") for _ in range(60)), None), ("n", "N" * 60, None)]
    df = spark.createDataFrame(reads, "header string, nucleotides string, nucleotides2 string")
    index.write(str(tmp_path / "index"), 3)
    loaded = MinimizerIndex.load(spark, str(tmp_path / "index"), tax)
    assert loaded.scheme == SMALL
    levels = [0.0, 0.2, 0.9]
    out = classify.classify(df, loaded, levels, sample_regex=r"^(S\d)")
    got = {(r.title, r.threshold): r for r in out.collect()}
    for h, a, b in reads:
        for c in levels:
            expected = naive_class(a, b, want, naive, c)
            assert (got[h, c].taxon if (h, c) in got else None) == expected, (h, c)
    assert ("S0:short", 0.0) not in got and got["S1:pair", 0.0].taxon == 0
    assert got["none", 0.0].sample == "other" and got["S1:pair", 0.0].length == "20|20" and got["S1:pair", 0.0].details == "|:|"
    assert got["n", 0.0].details == "A:40" and got["n", 0.0].length == "60"
    counts = out.where("threshold = 0").groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))
    lines = report.report_rows(counts, tax).orderBy("line").collect()
    tally = {r.taxon: r.n for r in counts.collect()}
    assert lines[0].taxon == 0 and lines[0].clade == tally[0] and lines[1].taxon == 1
    clades = {}
    for t, n in tally.items():
        for x in naive.path(t):
            clades[x] = clades.get(x, 0) + n
    assert {r.taxon: r.clade for r in lines[1:]} == {1: 0} | clades
    # depth first, larger clades first, larger ids first among equals
    def walk(t):
        yield t
        for c in sorted((c for c in naive.parent if naive.parent[c] == t and clades.get(c)), key=lambda c: (-clades[c], -c)):
            yield from walk(c)

    assert [r.taxon for r in lines[1:]] == list(walk(1))


def test_dynamic_and_stats(spark, library):
    _, naive, tax, genomes, seqs, labels = library
    index = MinimizerIndex.build(seqs, labels, tax, SMALL)
    reads = spark.createDataFrame([(f"r{i}", g[1][a : a + 80]) for i, (g, a) in enumerate((g, a) for g in genomes[:4] for a in range(160, 360, 20))], "header string, nucleotides string")
    deep = {r.taxon for r in tax.table.where("depth >= 1").collect()}
    for kind, least in (("reads", 2), ("total", 3), ("distinct", 3), ("fraction", 0.01)):
        taxa = {r.taxon for r in dynamic.taxon_set(reads, index, dynamic.Criterion(kind, least, 0.0), "superkingdom").collect()}
        assert {g[2] for g in genomes[:4]} & deep <= taxa
    again = dynamic.two_step(reads, seqs, labels, index, dynamic.Criterion("reads", 2, 0.0), "superkingdom", with_details=False)
    assert {r.taxon for r in again.collect()} - {0} <= {x for g in genomes for x in naive.path(g[2])}
    wider = index.respace(5)
    assert wider.records.count() <= index.records.count()
    with pytest.raises(ValueError, match="spaces"):
        index.respace(2)
    assert index.migration(index).where("steps <> 0").count() == 0
    assert index.genome_sizes(seqs, labels).where(f"size <> {450 - SMALL.k + 1}").count() == 0
    assert dynamic.Criterion().kind == "reads"


def test_weights_match_classification_of_each_window(spark, library):
    _, naive, tax, genomes, seqs, labels = library
    index = MinimizerIndex.build(seqs, labels, tax, SMALL)
    known = naive_index(genomes, naive)
    want = {}
    for _, s, t in genomes:
        for a in range(len(s) - 50 + 1):
            d = naive_class(s[a : a + 50], None, known, naive, 0.0)
            want[d, t] = want.get((d, t), 0) + 1
    for most in (1 << 20, 120):
        got = {(r.dest, r.source): r.n for r in bracken.weights(seqs, labels, index, 50, most).collect()}
        assert sum(got.values()) == sum(want.values())
        assert got == want, most
    lines = bracken.distribution_lines(bracken.weights(seqs, labels, index, 50)).collect()
    assert all(":" in r.line for r in lines)


@pytest.mark.parametrize("seed", range(6))
def test_window_sweep(seed):
    """Windows of random letters, repeats and gaps against each window on its own, with taxa in lineages so that scores tie and cross."""
    rng = random.Random(seed)
    scheme = Scheme(9, 5, 0)
    nodes = random_nodes(rng, 40)
    naive = Tree(nodes)
    taxa = rng.sample([t for t, *_ in nodes], 12)
    unit = "".join(rng.choice("ACGT") for _ in range(30))
    text = "".join(rng.choice([unit, unit[::-1], "N" * rng.randint(1, 14), "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60)))]) for _ in range(14))
    index = {x[3]: rng.choice(taxa) for x in spans(text, None, scheme) if x[0] == 1 and rng.random() < 0.8}
    ids, known = np.array(list(index), np.int64), np.array(list(index.values()), np.int32)
    ways = bracken.Ways({t: naive.path(t)[::-1] for t in taxa})
    for length in (8, 9, 10, 20, 45, len(text), len(text) + 1):
        expected = Counter()
        for i in range(len(text) - length + 1):
            found = [x for x in spans(text[i : i + length], None, scheme) if x[0] == 1]
            counts, groups = Counter(), 0
            for _, new, n, rank in found:
                taxon = index.get(rank, 0)
                groups += bool(new and taxon)
                if taxon:
                    counts[taxon] += n
            expected[naive.resolve(counts, 0) if groups >= 2 else 0] += 1
        assert Counter(bracken.simulated(text.encode(), bracken.lookup(ids, known, scheme), ways, scheme, length)) == expected


def test_weights_of_wide_minimizers(spark, library):
    """A word of over 31 letters stands for itself as one of 31 does: equal genomes give equal weights by both."""
    _, _, tax, genomes, seqs, labels = library
    sums = []
    for scheme in (Scheme(40, 33, 0), Scheme(40, 31, 0)):
        rows = bracken.weights(seqs, labels, MinimizerIndex.build(seqs, labels, tax, scheme), 80).collect()
        sums.append(sum(r.n for r in rows))
        assert any(r.dest == r.source for r in rows)
    assert sums[0] == sums[1] == sum(len(s) - 79 for _, s, _ in genomes)


def test_hit_categories(spark):
    nodes = [(1, 1, "root", ""), (2, 1, "genus", ""), (3, 2, "species", ""), (4, 3, "species", ""), (5, 4, "species", ""), (6, 2, "species", "")]
    tax = Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES))
    cases = [(2, 2, "TruePos", 0), (3, 2, "VaguePos", 1), (4, 2, "VaguePos", 1), (3, 1, "VaguePos", 8), (3, 6, "FalsePos", 9), (4, 3, "TruePos", 0), (3, 0, "FalseNeg", 9), (3, 5, "TruePos", 0)]
    df = spark.createDataFrame([(i, r, t) for i, (r, t, *_) in enumerate(cases)], "i int, ref_taxon int, test_taxon int")
    got = {r.i: (r.category, r["index"]) for r in compare.hit_categories(df, tax, "species").collect()}
    assert got == {i: (c, x) for i, (_, _, c, x) in enumerate(cases)}
    m = compare.all_metrics(df, df.select("ref_taxon"), tax, least=1).collect()
    assert {r["rank"] for r in m} == {"genus", "species"}


def test_metrics_of_many_results_equal_those_of_each(spark):
    rng = random.Random(3)
    nodes = random_nodes(rng, 40)
    tax = Taxonomy.from_nodes(spark.createDataFrame(nodes, NODES))
    taxa = [n[0] for n in nodes]
    truth = {(s, str(i)): rng.choice(taxa) for s in "ab" for i in range(40)}
    found = [(f"x/{t}/sample={s}", s, i, rng.choice([0, ref, *rng.sample(taxa, 2)])) for t in range(3) for (s, i), ref in truth.items()]
    found += [("x/0/sample=none", "none", "1", 1)]
    found = spark.createDataFrame(found, "title string, sample string, id string, test_taxon int")
    reference = spark.createDataFrame([(*k, v) for k, v in truth.items()], "sample string, id string, ref_taxon int")
    got = {(r.title, r.sample, r["rank"]): r.asDict() for r in compare.many_metrics(found, reference, tax, least=2).collect()}
    assert len(got) == 12
    for title, sample in (("x/0/sample=a", "a"), ("x/2/sample=b", "b")):
        own = reference.where(F.col("sample") == sample)
        for r in compare.all_metrics(found.where(F.col("title") == title).drop("title", "sample").join(own, "id"), own, tax, least=2).collect():
            one = r.asDict()
            assert {k: v for k, v in got[title, sample, r["rank"]].items() if k in one} == one
    m = compare.with_title_fields(spark.createDataFrame([("f/g/lib_x_35_31_s7_c0.15_classified/sample=S1",), ("other",)], "title string")).collect()
    assert [tuple(r)[1:] for r in m] == [("f", "g", "lib_x", "35", "31", "7", "0.15", "S1")]


def test_bad_arguments(spark):
    for a in ((150, 129, 7), (5, 6, 0), (35, 31, 16)):
        with pytest.raises(ValueError):
            Scheme(*a)
    with pytest.raises(ValueError):
        classify.classify_gathered(spark.createDataFrame([], "title string, taxa array<struct<taxon:int,n:int,path:array<int>>>, total bigint, n_distinct bigint"), 35, [1.5])
    assert classify.threshold_texts([0, 0.15, 0.5]) == ["0.00", "0.15", "0.50"]


def dust(text, window, threshold):
    """Letters in intervals whose score is over the threshold and that no part of scores higher, by all intervals."""
    scores = {}
    for a in range(len(text)):
        for b in range(a + 4, min(len(text), a + window) + 1):
            part = text[a:b]
            if set(part) <= set("ACGT"):
                n = Counter(part[i : i + 3] for i in range(len(part) - 2))
                scores[a, b] = Fraction(sum(x * (x - 1) // 2 for x in n.values()), b - a - 3)
    out = set()
    for (a, b), s in scores.items():
        if s > Fraction(threshold, 10) and all(o <= s for (c, d), o in scores.items() if c >= a and d <= b):
            out.update(range(a, b))
    return "".join("x" if i in out else c for i, c in enumerate(text))


@pytest.mark.parametrize(("window", "threshold"), [(64, 20), (12, 12), (20, 5)])
def test_low_complexity(spark, window, threshold, monkeypatch):
    rng = random.Random(window)
    seqs = ["", "A", "ACG", "AAAA", "A" * 30, "ACGTNNNNNNNNACGT", "x" * 20, "AT" * 12 + "N" + "TA" * 9]
    seqs += ["".join(rng.choice("ACGT") for _ in range(10)) + rng.choice(["A", "AC", "ACG", "TTG"]) * rng.randrange(3, 9) + "".join(rng.choice("ACGTN") for _ in range(15)) for _ in range(12)]
    df = spark.createDataFrame([(f"s{i}", s, s[::-1], i) for i, s in enumerate(seqs)] + [("none", None, None, 0)], "header string, nucleotides string, nucleotides2 string, other int")
    want = {f"s{i}": dust(s, window, threshold) for i, s in enumerate(seqs)} | {"none": None}
    got = masking.masked(df, window=window, threshold=threshold).collect()
    assert {r.header: r.nucleotides for r in got} == want
    assert all(r.nucleotides2 is None or r.nucleotides2 == dust(seqs[int(r.header[1:])][::-1], window, threshold) for r in got)
    monkeypatch.setattr(masking, "PIECE", 17)
    whole = "N".join(seqs).encode()
    hit = masking.low_complexity(np.frombuffer(whole, np.uint8), window, threshold)
    monkeypatch.undo()
    assert (hit == masking.low_complexity(np.frombuffer(whole, np.uint8), window, threshold)).all()


@pytest.mark.parametrize("m", [20, 40])
def test_stored_indexes_are_joined_as_they_lie(spark, m, tmp_path):
    """Neither index is dealt anew, narrow or wide, when two are compared or reads are looked up."""
    scheme, rng = Scheme(m + 8, m, 5), random.Random(m)
    df = spark.createDataFrame([(f"s{i}", "".join(rng.choice("ACGT") for _ in range(200))) for i in range(6)], "header string, nucleotides string")
    tax = Taxonomy.from_nodes(spark.createDataFrame([(1, 1, "root", ""), *[(2 + i, 1, "species", "") for i in range(6)]], NODES))
    labels = spark.createDataFrame([(f"s{i}", 2 + i) for i in range(6)], "header string, taxon int")
    loaded = []
    for name, some in (("a", labels), ("b", labels.where("taxon > 3"))):
        built = MinimizerIndex.build(df, some, tax, scheme)
        built.write(str(tmp_path / name), 4)
        loaded.append(MinimizerIndex.load(spark, str(tmp_path / name), tax))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        both = loaded[1].in_both(loaded[0])
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.where("t1 = t2").count() == both.count() == loaded[1].records.count()
        hits = loaded[0].looked_up(minimizers.spans(df, scheme), "minimizer")
        assert hits._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert loaded[1].migration(loaded[0]).where("steps <> 0").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
