"""Toxicity, n-gram join, SentencePiece, suffix arrays and the pipeline: brute force and edge cases."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import llm_naive as naive

from cladeforge.llm import components, ngram_join, sentencepiece_codec, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, id bigint, comp bigint, d string, s string, copies int"
RNG = random.Random(8)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), 0.1, "i", 1, 2, "d", "s", 3) for d, t, s in rows], SCHEMA)


def some_text(n, top=400):
    return " ".join(f"w{RNG.randrange(top)}" for _ in range(n))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[RNG.randrange(len(w))] = f"e{RNG.randrange(9999)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs():
    rows = [(i, some_text(RNG.randrange(1, 120)), f"s{i % 3}") for i in range(80)]
    base, passage = some_text(200), some_text(70)
    rows += [(100 + i, edited(base, RNG.randrange(0, 12)), "s0") for i in range(60)]
    rows += [(200 + i, some_text(30) + " " + passage + " " + some_text(20), "s1") for i in range(20)]
    rows += [(300 + i, "The same COPY of a short text", "s2") for i in range(15)] + [(330, "the SAME copy of a short text", "s2")]
    rows += [(400, None, "s0"), (401, "", "s0"), (402, " \n ", None), (403, "one", "s0"), (404, "one", "s0"), (405, "one two", "s0"), (406, some_text(20000), "s0"), (407, "ab " * 3000, "s1"), (408, "z" * 5000, "s1"), (409, "🎉é " * 200, "s1")]
    rows += [(rows[3][0], rows[3][1], "s0")]
    return rows


@pytest.fixture(scope="module")
def table(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    frame(spark, []).write.parquet(f"{path}/empty/documents.parquet")
    for p in (path, f"{path}/empty"):
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{p}/labels.parquet")
    return str(path)


def test_ngram_join(spark, docs, table):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op4(spark, table).collect()}
    assert got == naive.linked_components({d: t for d, t, _ in docs}, 3, 90)
    assert ngram_join.op4(spark, f"{table}/empty").count() == 0


@pytest.mark.parametrize(("n", "least"), [(5, 80), (1, 60)])
def test_ngram_join_other_limits(spark, docs, n, least):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, docs), n, least).collect()}
    assert got == naive.linked_components({d: t for d, t, _ in docs}, n, least)


def test_ngram_join_in_blocks(spark, docs, monkeypatch):
    """Keys with more points than a block, tasks that flush often, no nearest partners."""
    for name, value in (("BLOCK", 7), ("NEAR_BLOCK", 5), ("HELD", 500), ("NEAREST", 0), ("FEW", 0), ("BITS", 1 << 12), ("TOKENS_HELD", 3000), ("TOKENS_IN_BUCKET", 2000), ("HOT", 5), ("MOST_COPIES", 0), ("FEW_PAIRS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, docs)).collect()}
    assert got == naive.linked_components({d: t for d, t, _ in docs}, 3, 90)


@pytest.mark.parametrize("ids", [(7, 10, 3, 4), (7, 10, 3), (7, 10, 4)])
def test_ngram_join_copies_in_any_order(spark, ids):
    """Copies with smaller ids come later in a task than those that are dealt."""
    one = " ".join(f"v{k}" for k in range(200))
    two = one.replace("v100", "other")
    rows = [(d, t, "s") for d, t in zip(ids, (one, two, two if ids[2] == 4 else one, two), strict=False)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, rows).coalesce(1)).collect()}
    assert got == dict.fromkeys(ids, min(ids))


def test_ngram_join_several_texts(spark):
    """A doc_id with two texts joins the copies of both."""
    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "vw")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, [(9, one, "s"), (9, two, "s"), (8, one, "s"), (5, two, "s")])).collect()}
    assert got == {9: 5, 8: 5, 5: 5}
    # and what is like either of them
    near = [(9, one, "s"), (9, two, "s"), (20, one.replace("v0 ", "x "), "s"), (21, two.replace("w49", "y"), "s"), (22, "a b c d", "s")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, near)).collect()}
    assert got == {9: 9, 20: 9, 21: 9, 22: 22}


def test_linked_sets_share_a_key():
    """In any one order of the shingles, the first that linked sets share is a key of both."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        least = int(rng.integers(20, 101))
        order = rng.permutation(60)
        a = set(rng.choice(60, rng.integers(1, 50), replace=False).tolist())
        b = set(x for x in a if rng.random() > 0.15) | set(rng.choice(60, rng.integers(0, 5), replace=False).tolist())
        if b and 100 * len(a & b) >= least * len(a | b):
            first = min(order[x] for x in a & b)
            for s in (a, b):
                assert first in sorted(order[x] for x in s)[: int(ngram_join.key_count(np.array([len(s)]), least)[0])]


@pytest.mark.parametrize("hot", [2, 16])
def test_ngram_join_unlike_sizes_and_hot_shingles(spark, monkeypatch, hot):
    """Sets of 20 and 33 words at 60 per cent; a passage that most texts hold; ids in no order, far apart, below 0."""
    for name, value in (("HOT", hot), ("TOKENS_HELD", 4000), ("TOKENS_IN_BUCKET", 700), ("MOST_COPIES", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = []
    for k in range(25):
        words = [f"p{k}x{j}" for j in range(33)]
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(words[:20]), "s")]
    passage = some_text(40)
    rows += [(1000 + k, f"{passage} {some_text(60)}", "s") for k in range(60)] + [(2000 + k, f"{passage} tail {'x' * (k % 3)}", "s") for k in range(60)]
    RNG.shuffle(rows)
    rows = [(d * 10**15 - 5 * 10**17, t, s) for d, t, s in rows]
    for n, least in ((1, 60), (3, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows).repartition(3), n, least).collect()}
        assert got == naive.linked_components({d: t for d, t, _ in rows}, n, least)


def test_null_id(spark):
    got = ngram_join.ngram_join(frame(spark, [(None, "a b c d", "s"), (3, "a b c d", "s"), (4, "x y z", "s")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (3, 2, 3), (4, 1, 4)]


def test_tree_loses_nothing():
    rng = np.random.default_rng(3)
    base = rng.poisson(3, (30, ngram_join.GROUPS))
    points = np.concatenate([base + rng.integers(0, 2, base.shape) for _ in range(8)])
    sizes = points.sum(1)
    for least in (80, 95):
        found = set()
        for p, q in ngram_join.tree_pairs(points, sizes, np.arange(len(points)), np.zeros(len(points)), least):
            found |= {(min(a, b), max(a, b)) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
        want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if (100 + least) * np.minimum(points[i], points[j]).sum() >= least * (sizes[i] + sizes[j])}
        assert found == want


@pytest.mark.parametrize("block", [5, 20_000])
def test_pairs_are_told_once(spark, monkeypatch, block):
    """A pair that meets under many keys is one row, not one for each key; with few keys known to be earlier none is lost."""
    monkeypatch.setattr(ngram_join, "HELD", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    held = {i: [k for k in range(-15, 15) if (k + i) % 3] if i < 12 else [100] for i in range(14)}
    named = spark.createDataFrame([(k, i, i) for i, ks in held.items() for k in ks], "key bigint, id bigint, comp bigint")
    spots = spark.createDataFrame([(i, 128, 1, [1] * ngram_join.GROUPS) for i in held], "id bigint, n bigint, scale int, point array<tinyint>")
    keys = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    want = sorted([(a, b) for a in range(12) for b in range(a + 1, 12)] + [(12, 13)])
    for earlier in (64, 4):
        monkeypatch.setattr(ngram_join, "EARLIER", earlier, raising=False)
        got = sorted(tuple(r) for r in ngram_join.searched(ngram_join.dealt_rows(named, keys, spots, None), 80, None).collect())
        assert sorted(set(got)) == want
        assert earlier == 4 or got == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_suffix_dedup(spark, docs, table, monkeypatch):
    want = naive.repeats([t for _, t, _ in docs])
    expected = sorted((d, *w) for (d, _, _), w in zip(docs, want, strict=True))
    assert sum(w[1] for w in want) > 5000
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9(spark, table).collect())
    assert got == expected
    monkeypatch.setattr(suffix_dedup, "MOST_WINDOWS", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD", 1)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9(spark, table).collect())
    assert got == expected
    assert suffix_dedup.op9(spark, f"{table}/empty").count() == 0


def test_suffix_dedup_null_ids(spark):
    t = some_text(300)
    got = suffix_dedup.cleaned(frame(spark, [(None, t, "s"), (None, "x" + t, "s"), (1, "y", "s")]))
    assert sorted(bytes(r.kept) for r in got.collect()) == [b"", b"x"]


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(1, 4, rng.integers(1, 60)).astype(np.int16)
        x[rng.random(len(x)) < 0.1] = 0
        sa = suffix_dedup.suffix_array(x)
        suffix = [x[i:].tolist() for i in range(len(x))]
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: suffix[i])
        lcp = suffix_dedup.common_prefixes(x, sa)
        for r in range(1, len(x)):
            a, b, k = suffix[sa[r - 1]], suffix[sa[r]], 0
            while k < min(len(a), len(b)) and a[k] == b[k] != 0:
                k += 1
            assert lcp[r] == k


@pytest.fixture(scope="module")
def codec():
    if not Path(sentencepiece_codec.DEFAULT_MODEL).exists():
        pytest.skip("no model")
    return sentencepiece_codec.Codec(*sentencepiece_codec.read_model(sentencepiece_codec.DEFAULT_MODEL))


ODD = ["", " ", "  two  blanks ", "\n\nx", "日本語テキスト 🎉 emoji", "a\tb\x00c", " x", "a" * 900, " " * 50 + "x", "é" * 70, "un-sep_arated/words" * 20]


def test_codec_is_that_of_the_model(codec, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    for t in [*ODD, *(t for _, t, _ in docs if t)]:
        ids = np.frombuffer(codec.encode(t), np.int32).tolist()
        assert ids == sp.encode(t), t[:60]
        assert codec.decode(ids) == t


def test_streaming_search_commits(codec):
    """The search over a long text without blanks, piece by piece, against the merges done at once."""
    t = "".join(RNG.choice("abcdefgh") for _ in range(400))
    assert list(codec.segments(t)) == codec.merged(t)
    for n in range(1, 60):
        assert list(codec.segments(t[:n])) == codec.merged(t[:n])


def test_unigram_search():
    """Viterbi over additive scores against all ways to split."""
    pieces = [("<unk>", 0.0, "unknown")] + [(p, s, "piece") for p, s in (("a", -2.5), ("b", -2.0), ("ab", -3.5), ("ba", -2.2), ("aba", -4.1), ("bb", -5.0))]
    c = sentencepiece_codec.Codec(pieces, "unigram")

    def best(t):
        table = {0: (0.0, [])}
        for i in range(1, len(t) + 1):
            options = [(table[j][0] + c.scores[t[j:i]], [*table[j][1], t[j:i]]) for j in range(i) if j in table and t[j:i] in c.scores]
            table[i] = max(options, key=lambda x: x[0])
        return table[len(t)]

    for _ in range(40):
        t = "".join(RNG.choice("ab") for _ in range(RNG.randrange(1, 60)))
        got = list(c.segments(t))
        assert "".join(got) == t and abs(sum(c.scores[p] for p in got) - best(t)[0]) < 1e-9
    assert c.ids_of("axb") == np.array([1, 0, 2], np.int32).tobytes()


def test_encode_and_decode(spark, docs, table, codec):
    v = sentencepiece_codec.codec(spark)
    t = sentencepiece_codec.encode(frame(spark, docs), v, check="round_trip")
    assert t.columns.count("ids") == 1
    back = sentencepiece_codec.decode(t, v)
    assert back.where(~F.col("round_trip")).count() == 0
    assert back.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).count() == 0
    assert sentencepiece_codec.op5(spark, f"{table}/empty").count() == 0
    # the query's rows are those of the model's own library
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    want = Counter()
    for d, text, _ in docs:
        ids = sp.encode(text or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True, tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_ids, r.ids_sha256, r.round_trip, tuple(r.ids)) for r in sentencepiece_codec.op5(spark, table).collect()) == want


def test_models_with_other_settings_are_refused():
    part = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    plain = part(2, bytes([3 << 3, 2])) + part(3, part(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0]))
    assert sentencepiece_codec.settings(plain) == {"type": 2, "suffix": 0, "charsmap": 0, "dummy_prefix": 1, "extra_blanks": 0, "user_pieces": 0}
    other = part(1, part(1, b"<x>") + bytes([3 << 3, 4])) + part(3, part(2, b"map") + bytes([3 << 3, 0]))
    assert sentencepiece_codec.settings(other) == {"type": 1, "suffix": 0, "charsmap": 3, "dummy_prefix": 0, "extra_blanks": 1, "user_pieces": 1}


def toxic_rows(n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 1
        w = some_text(RNG.randrange(3, 60)).split(" ")
        if bad:
            for _ in range(3):
                w.insert(RNG.randrange(len(w)), RNG.choice(["idiot", "grumphol", "you", "m0ron", "grumpheth"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, tmp_path):
    rows, labels = toxic_rows(1500)
    extra = [(5000, None, "s"), (5001, "", "s"), (5002, "x" * 100_000, "s"), (None, "nobody", "s"), (7, rows[7][1], "s")]
    frame(spark, rows + extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (7, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op3(spark, str(tmp_path)).collect()
    assert len(got) == 1505 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert sorted(map(str, got)) == sorted(map(str, toxicity.op3(spark, str(tmp_path)).collect()))


def test_toxicity_without_labels(spark, table, docs):
    got = toxicity.op3(spark, table).collect()
    assert len(got) == len(docs) and {r.score for r in got} == {0.0}
    assert toxicity.op3(spark, f"{table}/empty").count() == 0


def test_calibration_and_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=2000) > 1).astype(float)
    trees = toxicity.Trees(rounds=40).fit(x[:1000], y[:1000])
    raw = trees.raw(x[1000:])
    assert ((raw > 0) == y[1000:]).mean() > 0.85
    xs, ys = toxicity.isotonic(raw, y[1000:])
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fitted = np.interp(raw, xs, ys)
    assert ((fitted - y[1000:]) ** 2).mean() <= ((1 / (1 + np.exp(-raw)) - y[1000:]) ** 2).mean() + 1e-9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_rows(700)
    rows += [(1000 + i, "Write to a.b@mail.example.com about " + rows[0][1], "t") for i in range(4)]
    rows += [(2000, None, None), (2001, "", "t")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    bad = {i for i, _, t in labels if t}
    left = {r.doc_id for r in kept["toxicity"].collect()}
    assert len(left & bad) < 0.1 * len(bad) and len(left - bad) > 0.98 * (len(rows) - len(bad))
    texts = {r.doc_id: r.text for r in kept["toxicity"].collect()}
    assert {r.doc_id for r in kept["n-gram Jaccard join"].collect()} == {d for d, (_, c) in naive.linked_components(texts, 5, 80).items() if c == d}
    assert kept["PII"].where(F.contains("text", F.lit("@mail"))).count() == 0
    last = kept["SentencePiece encoding"]
    assert last.where("not round_trip").count() == 0 and last.count() == kept["mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last.count()


def test_pipeline_edges(spark, docs, tmp_path):
    """Null and repeated doc_ids, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "vw")
    rows = [(7, one, "s"), (7, two, "s"), (None, "a b", "s"), (None, "c d", "s"), (None, one, "s"), (8, one, "s"), (9, two + " tail", "s"), (7, one, "s"), (3, None, "s"), (4, "", None)]
    left = stages["n-gram Jaccard join"](spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(7, one), (7, two), (0, "a b"), (0, "c d"), (0, one), (3, ""), (4, "")])
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in ([], rows):
        kept = frame(spark, some)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, kept, str(tmp_path))
            assert name == corpus_pipeline.STAGES[-1][0] or after.columns == kept.columns
            after.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{len(some)}")
            kept = spark.read.parquet(f"{tmp_path}/{name}-{len(some)}")
        assert bool(some) == bool(kept.count())


def labelled_texts(n, seed, insults, rare=0.1, wrong=0.0):
    """Texts of words that are mostly rare, a share with insults of their own; some labels are wrong."""
    rng = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        words = [f"{rng.choice('abcdefg')}{rng.randrange(40 if rng.random() < 0.5 else 30_000)}x{rng.choice('pqrst')}" for _ in range(rng.randrange(20, 90))]
        bad = rng.random() < rare
        for _ in range(rng.randrange(3, 7) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), "s"))
        truth[i] = int(bad)
        labels.append((i, 1, int(bad) ^ (rng.random() < wrong)))
    return rows, labels, truth


@pytest.mark.parametrize(("seed", "rare", "wrong", "most"), [(1, 0.1, 0.0, 900), (2, 0.1, 0.03, 1200), (3, 0.03, 0.0, 1200), (4, 0.3, 0.1, 900), (5, 0.1, 0.02, 2000)])
def test_toxicity_labels_beyond_the_bound(spark, seed, rare, wrong, most):
    """More labelled rows than training takes; insults that no list has; rare and wrong labels."""
    rows, labels, truth = labelled_texts(3000, seed, [f"zork{c}" for c in "abcdef"], rare, wrong)
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").select("doc_id", "toxic"), most_rows=most)
    assert model.told["toxic"] + model.told["other"] == most and model.told["top"] >= 0.5
    got = toxicity.scored(docs, model).where("held_out").collect()
    caught = [r.predicted for r in got if truth[r.doc_id]]
    alarms = [r.predicted for r in got if not truth[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) and sum(alarms) <= 0.02 * len(alarms)
    # no term that only chance explains
    assert all(t in toxicity.INSULTS or t.startswith("zork") for t in model.lexicon)


def test_toxicity_conflicting_labels(spark):
    """Labels that say nothing: no score says toxic with certainty, and nothing fails."""
    rows, labels, _ = labelled_texts(600, 9, ["zork"], 0.5, 0.5)
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([*labels, *[(i, 1, 1 - t) for i, _, t in labels[:50]]], "doc_id bigint, quality int, toxic int").select("doc_id", "toxic"))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, model).collect())
