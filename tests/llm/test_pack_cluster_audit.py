"""Packing, ball k-means and the divergence audit: brute force and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.llm import ball_kmeans, divergence, packing

RNG = random.Random(11)
SCHEMA = "doc_id bigint, text string, lang string, source string, length int, h string, bucket int, start string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, source, 7, "h", 3, "s") for d, t, lang, source in rows], SCHEMA)


def some_text(n):
    return " ".join(RNG.choice(["the", "word", f"w{RNG.randrange(999)}", "été", "l'eau,", "12.5", "A\nB", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rows = [(i, some_text(int(RNG.lognormvariate(5, 1.3))), "en", "s") for i in range(150)]
    rows += [(200, None, "en", "s"), (201, "", None, None), (202, "日本語 и кириллица 🎉", "", "s"), (203, "a <|endoftext|> b", "en", "s"), (204, some_text(9000), "en", "s")]
    rows += [(None, some_text(40), "en", "s"), (205, "x" * 5000, "en", "s"), (206, " \t\n " * 900, "en", "s"), (207, "trailing     x\x1c y ­", "en", "s")]
    return rows + [rows[3], rows[3]]


def ids_of(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(packing.default_tokenizer())
    return [[*known.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_packing_rows(spark, texts):
    rows = packing.packed(frame(spark, texts), ids=False).collect()
    wanted = defaultdict(list)
    for (d, *_), ids in zip(texts, ids_of([t[1] for t in texts]), strict=True):
        wanted[d].append(ids)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(wanted)
    for d, own in wanted.items():
        if len(own) > 1:
            # repeated rows: every id as often as there are rows
            assert sum(r.length for r in got[d]) == sum(map(len, own))
        else:
            at = 0
            for r in sorted(got[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0]) and 0 < r.length <= packing.WINDOW
                at += r.length
            assert at == len(own[0])
        for r in got[d]:
            assert r.ids_crc32 == zlib.crc32(np.array(own[0][r.start : r.start + r.length], "<u4").tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or (at < packing.WINDOW and at & (at - 1) == 0)


def test_packing_small_window_and_ids(spark, texts):
    """Ids of the pieces, laid out by sequence; the same places as without ids."""
    docs = frame(spark, [t for t in texts if t[0] is not None and t[0] < 60])
    with_ids = packing.packed(docs, window=64).cache()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(tuple, with_ids.select(names).collect())) == sorted(map(tuple, packing.packed(docs, window=64, ids=False).select(names).collect()))
    laid = {r.sequence_id: r.ids for r in packing.sequences(with_ids, 64).collect()}
    assert all(len(v) == 64 or len(v) & (len(v) - 1) == 0 for v in laid.values())
    wanted = Counter(i for ids in ids_of([t[1] for t in texts if t[0] is not None and t[0] < 60]) for i in ids)
    assert Counter(i for v in laid.values() for i in v) == wanted
    assert packing.packed(docs.limit(0)).count() == packing.packed(docs.limit(0), ids=False).count() == 0


def test_packing_one_length_only(spark):
    """Nothing fills a window: everything is laid end to end and cut."""
    docs = frame(spark, [(i, "the " * 12 + "the", "en", "s") for i in range(40)])
    rows = packing.packed(docs, window=17, ids=False).collect()
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert sum(fills.values()) == 40 * 14 and sum(n != 17 for n in fills.values()) <= 4


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_uses_what_there_is(seed):
    rng = np.random.default_rng(seed)
    have = np.zeros(257, np.int64)
    have[1:] = rng.integers(0, [3, 50, 4000][seed % 3], 256) * (rng.random(256) < [1, 0.1][seed // 3])
    slots, left, first = packing.planned(have.copy(), 256)
    filled, used = Counter(), np.zeros(257, np.int64)
    for v, own in slots.items():
        n = int(have[v] - left[v])
        for (rank, sequence, offset), to in zip(own, [*(s[0] for s in own[1:]), n], strict=True):
            assert rank < to
            used[v] += to - rank
            for k in range(to - rank):
                filled[sequence + k] += v
    assert (used == have - left).all() and (left >= 0).all()
    assert set(filled.values()) <= {256} and sorted(filled) == list(range(first))


def test_packing_plan_leaves_little():
    """Lengths most of which are short, as documents' are: nearly all fill windows without a cut."""
    rng = np.random.default_rng(1)
    # tails of lengths as they come
    have = np.bincount(rng.lognormal(4, 1, 200_000).astype(int) % 256, minlength=257)
    have[0] = 0
    _, left, _ = packing.planned(have.copy(), 256)
    assert (left * np.arange(257)).sum() < 0.02 * (have * np.arange(257)).sum()


def test_packing_least_squares():
    """With the fills that made a histogram, the solution tells it again."""
    fills = np.array([[0, 3, 5], [0, 4, 4], [2, 3, 3]])
    have = np.zeros(9)
    for row, n in zip(fills, (70, 40, 11), strict=True):
        for v in row[row > 0]:
            have[v] += n
    x = packing.repeat_counts(fills, have, sweeps=2000)
    assert np.abs(x - [70, 40, 11]).max() < 1


def brute_kmeans(vectors, k, rounds, seed=3):
    import hashlib

    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in vectors if v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    text = lambda i: "" if i is None else str(i)
    centroids = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{text(r[0])}".encode()).hexdigest(), r[0] or -1, r[1]))[:k]]
    place = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[place(x)[1]].append(x)
        centroids = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if members[j] else c for j, c in enumerate(centroids)]
    return sorted((text(i), place(x)[1], place(x)[0]) for i, x in kept), centroids


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_ball_kmeans(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    middle = rng.normal(0, 1, (6, 4))
    rows = [(i, [float(x) for x in np.float32(middle[i % 6] + rng.normal(0, spread, 4))], 5) for i in range(400)]
    rows += [(500 + i, [0.5, 0.25, -0.5, 0.0], 1) for i in range(30)] + [rows[7], rows[7]]
    rows += [(900, None, 1), (901, [1.0, 2.0], 1), (902, [1.0, None, 1.0, 1.0], 1), (903, [float("nan"), 1.0, 1.0, 1.0], 1), (904, [float("-inf"), 1.0, 1.0, 1.0], 1), (None, [0.1, 0.2, 0.3, 0.4], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster int")
    got, centroids, taken = ball_kmeans.ball_kmeans(df, k=6, rounds=5, size=4)
    want, means = brute_kmeans([(i, v) for i, v, _ in rows], 6, 5)
    assert centroids.tolist() == means
    assert sorted(("" if r.vec_id is None else str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    if spread < 0.1:
        # the core is compared with its own centroid alone
        assert taken[-1] < 2 * len(want)


def test_ball_kmeans_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3e30, -3e30])], "vec_id bigint, embedding array<float>")
    got, centroids, _ = ball_kmeans.ball_kmeans(df, k=8, rounds=2, size=2)
    assert {r.vec_id: r.distance for r in got.collect()} == {1: 0, 2: 0} and np.abs(centroids).max() == ball_kmeans.BOUND
    got, centroids, _ = ball_kmeans.ball_kmeans(df.limit(0), size=2)
    assert got.count() == 0 and len(centroids) == 0


def test_nearest_whatever_the_hint():
    rng = np.random.default_rng(4)
    for _ in range(60):
        c = rng.integers(-6, 7, (5, 2))
        c[4] = c[1]
        x, hint = rng.integers(-8, 9, (80, 2)), rng.integers(0, 5, 80)
        to, d, _ = ball_kmeans.nearest(x, hint, c)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (to == every.argmin(1)).all() and (d == every.min(1)).all()


def brute_audit(rows, least, most):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}

        def p(c, kept=kept):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // total for t in kept}

        q, ps = p(sum(count.values(), Counter())), {s: p(c) for s, c in count.items()}
        for s in count:
            pair = sorted(((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in count if o != s))
            term = sorted((q[t] - ps[s][t], t.encode()) for t in kept if count[s][t] and ps[s][t] > q[t])[:most]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "in_block", "held"), [(3, 4, 1024, 200_000), (2, 50, 7, 40), (1, 1, 3, 5)])
def test_divergence(spark, monkeypatch, least, most, in_block, held):
    monkeypatch.setattr(divergence, "IN_BLOCK", in_block)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(least)
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "Z", None, "é"])
        rows.append((i, " ".join(rng.choice([f"w{'abcdefgh'[int(rng.expovariate(0.5)) % 8]}", "Straße", "ÉTÉ", "the", f"{source}x", "a_b", "x9y"]) for _ in range(rng.randrange(0, 25))), lang, source))
    rows += [(200, None, "fr", "a"), (201, "", "fr", "b"), (202, "only once", "it", "a"), (203, "?!", "en", "none"), rows[5], rows[5], (None, "the word " * 4000, "en", "a")]
    got = divergence.audit(frame(spark, rows), least, most)
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()) == brute_audit(rows, least, most)


def test_divergence_empty_and_alone(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert divergence.audit(frame(spark, [(1, "alone", "en", "a")])).count() == 0
    assert divergence.audit(frame(spark, [(1, "a", "en", "a"), (2, "b", "en", "b")])).select(F.sum("value")).first()[0] == 0
