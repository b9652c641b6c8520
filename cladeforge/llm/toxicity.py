"""Toxicity: gradient-boosted trees over dense features, calibrated (operator 3).

Features of a text: densities of a lexicon, how near its words stand to the
second person, shares of capitals and punctuation, rates of disguised
spelling. The lexicon is a few plain insults and what is learned from
labelled documents: words and word beginnings that toxic ones hold more often
than chance explains, by a log-likelihood ratio against the number of terms
tried. Training takes at most `MOST_ROWS` labelled rows, those with the lowest
hash of their doc_id, in folds. A row is described by the lexicon of the other
folds, so trees do not trust what a row itself taught; the calibration takes
scores that trees of the other folds give, of all rows. The model's `told` has
class counts, sizes, the highest calibrated score, and the recall in each
fold. Scoring is one narrow pass over all texts, whole, without a shuffle; only
the model, of bounded size, is sent out.

Free style: trees and features are numpy and Python on Arrow batches.

Defined results: null text is an empty text, which has a score as all others;
without usable labels, or with one class only, every score is the share of
toxic labels (0 without labels); repeated labels of a document count as toxic
if one does; repeated rows are scored alike; all terms that pass the test are
in the lexicon, whose size the bound on labelled rows limits; equal raw scores
share one calibrated score; an empty table gives an empty result; extra
columns are kept by scored(), and columns named score, predicted or held_out
are replaced.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled rows that training takes.
MOST_ROWS = 20_000
#: Folds of the labelled rows; how likely any chance term is to pass; terms a task holds before it sends their counts.
FOLDS, CHANCE, HELD = 3, 0.05, 200_000
STEMS = (4, 5, 6)
LOG = logging.getLogger(__name__)

INSULTS = frozenset("idiot idiots moron morons loser losers scum trash stupid dumb pathetic worthless disgusting clown fool fools ugly filthy vermin imbecile cretin bastard jerk freak pig creep".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deiner deinen euch euer ihr tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro".split())
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l", "*": None, ".": None, "-": None, "_": None})
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SHOUT = re.compile(r"[A-Z]{4,}")
LONG_LETTER = re.compile(r"([^\W\d_])\1\1")
PUNCTUATION_RUN = re.compile(r"[!?]{2,}")
N_FEATURES = 20
REACH = 6


def tokens(text: str) -> list[str]:
    """Lower-case words without punctuation at their edges."""
    return [t if t.isalpha() else t.strip(EDGES) for t in text.lower().split()]


def plain(word: str) -> str:
    """A word as it reads with disguises undone."""
    return word if word.isalpha() else word.translate(LEET)


def terms(text: str) -> set[str]:
    """What the lexicon is learned from: words, and word beginnings marked with a hyphen."""
    words = {w for w in map(plain, tokens(text)) if w}
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = tokens(text)
    n, size = max(1, len(words)), max(1, len(text))
    hits, weights, stems, stem_weight, hidden, odd, insults, near = [], [], 0, 0.0, 0, 0, 0, 0
    get = lexicon.get
    for i, w in enumerate(words):
        if not w.isalpha() and w:
            p = w.translate(LEET)
            if p != w and any(c.isalpha() for c in w):
                odd += 1
                if p in INSULTS or p in lexicon:
                    hidden += 1
            w = p
        x = get(w)
        if x is not None:
            hits.append(i)
            weights.append(x)
        elif len(w) > 4:
            x = get(w[:6] + "-") or get(w[:5] + "-") or get(w[:4] + "-")
            if x is not None:
                stems += 1
                stem_weight += x
                hits.append(i)
        if w in INSULTS:
            insults += 1
    person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    if person and hits:
        at = np.asarray(person)
        pos = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(pos, len(at) - 1)] - hits), np.abs(at[np.maximum(pos - 1, 0)] - hits))
        near = int((gap <= REACH).sum())
    total = sum(weights) + stem_weight
    return [
        np.log1p(len(words)), np.log1p(len(hits)), len(hits) / n, np.log1p(len({words[i] for i in hits})), total / n, np.log1p(total),
        max(weights, default=0.0), stems / n, np.log1p(stems), near / n, len(person) / n, insults / n, np.log1p(insults),
        (len(raw) - len(raw.translate(None, UPPER))) / size, len(SHOUT.findall(text)) / n, (text.count("!") + text.count("?")) / n,
        len(PUNCTUATION_RUN.findall(text)) / n, odd / n, hidden / n + len(LONG_LETTER.findall(text)) / n, (len(raw) - len(raw.translate(None, DIGITS))) / size,
    ]


class Trees:
    """Boosted trees of fixed depth for the logistic loss, on features cut at quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, prob * (1 - prob)
            feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                if len(at) >= 2 * self.least:
                    best = 1e-9
                    all_g, all_h = g[at].sum(), h[at].sum()
                    base = all_g**2 / (all_h + self.ridge)
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[f][at]
                        sg, sh, sn = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at))))
                        gain = sg**2 / (sh + self.ridge) + (all_g - sg) ** 2 / (all_h - sh + self.ridge) - base
                        gain[(sn < self.least) | (len(at) - sn < self.least)] = 0
                        if gain.max() > best:
                            best, feature[k], cut[k] = gain.max(), f, c[gain.argmax()]
                node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.trees.append((feature, cut, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of a non-decreasing map from raw scores to shares of label 1."""
    order = np.lexsort((y, raw))
    blocks: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ys


class Model:
    """Lexicon, trees and calibration; constant where there was nothing to learn."""

    def __init__(self, lexicon: dict[str, float], constant: float = 0.0, trees: Trees | None = None, knots: tuple[np.ndarray, np.ndarray] | None = None, told: dict | None = None):
        self.lexicon, self.constant, self.trees, self.knots, self.told = lexicon, constant, trees, knots, told or {}

    def scores(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t or "", self.lexicon) for t in texts], float).reshape(-1, N_FEATURES)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def known_rows(docs: DataFrame, labels: DataFrame, most_rows: int, folds: int) -> DataFrame:
    """text, toxic, fold of the labelled rows that are not held out, those with the lowest hashes; written to the shared folder."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    # the bound of the sample makes it fit for broadcasting
    known = known.orderBy("h", "doc_id").limit(most_rows)
    fold = F.pmod(F.shiftright("h", 6), F.lit(folds)).cast("int").alias("fold")
    toxic = (F.col("toxic") > 0).cast("int").alias("toxic")
    return common.cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", toxic, fold))


def counted_terms(rows: DataFrame) -> DataFrame:
    """term, fold, toxic, n: the documents of each fold and label that hold a term."""
    names = ["term", "fold", "toxic", "n"]

    def sent(held: dict[tuple[int, int], Counter]) -> pa.RecordBatch:
        parts = [(t, fold, toxic, n) for (fold, toxic), c in held.items() for t, n in c.items()]
        columns = zip(*parts, strict=True) if parts else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}
        for b in batches:
            for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                held.setdefault((fold, toxic), Counter()).update(terms(text))
            if sum(map(len, held.values())) > HELD:
                yield sent(held)
                held = {}
        yield sent(held)

    return rows.mapInArrow(run, "term string, fold int, toxic int, n bigint").groupBy(*names[:3]).agg(F.sum("n").alias("n"))


def telling(p: Column, q: Column, bad: float, good: float, tried: float) -> Column:
    """Whether p of bad toxic and q of good other documents are too many for chance: log-likelihood ratio against all terms tried."""
    share = (p + q) / (bad + good)

    def part(seen: Column, wanted: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)

    ratio = 2 * (part(p, bad * share) + part(q, good * share) + part(bad - p, bad * (1 - share)) + part(good - q, good * (1 - share)))
    return (p * good > q * bad) & (ratio >= 2 * float(np.log(max(tried, 1.0) / CHANCE)))


def lexicons(counts: DataFrame, sizes: dict[tuple[int, int], int], folds: int, odds: float) -> list[dict[str, float]]:
    """For each fold what the others teach, and last what all of them do: terms that are no chance, with the log of their odds."""
    told = common.cut(counts)
    tried = float(told.select("term").distinct().count())
    sums = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") != f), F.col("n")).otherwise(0)).cast("double").alias(f"{'qp'[y]}{f}") for f in range(folds + 1) for y in (0, 1)]
    t = told.groupBy("term").agg(*sums)
    weights = []
    for f in range(folds + 1):
        bad, good = (float(sum(n for (g, y), n in sizes.items() if y == label and g != f)) for label in (1, 0))
        p, q = F.col(f"p{f}"), F.col(f"q{f}")
        ratio = ((p + 0.5) / (bad + 1)) / ((q + 0.5) / (good + 1))
        good_one = telling(p, q, bad, good, tried) & (ratio >= odds) if bad and good else F.lit(False)
        weights.append(F.when(good_one, F.log(ratio)).alias(f"w{f}"))
    t = t.select("term", *weights).where(F.coalesce(*[f"w{f}" for f in range(folds + 1)]).isNotNull())
    out: list[dict[str, float]] = [dict.fromkeys(sorted(INSULTS), 1.0) for _ in range(folds + 1)]
    # terms of a bounded number of documents, few of which pass the test
    for r in t.orderBy("term").collect():
        for f in range(folds + 1):
            if r[f"w{f}"] is not None:
                out[f][r["term"]] = r[f"w{f}"]
    common.drop(told)
    return out


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, odds: float = 3.0, folds: int = FOLDS) -> Model:
    """A model from the labelled rows of docs that are not held out; labels: (doc_id, toxic)."""
    common.narrow_batches(docs.sparkSession)
    rows = known_rows(docs, labels, most_rows, folds)
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = (sum(n for (_, y), n in sizes.items() if y == label) for label in (1, 0))
    if not bad or not good:
        return Model(dict.fromkeys(sorted(INSULTS), 1.0), float(bad > 0), told={"toxic": bad, "other": good})
    lexicon = lexicons(counted_terms(rows), sizes, folds, odds)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t, lexicon[f]) for t, f in zip(b["text"], b["fold"], strict=True)], "toxic": b["toxic"].astype("int32"), "fold": b["fold"]})

    table = rows.mapInPandas(described, "x array<double>, toxic int, fold int").toPandas()
    # an order that does not depend on how tasks finished
    table = table.iloc[sorted(range(len(table)), key=lambda i: (table["fold"].iloc[i], table["toxic"].iloc[i], tuple(table["x"].iloc[i])))]
    x, y, fold = np.array(table["x"].tolist(), float), table["toxic"].to_numpy(float), table["fold"].to_numpy()
    common.drop(rows)
    # every row has a raw score of trees that did not see it, for the calibration
    raw = np.zeros(len(y))
    for f in range(folds):
        own = fold == f
        if own.any():
            raw[own] = Trees().fit(x[~own], y[~own]).raw(x[own]) if (~own).any() else 0.0
    knots = isotonic(raw, y)
    said = np.interp(raw, *knots) >= 0.5
    told = {"toxic": bad, "other": good, "lexicon": [len(d) for d in lexicon], "top": float(knots[1][-1])}
    told |= {"recall": [round(float(said[(fold == f) & (y == 1)].mean()), 4) if ((fold == f) & (y == 1)).any() else None for f in range(folds)], "false_alarms": round(float(said[y == 0].mean()), 4)}
    LOG.info("toxicity: %s", told)
    return Model(lexicon[-1], 0.0, Trees().fit(x, y), knots, told)


def score_column(model: Model):
    """The score as a pandas UDF, for frames whose other columns need not pass through Python."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        common.remembered("toxicity", dict)
        return pd.Series(model.scores(texts.tolist()), dtype="float64")

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    t = docs.withColumn("held_out", remainder(F.col("doc_id")) == 0).withColumn("score", score_column(model)(F.col("text")))
    return t.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
