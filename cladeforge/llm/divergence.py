"""Source divergence audit (operator 13).

How a language's sources differ in their words: for each group (language,
source), how far every other source of the language lies from it (part `pair`)
and which terms it uses more than its language does (part `term`).

Terms are counted in Python workers, which send one row for each group and term
of a task. Documents are counted with them, so one aggregation gives a term's
occurrences in the group, in the language, and its number of documents.
Probabilities are whole numbers, computed with decimals.

Part `term` is an upper-bound search. The terms of a group lie in buckets by
their count and their language's probability; a bucket's largest count and its
least probability bound what any term of it can differ by. Buckets with the
best bounds are evaluated first, as many as hold `most` terms; then those whose
bound isn't strictly below the least value so found. No other term can rank.

Part `pair` works on postings: a term's groups and their probabilities. Terms
of a language are dealt into blocks; a block is a table of groups by terms,
with each group's probability of an absent term where it has no posting, and
gives one number for each two groups. So a language is many tasks however
large it is, and no list of pairs is made for a term.

Defined results: null text, lang or source count as ''; every group occurs,
also without terms, with every other source of its language (0 where no term
is kept); equal values are ranked by item in the order of UTF-8; repeated rows
count as documents of their own; texts of any length are whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAST_DOCS = 30
MOST = 50
#: Different terms that a task holds before it sends their counts.
HELD = 200_000
#: Terms of a block.
IN_BLOCK = 1024
UNIT = 1_000_000_000


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; one row without a term for each group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = ["lang", "source", "term", "n", "docs"]

    def sent(held: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), (n, d) in held.items():
            terms = [None, *n]
            for column, values in zip(out, ([lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(d.__getitem__, n)]), strict=True):
                column.extend(values)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                found = TERM.findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    t = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return t.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * kept)), 1 where nothing is kept."""
    return F.expr(f"case when {kept} > 0 then 1 + ((cast({UNIT} as decimal(10,0)) * cast({n} + 5 as decimal(19,0))) div cast({total} + 5 * {kept} as decimal(20,0))) else 1 end").cast("bigint")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (lang, source, term, p, q) of kept terms, groups (lang, source, z), langs (lang, kept): p the group's and q the language's probability, z the group's of a term it lacks."""
    raw = common.cut(counted(docs))
    by_term = Window.partitionBy("lang", "term")
    t = raw.where("term is not null").withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("all_n", F.sum("n").over(by_term))
    t = common.cut(t.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n"))
    own = t.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # each kept term of a language once
    lang = t.groupBy("lang", "term").agg(F.max("all_n").alias("all_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_total"))
    known = raw.where("term is null").select("lang", "source")
    groups = known.join(own, ["lang", "source"], "left").join(lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = common.cut(groups.withColumn("z", chance("cast(0 as bigint)", "total", "kept")))
    common.drop(raw)
    found = t.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", chance("n", "total", "kept").alias("p"), chance("all_n", "lang_total", "kept").alias("q"))
    found = common.cut(found)
    common.drop(t)
    return found, groups.select("lang", "source", "z"), groups.select("lang", "kept").distinct()


def leading_terms(found: DataFrame, most: int = MOST) -> DataFrame:
    """lang, source, item, value, rank: the terms of each group that lie most above their language."""
    step = lambda c: F.floor(4 * F.log2(F.col(c).cast("double"))).cast("int")
    above = found.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"), "p", "q", step("n").alias("count_step"), step("q").alias("q_step"))
    key = ["lang", "source", "count_step", "q_step"]
    bounds = above.groupBy(*key).agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.lit(1)).alias("terms"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "count_step", "q_step")
    before = F.coalesce(F.sum("terms").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = common.cut(bounds.withColumn("before", before))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")

    def ranked(buckets: DataFrame) -> DataFrame:
        t = above.join(buckets.select(*key), key, "left_semi")
        return t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    first = ranked(bounds.where(F.col("before") < most))
    kth = first.where(F.col("rank") == most).select("lang", "source", F.col("value").alias("kth"))
    # where a group has fewer terms than ranks, nothing is below
    open_ones = bounds.join(kth, ["lang", "source"], "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    return ranked(open_ones).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def distances(found: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: summed differences of every two groups of a language, both ways."""
    blocks = langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("kept") / IN_BLOCK)).cast("int").alias("blocks"))
    dealt = found.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    own = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "z")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        names = sorted(right["source"].to_pylist())
        row, z = {name: i for i, name in enumerate(names)}, dict(zip(right["source"].to_pylist(), right["z"].to_pylist(), strict=True))
        terms = {term: i for i, term in enumerate(dict.fromkeys(left["term"].to_pylist()))}
        p = np.repeat(np.array([[z[name]] for name in names], np.int64), len(terms), axis=1)
        p[[row[x] for x in left["source"].to_pylist()], [terms[x] for x in left["term"].to_pylist()]] = left["p"].to_numpy()
        first = [a for a in range(len(names)) for _ in range(a + 1, len(names))]
        second = [b for a in range(len(names)) for b in range(a + 1, len(names))]
        values = np.concatenate([np.zeros(0, np.int64), *(np.abs(p[a + 1 :] - p[a]).sum(1) for a in range(len(names)))])
        lang = [right["lang"][0].as_py()] * len(first)
        return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array([names[a] for a in first], pa.string()), "item": pa.array([names[b] for b in second], pa.string()), "value": pa.array(values, pa.int64())})

    half = dealt.groupBy("lang", "block").cogroup(own.groupBy("lang", "block")).applyInArrow(block, "lang string, source string, item string, value bigint")
    half = half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return half.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value, rank."""
    found, groups, langs = postings(docs, least_docs)
    pair = distances(found, groups, langs)
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")]
    return pair.select(*columns("pair")).unionByName(leading_terms(found, most).select(*columns("term")))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT lang, source, r, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(own.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) AS g LEFT JOIN own USING (lang, source) GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS q FROM kept JOIN langs USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, 1 + (1000000000 * (coalesce(own.n, 0) + 5)) // (g.total + 5 * v) AS p
      FROM totals AS g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM totals AS a JOIN totals AS b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
