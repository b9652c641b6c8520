"""Quality rules with cross-document line frequency (operator 6).

Base rules look at one document: too few words, or too many words in five-word
windows that the text repeats. They need no shuffle: windows are hashed and
compared within an array expression.

Line frequency looks at the corpus: every line with a word is normalised
(lower case, digits as 0, white space and punctuation runs as one blank) and
hashed; for each host (column `host_column`) the distinct documents that hold
a line are counted. Exact copies of a text count as one document, so a text
is not judged by how often it was crawled. Lines above the host's limit are
removed; a document that keeps too little is rejected.

The limit is the same at every size: `LEAST_DOCS` distinct documents of a
host. Callers may ask for the larger of that and a share of the host's
distinct documents.

Defined results: null text is empty (no words, base_failed); a null host is a
host of its own; repeated rows of one doc_id get the same row each; lines that
differ in case, digits or marks only are one line; texts and lines of any
length are whole; an empty table gives an empty result; extra columns are ignored by quality() and kept
by cleaned().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Distinct documents of a host in which a line may stand.
LEAST_DOCS = 10


def repeated_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: one for each window start."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(t: Column) -> Column:
        both = F.filter(t, lambda x, j: (x["h"] == F.get(t, j - 1)["h"]) | (x["h"] == F.get(t, j + 1)["h"]))
        return F.sort_array(F.transform(both, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        step = F.aggregate(s, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))
        return step["n"]

    # transform over a one-element array binds the sorted array once
    return F.get(F.transform(F.array(tagged), lambda t: covered(starts(t))), F.lit(0))


def base(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.withColumn("_w", common.words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumn("_l", lines).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    windows = F.when(n >= WINDOW, F.transform(F.slice("_h", F.lit(1), n - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get(F.col("_h"), i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("_x", windows)
    plain = F.size(F.array_distinct("_x")) == F.size("_x")
    t = t.withColumn("n_words", F.size("_w").cast("bigint"))
    t = t.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
    t = t.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
    t = t.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
    t = t.withColumn("n_repeat_words", F.when(plain, F.lit(0)).otherwise(repeated_words(F.col("_x"))).cast("bigint"))
    t = t.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return t.drop("_w", "_l", "_h", "_x")


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, all else that is no letter as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), r"[^\p{L}\p{M}0]+", " "))


def doc_lines(docs: DataFrame, host_column: str) -> DataFrame:
    """doc_id, host, text_hash, at, line, n: each line with a word, its place, the hash of its normalised form, its words."""
    t = docs.select("doc_id", F.col(host_column).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "raw"))
    t = t.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    return t.select("doc_id", "host", "text_hash", "at", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.size(common.words(F.col("raw"))).alias("n"))


def frequent_lines(lines: DataFrame, least_docs: int, share: float) -> DataFrame:
    """host, line: those in more distinct documents of the host than its limit."""
    held = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("in_docs"))
    held = held.where(F.col("in_docs") > least_docs)
    if not share:
        return held.select("host", "line")
    docs = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    both = held.join(docs.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "inner")
    return both.where(F.col("in_docs") > F.greatest(F.lit(float(least_docs)), F.lit(share) * F.col("host_docs"))).select("host", "line")


def removed_lines(docs: DataFrame, host_column: str, least_docs: int, share: float) -> DataFrame:
    """r_doc, r_text (hash of the text), n_removed (words), places: what each document loses."""
    lines = doc_lines(docs, host_column)
    often = frequent_lines(lines, least_docs, share).withColumnsRenamed({"host": "h", "line": "l"})
    hit = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "inner")
    # repeated rows hold a line at the same place: it counts once
    once = hit.groupBy(F.col("doc_id").alias("r_doc"), F.col("text_hash").alias("r_text"), "at").agg(F.first("n").alias("n"))
    return once.groupBy("r_doc", "r_text").agg(F.sum("n").alias("n_removed"), F.collect_set("at").alias("places"))


def verdict(n_words: Column, n_removed: Column, base_failed: Column, least_words: int, least_left: float) -> Column:
    left = n_words - n_removed
    return ~base_failed & (left >= least_words) & (left >= least_left * n_words)


def quality(docs: DataFrame, host_column: str = "source", least_docs: int = LEAST_DOCS, share: float = 0.0, least_words: int = 5, least_left: float = 0.3) -> DataFrame:
    """One row for each row of docs: the base figures, n_line_words (words in removed lines) and kept."""
    removed = removed_lines(docs, host_column, least_docs, share).drop("places")
    t = base(docs.select("doc_id", "text")).withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    t = t.drop("text").join(removed, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("_t") == F.col("r_text")), "left")
    t = t.withColumn("n_line_words", F.coalesce("n_removed", F.lit(0)).cast("bigint"))
    t = t.withColumn("kept", verdict(F.col("n_words"), F.col("n_line_words"), F.col("base_failed"), least_words, least_left))
    return t.drop("_t", "r_doc", "r_text", "n_removed")


def cleaned(docs: DataFrame, host_column: str = "source", least_docs: int = LEAST_DOCS, share: float = 0.0, least_words: int = 5, least_left: float = 0.3) -> DataFrame:
    """docs that are kept, without the lines above their host's limit."""
    removed = removed_lines(docs, host_column, least_docs, share)
    t = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text").withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    t = base(t).join(removed, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("_t") == F.col("r_text")), "left")
    t = t.where(verdict(F.col("n_words"), F.coalesce("n_removed", F.lit(0)), F.col("base_failed"), least_words, least_left))
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("places"), i))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return t.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY rid),
ln AS (SELECT * FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY rid),
nl AS (SELECT *, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[^\p{{L}}\p{{M}}0]+', ' ', 'g')) AS line, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM ln),
often AS (SELECT host, line FROM nl GROUP BY host, line HAVING count(DISTINCT text) > {LEAST_DOCS}),
cut AS (SELECT rid, sum(n) AS n FROM nl JOIN often o ON nl.host IS NOT DISTINCT FROM o.host AND nl.line = o.line GROUP BY rid),
f AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_line_words
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN cut USING (rid)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_line_words >= 5 AND n_words - n_line_words >= 0.3 * n_words AS kept FROM g
"""
