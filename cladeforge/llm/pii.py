"""Information-theoretic sanitisation (operator 1).

Protected entities are the personal data that patterns find (e-mail addresses,
IP addresses, payment cards, phone numbers) and secrets: runs of 16 or more
letters, digits and joining signs, with both letters and digits, that carry
`SECRET_BITS` bits or more (length times log2 of the distinct characters).
Other words may reveal them. How strongly is estimated from the corpus: for an
entity e and a term t that stands near it, with document counts n_e, n_t, n_et
out of N,

    disclosure(t, e) = PMI(t; e) / IC(e),  PMI = log2(N n_et / (n_e n_t)),
    IC = log2(N / n_e),

which is 1 for a term that occurs only with e. An entity is known at several
levels: its value, the domain of an address, and its kind (any secret, say),
so that values that are seen once count as well. A term that meets an entity
in `least_docs` different texts or more and discloses `generalise_at` of it is
generalised in those documents, from `remove_at` on it is removed.

Terms are words of three letters or more; those near a mention are the `words`
nearest on each side within `reach` characters. Counts cover all documents.
Pairs are made only of an entity and the few words around each mention, so
they grow with the mentions; they and the term counts are aggregated before
they are shuffled.

Defined results: null text is empty and has no spans; texts may be of any
length; repeated rows each get their spans; repeated doc_ids with different
texts are kept apart by a hash of the text; equal spans of two kinds are in
the order of the kinds; an empty table gives an empty result; extra columns of
any name pass through sanitised().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "term", "secret")
TERM, SECRET = KINDS.index("term"), KINDS.index("secret")
#: Bits that a secret carries at least.
SECRET_BITS = 48

# A run that the wanted match begins with is entered at its start only, or
# where the last match ended: the same matches, without quadratic time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORD = r"\p{L}{3,}"


def located(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<s, k, e, v>>: start, kind, end (code points, exclusive) and text of the pattern's matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sized = F.zip_with(F.transform(F.slice(gaps, F.lit(1), F.size(m)), lambda g: F.length(g)), m, lambda g, x: F.struct(g.alias("g"), F.length(x).alias("n"), x.alias("v")))

        def rows(z: Column) -> Column:
            sums = common.prefix_sums(F.transform(z, lambda x: x["g"] + x["n"]))
            both = F.zip_with(z, F.slice(sums, F.lit(1), F.size(z)), lambda x, o: F.struct((o + x["g"]).cast("int").alias("s"), F.lit(kind).alias("k"), (o + x["g"] + x["n"]).cast("int").alias("e"), x["v"].alias("v")))
            return both

        return F.when(F.size(m) > 0, common.bind(sized, rows)).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,v:string>>"))

    return common.bind(found, place)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def doubled(d: Column) -> Column:
        return F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """The four patterns' matches that pass their tests, by start, then kind."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    email = F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(located(text, IP, 1), lambda x: x["v"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"))).otherwise(none)
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), F.filter(located(text, CARD, 2), lambda x: F.length(digits(x["v"])).between(14, 19) & luhn(digits(x["v"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), lambda x: F.length(digits(x["v"])).between(10, 15))).otherwise(none)
    return F.sort_array(F.concat(email, ip, card, phone))


def secret_spans(text: Column, spans: Column) -> Column:
    """Runs that look like secrets, unless they begin within a base span."""

    def secret(x: Column) -> Column:
        bits = F.length(x["v"]) * F.log2(F.size(F.array_distinct(F.split(x["v"], ""))).cast("double"))
        inside = F.exists(spans, lambda b: (b["s"] <= x["s"]) & (x["s"] < b["e"]))
        return x["v"].rlike("[A-Za-z]") & x["v"].rlike("[0-9]") & (bits >= SECRET_BITS) & ~inside

    return F.when(text.rlike(RUN), F.filter(located(text, RUN, SECRET), secret)).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,v:string>>"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def detected(docs: DataFrame) -> DataFrame:
    """docs with _text (null: empty), _key (hash of the text), _spans (base spans) and _secrets."""
    t = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    t = t.withColumn("_key", F.xxhash64("_text")).withColumn("_spans", base_spans(F.col("_text")))
    return t.withColumn("_secrets", secret_spans(F.col("_text"), F.col("_spans")))


def neighbours(text: Column, span: Column, words: int, reach: int) -> Column:
    """Lower-case words near a span: at most `words` on each side, whole ones within `reach` characters."""
    start = F.greatest(F.lit(0), span["s"] - reach)
    before = F.substr(text, start + 1, span["s"] - start)
    after = F.substr(text, span["e"] + 1, F.lit(reach))
    left = F.regexp_extract_all(F.when(start > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before), F.lit(WORD), F.lit(0))
    right = F.regexp_extract_all(F.when(span["e"] + reach < F.length(text), F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after), F.lit(WORD), F.lit(0))
    both = F.concat(F.reverse(F.slice(F.reverse(left), F.lit(1), F.lit(words))), F.slice(right, F.lit(1), F.lit(words)))
    return F.transform(both, lambda w: F.lower(w))


def entities(span: Column) -> Column:
    """The levels at which a span's entity is known: kind, value, and the domain of an address."""
    value = F.when((span["k"] == 2) | (span["k"] == 3), digits(span["v"])).when(span["k"] == SECRET, span["v"]).otherwise(F.lower(span["v"]))
    kind = F.concat(span["k"].cast("string"), F.lit(":"))
    domain = F.concat(kind, F.regexp_extract(F.lower(span["v"]), "@.*", 0))
    levels = F.array(kind, F.concat(kind, value))
    return F.when(span["k"] == 0, F.array_append(levels, domain)).otherwise(levels)


def disclosures(docs: DataFrame, found: DataFrame, words: int = 6, reach: int = 160, least_docs: int = 3, generalise_at: float = 0.5, remove_at: float = 0.75) -> DataFrame:
    """doc_id, _key, level map: for documents with revealing terms, each term's level (1: generalise, 2: remove).

    docs: all documents; found: those with spans, as detected() has them.
    """
    mentions = found.select("doc_id", "_key", "_text", F.explode(F.concat("_spans", "_secrets")).alias("x"))
    mentions = mentions.select("doc_id", "_key", entities(F.col("x")).alias("es"), F.explode_outer(neighbours(F.col("_text"), F.col("x"), words, reach)).alias("t"))
    mentions = common.cut(mentions.select("doc_id", "_key", F.explode("es").alias("e"), "t").distinct())
    n_e = mentions.select("doc_id", "_key", "e").distinct().groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    n_et = mentions.where(F.col("t").isNotNull()).groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"), F.count_distinct("_key").alias("texts")).where(F.col("texts") >= least_docs)
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))).alias("t"))
    n_t = terms.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = n_et.join(n_e, "e").join(n_t, "t").join(F.broadcast(total), F.lit(True))
    pmi = F.log2(F.col("n") * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    ic = F.log2(F.col("n") / F.col("n_e"))
    # an entity in every document has no information to disclose
    scored = scored.where(F.col("n_e") < F.col("n")).withColumn("d", pmi / ic)
    level = F.when(F.col("d") >= remove_at, F.lit(2)).when(F.col("d") >= generalise_at, F.lit(1))
    flagged = scored.withColumn("level", level).where(F.col("level").isNotNull()).select("e", "t", "level")
    hit = mentions.join(flagged, ["e", "t"]).groupBy("doc_id", "_key", "t").agg(F.max("level").alias("level"))
    return hit.groupBy("doc_id", "_key").agg(F.map_from_entries(F.collect_list(F.struct("t", "level"))).alias("_levels"))


def term_spans(text: Column, spans: Column, levels: Column) -> Column:
    """Spans (v: the level) of the flagged terms outside the base spans."""
    words = F.filter(located(text, WORD, TERM), lambda x: F.map_contains_key(levels, F.lower(x["v"])))
    clear = F.filter(words, lambda x: ~F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.transform(clear, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.element_at(levels, F.lower(x["v"])).cast("string").alias("v")))


def spans(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, _key, _spans (base), _secrets and _all (with secrets and terms), for each row of docs."""
    docs = docs.select("doc_id", "text")
    t = detected(docs)
    some = (F.size("_spans") > 0) | (F.size("_secrets") > 0)
    t = common.cut(t.select("doc_id", "_key", "_spans", "_secrets", F.when(some, F.col("_text")).alias("_text")))
    found = t.where(some)
    levels = disclosures(docs, found, **limits).withColumnsRenamed({"doc_id": "_d", "_key": "_k"})
    more = found.select("doc_id", "_key", "_text", F.concat("_spans", "_secrets").alias("_spans")).join(levels, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    more = more.groupBy("_d", "_k").agg(F.first(term_spans(F.col("_text"), F.col("_spans"), F.col("_levels"))).alias("_terms"))
    out = t.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    every = F.sort_array(F.concat("_spans", "_secrets", F.coalesce("_terms", none)))
    return out.select("doc_id", "_key", "_spans", "_secrets", every.alias("_all"))


def replaced(text: Column, all_spans: Column) -> Column:
    """text with base spans, secrets and generalised terms as [KIND] and removed terms left out."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"]))
        label = F.when((x["k"] == TERM) & (x["v"] == "2"), F.lit("")).otherwise(F.get(names, x["k"]))
        after = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, label)).alias("out"))
        return after

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(all_spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, **limits) -> DataFrame:
    """docs with the spans of each text replaced; documents without spans keep their text."""
    hits = spans(docs.select("doc_id", "text"), **limits).where(F.size("_all") > 0).groupBy("doc_id", "_key").agg(F.first("_all").alias("_all"))
    hits = hits.withColumnsRenamed({"doc_id": "_d", "_key": "_k"})
    t = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    t = t.withColumn("_key", F.xxhash64(F.coalesce("_text", F.lit(""))))
    t = t.join(hits, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    text = F.when(F.col("_all").isNull(), F.col("_text")).otherwise(replaced(F.col("_text"), F.col("_all")))
    return t.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    t = spans(common.documents(spark, sf_dir).select("doc_id", "text"))

    def count(k: int):
        return F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    more = [F.size("_secrets").cast("bigint").alias("n_secret"), F.size("_all").cast("bigint").alias("n_spans")]
    return t.select("doc_id", *counts, F.sha2(joined(F.col("_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"), *more)


def _found_sql(name: str, source: str, pattern: str, kind: int) -> str:
    """Matches of a pattern in SQL: their starts are the lengths of what stands before them."""
    return f"""{name} AS (SELECT doc_id, {kind} AS k, v, s, s + length(v) AS e FROM (
  SELECT doc_id, m[i] AS v, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM {source}))))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_WORDS = r"regexp_extract_all({}, '\p{{L}}{{3,}}')"
OP1_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_found_sql("email", "d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0)},
{_found_sql("ip", "d", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 1)},
{_found_sql("card", "d", r"[0-9]([\x20-]?[0-9])+", 2)},
{_found_sql("phone", "d", r"\+[0-9][\x20().0-9-]+[0-9]", 3)},
base AS MATERIALIZED (
  SELECT * FROM email
  UNION ALL SELECT * FROM ip WHERE len(list_filter(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN true ELSE CAST('0' || ltrim(x, '0') AS INTEGER) > 255 END)) = 0
  UNION ALL SELECT * FROM card WHERE length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length({_DIGITS})), lambda i:
    CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INTEGER) WHEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INTEGER) - 9
         ELSE 2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INTEGER) END)) % 10 = 0
  UNION ALL SELECT * FROM phone WHERE length({_DIGITS}) BETWEEN 10 AND 15),
{_found_sql("run", "d", r"[A-Za-z0-9_+/-]{16,}", 5)},
secret AS MATERIALIZED (SELECT * FROM run r WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND length(v) * log2(CAST(len(list_distinct(string_split(v, ''))) AS DOUBLE)) >= {SECRET_BITS}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND r.s < b.e)),
found AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM secret),
near AS MATERIALIZED (SELECT doc_id, list_concat([k || ':', k || ':' || CASE WHEN k = 2 OR k = 3 THEN {_DIGITS} WHEN k = 5 THEN v ELSE lower(v) END], CASE WHEN k = 0 THEN [k || ':' || regexp_extract(lower(v), '@.*')] ELSE [] END) AS es,
    {_WORDS.format("CASE WHEN s > 160 THEN regexp_replace(substr(text, s - 159, 160), '^\\p{L}+', '') ELSE substr(text, 1, s) END")} AS l,
    {_WORDS.format("CASE WHEN e + 160 < length(text) THEN regexp_replace(substr(text, e + 1, 160), '\\p{L}+$', '') ELSE substr(text, e + 1, 160) END")} AS r, text FROM found JOIN d USING (doc_id)),
mentions AS MATERIALIZED (SELECT DISTINCT doc_id, text, e, lower(t) AS t FROM (SELECT doc_id, text, e, unnest(list_concat(l[greatest(1, len(l) - 5):len(l)], r[1:6])) AS t FROM (SELECT *, unnest(es) AS e FROM near))),
n_e AS (SELECT e, count(DISTINCT doc_id) AS n_e FROM (SELECT doc_id, unnest(es) AS e FROM near) GROUP BY e),
n_et AS (SELECT e, t, count(*) AS n_et FROM mentions GROUP BY e, t HAVING count(DISTINCT text) >= 3),
n_t AS (SELECT t, count(*) AS n_t FROM (SELECT unnest(list_distinct({_WORDS.format("lower(text)")})) AS t FROM d) GROUP BY t),
flagged AS (SELECT e, t FROM n_et JOIN n_e USING (e) JOIN n_t USING (t), (SELECT count(*) AS n FROM d) WHERE n_e < n AND log2(n * n_et / (CAST(n_e AS DOUBLE) * n_t)) / log2(n / n_e) >= 0.5),
hit AS (SELECT DISTINCT doc_id, t FROM mentions JOIN flagged USING (e, t)),
marked AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
{_found_sql("word", "marked", chr(92) + "p{L}{3,}", 4)},
term AS (SELECT w.* FROM word w JOIN hit h ON h.doc_id = w.doc_id AND h.t = lower(w.v) WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
every AS (SELECT doc_id, k, s, ['email', 'ip', 'card', 'phone', 'term', 'secret'][k + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM found UNION ALL SELECT * FROM term)),
told AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) FILTER (k = 5) AS n_secret, count(*) AS n_spans,
    string_agg(x, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_secret, 0) AS n_secret, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN told USING (doc_id)
"""
