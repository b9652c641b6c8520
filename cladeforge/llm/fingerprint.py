"""Document fingerprints: bottom-k sketches of shingle hashes (operator 10).

A sketch holds the k smallest distinct hashes of a text's five-word shingles,
in order. It is mergeable: the k smallest of two sketches' union is the sketch
of the parts together. Two sketches estimate resemblance, containment and,
alone, the number of distinct shingles. A text with fewer than five words has
its whole word sequence as one shingle; one without words an empty sketch.

The document after each one is found in buckets of neighbouring doc_ids. Ids
may lie anywhere: a bucket that got too many rows is split again, by its own
range of ids, and rows of one id by the hash of their text.

Defined results: null text is empty; texts of any length are whole; two empty
sketches have likeness 1, an empty and another one 0; rows that share a doc_id
are ordered by the hash of the text, then the text, so repeated rows follow
each other; the last document is followed by the first, a lone document by
itself; a null doc_id comes before all others; an empty table gives an empty
result; followed() keeps extra columns of any name and replaces those named
like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 128
SHINGLE = 5


def shingle_hashes(word_hashes: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of n-word shingles, given the words' hashes."""
    size = F.size(word_hashes)
    windows = F.transform(F.slice(word_hashes, F.lit(1), size - (n - 1)), lambda h, i: F.xxhash64(h, *[F.get(word_hashes, i + j) for j in range(1, n)]))
    short = F.when(size > 0, F.array(F.xxhash64(word_hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(size >= n, windows).otherwise(short)


def sketch(text: Column, k: int = K) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes of a text, ascending."""
    hashes = common.bind(F.transform(common.words(text), lambda w: F.xxhash64(w)), lambda h: shingle_hashes(h))
    return F.slice(F.sort_array(F.array_distinct(hashes)), F.lit(1), F.lit(k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), F.lit(k))


def merge_all(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group of keys: the k smallest distinct hashes, found after a partial aggregation."""
    h = df.select(*keys, F.explode(column).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    h = h.withColumn("_r", rank).where(F.col("_r") <= k)
    return h.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets: the share of their k smallest that both have."""
    both = merge(a, b, k)
    common_part = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common_part / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th hash."""
    spread = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as text: hexadecimal hashes joined by dots."""
    return F.array_join(F.transform(a, lambda h: F.hex(h)), ".")


#: Buckets that Spark is told to broadcast at most, as those that were split again.
MOST_SPLIT = 100_000


def bucketed(rows: DataFrame, rows_a_bucket: int) -> tuple[DataFrame, DataFrame]:
    """rows (__id, __h, ...) with __path, which orders buckets of neighbouring rows, and the buckets: path, n, first id and hash."""

    def place(x: Column, low: Column, high: Column, n: Column) -> Column:
        return F.floor((x - low) / F.greatest(F.lit(1.0), (high.cast("double") - low + 1) * rows_a_bucket / n)).cast("bigint")

    # one row, so the broadcast is bounded
    ends = rows.agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi"), F.count("__id").alias("__n"))
    t = rows.join(F.broadcast(ends), how="left", on=F.lit(True))
    first = place(F.col("__id").cast("double"), F.col("__lo").cast("double"), F.col("__hi"), F.greatest(F.lit(1), F.col("__n")))
    t = t.withColumn("__path", F.array(F.coalesce(first, F.lit(-1)))).drop("__lo", "__hi", "__n")
    while True:
        cells = common.cut(t.groupBy("__path").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("lo"), F.max("__id").alias("hi")))
        full = cells.where(F.col("n") > 4 * rows_a_bucket).select(F.col("__path").alias("__p"), F.col("n").alias("__n"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        same = full.where(F.coalesce(F.col("__lo") == F.col("__hi"), F.lit(True)))
        if same.limit(1).count():
            # one id, or none: by the hash of the text
            hashes = t.join(same.select("__p"), F.col("__path") == F.col("__p"), "left_semi").groupBy(F.col("__path").alias("__q")).agg(F.min(F.shiftright("__h", 1)).alias("__l"), F.max(F.shiftright("__h", 1)).alias("__m"))
            full = full.join(hashes, F.col("__p") == F.col("__q"), "left").drop("__q")
        else:
            full = full.withColumn("__l", F.lit(None).cast("bigint")).withColumn("__m", F.lit(None).cast("bigint"))
        full = common.cut(full.where((F.col("__lo") < F.col("__hi")) | (F.col("__l") < F.col("__m"))))
        n_full = full.count()
        if not n_full:
            return t, cells
        common.drop(cells)
        t = t.join(F.broadcast(full) if n_full <= MOST_SPLIT else full, F.col("__path") == F.col("__p"), "left")
        deeper = F.coalesce(place(F.shiftright("__h", 1), F.col("__l"), F.col("__m"), F.col("__n")), place(F.col("__id"), F.col("__lo"), F.col("__hi"), F.col("__n")))
        t = t.withColumn("__path", F.when(F.col("__p").isNull(), F.col("__path")).otherwise(F.array_append("__path", deeper))).drop("__p", "__n", "__lo", "__hi", "__l", "__m")


#: Cells of a range, about: what one task puts in order.
IN_RANGE = 100_000


def ranges_before(heads: DataFrame) -> DataFrame:
    """heads (__p, ...) with __before: the greatest __p below its own, for the least one the greatest of all.

    Cells are dealt to ranges of __p of like size, whatever ids there are; each
    is put in order alone, and only the last cells of the ranges are put in
    order together.
    """
    heads = common.cut(heads)
    ranged = common.cut(heads.repartitionByRange(heads.count() // IN_RANGE + 1, "__p").withColumn("__g", F.spark_partition_id()))
    common.drop(heads)
    ends = ranged.groupBy("__g").agg(F.max("__p").alias("__end"))
    ends = ends.select("__g", F.coalesce(F.lag("__end").over(Window.orderBy("__g")), F.max("__end").over(Window.partitionBy())).alias("__end"))
    before = F.coalesce(F.lag("__p").over(Window.partitionBy("__g").orderBy("__p")), F.col("__end"))
    out = common.cut(ranged.join(ends, "__g").withColumn("__before", before).drop("__g", "__end"))
    common.drop(ranged)
    return out


def followed(docs: DataFrame, extra: list[str], rows_a_bucket: int = 256) -> DataFrame:
    """docs (doc_id, text, ...) with next_text and next_<extra> of the following row by doc_id, text; the last has the first.

    Rows are dealt to buckets of neighbouring ids; the first row of each
    bucket is also sent to the bucket before it. So one exchange of the rows
    is enough and no window spans the rows of the table.
    """
    own_names = [f"__c_{c}" for c in docs.columns]
    rows = docs.select(*[F.col(c).alias(f"__c_{c}") for c in docs.columns], F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"))
    t, cells = bucketed(rows, rows_a_bucket)
    common.drop(cells)
    first = F.struct(F.col("__id").isNotNull().alias("set"), F.col("__id"), F.col("__h"))
    heads = t.groupBy(F.col("__path").alias("__p")).agg(F.min(first).alias("__first"))
    cells = ranges_before(heads)
    marked = t.join(cells, F.col("__path") == F.col("__p"), "left")
    # of equal rows at the head of a bucket any one may be lent
    head = F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__h") == F.col("__first.__h"))
    own = F.struct(F.col("__path").alias("b"), F.lit(0).alias("kind"))
    lent = F.struct(F.col("__before").alias("b"), F.lit(1).alias("kind"))
    both = marked.select(*own_names, "__h", F.explode(F.when(head, F.array(own, lent)).otherwise(F.array(own))).alias("__to"))
    both = both.select(*own_names, "__h", F.col("__to.b").alias("__b"), F.col("__to.kind").alias("__kind"))
    # plain columns, so that nothing travels twice
    order = Window.partitionBy("__b").orderBy("__kind", F.col("__c_doc_id").asc_nulls_first(), "__h", "__c_text")
    named = ["text", *extra]
    both = both.select(*own_names, "__kind", *[F.lead(f"__c_{c}").over(order).alias(f"__next_{c}") for c in named]).where(F.col("__kind") == 0)
    keep = [F.col(f"__c_{c}").alias(c) for c in docs.columns if c not in {f"next_{x}" for x in named}]
    return both.select(*keep, *[F.col(f"__next_{c}").alias(f"next_{c}") for c in named])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = followed(docs.withColumn("sketch", sketch(F.col("text"))), ["sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    t = t.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    t = t.withColumn("edited_sketch", sketch(F.col("edited")))
    return t.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
