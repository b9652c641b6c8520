"""k-mer tables: enumeration, orientation, counts, and priorities by lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alphabet
from . import minimizers

#: Lookup tables have all words of so many letters at most; that bounds their size.
MOST_LETTERS = 10


def kmers(sequences: DataFrame, k: int, forward_only: bool = False) -> DataFrame:
    """header, pos, word of all k-mers of sequences of A, C, G, T; forward_only: those that are not above their reverse complement."""
    t = minimizers.words(sequences, k)
    return t.where(F.col("word") <= alphabet.reverse_complement(F.col("word"))) if forward_only else t


def coded_kmers(sequences: DataFrame, k: int, forward_only: bool = False) -> DataFrame:
    """header, pos, code: as kmers(), of at most 31 letters, without making text of each."""
    return minimizers.coded_words(sequences, k, forward_only)


def counts(sequences: DataFrame, k: int, canonical: bool = True, abundance: str | None = None) -> DataFrame:
    """word, n: k-mers with how often they occur, each sequence counting as often as its abundance says.

    Super-mers are dealt by minimizer, with their letters packed; k-mers are
    made where all that can be equal meet, and counted there, so no k-mer is
    shuffled. k-mers with other letters than A, C, G, T, U are left out; lower
    case counts as upper, U as T. A null abundance counts as none. Words of
    over 31 letters are cut out of the same super-mers as text.
    """
    scheme = alphabet.Scheme(k, max(1, min(15, k - k // 3)), 0, canonical)
    weighted = sequences.select(F.lit(1).cast("bigint").alias("w") if abundance is None else F.col(abundance).cast("bigint").alias("w"), "nucleotides")
    t = minimizers.counted_supermers(weighted, "w", scheme).repartition("minimizer")
    if k <= 31:
        t = t.select("minimizer", "letters", "n", F.explode(F.sequence(F.lit(0), F.col("kmers") - 1)).alias("at"))
        t = t.select("minimizer", "n", alphabet.code_in(F.col("letters"), F.col("at"), k).alias("code"))
        if canonical:
            t = t.select("minimizer", "n", F.least("code", alphabet.reverse_complement_code(F.col("code"), k)).alias("code"))
        return t.groupBy("minimizer", "code").agg(F.sum("n").alias("n")).select(alphabet.decode(F.col("code"), k).alias("word"), "n")
    t = t.select("minimizer", alphabet.unpacked(F.col("letters"), F.col("kmers") + (k - 1)).alias("text"), "n", F.explode(F.sequence(F.lit(1), F.col("kmers"))).alias("at"))
    word = F.substr("text", F.col("at"), F.lit(k))
    t = t.groupBy("minimizer", (alphabet.canonical(word) if canonical else word).alias("word")).agg(F.sum("n").alias("n"))
    return t.select("word", "n")


def table_priorities(motifs: DataFrame, letters: int) -> DataFrame:
    """motif, rank of a given order of motifs (motif, rank), checked for length."""
    if not 1 <= letters <= MOST_LETTERS:
        raise ValueError(f"lookup tables are for 1 to {MOST_LETTERS} letters")
    return motifs.where(F.length("motif") == letters).groupBy("motif").agg(F.min("rank").alias("rank"))


def minimizers_by_table(sequences: DataFrame, motifs: DataFrame, k: int, letters: int) -> DataFrame:
    """header, pos, minimizer (rank) of each k-mer by a lookup table; words that are not in it are never chosen.

    A k-mer none of whose words is in the table has no minimizer (null).
    """
    table = table_priorities(motifs, letters).withColumnRenamed("motif", "word")
    # sent to all tasks: joined by word, all words of a table of a few would meet in as few tasks, and be dealt by header again after that
    t = minimizers.words(sequences, letters).join(F.broadcast(table), "word", "left")
    frame = Window.partitionBy("header").orderBy("pos").rowsBetween(0, k - letters)
    t = t.withColumn("minimizer", F.min("rank").over(frame)).withColumn("n", F.count(F.lit(1)).over(frame))
    return t.where(F.col("n") == k - letters + 1).select("header", "pos", "minimizer")


def runs_of(t: DataFrame, k: int) -> DataFrame:
    """header, location, length, minimizer: runs of neighbouring k-mers (header, pos, minimizer) with one minimizer."""
    order = Window.partitionBy("header").orderBy("pos")
    t = t.where("minimizer is not null").withColumn("b", F.lag("minimizer").over(order)).withColumn("p", F.lag("pos").over(order))
    t = t.withColumn("run", F.sum(F.when((F.col("b") == F.col("minimizer")) & (F.col("p") == F.col("pos") - 1), 0).otherwise(1)).over(order))
    t = t.groupBy("header", "run").agg((F.min("pos") - 1).cast("bigint").alias("location"), (F.count(F.lit(1)) + (k - 1)).alias("length"), F.first("minimizer").alias("minimizer"))
    return t.select("header", "location", "length", "minimizer")


def rank_of(word: Column, ordering: str, scheme: alphabet.Scheme) -> Column:
    """Priority of a word in an ordering: lexicographic, or xor (random)."""
    if ordering == "lexicographic":
        return alphabet.encode(alphabet.canonical(word) if scheme.canonical else word)
    if ordering == "xor":
        return alphabet.priority(word, scheme)
    raise ValueError("ordering must be lexicographic or xor; for a given order use minimizers_by_table()")
