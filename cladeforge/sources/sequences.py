"""Sequences as DataFrames: FASTA, FASTQ, indexed FASTA, DataFrames, mates.

Rows are header, location (1-based), nucleotides, nucleotides2 (mates only).
All reading goes through Spark, so any storage that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import reverse_complement
from .ranges import read_ranges

#: Bytes of an indexed sequence that one row takes at most.
CHUNK = 4 << 20
#: Bytes of FASTQ files that one task reads at least, in as many splits as they have.
TASK_BYTES = 16 << 20


def short_id(header: Column) -> Column:
    return F.split(header, "[ \t]", 2)[0]


def parse_fasta(records: DataFrame) -> DataFrame:
    """header, location, nucleotides of records (value: text between > marks); those without a sequence line are dropped."""
    lines = F.split("value", "[\n\r]+")
    t = records.select(lines.alias("l")).where(F.size("l") > 1)
    t = t.select(short_id(F.col("l")[0]).alias("header"), F.lit(1).cast("bigint").alias("location"), F.array_join(F.slice("l", F.lit(2), F.size("l")), "").alias("nucleotides"))
    return t.where((F.col("header") != "") | (F.col("nucleotides") != ""))


def fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """FASTA files, plain or compressed; a record is one row."""
    return parse_fasta(spark.read.option("lineSep", ">").text(path))


def parse_fastq(lines: DataFrame, file: str, order: str) -> DataFrame:
    """header, location, nucleotides of lines (file, order, value).

    A record is four lines in a row whose first begins with @ and third with
    +; windows at other offsets fail one of the tests.
    """
    frame = Window.partitionBy(file).orderBy(order)
    t = lines.select("value", F.lead("value", 1).over(frame).alias("seq"), F.lead("value", 2).over(frame).alias("plus"), F.lead("value", 3).over(frame).alias("quality"))
    t = t.where(F.col("value").startswith("@") & F.col("plus").startswith("+"))
    return t.select(short_id(F.substr("value", F.lit(2))).alias("header"), F.lit(1).cast("bigint").alias("location"), F.regexp_replace("seq", "\r", "").alias("nucleotides"))


def records_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head, seq of the records whose first three lines lie in one split (value, file, split), in Arrow arrays."""
    held = None
    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        n = max(0, b.num_rows - 2)
        lines, run = b.column("value"), np.zeros(b.num_rows, np.int64)
        run[run_starts(b)[1:]] = 1
        run = np.cumsum(run)
        starts = pc.and_(pc.and_(pc.starts_with(lines.slice(0, n), "@"), pc.starts_with(lines.slice(2, n), "+")), pa.array(run[:n] == run[2 : n + 2]))
        yield pa.RecordBatch.from_arrays([lines.slice(0, n).filter(starts), lines.slice(1, n).filter(starts)], ["head", "seq"])
        held = b.slice(n)


def split_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, split, n (lines), at, value: the first two and last two lines of each split."""
    rows: list[tuple] = []

    def told(key: tuple, n: int, first: list, last: list) -> None:
        lines = dict(enumerate(first)) | {n - len(last) + i: v for i, v in enumerate(last)}
        rows.extend((*key, n, at, v) for at, v in lines.items())

    def batch() -> pa.RecordBatch:
        kinds = {"file": pa.string(), "split": pa.int64(), "n": pa.int64(), "at": pa.int64(), "value": pa.string()}
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
        rows.clear()
        return out

    place, n, first, last = None, 0, [], []
    for b in batches:
        for key, lines in runs(b):
            if key != place:
                if place is not None:
                    told(place, n, first, last)
                place, n, first, last = key, 0, [], []
            n += len(lines)
            first += lines.slice(0, 2 - len(first)).to_pylist()
            last = [*last, *lines.slice(max(0, len(lines) - 2)).to_pylist()][-2:]
        yield batch()
    if place is not None:
        told(place, n, first, last)
        yield batch()


def run_starts(b: pa.RecordBatch) -> np.ndarray:
    """Where a batch's stretches of lines of one split begin; a task has the lines of a split in a row."""
    if not b.num_rows:
        return np.zeros(0, np.int64)
    codes = b.column("file").dictionary_encode().indices.to_numpy()
    return np.r_[0, np.flatnonzero(np.diff(codes) | np.diff(b.column("split").to_numpy())) + 1]


def runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, split), lines) of a batch's stretches of one split."""
    at = [*run_starts(b).tolist(), b.num_rows]
    for i, j in zip(at, at[1:], strict=False):
        yield (b.column("file")[i].as_py(), b.column("split")[i].as_py()), b.column("value").slice(i, j - i)


def fastq(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """FASTQ files, plain or compressed, read by splits however large a file is.

    A record is a line that begins with @ and two lines later one with +, as in
    parse_fastq(). Records inside a split are put together as it is read, and
    their lines are not shuffled. Each split also tells its first and last two
    lines and how many it has; sums of these counts number the lines at the
    borders, and records that begin before a border meet their other lines by
    number. Files of a format that Spark does not split have no borders, and
    are read once; others are read twice. Small splits are read one after
    another by one task: a task for each would take longer than its lines.
    """
    text = spark.read.text(path)
    size = int(str(text._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    lines = lines.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    inside = lines.mapInArrow(records_inside, "head string, seq string")
    if all(p.lower().endswith(".gz") for p in ([path] if isinstance(path, str) else path)):
        return named_records(inside)
    edges = lines.mapInArrow(split_edges, "file string, split bigint, n bigint, at bigint, value string")
    # four rows for each split
    so_far = Window.partitionBy("file").orderBy("split", "at").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).over(so_far) - F.col("n") + F.col("at")
    t = edges.withColumn("number", number).withColumn("late", F.col("at") >= F.col("n") - 2)
    t = t.select("file", "number", "late", "value", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("place"))
    line = lambda i: F.max(F.when(F.col("place") == i, F.col("value")))
    t = t.groupBy("file", (F.col("number") - F.col("place")).alias("first")).agg(F.bool_or(F.col("late") & (F.col("place") == 0)).alias("late"), line(0).alias("head"), line(1).alias("seq"), line(2).alias("plus"))
    return named_records(inside.unionByName(t.where(F.col("late") & F.col("head").startswith("@") & F.col("plus").startswith("+")).select("head", "seq")))


def named_records(t: DataFrame) -> DataFrame:
    """header, location, nucleotides of head and seq lines."""
    return t.select(short_id(F.substr("head", F.lit(2))).alias("header"), F.lit(1).cast("bigint").alias("location"), F.regexp_replace("seq", "\r", "").alias("nucleotides"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """id, length, start, line_bases, line_bytes of a .fai file, with end (the last byte)."""
    t = spark.read.csv(path, sep="\t", schema="id string, length bigint, start bigint, line_bases int, line_bytes int")
    return t.withColumn("end", index_end(F.col("length"), F.col("start"), F.col("line_bases"), F.col("line_bytes")))


def index_end(length: Column, start: Column, line_bases: Column, line_bytes: Column) -> Column:
    """Last byte of an indexed sequence: whole lines, then the rest."""
    return start + F.floor(length / line_bases) * line_bytes + length % line_bases - 1


def position_of_offset(offset: Column, start: Column, line_bases: Column, line_bytes: Column) -> Column:
    """1-based position in the sequence of a byte offset; line breaks count as the next line's first letter."""
    row, column = F.floor((offset - start) / line_bytes), (offset - start) % line_bytes
    return (row * line_bases + F.least(column, line_bases.cast("bigint")) + 1).cast("bigint")


def indexed_chunks(index: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """id, location, bases, first_byte, n_bytes: pieces of indexed sequences that overlap by k - 1 letters."""
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("length") - k), F.lit(chunk).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    t = index.select("id", "length", "start", "line_bases", "line_bytes", F.explode(starts).alias("at"))
    last = F.least(F.col("length"), F.col("at") + chunk + (k - 1))

    def byte(p: Column) -> Column:
        return F.col("start") + F.floor(p / F.col("line_bases")) * F.col("line_bytes") + p % F.col("line_bases")

    return t.select("id", (F.col("at") + 1).alias("location"), (last - F.col("at")).alias("bases"), byte(F.col("at")).alias("first_byte"), (byte(last - 1) - byte(F.col("at")) + 1).alias("n_bytes"))


def indexed_fasta(spark: SparkSession, path: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """Long sequences of one FASTA file with path.fai, in overlapping pieces that are read in parallel."""
    return read_ranges(spark, path, indexed_chunks(fasta_index(spark, f"{path}.fai"), k, chunk))


def from_dataframe(df: DataFrame) -> DataFrame:
    """A DataFrame with header and nucleotides as sequences; location 1 and no mate unless it has them."""
    location = F.col("location").cast("bigint") if "location" in df.columns else F.lit(1).cast("bigint")
    mate = [F.col("nucleotides2")] if "nucleotides2" in df.columns else []
    return df.select("header", location.alias("location"), "nucleotides", *mate)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates joined by header without /1 and /2."""
    a = first.withColumn("header", F.regexp_replace("header", "/1$", ""))
    b = second.select(F.regexp_replace("header", "/2$", "").alias("header"), F.col("nucleotides").alias("nucleotides2"))
    return a.select("header", "location", "nucleotides").join(b, "header")


def expanded(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """File names with @lists replaced by the names in them. The lists are short, as they are typed by hand."""
    out: list[str] = []
    for f in files:
        out += [r.value.strip() for r in spark.read.text(f[1:]).collect() if r.value.strip()] if f.startswith("@") else [f]
    return out


def is_fastq(path: str) -> bool:
    name = path.lower()
    for end in (".gz", ".bz2"):
        name = name.removesuffix(end)
    return name.endswith((".fq", ".fastq"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever storage it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, files: Sequence[str], paired_files: bool = False, k: int = 35, fraction: float | None = None, indexed: bool | None = None, chunk: int = CHUNK) -> DataFrame:
    """Sequences of files, each by its name's format; paired_files: names in pairs of mates.

    A FASTA file with a .fai beside it is read in pieces (indexed: True or
    False to say so instead).
    """
    names = expanded(spark, files)

    def one(f: str) -> DataFrame:
        by_index = not is_fastq(f) and (exists(spark, f"{f}.fai") if indexed is None and "*" not in f else bool(indexed))
        t = fastq(spark, f) if is_fastq(f) else indexed_fasta(spark, f, k, chunk) if by_index else fasta(spark, f)
        return t.select("header", "location", "nucleotides")

    if paired_files:
        if len(names) % 2:
            raise ValueError("paired reads need an even number of files")
        frames = [paired(one(a), one(b)) for a, b in zip(names[::2], names[1::2], strict=True)]
    else:
        frames = [one(f) for f in names]
    out = reduce(DataFrame.unionByName, frames)
    return out if fraction is None else out.sample(fraction)


def titles(sequences: DataFrame) -> DataFrame:
    return sequences.select("header").distinct()


def with_reverse_complements(sequences: DataFrame) -> DataFrame:
    """Each row and its reverse complement, of both mates."""
    both = [c for c in ("nucleotides", "nucleotides2") if c in sequences.columns]
    return sequences.unionByName(sequences.withColumns({c: reverse_complement(F.col(c)) for c in both}))


def without_ambiguous(sequences: DataFrame) -> DataFrame:
    """A row for each stretch of nucleotides, with its location."""
    pieces = F.split("nucleotides", "[^ACGTUacgtu\n\r]+", -1)
    gaps = F.regexp_extract_all("nucleotides", F.lit("[^ACGTUacgtu\n\r]+"), F.lit(0))
    t = sequences.withColumn("_p", pieces).withColumn("_g", gaps)
    t = t.select(*[c for c in sequences.columns if c != "nucleotides"], F.posexplode("_p").alias("_i", "_raw"), "_p", "_g")
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("_i")), F.lit(0), lambda acc, x: acc + F.length(x)) + F.aggregate(F.slice("_g", F.lit(1), F.col("_i")), F.lit(0), lambda acc, x: acc + F.length(x))
    # a stretch begins with a nucleotide: line breaks at its start are passed
    lead = F.length(F.regexp_extract("_raw", "^[\n\r]*", 0))
    t = t.withColumn("nucleotides", F.substr("_raw", lead + 1)).withColumn("location", F.col("location") + before + lead)
    return t.where(F.length("nucleotides") > 0).select(*sequences.columns)


# Fixed patterns of the header formats.
TAXON_TOKEN, BARE_TAXON, ACCESSION = r"(?:^|\|)kraken:taxid\|(\d+)", r"^(\d+)$", r"(?:^|\|)([A-Z]+_?[A-Z0-9]+)(?:\||\b|\.)"


def header_taxon(header: Column) -> Column:
    """Taxon id in a FASTA header: kraken:taxid|N, or a bare number; null if there is none."""
    token = F.regexp_extract(header, TAXON_TOKEN, 1)
    bare = F.regexp_extract(header, BARE_TAXON, 1)
    return F.coalesce(F.nullif(token, F.lit("")), F.nullif(bare, F.lit(""))).cast("int")


def header_accession(header: Column) -> Column:
    """Accession in a FASTA header, null if there is none."""
    return F.nullif(F.regexp_extract(header, ACCESSION, 1), F.lit(""))


def header_entries(header: Column) -> Column:
    """id, taxon and accession of each of the headers that a shared sequence joins by \\x01, in order."""
    return F.transform(F.split(header, "\x01"), lambda h: F.struct(short_id(h).alias("id"), header_taxon(h).alias("taxon"), header_accession(h).alias("accession")))


def accession_taxa(accessions: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accession, taxon by tables (accession, taxon, place: the first place wins), and the accessions without one."""
    best = tables.groupBy("accession").agg(F.min_by("taxon", "place").alias("taxon"))
    found = accessions.select("accession").distinct().join(best, "accession", "left")
    return found.where("taxon is not null"), found.where("taxon is null").select("accession")
