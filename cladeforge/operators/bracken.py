"""Abundance-correction weights: how reads of each genome would be classified.

Every window of `read_length` letters of every genome is classified as a read
of its own, with no confidence threshold and two hit groups. A window is a
run of consecutive k-mers, so its hits come from one sweep over the genome, in
which taxa enter and leave the window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import NONE, SEQUENCE
from . import minimizers
from .index import KEY, MinimizerIndex

FRAGMENT = 1 << 20
MIN_HIT_GROUPS = 2


def fragments(sequences: DataFrame, read_length: int, most: int = FRAGMENT) -> DataFrame:
    """header, location, nucleotides: pieces of at most `most` letters that overlap by read_length - 1.

    Every window of read_length letters is in one piece, and in one only.
    """
    if most < read_length:
        raise ValueError("fragments must be at least as long as reads")
    clean = sequences.withColumn("nucleotides", F.regexp_replace("nucleotides", r"\s+", ""))
    n, step = F.length("nucleotides"), most - (read_length - 1)
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - read_length, F.lit(step)))
    t = clean.withColumn("at", F.explode(starts))
    others = [c for c in clean.columns if c not in ("nucleotides", "location")]
    return t.select(*others, F.col("at").cast("bigint").alias("location"), F.substr("nucleotides", F.col("at") + 1, F.lit(most)).alias("nucleotides"))


class Ways:
    """The ways from the root to the taxa that a fragment meets."""

    def __init__(self, paths: dict[int, list[int]]):
        self.paths = paths
        #: of each taxon, those of the fragment's taxa that are on its way, itself included
        self.above = {t: frozenset(x for x in way if x in paths) for t, way in paths.items()}
        #: the longest way, if all taxa are on it, as where the genome is in the index itself; None otherwise
        self.chain = max(paths.values(), key=len, default=[])
        if not set(self.chain).issuperset(paths):
            self.chain = None

    def change(self, counts: dict[int, int], scores: dict[int, int], taxon: int, n: int) -> None:
        """n more k-mers of a taxon; scores has the k-mers on the ways of the taxa in counts."""
        if taxon == NONE:
            return
        for t in scores:
            if taxon in self.above[t]:
                scores[t] += n
        counts[taxon] = counts.get(taxon, 0) + n
        if not counts[taxon]:
            del counts[taxon], scores[taxon]
        elif taxon not in scores:
            scores[taxon] = self.score(counts, taxon)

    def score(self, counts: dict[int, int], taxon: int) -> int:
        return sum(counts.get(x, 0) for x in self.above[taxon])

    def best(self, counts: dict[int, int], scores: dict[int, int], leaves: int, enters: int, windows: int) -> Iterator[tuple[int, int]]:
        """(taxon, number) of neighbouring windows: in each next one, a k-mer of `leaves` is gone and one of `enters` there.

        A taxon's score, the k-mers on its way, grows, stays or shrinks by one
        from window to window, so the best of each kind is a line, and the
        answer changes only where two of three lines meet. Taxa without k-mers
        in a window do no harm: one on their way has the same score.
        """
        lines: dict[int, tuple[int, list[int]]] = {}
        coming = [(enters, self.score(counts, enters))] if enters != NONE and enters not in scores else []
        for t, score in [*scores.items(), *coming]:
            above = self.above[t]
            slope = (enters in above) - (leaves in above)
            if slope not in lines or score > lines[slope][0]:
                lines[slope] = score, self.paths[t]
            elif score == lines[slope][0]:
                lines[slope] = score, shared_way(lines[slope][1], self.paths[t])
        cuts = {0, windows}
        for (s, (x, _)), (r, (y, _)) in combinations(lines.items(), 2):
            meet = (x - y) // (r - s)
            cuts |= {meet, meet + 1}
        for start, end in pairwise(sorted(c for c in cuts if 0 <= c <= windows)):
            top = max((x + s * start for s, (x, _) in lines.items()), default=0)
            ways = [way for s, (x, way) in lines.items() if x + s * start == top] if top > 0 else []
            yield reduce(shared_way, ways)[-1] if ways else NONE, end - start


def shared_way(a: list[int], b: list[int]) -> list[int]:
    return [x for x, y in zip(a, b) if x == y]  # noqa: B905


def simulated(fragment: bytes, taxa_of: Callable[[np.ndarray, np.ndarray], np.ndarray], ways: Ways, scheme, read_length: int) -> dict[int, int]:
    """Number of windows of one fragment by taxon. taxa_of: taxa of the kernel's minimizers (minimizer, words), NONE of unknown ones.

    Where the taxa are on one way, a window is of the lowest among them. Others
    are swept by stretches in which the k-mer that leaves and the one that enters
    keep their taxa; the counts of the taxa in a window are all that is carried
    along.
    """
    s = minimizers.supermers([fragment], scheme)
    ok = s["flag"] == SEQUENCE
    return swept(len(fragment), s["location"][ok], s["kmers"][ok], s["minimizer"][ok], taxa_of(s["minimizer"][ok], s["words"]), ways, scheme, read_length)


def swept(letters: int, at: np.ndarray, length: np.ndarray, rank: np.ndarray, taxa: np.ndarray, ways: Ways, scheme, read_length: int) -> dict[int, int]:
    """As simulated(), of a fragment of so many letters with super-mers of `length` k-mers from `at` on, their minimizers and taxa."""
    n_windows, per_read = letters - read_length + 1, read_length - (scheme.k - 1)
    if n_windows <= 0:
        return {}
    if per_read <= 0:
        return {NONE: n_windows}
    size = letters - (scheme.k - 1)
    places = np.repeat(at - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    # hit groups of a window: those begun before its end, less those ended before its start
    real = np.r_[True, rank[1:] != rank[:-1]][: len(rank)] & (taxa != NONE)
    begun = np.r_[0, np.cumsum(np.bincount(at[real], minlength=size)[:size], dtype=np.int32)]
    ended = np.r_[0, np.cumsum(np.bincount(at[real] + length[real], minlength=size + 1)[: size + 1], dtype=np.int32)]
    enough = begun[per_read : per_read + n_windows] - ended[1 : 1 + n_windows] >= MIN_HIT_GROUPS
    if ways.chain is not None:
        # on one way, the k-mers of the lowest taxon in a window are all that it needs to have the best score
        kinds, kind = np.unique(taxa, return_inverse=True)
        level = np.array([ways.chain.index(t) + 1 if t != NONE else 0 for t in kinds.tolist()], np.int64)
        levels = np.zeros(size, np.int64)
        levels[places] = np.repeat(level[kind], length)
        lowest = np.where(enough, -minimizers.least_in_windows(-levels, per_read), 0)
        return {ways.chain[x - 1] if x else NONE: n for x, n in enumerate(np.bincount(lowest).tolist()) if n}
    kmer_taxon = np.zeros(size, np.int32)
    kmer_taxon[places] = np.repeat(taxa, length)
    leaves, enters = kmer_taxon[:n_windows], np.r_[kmer_taxon[per_read:], np.int32(NONE)]
    change = np.flatnonzero(np.r_[True, (leaves[1:] != leaves[:-1]) | (enters[1:] != enters[:-1]) | (enough[1:] != enough[:-1])])
    counts: dict[int, int] = {}
    scores: dict[int, int] = {}
    for t, n in zip(*np.unique(kmer_taxon[:per_read], return_counts=True), strict=True):
        ways.change(counts, scores, int(t), int(n))
    out: dict[int, int] = {}
    for start, end in pairwise([*change.tolist(), n_windows]):
        gone, new, n = int(leaves[start]), int(enters[start]), end - start
        for taxon, m in ways.best(counts, scores, gone, new, n) if enough[start] else ((NONE, n),):
            out[taxon] = out.get(taxon, 0) + m
        if gone != new and end < n_windows:
            ways.change(counts, scores, gone, -n)
            ways.change(counts, scores, new, n)
    return out


def lookup(ids: np.ndarray, taxa: np.ndarray, scheme) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Taxa of the kernel's minimizers by a fragment's known ones (ids: a number, or a row of words where they are wide)."""

    def narrow(minimizer: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(len(minimizer), np.int32)
        order = np.argsort(ids)
        place = np.minimum(np.searchsorted(ids, minimizer, sorter=order), len(ids) - 1)
        return np.where(ids[order[place]] == minimizer, taxa[order[place]], NONE).astype(np.int32)

    def wide(minimizer: np.ndarray, words: np.ndarray) -> np.ndarray:
        known = {row.tobytes(): t for row, t in zip(ids, taxa.tolist(), strict=True)}
        used, place = np.unique(minimizer, return_inverse=True)
        return np.array([known.get(row.tobytes(), NONE) for row in words[used]], np.int32)[place]

    return wide if scheme.wide else narrow


def weights(sequences: DataFrame, labels: DataFrame, index: MinimizerIndex, read_length: int = 100, most: int = FRAGMENT) -> DataFrame:
    """dest, source, n: windows of the genomes of `source` that are classified as `dest`."""
    # labels are looked up in the tree before sequences are joined, which stay in their tasks
    known_labels = index.taxonomy.defined(labels.select("header", F.col("taxon").cast("int").alias("taxon")))
    tagged = sequences.select("header", "nucleotides").join(known_labels, "header")
    pieces = fragments(tagged, read_length, most).withColumn("fragment", F.concat_ws(":", "header", "location"))
    asked = minimizers.tagged_minimizers(pieces, "fragment", index.scheme)
    known = asked.join(index.records.withColumnRenamed(KEY, "minimizer"), "minimizer").join(index.taxonomy.table.select("taxon", "path"), "taxon")
    # a fragment has at most as many minimizers as letters, so its group is bounded
    lca = known.groupBy("fragment").agg(F.collect_list("minimizer").alias("minimizers"), F.collect_list("taxon").alias("taxa"), F.collect_set(F.struct("taxon", "path")).alias("paths"))
    rows = pieces.join(lca, "fragment", "left").select("taxon", "nucleotides", "minimizers", "taxa", "paths")
    scheme = index.scheme

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # windows by (dest, source) over the batch: one small batch out for each that comes in
            found: Counter[tuple[int, int]] = Counter()
            for part, (texts,) in minimizers.parts(b, [1], FRAGMENT):
                s = minimizers.supermers([t or b"" for t in texts], scheme)
                ok = s["flag"] == SEQUENCE
                at, length, rank = s["location"][ok], s["kmers"][ok], s["minimizer"][ok]
                ends = np.searchsorted(s["text"][ok], np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    # one fragment's lists at a time, the long ones as arrays
                    source, _, ids, taxa, paths = (part.column(c)[i] for c in range(5))
                    flat = (ids.values.flatten() if scheme.wide else ids.values).to_numpy() if ids.is_valid else np.zeros(0, np.int64)
                    known = taxa.values.to_numpy() if taxa.is_valid else np.zeros(0, np.int32)
                    ways, own = Ways({p["taxon"]: p["path"] for p in paths.as_py() or ()}), slice(ends[i], ends[i + 1])
                    taxa_of, of = lookup(flat.reshape(len(known), -1) if scheme.wide else flat, known, scheme), source.as_py()
                    for dest, n in swept(len(texts[i] or b""), at[own], length[own], rank[own], taxa_of(rank[own], s["words"]), ways, scheme, read_length).items():
                        found[dest, of] += n
            dests, sources = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(dests, pa.int32()), pa.array(sources, pa.int32()), pa.array(list(found.values()), pa.int64())], ["dest", "source", "n"])

    return rows.mapInArrow(run, "dest int, source int, n bigint").groupBy("dest", "source").agg(F.sum("n").alias("n"))


def distribution_lines(weights: DataFrame) -> DataFrame:
    """dest, line: source:windows:all windows of the source, joined by blanks, for each dest."""
    total = weights.groupBy("source").agg(F.sum("n").alias("total"))
    t = weights.where(F.col("dest") != NONE).join(total, "source").groupBy("dest").agg(F.array_sort(F.collect_list(F.struct("source", "n", "total"))).alias("a"))
    return t.select("dest", F.concat_ws("\t", "dest", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["source"], x["n"], x["total"])), " ")).alias("line"))


# Fixed value: the header of the weights format.
HEADER = "mapped_taxid\tgenome_taxids:kmers_mapped:total_genome_kmers"


def weights_in_batches(sequences: DataFrame, labels: DataFrame, index: MinimizerIndex, path: str, read_length: int = 100, batches: int = 5) -> DataFrame:
    """As weights(), in batches of taxa appended to a Parquet table at path: a failure costs one batch."""
    for i in range(batches):
        part = labels.where(F.pmod(F.hash("taxon"), F.lit(batches)) == i)
        weights(sequences, part, index, read_length).write.mode("overwrite" if i == 0 else "append").parquet(path)
    return index.records.sparkSession.read.parquet(path).groupBy("dest", "source").agg(F.sum("n").alias("n"))
