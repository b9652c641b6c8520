"""Minimizers and super-mers: an Arrow kernel, and the same in SQL operators.

The kernel works on a whole batch of sequences as one array of letters, so its
cost is a few vector passes a letter, whatever the number of sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet
from ..functions.alphabet import AMBIGUOUS, BORDER, CODES, SEQUENCE, Scheme

#: Letters that are worked on together.
BATCH = 4 << 20


def rolling(codes: np.ndarray, m: int, forward: bool) -> np.ndarray:
    """Codes of all words of m letters, put together from words of powers of two."""
    n = len(codes) - m + 1
    part, length, out, done = codes.astype(np.int64), 1, None, 0
    while True:
        if m & length:
            piece = part[done : done + n]
            if out is None:
                out = piece.copy()
            elif forward:
                out = (out << 2 * length) | piece
            else:
                out |= piece << 2 * done
            done += length
        length *= 2
        if length > m:
            return out
        half = length // 2
        a, b = part[: len(part) - half], part[half:]
        part = (a << 2 * half) | b if forward else a | (b << 2 * half)


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each run of w elements."""
    if w == 1:
        return x
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.int64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def wide_words(codes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Codes of all words of over 31 letters: a row for each 32 letters of them, left aligned."""
    n = len(codes) - scheme.m + 1
    full = codes.astype(np.uint64)
    for half in (1, 2, 4, 8, 16):
        # words of twice as many letters; past the end they are padded
        full = (full << np.uint64(2 * half)) | np.r_[full[half:], np.zeros(half, np.uint64)]
    out = []
    for j, r in enumerate(scheme.rests):
        w = full[32 * j : 32 * j + n]
        out.append(w if r == 32 else w & np.uint64((1 << 64) - (1 << 64 - 2 * r)))
    return np.stack(out)


def wide_ranks(codes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the priorities of all words, and the priorities (rows of words) by number."""
    w = wide_words(codes, scheme)
    if scheme.canonical:
        other = wide_words(3 - codes[::-1], scheme)[:, ::-1]
        less = np.zeros(w.shape[1], bool)
        for a, b in zip(other[::-1], w[::-1], strict=True):
            less = (a < b) | ((a == b) & less)
        w = np.where(less, other, w)
    for j, (x, s) in enumerate(zip(scheme.xor_words, scheme.space_words, strict=True)):
        w[j] = (w[j] ^ np.uint64(x)) & np.uint64(s)
    order = np.lexsort(w[::-1])
    w = w[:, order]
    new = np.r_[True, (w[:, 1:] != w[:, :-1]).any(0)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, w[:, new].T.copy().view(np.int64)


def supermers(texts: list[bytes], scheme: Scheme) -> dict[str, np.ndarray]:
    """Super-mers and ambiguous stretches of sequences, in order.

    text: index of the sequence; flag; location: offset of its first letter,
    white space left out; kmers; minimizer (0 where ambiguous). Wide
    minimizers are numbers here, and `words` has the codes by number. codes:
    those of all letters but white space; at: where in them a super-mer begins.
    """
    k, m = scheme.k, scheme.m
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = CODES[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    if (codes == 5).any():
        keep = codes != 5
        codes, owner = codes[keep], owner[keep]
    none, words = np.zeros(0, np.int64), np.zeros((1, len(scheme.rests)), np.int64)
    if not len(codes):
        return {"text": none, "flag": none, "location": none, "kmers": none, "minimizer": none, "words": words, "codes": codes, "at": none}
    first = np.searchsorted(owner, np.arange(len(texts)))
    good = codes < 4
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])])
    length = np.diff(np.r_[new, len(codes)])
    long = length >= k
    odd = long & ~good[new]
    out = [(owner[new[odd]], np.full(odd.sum(), AMBIGUOUS), new[odd], length[odd] - (k - 1), np.zeros(odd.sum(), np.int64))]
    sound = long & good[new]
    if sound.any():
        if scheme.wide:
            word, words = wide_ranks(codes & 3, scheme)
        else:
            word = rolling(codes & 3, m, True)
            if scheme.canonical:
                word = np.minimum(word, rolling(3 - (codes & 3), m, False))
            word = (word ^ scheme.xor_mask) & scheme.space_mask
        rank = least_in_windows(word, k - m + 1)
        start, count = new[sound], length[sound] - (k - 1)
        # positions of all k-mers of sound stretches
        at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        least = rank[at]
        begins = np.zeros(len(at), bool)
        begins[np.cumsum(count) - count] = True
        head = np.flatnonzero(begins | np.r_[True, least[1:] != least[:-1]])
        out.append((owner[at[head]], np.full(len(head), SEQUENCE), at[head], np.diff(np.r_[head, len(at)]), least[head]))
    text, flag, location, kmers, minimizer = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(location, kind="stable")
    text, location = text[order], location[order]
    return {"text": text, "flag": flag[order], "location": location - first[text], "kmers": kmers[order], "minimizer": minimizer[order], "words": words, "codes": codes, "at": location}


def packed_letters(codes: np.ndarray, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The given number of letters (0 to 32) from each place on, 2 bits each, left aligned, the rest 0."""
    full = (codes & 3).astype(np.uint64)
    for half in (1, 2, 4, 8, 16):
        full = (full << np.uint64(2 * half)) | np.r_[full[half:], np.zeros(min(half, len(full)), np.uint64)][: len(full)]
    unused = (2 * (32 - letters)).astype(np.uint64)
    word = np.where(letters > 0, full[np.minimum(at, len(codes) - 1)], np.uint64(0))
    # in two steps: a shift by 64 is not defined
    return (word >> (unused >> np.uint64(1)) >> (unused - (unused >> np.uint64(1))) << (unused >> np.uint64(1)) << (unused - (unused >> np.uint64(1)))).view(np.int64)


def key_type(scheme: Scheme) -> str:
    return "array<bigint>" if scheme.wide else "bigint"


def key_column(minimizer: np.ndarray, words: np.ndarray, scheme: Scheme, absent: np.ndarray | None = None) -> pa.Array:
    """Minimizers as an Arrow column: bigints, or arrays of them; null where absent."""
    if not scheme.wide:
        return pa.array(minimizer, mask=absent)
    rows = words[minimizer]
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()), mask=None if absent is None else pa.array(absent))


def parts(batch: pa.RecordBatch, columns: list[int], most: int = BATCH) -> Iterator[tuple[pa.RecordBatch, list[list[bytes | None]]]]:
    """A batch in parts of about `most` letters, with the bytes of its text columns."""
    texts = [batch.column(c).cast(pa.binary()).to_pylist() for c in columns]
    at, size = 0, 0
    for i in range(batch.num_rows):
        size += sum(len(t[i] or b"") for t in texts)
        if size >= most or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at), [t[at : i + 1] for t in texts]
            at, size = i + 1, 0


def spans(reads: DataFrame, scheme: Scheme) -> DataFrame:
    """title, ordinal, flag, is_distinct, kmers, minimizer of reads (header, nucleotides, nucleotides2 or none).

    Stretches shorter than k give nothing. Mates are joined by a border row of
    -(k-1) k-mers. is_distinct: the minimizer differs from the last one before
    it in the read, ambiguous stretches and the border left out.
    """
    paired = "nucleotides2" in reads.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1, 2] if paired else [1]):
                n = part.num_rows
                # sequence 2i is the read, 2i + 1 its mate
                both = [t or b"" for pair in zip(*texts, strict=True) for t in pair] if paired else [t or b"" for t in texts[0]]
                s = supermers(both, scheme)
                read, mate = (s["text"] // 2, s["text"] % 2) if paired else (s["text"], np.zeros(len(s["text"]), np.int64))
                flag, kmers, minimizer = s["flag"], s["kmers"], s["minimizer"]
                place = mate * 2
                if paired:
                    border = np.array([i for i in range(n) if texts[1][i] is not None], np.int64)
                    read, place = np.r_[read, border], np.r_[place, np.ones(len(border), np.int64)]
                    flag, kmers, minimizer = np.r_[flag, np.full(len(border), BORDER)], np.r_[kmers, np.full(len(border), 1 - scheme.k)], np.r_[minimizer, np.zeros(len(border), np.int64)]
                    order = np.lexsort((np.arange(len(read)), place, read))
                    read, flag, kmers, minimizer = read[order], flag[order], kmers[order], minimizer[order]
                ordinal = np.arange(len(read)) - np.searchsorted(read, read)
                sound = np.flatnonzero(flag == SEQUENCE)
                differs = np.zeros(len(read), bool)
                if len(sound):
                    differs[sound] = np.r_[True, (read[sound][1:] != read[sound][:-1]) | (minimizer[sound][1:] != minimizer[sound][:-1])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(read)), pa.array(ordinal.astype(np.int32)), pa.array(flag.astype(np.int32)), pa.array(differs), pa.array(kmers.astype(np.int32)), key_column(minimizer, s["words"], scheme, flag != SEQUENCE)],
                    ["title", "ordinal", "flag", "is_distinct", "kmers", "minimizer"],
                )

    columns = ["header", "nucleotides", *(["nucleotides2"] if paired else [])]
    return reads.select(*columns).mapInArrow(run, f"title string, ordinal int, flag int, is_distinct boolean, kmers int, minimizer {key_type(scheme)}")


def tagged_minimizers(sequences: DataFrame, tag: str, scheme: Scheme, counted: bool = False) -> DataFrame:
    """tag, minimizer (and with counted: n, kmers) of the super-mers of sequences (tag, nucleotides).

    Equal minimizers of a tag are put together within a batch, before anything
    is shuffled; n is the number of super-mers, kmers their k-mers.
    """
    kind = sequences.schema[tag].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1]):
                s = supermers([t or b"" for t in texts[0]], scheme)
                ok = s["flag"] == SEQUENCE
                text, minimizer, kmers = s["text"][ok], s["minimizer"][ok], s["kmers"][ok]
                if not len(text):
                    continue
                tags = part.column(0)
                number = tags.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[text]
                order = np.lexsort((minimizer, number))
                head = np.flatnonzero(np.r_[True, (number[order][1:] != number[order][:-1]) | (minimizer[order][1:] != minimizer[order][:-1])])
                out = [tags.take(pa.array(text[order][head])), key_column(minimizer[order][head], s["words"], scheme)]
                if counted:
                    out += [pa.array(np.diff(np.r_[head, len(order)])), pa.array(np.add.reduceat(kmers[order], head))]
                yield pa.RecordBatch.from_arrays(out, [tag, "minimizer", "n", "kmers"][: len(out)])

    extra = ", n bigint, kmers bigint" if counted else ""
    return sequences.select(tag, "nucleotides").mapInArrow(run, f"{tag} {kind}, minimizer {key_type(scheme)}{extra}")


def positions(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """header, location, length, kmers, minimizer of the super-mers of sequences (header, nucleotides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1]):
                s = supermers([t or b"" for t in texts[0]], scheme)
                ok = s["flag"] == SEQUENCE
                kmers = s["kmers"][ok]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(s["text"][ok])), pa.array(s["location"][ok]), pa.array(kmers + scheme.k - 1), pa.array(kmers), key_column(s["minimizer"][ok], s["words"], scheme)], ["header", "location", "length", "kmers", "minimizer"])

    return sequences.select("header", "nucleotides").mapInArrow(run, f"header string, location bigint, length bigint, kmers bigint, minimizer {key_type(scheme)}")


def with_any(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """header, any: whether a sequence (header, nucleotides) gives a minimizer; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1]):
                s = supermers([t or b"" for t in texts[0]], scheme)
                some = np.zeros(part.num_rows, bool)
                some[s["text"][s["flag"] == SEQUENCE]] = True
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(some)], ["header", "any"])

    return sequences.select("header", "nucleotides").mapInArrow(run, "header string, any boolean")


def counted_kmers(reads: DataFrame, scheme: Scheme) -> DataFrame:
    """title, first, second: k-mers of each read (header, nucleotides, nucleotides2 or none) and of its mate, null without one, as spans() gives them; reads without any are left out."""
    paired = "nucleotides2" in reads.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1, 2] if paired else [1]):
                sums, some = [], np.zeros(part.num_rows, bool)
                for column in texts:
                    s = supermers([t or b"" for t in column], scheme)
                    sums.append(np.bincount(s["text"], s["kmers"], part.num_rows).astype(np.int64))
                    some[s["text"]] = True
                mated = np.array([t is not None for t in texts[1]], bool) if paired else np.zeros(part.num_rows, bool)
                second = pa.array(sums[1] if paired else sums[0], mask=~mated)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[0]), second], ["title", "first", "second"]).filter(pa.array(some | mated))

    columns = ["header", "nucleotides", *(["nucleotides2"] if paired else [])]
    return reads.select(*columns).mapInArrow(run, "title string, first bigint, second bigint")


def supermers_with_letters(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """header, location, kmers, minimizer, letters: the super-mers of positions() with their letters, 32 in a bigint (alphabet.unpacked() reads them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1]):
                s = supermers([t or b"" for t in texts[0]], scheme)
                ok = s["flag"] == SEQUENCE
                kmers, length = s["kmers"][ok], s["kmers"][ok] + scheme.k - 1
                n = (length + 31) // 32
                ends = np.r_[0, np.cumsum(n)]
                done = 32 * (np.arange(ends[-1]) - np.repeat(ends[:-1], n))
                words = packed_letters(s["codes"], np.repeat(s["at"][ok], n) + done, np.minimum(np.repeat(length, n) - done, 32)) if len(done) else done
                letters = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(s["text"][ok])), pa.array(s["location"][ok]), pa.array(kmers), key_column(s["minimizer"][ok], s["words"], scheme), letters], ["header", "location", "kmers", "minimizer", "letters"])

    return sequences.select("header", "nucleotides").mapInArrow(run, f"header string, location bigint, kmers bigint, minimizer {key_type(scheme)}, letters array<bigint>")


def counted_supermers(sequences: DataFrame, weight: str, scheme: Scheme) -> DataFrame:
    """minimizer, kmers, letters, n: distinct super-mers of sequences (weight, nucleotides) with the sum of their weights.

    Equal ones are put together within a batch. A super-mer of more letters
    than one k-mer's minimizer can span (a repeat) is cut into pieces of so
    many, so all have as many words of letters.
    """
    k, width = scheme.k, -(-(2 * scheme.k - scheme.m) // 32)
    most = 32 * width - (k - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, [1]):
                s = supermers([t or b"" for t in texts[0]], scheme)
                ok = np.flatnonzero(s["flag"] == SEQUENCE)
                if not len(ok):
                    continue
                n = -(-s["kmers"][ok] // most)
                piece = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
                of = np.repeat(ok, n)
                kmers = np.minimum(s["kmers"][of] - piece * most, most)
                at = (s["at"][of] + piece * most)[:, None] + 32 * np.arange(width)
                left = np.clip((kmers + k - 1)[:, None] - 32 * np.arange(width), 0, 32)
                words = packed_letters(s["codes"], at.ravel(), left.ravel()).reshape(-1, width)
                weights = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[s["text"][of]]
                columns = [kmers, *words.T, s["minimizer"][of]]
                order = np.lexsort(columns)
                same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
                head = np.flatnonzero(np.r_[True, ~same])
                kept = order[head]
                ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * width)
                letters = pa.ListArray.from_arrays(ends, pa.array(words[kept].ravel()))
                yield pa.RecordBatch.from_arrays([key_column(s["minimizer"][of][kept], s["words"], scheme), pa.array(kmers[kept].astype(np.int32)), letters, pa.array(np.add.reduceat(weights[order], head))], ["minimizer", "kmers", "letters", "n"])

    return sequences.select(weight, "nucleotides").mapInArrow(run, f"minimizer {key_type(scheme)}, kmers int, letters array<bigint>, n bigint")


# The same as DataFrame operations, for words of A, C, G, T only.


def words(sequences: DataFrame, width: int) -> DataFrame:
    """header, pos (from 1), word: all words of a width."""
    starts = F.when(F.length("nucleotides") >= width, F.sequence(F.lit(1), F.length("nucleotides") - (width - 1))).otherwise(F.array().cast("array<int>"))
    t = sequences.select("header", "nucleotides", F.explode(starts).alias("pos"))
    return t.select("header", "pos", F.substr("nucleotides", F.col("pos"), F.lit(width)).alias("word"))


def coded_words(sequences: DataFrame, width: int, forward_only: bool = False) -> DataFrame:
    """header, pos (from 1), code: as words(), of at most 31 letters; a sequence is packed once, and a word's code is two shifts.

    forward_only: those that are not above their reverse complement, which is a word of the sequence's.
    """
    t = sequences.select("header", F.col("nucleotides").alias("text"), F.length("nucleotides").alias("n"), *([alphabet.reverse_complement(F.col("nucleotides")).alias("other")] if forward_only else []))
    # a select of its own: beside explode() it would be packed again for each word
    t = t.select("header", "n", *[alphabet.packed(F.col(c)).alias(c) for c in (("text", "other") if forward_only else ("text",))])
    starts = F.when(F.col("n") >= width, F.sequence(F.lit(1), F.col("n") - (width - 1))).otherwise(F.array().cast("array<int>"))
    t = t.select("*", F.explode(starts).alias("pos"))
    code = alphabet.code_in(F.col("text"), F.col("pos") - 1, width)
    if forward_only:
        t = t.where(code <= alphabet.code_in(F.col("other"), F.col("n") - width + 1 - F.col("pos"), width))
    return t.select("header", "pos", code.alias("code"))


def window_minimizers(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """header, minimizers: an array of the minimizers of all k-mers of a sequence, in order; m of at most 31 letters.

    Windows are within a sequence's array of priorities, so no word is a row that has to be sorted.
    """
    k, m, n = scheme.k, scheme.m, F.col("n")
    t = sequences.select("header", F.length("nucleotides").alias("n"), F.col("nucleotides").alias("text"), alphabet.reverse_complement(F.col("nucleotides")).alias("other"))
    t = t.select("header", "n", *[alphabet.packed(F.col(c)).alias(c) for c in (("text", "other") if scheme.canonical else ("text",))])

    def rank(i: Column) -> Column:
        # a word's reverse complement is a word of the reverse complement
        own = alphabet.code_in(F.col("text"), i, m)
        return alphabet.toggled(F.least(own, alphabet.code_in(F.col("other"), n - m - i, m)) if scheme.canonical else own, scheme)

    def places(width: int) -> Column:
        return F.when(n >= k, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))

    t = t.select("header", "n", F.transform(places(m), rank).alias("ranks"))
    least = F.transform(places(k), lambda i: F.least(*[F.get("ranks", i + j) for j in range(k - m + 1)]) if k > m else F.get("ranks", i))
    return t.select("header", least.alias("minimizers"))


def minimizers_by_window(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """header, pos, minimizer for each k-mer, by a window over its m-mers."""
    # outer: for a plain one Spark adds a filter on the array's size, in which the array is made anew for each of its elements
    t = window_minimizers(sequences, scheme).select("header", F.posexplode_outer("minimizers").alias("i", "minimizer")).where("i IS NOT NULL")
    return t.select("header", (F.col("i") + 1).alias("pos"), "minimizer")


def supermers_by_window(sequences: DataFrame, scheme: Scheme) -> DataFrame:
    """header, location, length, kmers, minimizer: runs of k-mers with one minimizer."""
    places = F.when(F.size("minimizers") > 0, F.sequence(F.lit(0), F.size("minimizers") - 1)).otherwise(F.array().cast("array<int>"))
    t = window_minimizers(sequences, scheme).withColumn("heads", F.filter(places, lambda i: (i == 0) | (F.get("minimizers", i) != F.get("minimizers", i - 1))))
    t = t.select("header", "minimizers", "heads", F.posexplode_outer("heads").alias("i", "head")).where("i IS NOT NULL")
    kmers = (F.coalesce(F.get("heads", F.col("i") + 1), F.size("minimizers")) - F.col("head")).cast("bigint")
    t = t.select("header", F.col("head").cast("bigint").alias("location"), kmers.alias("kmers"), F.get("minimizers", F.col("head")).alias("minimizer"))
    return t.select("header", "location", (F.col("kmers") + (scheme.k - 1)).alias("length"), "kmers", "minimizer")
