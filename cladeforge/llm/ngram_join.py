"""N-gram Jaccard join with a count-vector R-tree (operator 4).

A document is the set of its distinct n-word shingles; two documents link
when their Jaccard likeness is at least `least` per cent. Exact copies are
one node: sets are first grouped by a 128-bit hash, and the smallest doc_id
that has a set stands for it.

Points. Shingles are hashed into `GROUPS` groups; the counts of a set's
shingles by group are its point. Two sets share at most the sum of the
coordinate minima of their points, and an R-tree node that covers many points
bounds them all by its upper corner.

Where points meet. Order all shingles of the corpus by how many sets hold
them, rare ones first. Two linked sets of sizes n and m share least per cent
of either, so the first shingle that they share, in that order, is among the
first n - ceil(least * n / 100) + 1 of the one and the like number of the
other: that shingle is the key under which the two meet. Shingles that only
one set holds come first and meet nobody, so a set with enough of them needs
no key at all. No link is lost, whatever the data.

How the order is found. Shingles go to buckets by hash, packed, with the ids
of their sets; a bucket counts and drops what only one set holds. The others
return to buckets of ids, where each set picks its keys. A shingle that many
sets of one task hold goes to its bucket as a count; the list of its sets
stays aside and meets the sum of the counts later, so no bucket gathers the
sets of a very common shingle. Keys are combined within a task in the same
way, so copies and common keys cost at most a row for each task.

Which pairs are looked at. First each set and the smallest one under each of
its keys. Pairs that pass the bound are verified on the sets themselves, and
verified links make components. Then, under keys that still have several
components, an R-tree over the points finds for each set its nearest partners
in other components; those are verified (where such keys have few points, this
is left out, as the next step finds all). Last, the R-trees of the keys that
are still open give every pair across components that passes the bound, once,
under the least open key that its sets share (as far as the `EARLIER` keys
tell), and all of these are verified. Pairs within a component need no look, so a group
of near copies costs about as many pairs as it has members, not the square.
Keys with very many points are split into blocks, and each pair of blocks is
a task of its own.

Free style: shingles and the R-tree are numpy on Arrow batches, joins and
components are DataFrame operations.

Defined results: null and empty texts have an empty set and link with
nothing, their component is their own doc_id; a text with fewer words than n
has its word sequence as one shingle; repeated rows are one document; of rows
that share a doc_id but not a text, each has its size, and their component is
that of the links found for any of them; a null doc_id has no component (null);
equally rare shingles are ordered by hash; rows may come in any order; an
empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

GROUPS = 128
LEAF, FAN = 32, 8
#: Points of one key that one task takes together.
BLOCK = 20_000
#: Keys or pairs that a task holds before it hands them on; also about the keys of a bucket.
HELD = 250_000
#: Points of one key among which a set looks for its nearest partners.
NEAR_BLOCK = 2_000
#: Partners that a set is verified with before all remaining pairs are looked at.
NEAREST = 3
#: Shingles that a task holds before it hands them on, and about those of a bucket.
TOKENS_HELD, TOKENS_IN_BUCKET = 1_000_000, 300_000
#: A shingle that so many of the sets a task holds have is sent as a count.
HOT = 16
#: Ids of copies that are broadcast at most, to leave them out early.
MOST_COPIES = 200_000
#: Pairs of points a row under open keys up to which all pairs are looked at without looking for nearest partners first.
FEW_PAIRS = 4
#: Keys of a set, the least ones, that travel with it, so that a pair is not told again under a later key.
EARLIER = 64
#: Ids that are broadcast at most, and bits of the map that stands for more of them (16 MB).
FEW, BITS = 10_000, 1 << 27
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Sets seen that a task remembers, and word hashes that a worker does.
MOST_KEPT, MOST_WORDS = 300_000, 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(31))) * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, n: int):
        self.n = n
        # the words of one task after the other; what another operator remembered goes
        self.kept: dict[bytes, int] = common.remembered("words", dict)

    def word_hashes(self, text: str) -> np.ndarray:
        # bytes.lower() and bytes.split() know A-Z and the six ASCII blanks only, as the definition does
        words = text.encode("utf-8", "surrogatepass").lower().split()
        kept = self.kept
        if len(kept) > MOST_WORDS:
            kept.clear()
        try:
            return np.array([kept[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in kept:
                    kept[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([kept[w] for w in words], np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        w = self.word_hashes(text or "")
        if not len(w):
            return w
        width = min(self.n, len(w))
        h = np.full(len(w) - width + 1, width, np.uint64)
        for k in range(width):
            h = mixed(h * MIX2 + w[k : len(w) - width + 1 + k])
        return np.unique(h)


def key_count(n: np.ndarray, least: int) -> np.ndarray:
    """How many of a set's n shingles, rarest first, are its keys."""
    return n - -(-least * n // 100) + 1


def lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def point_of(h: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts by group as bytes times a scale; scaled counts are rounded up, so that bounds stay bounds."""
    counts = np.bincount((h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    scale = max(1, -(-int(counts.max()) // 127))
    return -(-counts // scale), scale


def digest(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, sig (null for an empty set), point and scale of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [s.hashes(t) for t in part.column(1).to_pylist()]
                points = [point_of(h) for h in sets]
                sig = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(sig, pa.binary()), lists([p.astype(np.int8) for p, _ in points], pa.int8()), pa.array([x for _, x in points], pa.int32())], ["doc_id", "n_shingles", "sig", "point", "scale"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, sig binary, point array<tinyint>, scale int")


def some_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents (doc_id, text) with the given ids, and perhaps of a few others.

    Few ids are broadcast. Many are told to the scan by a bitmap of their
    hashes, whose size is fixed: it may let others pass, which the join with
    the pairs leaves out, but only wanted texts are shuffled.
    """
    ids = common.cut(ids)
    if ids.count() <= FEW:
        return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    spot = F.pmod(F.xxhash64("id"), F.lit(BITS))
    words = ids.select(F.shiftright(spot, 5).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (spot % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = words.toPandas()
    bitmap = np.zeros(BITS >> 5, np.uint32)
    bitmap[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((bits.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0))
            if b.num_rows:
                yield b.select([0, 1]).rename_columns(["id", "text"])

    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("place")).mapInArrow(run, "id bigint, text string")


PACKED = ["bucket", "local", "keys", "base", "ids", "firsts"]


def packed(keys: np.ndarray, ids: np.ndarray, firsts: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Entries by bucket of their key, packed: the low 6 bytes of keys, ids as offsets from the least, as short as they can be."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    keys, ids, bucket = keys[order], ids[order], bucket[order]
    firsts = ids if firsts is None else firsts[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    base = int(min(ids.min(), firsts.min()))
    span = int(max(ids.max(), firsts.max())) - base
    kind = np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.uint64
    short, short_firsts = (ids - base).astype(kind), (firsts - base).astype(kind)
    local = firsts is not ids
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    rows = [slice(a, z) for a, z in zip(at, [*at[1:], len(keys)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array([local] * len(rows)), pa.array([low[r].tobytes() for r in rows], pa.binary()), pa.array([base] * len(rows), pa.int64()), pa.array([short[r].tobytes() for r in rows], pa.binary()), pa.array([short_firsts[r].tobytes() if local else b"" for r in rows], pa.binary())], PACKED)


def offsets(ids: np.ndarray) -> tuple[int, np.ndarray]:
    """The least id, and all as offsets from it, as short as they can be."""
    base = int(ids.min())
    span = int(ids.max()) - base
    return base, (ids - base).astype(np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.uint64)


def from_offsets(base: int, packed_ids: bytes, n: int) -> np.ndarray:
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(packed_ids) // n]
    return np.frombuffer(packed_ids, kind).astype(np.int64) + base


def planes(sorted_low: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps, byte by byte: the upper bytes compress."""
    steps = np.diff(sorted_low, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32)


def slices(sorted_values: np.ndarray) -> list[slice]:
    """Runs of equal values."""
    if not len(sorted_values):
        return []
    at = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return [slice(int(a), int(z)) for a, z in zip(at, [*at[1:], len(sorted_values)], strict=True)]


#: Kinds of rows: entries of shingles or sets, counts of hot shingles, sets of hot shingles, sizes of sets.
ENTRIES, COUNTS, HOT_LIST, SIZES = range(4)
ROW = "kind int, bucket bigint, token bigint, base bigint, ids binary, tokens binary, ranks binary"
ROW_NAMES = [c.split()[0] for c in ROW.split(", ")]


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ROW_NAMES)


def dealt_tokens(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Shingles of the sets of documents with the ids of the sets, packed by bucket.

    A shingle is known by its bucket and 32 bits of its hash: if two agree in
    both, they count as one, which makes keys more common, not wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n)
        # the smallest id of each set so far: it may be the one that stands for the set
        seen: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x for x, _ in held])
            ids = np.repeat(np.array([i for _, i in held], np.int64), [len(x) for x, _ in held])
            held.clear()
            token = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            order = np.argsort(token, kind="stable")
            token, ids = token[order], ids[order]
            del h, order
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            count = np.diff(np.r_[start, len(token)])
            hot = count >= HOT
            rows = []
            for a, c in zip(start[hot].tolist(), count[hot].tolist(), strict=True):
                base, short = offsets(ids[a : a + c])
                # anywhere but in one place: it waits for the count
                rows.append((HOT_LIST, buckets + int(ids[a]) % buckets, int(token[a]), base, bytes([short.itemsize]) + short.tobytes(), b"", b""))
                if len(rows) >= 5_000:
                    yield row_batch(rows)
                    rows = []
            counted, counts = token[start[hot]], count[hot]
            few = np.repeat(~hot, count)
            token, ids = token[few], ids[few]
            for kind, values, others in ((COUNTS, counted, counts), (ENTRIES, token, ids)):
                bucket, low = (values >> np.uint64(32)).astype(np.int64), (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for r in slices(bucket):
                    base, short = offsets(others[r])
                    rows.append((kind, int(bucket[r.start]), None, base, short.tobytes(), planes(low[r]), b""))
                    if len(rows) >= 200:
                        yield row_batch(rows)
                        rows = []
            if rows:
                yield row_batch(rows)

        for b in batches:
            ids = b.column(0).to_pylist()
            for i, t in zip(ids, b.column(1), strict=True):
                h = s.hashes(t.as_py())
                if i is None or not len(h):
                    continue
                sig = xxhash.xxh3_128_digest(h.tobytes())
                if seen.get(sig, i + 1) <= i:
                    continue
                if len(seen) >= MOST_KEPT:
                    seen.clear()
                seen[sig] = i
                held.append((h, i))
                size += len(h)
                if size >= TOKENS_HELD:
                    yield from flushed()
                    size = 0
        if held:
            yield from flushed()

    return docs.mapInArrow(run, ROW)


def buckets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of a sorted partition, one list for each bucket."""
    held: list[tuple] = []
    for b in batches:
        for row in range(b.num_rows):
            r = tuple(c[row].as_py() for c in b.columns)
            if held and held[-1][1] != r[1]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def by_id(ids: np.ndarray, tokens: np.ndarray, ranks: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries (id, shingle, rank) packed by bucket of their id."""
    bucket = (mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, tokens, ranks = (x[order] for x in (bucket, ids, tokens, ranks))
    low = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    rows = []
    for r in slices(bucket):
        base, short = offsets(ids[r])
        rows.append((ENTRIES, int(bucket[r.start]), None, base, short.tobytes(), low[r].tobytes(), ranks[r].tobytes()))
    for at in range(0, len(rows), 500):
        yield row_batch(rows[at : at + 500])


def rank_of(df: np.ndarray) -> np.ndarray:
    """How common a shingle is, in steps of an eighth of a doubling."""
    return np.minimum(255, 8 * np.log2(np.maximum(df, 1))).astype(np.uint8)


def shared_tokens(dealt: DataFrame, buckets: int) -> DataFrame:
    """Shingles that several sets hold: their sets by bucket of id, and the counts and lists of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            yield from by_id(*(np.concatenate([x[c] for x in held]) for c in range(3)), buckets)
            held.clear()

        for rows in buckets_in(batches):
            aside = [r for r in rows if r[0] == HOT_LIST]
            for at in range(0, len(aside), 5_000):
                yield row_batch(aside[at : at + 5_000])
            rows = [r for r in rows if r[0] != HOT_LIST]
            if not rows:
                continue
            lows = [from_planes(r[5]) for r in rows]
            values = [from_offsets(r[3], r[4], len(x)) for r, x in zip(rows, lows, strict=True)]
            counts = np.concatenate([v if r[0] == COUNTS else np.ones(len(v), np.int64) for r, v in zip(rows, values, strict=True)])
            ids = np.concatenate([np.full(len(v), np.iinfo(np.int64).min) if r[0] == COUNTS else v for r, v in zip(rows, values, strict=True)])
            low = np.concatenate(lows)
            order = np.argsort(low, kind="stable")
            low, ids, counts = low[order], ids[order], counts[order]
            start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            df = np.repeat(np.add.reduceat(counts, start), np.diff(np.r_[start, len(low)]))
            token = np.uint64(rows[0][1] << 32) | low.astype(np.uint64)
            is_hot = ids == np.iinfo(np.int64).min
            if is_hot.any():
                told, first = np.unique(token[is_hot], return_index=True)
                number = df[is_hot][first]
                for at in range(0, len(told), 5_000):
                    yield row_batch([(COUNTS, 0, int(t), int(c), b"", b"", b"") for t, c in zip(told[at : at + 5_000], number[at : at + 5_000], strict=True)])
            keep = (df > 1) & ~is_hot
            if keep.any():
                held.append((ids[keep], token[keep], rank_of(df[keep])))
                size += int(keep.sum())
                if size >= TOKENS_IN_BUCKET:
                    yield from flushed()
                    size = 0
        if held:
            yield from flushed()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ROW)


def hot_entries(table: DataFrame, buckets: int) -> DataFrame:
    """The lists of hot shingles as entries by bucket of id, now that the counts are known."""
    counts = table.where(F.col("kind") == COUNTS).select("token", F.col("base").alias("df"))
    lists_of = table.where(F.col("kind") == HOT_LIST).select("token", "base", "ids").join(counts, "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                token, base, ids, df = (c.to_pylist() for c in b.slice(at, 2_000).columns)
                # the first byte of a list is the width of its ids
                each = [from_offsets(x, y[1:], (len(y) - 1) // y[0]) for x, y in zip(base, ids, strict=True)]
                many = [len(x) for x in each]
                yield from by_id(np.concatenate(each), np.repeat(np.array(token, np.uint64), many), np.repeat(rank_of(np.array(df)), many), buckets)

    return lists_of.mapInArrow(run, ROW)


def packed_sizes(sets: DataFrame, buckets: int) -> DataFrame:
    """Sizes of the sets (id, n), packed by bucket of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            bucket = (mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, ids, n = bucket[order], ids[order], n[order]
            yield row_batch([(SIZES, int(bucket[r.start]), None, 0, ids[r].astype("<i8").tobytes(), n[r].astype("<i8").tobytes(), b"") for r in slices(bucket)])

    return sets.select("id", "n").mapInArrow(run, ROW)


def dealt_keys(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """Keys of the sets, packed by bucket, from entries and sizes by bucket of id.

    Sets of a task that meet under a key are told there and then (local): only
    the smallest of them goes on for that key. So a common key sends no more
    rows than there are tasks. Sets without a size are copies of others and
    have no keys; those of size -1 have all their shared shingles as keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            keys, ids = (np.concatenate([x[c] for x in held]) for c in (0, 1))
            held.clear()
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.r_[True, keys[1:] != keys[:-1]]
            first = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            yield packed(keys[new], ids[new], None, buckets)
            several = ~new | np.r_[~new[1:], False]
            if several.any():
                yield packed(keys[several], ids[several], first[several], buckets)

        for group in buckets_in(batches):
            sized, entries = ([r for r in group if r[0] == kind] for kind in (SIZES, ENTRIES))
            if not sized or not entries:
                continue
            known, n = (np.concatenate([np.frombuffer(r[c], "<i8") for r in sized]) for c in (4, 5))
            order = np.argsort(known)
            known, n = known[order], n[order]
            ids = np.concatenate([from_offsets(r[3], r[4], len(r[6])) for r in entries])
            token = np.zeros((len(ids), 8), np.uint8)
            token[:, :7] = np.concatenate([np.frombuffer(r[5], np.uint8) for r in entries]).reshape(-1, 7)
            token = token.view("<u8").ravel()
            rank = np.concatenate([np.frombuffer(r[6], np.uint8) for r in entries])
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            ok = known[at] == ids
            ids, token, rank, n_of = ids[ok], token[ok], rank[ok], n[at[ok]]
            order = np.lexsort((token, rank, ids))
            ids, token, n_of = ids[order], token[order], n_of[order]
            runs = slices(ids)
            start = np.repeat([r.start for r in runs], [r.stop - r.start for r in runs])
            shared = np.repeat([r.stop - r.start for r in runs], [r.stop - r.start for r in runs])
            if not len(ids):
                continue
            # those that no other set holds come first
            place = np.arange(len(ids)) - start + (n_of - shared)
            keep = (n_of < 0) | (place < key_count(n_of, least))
            held.append((mixed(token[keep]), ids[keep]))
            size += int(keep.sum())
            if size >= HELD:
                yield from flushed()
                size = 0
        if size:
            yield from flushed()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket bigint, local boolean, keys binary, base bigint, ids binary, firsts binary")


def meetings(dealt: DataFrame) -> DataFrame:
    """key, id, first: sets under keys that several have, and the smallest of them (or of those of a task)."""

    def unpacked(bucket: int, keys: bytes, base: int, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        # the bucket stands for the rest of the key: keys that agree in both meet, and are told apart when verified
        whole = np.zeros((len(keys) // 6, 8), np.uint8)
        whole[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
        k = whole.view("<u8").ravel() | np.uint64((bucket & 0xFFFF) << 48)
        width = len(ids) // max(1, len(k))
        return k, np.frombuffer(ids, {2: np.uint16, 4: np.uint32, 8: np.uint64}[width]).astype(np.int64) + base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def told(keys: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(ids), pa.array(firsts)], ["key", "id", "first"])

        def found() -> Iterator[pa.RecordBatch]:
            keys, ids = (np.concatenate([x[c] for x in held]) for c in (0, 1))
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            new = np.r_[True, keys[1:] != keys[:-1]]
            several = ~new | np.r_[~new[1:], False]
            if several.any():
                first = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
                yield told(keys[several], ids[several], first[several])

        for b in batches:
            for row in range(b.num_rows):
                bucket, local, keys, base, ids, firsts = (c[row].as_py() for c in b.columns)
                if held and bucket != last:
                    yield from found()
                    held = []
                last = bucket
                k, i = unpacked(bucket, keys, base, ids)
                if local:
                    yield told(k, i, unpacked(bucket, keys, base, firsts)[1])
                else:
                    held.append((k, i))
        if held:
            yield from found()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key bigint, id bigint, first bigint")


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: int) -> np.ndarray:
    """Whether the summed coordinate minima of points (or upper corners, with the least sizes below them) allow a link."""
    return (100 + least) * np.minimum(a, b).sum(-1, dtype=np.int64) >= least * (na + nb)


class Tree:
    """R-tree packed by sort-tile order: nodes hold the upper corner and the least size below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slabs = max(1, int(np.sqrt(len(points) / LEAF)))
        by_size = np.argsort(sizes, kind="stable")
        wide = points.var(0).argmax()
        order = np.concatenate([s[np.argsort(points[s, wide], kind="stable")] for s in np.array_split(by_size, slabs)])
        self.order, corner, low, step = order, points[order], sizes[order], LEAF
        self.levels = []
        while True:
            at = np.arange(0, len(corner), step)
            corner, low = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at)
            self.levels.append((corner, low))
            if len(corner) == 1:
                break
            step = FAN

    def pairs_of_leaves(self, least: int) -> Iterator[tuple[int, int]]:
        """Leaves (i <= j) that may hold linked points, by descent of two nodes at once."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                yield i, j
                continue
            corner, low = self.levels[level - 1]
            left, right = (np.arange(x * FAN, min((x + 1) * FAN, len(corner))) for x in (i, j))
            ok = may_link(corner[left][:, None], low[left][:, None], corner[right][None], low[right][None], least)
            stack += [(level - 1, int(left[p]), int(right[q])) for p, q in zip(*np.nonzero(ok), strict=True) if left[p] <= right[q]]


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, sides: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different components (and, where sides differ, of different sides) that the bound lets through."""
    tree = Tree(points, sizes)
    two = len(np.unique(sides)) > 1
    for i, j in tree.pairs_of_leaves(least):
        a, b = tree.order[i * LEAF : (i + 1) * LEAF], tree.order[j * LEAF : (j + 1) * LEAF]
        ok = may_link(points[a][:, None], sizes[a][:, None], points[b][None], sizes[b][None], least) & (comps[a][:, None] != comps[b][None])
        if two:
            ok &= sides[a][:, None] != sides[b][None]
        if i == j:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        p, q = np.nonzero(ok)
        if len(p):
            yield a[p], b[q]


def nearest(pairs: list[tuple[np.ndarray, np.ndarray]], points: np.ndarray, asks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs, those with the `most` nearest partners of each point that asks."""
    if not pairs:
        return np.zeros(0, int), np.zeros(0, int)
    p, q = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
    far = np.concatenate([np.abs(points[a] - points[b]).sum(1) for a, b in pairs])
    p, q, far = np.r_[p, q], np.r_[q, p], np.r_[far, far]
    keep = asks[p]
    p, q, far = p[keep], q[keep], far[keep]
    order = np.lexsort((q, far, p))
    p, q = p[order], q[order]
    place = np.arange(len(p)) - np.searchsorted(p, p)
    return p[place < most], q[place < most]


def met_before(p: np.ndarray, q: np.ndarray, ends: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Whether the points of each index pair share one of their earlier keys: those of point i lie from ends[i] to ends[i + 1]."""
    at = np.unique(np.concatenate([p, q]))
    many = ends[at + 1] - ends[at]
    flat = np.concatenate([earlier[ends[i] : ends[i + 1]] for i in at])
    known, column = np.unique(flat, return_inverse=True)
    holds = np.zeros((len(at), len(known)), bool)
    holds[np.repeat(np.arange(len(at)), many), column] = True
    return (holds[np.searchsorted(at, p)] & holds[np.searchsorted(at, q)]).any(1)


def distinct(a_ids: list[np.ndarray], b_ids: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a_ids), np.concatenate(b_ids)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def searched(rows: DataFrame, least: int, most: int | None) -> DataFrame:
    """a, b (a < b): pairs across components that the R-trees of the keys let through.

    rows: key, part (a pair of blocks), side, id, n, comp, asks, scale, point,
    earlier (keys under which the id is too), dealt by key and part and sorted by
    them. most: only so many nearest partners of each point that asks; None: all
    pairs but those that share an earlier key, which tells them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            key, part, side, ids, n, comp, asks, scale = (table.column(i).to_numpy() for i in range(8))
            points = np.asarray(table.column(8).combine_chunks().flatten()).reshape(-1, GROUPS) * scale.astype(np.int64)[:, None]
            before = table.column(9).combine_chunks()
            ends, earlier = np.r_[0, np.cumsum(before.value_lengths().to_numpy())], before.flatten().to_numpy()
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            a_ids, b_ids, size = [], [], 0
            for s, e in zip(new, [*new[1:], len(key)], strict=True):
                if e - s > 1:
                    pairs = tree_pairs(points[s:e], n[s:e], comp[s:e], side[s:e], least)
                    for p, q in pairs if most is None else [nearest(list(pairs), points[s:e], asks[s:e], most)]:
                        if most is None:
                            fresh = ~met_before(s + p, s + q, ends, earlier)
                            p, q = p[fresh], q[fresh]
                        a_ids.append(ids[s + p])
                        b_ids.append(ids[s + q])
                        size += len(p)
                        if size >= HELD:
                            yield distinct(a_ids, b_ids)
                            a_ids, b_ids, size = [], [], 0
            if size:
                yield distinct(a_ids, b_ids)

        for b in batches:
            if not b.num_rows:
                continue
            key, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != key[0] or held[-1].column(1)[-1].as_py() != part[0]):
                # keys end here: all but the last one are whole
                yield from found(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
                b = b.slice(cut)
            elif cut:
                yield from found(pa.Table.from_batches([b.slice(0, cut)]))
                b = b.slice(cut)
            held.append(b)
        if held:
            yield from found(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a bigint, b bigint")


def open_keys(met: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met with comp, and the keys that still have several components: key, m (points)."""
    named = met.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    named = common.cut(named)
    return named, named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")


def dealt_rows(named: DataFrame, keys: DataFrame, spots: DataFrame, asking: DataFrame | None) -> DataFrame:
    """Rows for searched(): the points under the keys, those of large keys in blocks.

    asking (id, key): who looks for partners, in its own block of the key. If
    None, all pairs are wanted: each pair of blocks is a part.
    """
    rows = named.join(keys, "key")
    if asking is None:
        rows = rows.withColumn("asks", F.lit(True))
        under = rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, EARLIER).alias("keys"))
        spots = spots.join(under, "id")
    else:
        spots = spots.withColumn("keys", F.array().cast("array<bigint>"))
        rows = rows.join(asking.withColumn("a", F.lit(True)), ["id", "key"], "left").withColumn("asks", F.coalesce("a", F.lit(False)))
    rows = rows.join(spots, "id")
    blocks = F.ceil(F.col("m") / (BLOCK if asking is None else NEAR_BLOCK)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if asking is None else F.col("own"))
    part = F.least("own", "other") * F.lit(1 << 16) + F.greatest("own", "other")
    rows = rows.select("key", part.alias("part"), F.col("own").alias("side"), "id", "n", "comp", "asks", "scale", "point", F.filter("keys", lambda k: k < F.col("key")).alias("earlier"))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part")


def verified(pairs: DataFrame, docs: DataFrame, n: int, least: int) -> DataFrame:
    """The pairs (a, b) of documents whose sets are alike enough.

    Texts travel, not sets: they are half as large, and compress.
    """
    pairs = common.cut(pairs.distinct())
    # both joins read the same exchange of the texts
    texts = some_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    left = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(n)
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keep = []
                for ta, tb in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if ta != last:
                        last, mine = ta, s.hashes(ta)
                    other = s.hashes(tb)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append((100 + least) * both >= least * (len(mine) + len(other)))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    t = pairs.join(left, "b").join(right, "a").select("a", "b", "ta", "tb")
    return common.cut(t.mapInArrow(run, "a bigint, b bigint").distinct())


def corners(points: DataFrame) -> DataFrame:
    """One row for each id of points with several sets: the upper corner of their points and the least of their sizes."""
    each = points.select("id", "n", "scale", F.posexplode("point").alias("at", "v"))
    each = each.groupBy("id", "at").agg(F.min("n").alias("n"), F.max(F.col("v") * F.col("scale")).alias("v"))
    whole = each.groupBy("id").agg(F.min("n").alias("n"), F.ceil(F.greatest(F.lit(1), F.max("v")) / 127).cast("int").alias("scale"), F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))
    return whole.select("id", "n", "scale", F.transform("all", lambda x: F.ceil(x["v"] / F.col("scale")).cast("tinyint")).alias("point"))


def ngram_join(docs: DataFrame, n: int = 3, least: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    common.narrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = common.cut(digest(docs, n))
    full = base.where("sig is not null and doc_id is not null")
    # the smallest doc_id of each set stands for it
    lowest = common.cut(full.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.first("n_shingles").alias("n")))
    several = common.cut(full.groupBy(F.col("doc_id").alias("id")).agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("id"))
    sets = lowest.groupBy(F.col("lo").alias("id")).agg(F.max("n").alias("n")).join(several.withColumn("many", F.lit(True)), "id", "left")
    sets = common.cut(sets.select("id", F.when(F.col("many"), F.lit(-1)).otherwise(F.col("n")).cast("bigint").alias("n")))
    copies = full.select(F.col("doc_id").alias("id")).distinct().join(sets, "id", "left_anti")
    some = docs
    if copies.count() <= MOST_COPIES:
        some = docs.join(F.broadcast(copies), F.col("doc_id") == F.col("id"), "left_anti")
    shingles = lowest.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions, shingles // TOKENS_IN_BUCKET + 1)
    shared = common.cut(shared_tokens(dealt_tokens(some, n, buckets), buckets))
    entries = shared.where(F.col("kind") == ENTRIES).unionByName(hot_entries(shared, buckets)).unionByName(packed_sizes(sets, buckets))
    met = common.cut(meetings(dealt_keys(entries, least, buckets)))
    common.drop(shared)
    points = full.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "scale", "point")
    points = points.join(several, "id", "left_anti").dropDuplicates(["id"]).unionByName(corners(points.join(several, "id", "left_semi")))
    spots = common.cut(points.join(met.select("id").distinct(), "id", "left_semi"))
    # each set and the smallest under its keys
    stars = met.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    sa, sb = (spots.select(*[F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in ("id", "n", "scale", "point")]) for x in "ab")
    minima = F.zip_with("point_a", "point_b", lambda x, y: F.least(x * F.col("scale_a"), y * F.col("scale_b")))
    bound = F.aggregate(minima, F.lit(0), lambda acc, x: acc + x)
    stars = stars.join(sb, "b").join(sa, "a").where((100 + least) * bound >= least * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    links = verified(stars, docs, n, least)
    comp = components(links)
    named, keys = open_keys(met, comp)
    rows, pairs = keys.agg(F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()
    if (pairs or 0) > FEW_PAIRS * (rows or 0):
        # large keys: first the nearest partners of each set in other components, under two of its open keys, the largest and any
        under = named.join(keys, "key").groupBy("id").agg(F.max_by("key", F.struct("m", "key")).alias("x"), F.max_by("key", F.xxhash64("key", "id")).alias("y"))
        asking = common.cut(under.select("id", F.explode(F.array_distinct(F.array("x", "y"))).alias("key")))
        near = searched(dealt_rows(named, keys.join(asking.select("key").distinct(), "key"), spots, asking), least, NEAREST)
        links = links.unionByName(verified(near, docs, n, least))
        common.drop(named, asking)
        comp = components(links)
        named, keys = open_keys(met, comp)
    # all pairs that are left under keys with several components
    links = links.unionByName(verified(searched(dealt_rows(named, keys, spots, None), least, None), docs, n, least))
    common.drop(named, met, spots)
    # a doc_id with several texts ties their sets
    same = full.join(several.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").join(lowest, "sig").where("lo <> doc_id").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"))
    comp = components(links.unionByName(same))
    whole = lowest.join(comp, F.col("lo") == F.col("node"), "left").select(F.col("sig").alias("s"), F.coalesce("comp", "lo").alias("comp"))
    out = base.join(whole, F.col("sig") == F.col("s"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
