"""Suffix-array removal of repeated byte strings (operator 9).

Every byte that a string of `length` bytes covers is removed if that string
also starts somewhere else, in the same document or another one. Matches do
not cross documents.

Finding the places. Each string of `length` bytes holds a gram of `GRAM` bytes
whose hash is the least in it, its anchor; equal strings have equal ones. An
anchor serves a run of starts, about 70; the bytes of their strings are its
window. Strings whose anchor occurs once in the corpus are not repeated. All
strings of windows with the same anchor and the same bytes are; one such
window stands for all in what follows.

Suffix arrays. Different windows with the same anchor go to the same shard.
A shard is one text of whole windows; its suffix array is refined in the way
of Larsson and Sadakane (groups of equal order h are sorted by the order of
the suffix h further on, singletons are left alone), and common prefixes come
from Kasai's rule in its permuted form: where the characters before two
neighbours agree, the prefix is one shorter than the one before. Neighbours
with `length` common bytes, at different places, are repeats. An anchor with
very many different windows is dealt over several shards. These are merged by
binary search: each shard's different strings are looked for among the sorted
strings of the other shards, which meet by the range of a hash.

Free style: numpy on Arrow batches; the rest are DataFrame operations.

Defined results: null text is empty and has no bytes to remove; texts shorter
than `length` stay as they are; repeated rows are documents of their own, so
their long texts are removed whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 200, 64
#: Bytes that are worked on together: of texts, and of windows in a shard.
BATCH, SHARD = 4 << 20, 1 << 20
#: Windows of one anchor in a shard; further ones go to other shards.
MOST_WINDOWS = 4_000

_values = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.ones(size, np.uint64)
        known[1:] = np.uint64(base)
        known = _powers[base] = np.cumprod(known)
    return known[:n]


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each run of w elements; len(x) - w + 1 results."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, (1 << 64) - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of each anchor, and the first and last start of the strings that it is the anchor of.

    A string's anchor is the gram with the least 33 bits of hash in it, the
    leftmost of several; the low 31 bits of what is compared are the place.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none, none, none
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_values[b] * powers(_BASE, len(b)), out=sums[1:])
    v = (sums[gram:] - sums[:-gram]) * powers(_INVERSE, len(b) - gram + 1)
    del sums
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.uint64((1 << 31) - 1)
    low = least_in_windows((v & ~place) | np.arange(len(v), dtype=np.uint64), length - gram + 1)
    at = (low & place).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    # strings that cross the end of their text are none
    own = owner[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[own])
    if not len(start):
        return none, none, none, none, none
    new = np.flatnonzero(np.r_[True, (at[start][1:] != at[start][:-1]) | (own[start][1:] != own[start][:-1])])
    first, last = start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
    at, own = at[first], own[first].astype(np.int64)
    base = (ends - sizes)[own]
    return own, at - base, v[at].view(np.int64), first - base, last - base


def suffix_array(text: np.ndarray, order_of: int | None = None) -> np.ndarray:
    """Order of the suffixes of an array of symbols 0..256, by Larsson-Sadakane refinement.

    order_of: suffixes that agree on so many symbols may stay in the order of
    the text.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])  # 0: past the end
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : n + k]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = start
    h = 7
    # places in the array whose group has more than one suffix
    open_at = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(open_at) and (order_of is None or h < order_of):
        group = sa[open_at]
        key = rank[group] * (n + 2) + rank[np.minimum(group + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, group = key[order], group[order]
        sa[open_at] = group
        new = np.r_[True, key[1:] != key[:-1]]
        rank[group] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        open_at = open_at[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in the array with the one before it, by Kasai's rule. The symbol 0 ends a prefix."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    # a pair that is the one before it moved by a symbol, if that one had a symbol in common
    follows = np.zeros(n, bool)
    follows[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (text[:-1] != 0)
    follows[1:] &= text[:-1] == text[np.maximum(before[:-1], 0)]
    heads = np.flatnonzero(~follows)
    # symbols in eights, so that most comparisons are of whole words
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    word = np.zeros(n + 1, np.uint64)
    clear = np.ones(n + 1, bool)
    for k in range(8):
        word[:n] = (word[:n] << np.uint64(8)) | ((padded[k : n + k] - 1) & 255).astype(np.uint64)
        clear[:n] &= padded[k : n + k] != 0
    clear[n] = False
    shared = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(before[heads] >= 0)
    i, j = heads[live], before[heads[live]]
    while len(live):
        same = (word[i] == word[j]) & clear[i] & clear[j]
        single = live[~same], i[~same], j[~same]
        live, i, j = live[same], i[same] + 8, j[same] + 8
        shared[live] += 8
        rest, a, b = single
        for _ in range(8):
            go = (padded[a] == padded[b]) & (padded[a] != 0)
            rest, a, b = rest[go], a[go] + 1, b[go] + 1
            shared[rest] += 1
    head = np.maximum.accumulate(np.where(follows, 0, at))
    value = np.zeros(n, np.int64)
    value[heads] = shared
    return np.maximum(0, value[head] - (at - head))[sa]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) over sorted starts."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return [(int(starts[a]), int(starts[b - 1]) + length) for a, b in zip(new, [*new[1:], len(starts)], strict=True)]


def repeated_starts(windows: list[bytes], doc: np.ndarray, origin: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's windows: index and start of each string, whether it is known to start at two places, and whether it is the first of its equals.

    doc, origin: the document (a number) and the position that each window
    comes from; many: whether its bytes occur at several places.
    """
    sizes = np.array([len(w) for w in windows], np.int64)
    text = np.frombuffer(b"\0".join(windows) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text[ends - 1] = 0
    sa = suffix_array(text, length)
    same = common_prefixes(text, sa) >= length
    owner = np.repeat(np.arange(len(windows), dtype=np.int32), sizes + 1)[sa]
    inner = sa - begins[owner]
    del sa
    whole = inner + length <= sizes[owner]
    # classes of equal strings: runs of neighbours with `length` common bytes
    group = (np.cumsum(~same) - 1)[whole]
    owner, inner = owner[whole], inner[whole]
    if not len(owner):
        return owner, inner, np.zeros(0, bool), np.zeros(0, bool)
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    twice = np.maximum.reduceat(many[owner].astype(np.int8), new) > 0
    for x in (doc[owner], origin[owner] + inner):
        twice |= np.minimum.reduceat(x, new) != np.maximum.reduceat(x, new)
    head = np.zeros(len(owner), bool)
    head[new] = True
    return owner, inner, np.repeat(twice, np.diff(np.r_[new, len(owner)])), head


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th, body: th, a hash of the text, tells rows of one doc_id with different texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.cast("binary").alias("body"))


def in_parts(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about BATCH bytes, with their texts."""
    at, size, texts = 0, 0, []
    for k, t in enumerate(batch.column(text_at)):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= BATCH or k + 1 == batch.num_rows:
            yield batch.slice(at, k + 1 - at), texts
            at, size, texts = k + 1, 0, []


def located(texts: DataFrame, length: int, with_place: bool) -> DataFrame:
    """anchor of all strings of `length` bytes; with_place: where they start and what they hold.

    doc_id, th, lo, n: the starts, from lo on, that the anchor stands for; ctx:
    the hash of all bytes of their strings, the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, bodies in in_parts(b, 2):
                own, _, mark, first, last = anchors(bodies, length)
                out = [pa.array(mark)]
                if with_place:
                    digest = xxhash.xxh3_64_intdigest
                    ctx = [digest(bodies[t][a : z + length]) for t, a, z in zip(own.tolist(), first.tolist(), last.tolist(), strict=True)]
                    at = pa.array(own)
                    out += [part.column(0).take(at), part.column(1).take(at), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(np.array(ctx, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["anchor", "doc_id", "th", "lo", "n", "ctx"][: len(out)])

    return texts.mapInArrow(run, "anchor bigint" + (", doc_id bigint, th bigint, lo int, n int, ctx bigint" if with_place else ""))


def same_doc(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by doc_id (nulls are equal) and th; right's are named d and t."""
    return left.join(right, left["doc_id"].eqNullSafe(right["d"]) & (left["th"] == right["t"]), how).drop("d", "t")


#: What a shard gives: a window's repeated spans (anchor null), or its different strings, packed.
SHARD_ROWS = pa.schema([("anchor", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("docs", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("hashes", pa.binary())])
SHARD_SCHEMA = "anchor bigint, bucket int, doc_id bigint, th bigint, spans array<struct<s:int,e:int>>, docs array<bigint>, ths array<bigint>, starts array<int>, hashes binary"


def sharded(rows: DataFrame, length: int) -> DataFrame:
    """SHARD_SCHEMA of rows anchor, shard, shards, doc_id, th, lo, many, bytes, dealt and sorted by anchor and shard."""

    def spans_and_rest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        mark, shards, ids, ths, lo, many = (t.column(c).to_pylist() for c in ("anchor", "shards", "doc_id", "th", "lo", "many"))
        windows = t.column("bytes").to_pylist()
        numbers: dict = {}
        doc = np.array([numbers.setdefault(x, len(numbers)) for x in zip(ids, ths, strict=True)])
        owner, inner, twice, head = repeated_starts(windows, doc, np.array(lo), np.array(many), length)
        order = np.lexsort((inner, owner))
        owner, inner, twice, head = owner[order], inner[order], twice[order], head[order]
        edge = np.searchsorted(owner, np.arange(len(windows) + 1))
        out: list[dict] = []
        rest: dict[tuple[int, int], list] = {}
        for k in range(len(windows)):
            s, f, one = (x[edge[k] : edge[k + 1]] for x in (inner, twice, head))
            if not many[k] and f.any():
                out.append({"doc_id": ids[k], "th": ths[k], "spans": [{"s": a + lo[k], "e": b + lo[k]} for a, b in runs(s[f], length)]})
            if shards[k] > 1:
                for x in s[one].tolist():
                    h = xxhash.xxh3_128_digest(windows[k][x : x + length])
                    rest.setdefault((mark[k], (h[0] * 256 + h[1]) % shards[k]), []).append((ids[k], ths[k], x + lo[k], h))
        for (anchor, bucket), x in rest.items():
            i, t_, starts, h = zip(*x, strict=True)
            out.append({"anchor": anchor, "bucket": bucket, "docs": i, "ths": t_, "starts": starts, "hashes": b"".join(h)})
        for at in range(0, len(out), 5000):
            yield pa.RecordBatch.from_pylist(out[at : at + 5000], SHARD_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            mark, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero(np.r_[last != (mark[0], shard[0]), (mark[1:] != mark[:-1]) | (shard[1:] != shard[:-1])])
            ends = np.cumsum([len(x.as_py()) for x in b.column(7)])
            at = 0
            for k in new.tolist():
                # a whole anchor ends before k
                done = size + int(ends[k - 1] if k else 0) - int(ends[at - 1] if at else 0)
                if done >= SHARD:
                    yield from spans_and_rest(pa.Table.from_batches([*held, b.slice(at, k - at)]))
                    held, size, at = [], 0, k
            held.append(b.slice(at))
            size += int(ends[-1]) - int(ends[at - 1] if at else 0)
            last = (mark[-1], shard[-1])
        if held:
            yield from spans_and_rest(pa.Table.from_batches(held))

    return rows.mapInArrow(run, SHARD_SCHEMA)


def merged_shards(rows: DataFrame) -> DataFrame:
    """doc_id, th, s: strings that several shards of an anchor have.

    rows: anchor, bucket, docs, ths, starts, hashes. Those of one anchor and
    range of hashes meet; each string is looked up among all by binary search.
    """

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        ids, ths, starts = (np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in t.column(c)]) for c in ("docs", "ths", "starts"))
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.dtype([("a", "<u8"), ("b", "<u8")]))
        order = np.lexsort((h["b"], h["a"]))
        a = h["a"][order]
        several = np.searchsorted(a, a, "right") - np.searchsorted(a, a, "left") > 1
        order = order[several]
        a, b = h["a"][order], h["b"][order]
        if not len(order):
            return
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        twice = np.zeros(len(new), bool)
        for x in (ids[order], ths[order], starts[order]):
            twice |= np.minimum.reduceat(x, new) != np.maximum.reduceat(x, new)
        order = order[np.repeat(twice, np.diff(np.r_[new, len(order)]))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ths[order]), pa.array(starts[order].astype(np.int32))], ["doc_id", "th", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            mark, bucket = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            for k, key in enumerate(zip(mark, bucket, strict=True)):
                if last is not None and key != last:
                    yield from found(pa.Table.from_batches([*held, b.slice(at, k - at)]))
                    held, at = [], k
                last = key
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield from found(pa.Table.from_batches(held))

    packed = rows.where("anchor is not null").select("anchor", "bucket", "docs", "ths", "starts", "hashes")
    return packed.repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket").mapInArrow(run, "doc_id bigint, th bigint, s int")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, body, spans (array of start, end in bytes, may overlap) for the documents with bytes to remove."""
    texts = keyed(docs)
    # written, so that the join below is an ordinary one, whose hot anchors can be split
    twice = common.cut(located(texts, length, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"))
    around = common.cut(located(texts, length, True).join(twice, "anchor"))
    kinds = common.cut(around.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "lo", "n")).alias("one")))
    # windows whose bytes are at several places
    several = kinds.where("c > 1").select("anchor", "ctx")
    resolved = around.join(several, ["anchor", "ctx"]).select("doc_id", "th", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    # anchors with different windows: one of each kind goes to the shards
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shards = F.ceil(F.col("m") / MOST_WINDOWS).cast("int")
    reps = kinds.join(mixed, "anchor").select("anchor", shards.alias("shards"), (F.col("c") > 1).alias("many"), "one.*")
    asked = reps.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("anchor", "shards", "many", "lo", "n")).alias("w"))
    rows = same_doc(texts, asked).select("doc_id", "th", "body", F.explode("w").alias("w"))
    shard = F.pmod(F.xxhash64("doc_id", "w.lo"), F.col("w.shards")).cast("int")
    rows = rows.select(F.col("w.anchor").alias("anchor"), shard.alias("shard"), F.col("w.shards").alias("shards"), "doc_id", "th", F.col("w.lo").alias("lo"), F.col("w.many").alias("many"), F.substr("body", F.col("w.lo") + 1, F.col("w.n") - 1 + length).alias("bytes"))
    # rows of one doc_id and text are one document here: their strings are all repeated, and found so
    out = common.cut(sharded(rows.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard"), length))
    alone = out.where("anchor is null").select("doc_id", "th", F.explode("spans").alias("x")).select("doc_id", "th", "x.s", "x.e")
    merged = merged_shards(out).select("doc_id", "th", "s", (F.col("s") + length).alias("e"))
    spans = resolved.unionByName(alone).unionByName(merged).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return same_doc(texts, spans)


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, kept (bytes), n_removed, n_spans for the documents with repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                body = b.column(2)[k].as_py()
                at, removed, n, out = 0, 0, 0, []
                for s, e in sorted((x["s"], x["e"]) for x in b.column(3)[k].as_py()):
                    if s > at or not n:
                        out.append(body[at:s])
                        n += 1
                        removed += e - s
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([b"".join([*out, body[at:]])], pa.binary()), pa.array([removed], pa.int64()), pa.array([n], pa.int64())], ["doc_id", "th", "kept", "n_removed", "n_spans"])

    return repeated(docs, length).mapInArrow(run, "doc_id bigint, th bigint, kept binary, n_removed bigint, n_spans bigint")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cut_down = cleaned(docs).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"), F.first(F.sha2("kept", 256)).alias("sha"))
    base = keyed(docs).select("doc_id", "th", F.octet_length("body").cast("bigint").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    out = same_doc(base, cut_down, "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
