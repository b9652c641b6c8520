"""Packing token sequences into windows of one length (operator 11).

Every document is its token ids and an end id. It is laid in pieces of a whole
window and one shorter tail. Pieces of one length are alike for packing, so all
that is planned on the driver is a histogram with a count for each length, at
most `window` of them however many documents there are:

1. shallow combinations of up to six lengths that fill a window exactly are
   enumerated (`exact_fills`);
2. how often each is used solves a non-negative least squares problem against
   the histogram (`repeat_counts`), by steps along the best coordinates, so few
   combinations are in use;
3. counts are rounded down to what the histogram has, and what is left is
   packed greedily, first by combinations that still fit (after which 1 to 3
   are repeated for what is left), then end to end,
   longest first, cut where a window ends. The last window is cut into
   sequences whose lengths are powers of two, which need no padding.

So no id is padded and only pieces of the last kind are cut. A piece finds its
place from its rank among those of its length: ranks are counted in buckets by
hash, and no length, however frequent, is one task.

Texts are tokenised by Python workers, one narrow pass, with the vocabulary's
file as a parameter; only the few documents cut in the last step are tokenised
once more.

Defined results: null text is an empty one, whose ids are the end id alone; a
null doc_id is kept as such; texts of any length are whole; repeated rows are
packed as often as they come; pieces of one length are ranked by a hash of
doc_id, text and start, so reruns agree; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
END = 1
#: Lengths in a combination at most; partners tried for each length; sweeps of a solution; how often what is left is solved again.
DEPTH, PARTNERS, SWEEPS, TURNS = 6, 12, 150, 4
#: Pieces of one length that are ranked in one bucket, about.
IN_BUCKET = 50_000
#: Keys of cut documents up to which Spark is told to broadcast them; beyond, it decides.
FEW_CUT = 100_000
#: The word pattern of byte-level BPE vocabularies of this kind (a fixed value of the format).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone go the fast way; all Unicode tables agree on what they are.
USUAL = regex.compile(r"[\t\n\r\x20-\x7E\xA1-ɏ‐-‧€]*+")


def letters_of_bytes() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, those of the tokenizers library for the file.

    Where a vocabulary's ids are its merges in order, texts of usual characters
    are encoded with the same vocabulary by tiktoken, which takes a fifth of the
    time; all others by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self.ranked(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def ranked(told: dict):
        """The same vocabulary as ranks, or None where it is of another kind."""
        model, letters = told["model"], letters_of_bytes()
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
        vocab, plain = model.get("vocab", {}), told["pre_tokenizer"] or {}
        usual = model.get("type") == "BPE" and not told["normalizer"] and plain.get("type") == "ByteLevel" and plain.get("use_regex", True) and not plain.get("add_prefix_space")
        if not usual or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or [vocab.get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("same vocabulary", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or not USUAL.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    return common.remembered(("packing", path), lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, h (hash of the text), start, length, doc_tokens, ids_crc32 of every whole window and tail; with ids, their array."""
    last = np.array([end], "<u4").tobytes()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            row, start, length, tokens, crc, values = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = encode(text) + last
                n = len(raw) // 4
                for s in range(0, n, window):
                    own = raw[4 * s : 4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(own) // 4)
                    tokens.append(n)
                    crc.append(zlib.crc32(own))
                    if ids:
                        values.append(np.frombuffer(own, "<i4"))
            kept = b.select(["doc_id", "h"]).take(pa.array(row, pa.int64()))
            columns = [*kept.columns, pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(tokens, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "h", "start", "length", "doc_tokens", "ids_crc32"]
            if ids:
                columns.append(pa.array(values, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h bigint, start bigint, length int, doc_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else ""))


def exact_fills(have: np.ndarray, window: int, turn: int = 0, depth: int = DEPTH, partners: int = PARTNERS) -> np.ndarray:
    """Rows of up to `depth` lengths, ascending after zeros, whose sum is the window; have: pieces of each length, 0 to window.

    All pairs, and for each number of lengths and each length some partners,
    spread evenly over the pieces that there are (with other ones each turn);
    the last length is what the window lacks. All of it is fixed by the arguments.
    """
    there = have > 0
    there[0] = there[window] = False
    lengths = np.flatnonzero(there)
    if not len(lengths):
        return np.zeros((0, depth), np.int64)
    spread, rng = np.cumsum(have[lengths]), np.random.default_rng(turn)
    found = []
    for size in range(2, depth + 1):
        row = np.zeros((len(lengths) * (partners if size > 2 else 1), depth), np.int64)
        row[:, 0] = np.resize(lengths, len(row))
        # partners of a window with more lengths are shorter ones
        short = np.searchsorted(lengths, 2 * window // size)
        for k in range(1, size - 1):
            at = rng.random(len(row)) * spread[max(0, short - 1)]
            row[:, k] = lengths[np.minimum(np.searchsorted(spread, at, side="right"), len(lengths) - 1)]
        rest = window - row.sum(1)
        row[:, size - 1] = rest
        found.append(np.sort(row[(rest > 0) & there[np.clip(rest, 0, window)]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def apart(fills: np.ndarray, order: np.ndarray, window: int) -> list[int]:
    """Of fills in order, each that shares no length with one before it."""
    met, out = bytearray(window + 1), []
    for j, row in zip(order.tolist(), fills[order].tolist(), strict=True):
        if not any(met[v] for v in row if v):
            out.append(j)
            for v in row:
                met[v] = 1
    return out


def repeat_counts(fills: np.ndarray, have: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares: how often each fill is used so that the lengths used come nearest to those there are.

    Each sweep takes the exact step along the coordinates with the greatest
    gain that share no length, so few fills are in use.
    """
    x, left = np.zeros(len(fills)), have.astype(float)
    left[0] = 0.0
    if not len(fills):
        return x
    norm = ((fills[:, :, None] == fills[:, None, :]) & (fills > 0)[:, :, None]).sum((1, 2)).astype(float)
    for _ in range(sweeps):
        slope = left[fills].sum(1)
        step = np.maximum(slope / norm, -x)
        gain = step * (slope - 0.5 * norm * step)
        top = np.argpartition(-gain, min(2000, len(gain) - 1))[:2000]
        top = top[gain[top] > 0.05]
        if not len(top):
            break
        chosen = apart(fills, top[np.argsort(-gain[top], kind="stable")], len(have) - 1)
        x[chosen] += step[chosen]
        np.subtract.at(left, fills[chosen], step[chosen][:, None])
        left[0] = 0.0
    return x


def rounded(fills: np.ndarray, x: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts that the histogram has, those of the solution first, then greedily more; and what is left of the histogram."""
    counts, left = np.zeros(len(fills), np.int64), have.astype(np.int64).copy()
    if not len(fills):
        return counts, left
    left[0] = np.iinfo(np.int64).max // 8
    often = np.where(fills == 0, 1, (fills[:, :, None] == fills[:, None, :]).sum(2))

    def take(j: int, most: int) -> None:
        n = min(most, int((left[fills[j]] // often[j]).min()))
        if n > 0:
            counts[j] += n
            for v in set(fills[j].tolist()) - {0}:
                left[v] -= n * int((fills[j] == v).sum())

    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        take(j, int(x[j]))
    while (room := (left[fills] // often).min(1)).max() > 0:
        top = np.argsort(-room, kind="stable")[:2000]
        for j in apart(fills, top[room[top] > 0], len(have) - 1):
            take(j, int(room[j]))
    left[0] = 0
    return counts, left


def planned(have: np.ndarray, window: int = WINDOW, turns: int = TURNS) -> tuple[dict[int, list[tuple[int, int, int]]], np.ndarray, int]:
    """Slots (first rank, sequence, offset) of each length; how many of each length are left; the first sequence of these.

    A slot holds the ranks from its first one to that of the next slot, in as
    many sequences in a row. What a turn leaves is enumerated and solved again.
    """
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence, left = np.zeros(len(have), np.int64), 0, have.astype(np.int64).copy()
    if have[window]:
        slots[window], sequence = [(0, 0, 0)], int(have[window])
    left[window] = 0
    for turn in range(turns):
        fills = exact_fills(left, window, turn)
        counts, left = rounded(fills, repeat_counts(fills, left), left)
        for j in np.flatnonzero(counts):
            offset, n = 0, int(counts[j])
            for v in fills[j][fills[j] > 0].tolist():
                slots.setdefault(v, []).append((int(used[v]), sequence, offset))
                used[v] += n
                offset += v
            sequence += n
    return slots, left, sequence


def ends(total: int, window: int) -> tuple[int, list[int]]:
    """Where whole windows end in `total` ids laid end to end, and where the sequences after it begin, each a power of two long."""
    at = whole = total // window * window
    starts = []
    while at < total:
        starts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return whole, starts


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids, or without them ids_crc32."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    common.narrow_batches(spark)
    t = common.cut(pieces(docs, tokenizer, window, end, ids))
    have = np.zeros(window + 1, np.int64)
    # at most one row for each length of a window
    for r in t.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        have[r["length"]] = r["n"]
    slots, left, first = planned(have, window)
    at, rows = 0, []
    for v in range(window, 0, -1):
        if have[v]:
            rows.append((v, max(1, -(-int(have[v]) // IN_BUCKET)), slots.get(v, []), int(have[v] - left[v]), at))
            at += int(left[v]) * v
    whole, starts = ends(at, window)
    # bounded by the window
    classes = F.broadcast(spark.createDataFrame(rows, "length int, buckets int, slots array<struct<first: bigint, sequence: bigint, offset: int>>, kept bigint, at bigint"))
    t = t.withColumn("r", F.xxhash64("doc_id", "h", "start")).join(classes, "length")
    t = t.withColumn("bucket", F.pmod("r", F.col("buckets")).cast("int"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    sizes = t.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("r", "doc_id", "h", "start")) - 1
    t = t.withColumn("own", own).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    slot = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1)
    shared = ["doc_id", "start", "length", "doc_tokens", "ids" if ids else "ids_crc32"]
    t = t.withColumn("slot", F.when(F.col("rank") < F.col("kept"), slot)).withColumn("pos", F.when(F.col("rank") >= F.col("kept"), F.col("at") + (F.col("rank") - F.col("kept")) * F.col("length")))
    if not at:
        return t.select(*shared, (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").cast("bigint").alias("offset"))
    t = common.cut(t.select(*shared, "h", "slot", "rank", "pos"))
    filled = t.where("pos is null").select(*shared, (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").cast("bigint").alias("offset"))

    # the rest lies end to end and is cut where sequences end
    to = F.col("pos") + F.col("length")
    marks = F.array(*[F.lit(s).cast("bigint") for s in starts]) if starts else F.array().cast("array<bigint>")
    next_window = (F.floor(F.col("pos") / window) + 1) * window
    inside = F.filter(F.array_distinct(F.concat(F.when(next_window < to, F.array(next_window)).otherwise(F.array().cast("array<bigint>")), marks)), lambda b: (b > F.col("pos")) & (b < to))
    loose = t.where("pos is not null").drop("slot", "rank").withColumn("cuts", F.array_sort(inside))
    bounds = F.arrays_zip(F.concat(F.array("pos"), F.col("cuts")).alias("a"), F.concat(F.col("cuts"), F.array(to)).alias("b"))
    loose = loose.withColumn("cut", F.explode(bounds)).withColumn("a", F.col("cut.a")).withColumn("size", (F.col("cut.b") - F.col("cut.a")).cast("int"))
    loose = loose.withColumn("skipped", (F.col("a") - F.col("pos")).cast("int"))
    marks_before = F.filter(marks, lambda b: b <= F.col("a"))
    late = F.col("a") >= whole
    loose = loose.withColumn("sequence_id", F.when(late, F.lit(first + whole // window) + F.size(marks_before) - 1).otherwise(F.lit(first) + F.floor(F.col("a") / window)).cast("bigint"))
    loose = loose.withColumn("offset", F.when(late, F.col("a") - F.element_at(marks_before, -1)).otherwise(F.col("a") % window).cast("bigint"))
    placed = [(F.col("start") + F.col("skipped")).alias("start"), F.col("size").alias("length"), "doc_tokens"]
    if ids:
        return filled.unionByName(loose.select("doc_id", *placed, F.slice("ids", F.col("skipped") + 1, F.col("size")).alias("ids"), "sequence_id", "offset"))
    uncut = loose.where(F.size("cuts") == 0).select("doc_id", *placed, "ids_crc32", "sequence_id", "offset")
    parts = common.cut(loose.where(F.size("cuts") > 0).select("doc_id", "h", *placed, "sequence_id", "offset"))
    sums = checksums(docs, parts, tokenizer, end)
    said = parts.join(sums, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("h") == F.col("__h")) & (F.col("start") == F.col("__start")) & (F.col("length") == F.col("__length")))
    return filled.unionByName(uncut).unionByName(said.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"))


def checksums(docs: DataFrame, parts: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """__id, __h, __start, __length, ids_crc32 of parts (doc_id, h, start, length) of documents, whose texts are tokenised again.

    Rows that repeat a document ask for less than twice a window's parts together, so a key's list is bounded.
    """
    asked = common.cut(parts.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("start", "length")).alias("__asked")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    few = asked.count() <= FEW_CUT
    found = rows.join(F.broadcast(asked) if few else asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("__id", "__h", "text", "__asked")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            row, start, length, crc = [], [], [], []
            for i, (text, asked_of) in enumerate(zip(b.column("text").to_pylist(), b.column("__asked").to_pylist(), strict=True)):
                raw = encode(text) + last
                for x in asked_of:
                    row.append(i)
                    start.append(x["start"])
                    length.append(x["length"])
                    crc.append(zlib.crc32(raw[4 * x["start"] : 4 * (x["start"] + x["length"])]))
            kept = b.select(["__id", "__h"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], ["__id", "__h", "__start", "__length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # repeated rows of a document say the same
    return found.mapInArrow(run, f"__id {kind}, __h bigint, __start bigint, __length int, ids_crc32 bigint").distinct()


def sequences(rows: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, ids, n_ids: the pieces of packed(ids=True) laid out, padded to the window unless n_ids is a power of two."""
    t = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    t = t.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")).withColumn("n_ids", F.size("ids"))
    power = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    padded = F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - F.col("n_ids"))))
    return t.select("sequence_id", padded.alias("ids"), "n_ids")


def op11(spark, sf_dir: str) -> DataFrame:
    t = packed(common.documents(spark, sf_dir), ids=False)
    return t.select("doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
