"""SentencePiece encoding and decoding by streaming lattice search (operator 5).

The text is read from left to right. Every boundary keeps one backpointer:
the piece that ends there. Only boundaries within one maximum piece length of
the current one can still be extended, and whenever the backpointer paths of
all of those meet in one boundary, the ids up to it are committed and
forgotten. So memory is bounded by the window, not by the text.

Which backpointer wins depends on the model. For a unigram model it is the
Viterbi choice: the highest sum of piece scores. The scores of a BPE model are
merge ranks, not log-probabilities, so their highest sum is not its encoding.
There the rule is merge consistency: the piece is the one that, joined to the
last piece of the encoding before it, BPE would leave apart. For each boundary
exactly one piece has this property, because each prefix of a BPE encoding and
each pair of its neighbours is itself a BPE encoding. The search is the same;
the ids are those of the model.

Pieces never continue over a blank that follows other characters, so the
search restarts there, and the ids of such stretches are kept in a bounded
table. Models with a normaliser or other settings that change the text are
refused.

Defined results: null and empty texts have no ids; characters outside the
vocabulary become byte pieces (or the unknown id where the model has none);
decoding gives the text back, except that a literal U+2581 reads as a blank;
of equal sums the one found first, from the boundary furthest back, stays;
repeated rows are encoded alike; an empty table gives an empty result; extra columns are kept, and a column named
like an output is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stretches whose ids a worker remembers (half of them at least), and pairs of pieces.
MOST_KEPT = 400_000
#: Stretches of so many characters at most are remembered.
SHORT = 64
#: Bound of a vocabulary, so that it may be sent to every worker.
MOST_PIECES = 2_000_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message, groups aside."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = varint() if size is None else size
            yield key >> 3, message[at : at + size]
            at += size


def settings(model: bytes) -> dict[str, int]:
    """What of a model file's settings the codec depends on."""
    out = {"type": 1, "suffix": 0, "charsmap": 0, "dummy_prefix": 1, "extra_blanks": 1, "user_pieces": 0}
    for number, part in fields(model):
        if number == 1:
            out["user_pieces"] += any(f == (3, 4) for f in fields(part))
        elif number == 2:
            names = {3: "type", 24: "suffix"}
            out |= {names[n]: v for n, v in fields(part) if n in names}
        elif number == 3:
            names = {3: "dummy_prefix", 4: "extra_blanks"}
            out |= {names[n]: v for n, v in fields(part) if n in names} | {"charsmap": len(v) for n, v in fields(part) if n == 2}
    return out


def read_model(path: str) -> tuple[list[tuple[str, float, str]], str]:
    """Pieces (text, score, kind) by id, and the type of the model, from a model file.

    Models with settings that the codec does not follow are refused.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > MOST_PIECES:
        raise ValueError(f"at most {MOST_PIECES} pieces")
    found = settings(sp.serialized_model_proto())
    wanted = {"suffix": 0, "charsmap": 0, "dummy_prefix": 1, "extra_blanks": 0, "user_pieces": 0}
    if found["type"] not in (1, 2) or any(found[k] != v for k, v in wanted.items()):
        raise ValueError(f"a unigram or BPE model with {wanted} is needed, this one has {found}")

    def kind(i: int) -> str:
        return "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "none" if sp.is_control(i) or sp.is_unused(i) else "piece"

    pieces = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
    return pieces, "bpe" if found["type"] == 2 else "unigram"


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str):
        self.kind = kind
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == "piece"}
        self.scores = {p: s for p, s, k in pieces if k == "piece"}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(BLANK, " ").encode() if k == "piece" else b"" for p, _, k in pieces]
        self.least = min(self.scores.values(), default=0.0) - 10.0
        # where no piece has a blank after another character, stretches that begin with blanks are independent
        self.splits = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids) and not any("\n" in p and len(p) > 1 for p in self.ids)
        self.stretch = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        # the pieces as a trie: children by character, the piece that ends at a node under ""
        self.root: dict = {}
        for p in self.ids:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """BPE by its definition: merge the best-scored pair, leftmost first, until none is a piece (or so many parts are left)."""
        parts = list(text)
        while len(parts) > until:
            best = max(((self.scores.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1)))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (1) edge of a piece while it is merged, the whole first, each with the score of the merge that ends it."""
        known = self.edges[side].get(piece)
        if known is None:
            known = [(piece, -np.inf)]
            while len(part := known[-1][0]) > 1 and len(halves := self.merged(part, 2)) == 2:
                known.append((halves[side], self.scores[part]))
            self.edges[side][piece] = known
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether BPE leaves two pieces apart when they meet: no two edges that stand together merge before either is merged otherwise."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > MOST_KEPT:
                self.pairs.clear()
            score, others = self.scores.get, self.edge(right, 0)
            known = True
            for x, until in self.edge(left, 1):
                for y, then in others:
                    s = score(x + y)
                    # of equal scores the leftmost goes first
                    if s is not None and s > until and s >= then:
                        known = False
            self.pairs[left, right] = known
        return known

    def reachable(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def segments(self, text: str) -> Iterator[str]:
        """Pieces of a text in order, committed as the paths of all live boundaries meet.

        Each boundary that is reached is searched ahead; what it reaches gets
        its backpointer. last[i - base] is the piece that ends at boundary i:
        boundaries before base are committed.
        """
        n, window, bpe = len(text), self.longest, self.kind == "bpe"
        root, pairs, whole, scores = self.root, self.pairs, self.whole, self.scores
        base, check = 0, 2 * window
        last: list[str | None] = [None] * (min(n, 3 * window) + 1)
        last[0] = ""
        best: list[float] = [] if bpe else [0.0] + [-np.inf] * (len(last) - 1)
        for j in range(n):
            if j == check:
                # the paths of all boundaries from here on that have a backpointer
                live = {i for i in range(j, min(n, j + window) + 1) if last[i - base] is not None}
                while len(live) > 1:
                    far = max(live)
                    live.remove(far)
                    live.add(far - len(last[far - base]))
                meet = live.pop()
                yield from self.path(last, meet - base)
                last, best = last[meet - base :], best[meet - base :]
                base, check = meet, j + window
                more = min(n, check + window) + 1 - base - len(last)
                last += [None] * more
                best += [] if bpe else [-np.inf] * more
            left = last[j - base]
            if left is None:
                continue
            node = root
            for i in range(j + 1, n + 1):
                node = node.get(text[i - 1])
                piece = None if node is None else node.get("")
                if piece is None and i == j + 1:
                    # one character that is no piece
                    piece = text[j]
                if piece is not None:
                    if bpe:
                        if last[i - base] is None:
                            fits = whole.get(piece)
                            if fits is None:
                                fits = self.reachable(piece)
                            if fits and j:
                                fits = pairs.get((left, piece))
                                if fits is None:
                                    fits = self.apart(left, piece)
                            if fits:
                                last[i - base] = piece
                    else:
                        score = scores.get(piece, self.least)
                        if best[j - base] + score > best[i - base]:
                            best[i - base], last[i - base] = best[j - base] + score, piece
                if node is None:
                    break
        yield from self.path(last, n - base)

    @staticmethod
    def path(last: list[str | None], at: int) -> list[str]:
        """The pieces up to a boundary."""
        out = []
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids_of(self, stretch: str) -> bytes:
        """The ids of a stretch, as 32-bit integers."""
        known = self.kept.get(stretch)
        if known is None:
            known = self.older.get(stretch)
            if known is None:
                ids: list[int] = []
                for piece in self.segments(stretch):
                    i = self.ids.get(piece)
                    if i is not None:
                        ids.append(i)
                    elif self.byte_ids:
                        ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
                    else:
                        ids.append(self.unknown)
                known = array("i", ids).tobytes()
            if len(stretch) <= SHORT:
                if len(self.kept) >= MOST_KEPT:
                    # what is asked for again moves back from the older half
                    self.older, self.kept = self.kept, {}
                self.kept[stretch] = known
        return known

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        whole = BLANK + text.replace(" ", BLANK)
        if not self.splits:
            return self.ids_of(whole)
        get, own = self.kept.get, self.ids_of
        return b"".join([get(s) or own(s) for s in self.stretch.findall(whole)])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(spark: SparkSession, path: str = DEFAULT_MODEL):
    """A broadcast of the vocabulary of a model file."""
    common.narrow_batches(spark)
    return spark.sparkContext.broadcast(read_model(path))


def _own(vocabulary) -> Codec:
    """This worker's codec of a broadcast vocabulary, with what it remembers."""
    value = vocabulary.value
    return common.remembered(("codec", id(value)), lambda: Codec(*value))


def encode(df: DataFrame, vocabulary, column: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """df with ids (array<int>) of a text column; check: name of a column that says whether decoding gives the text back."""
    kept = df.drop(ids, *([check] if check else []))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), True))] + ([T.StructField(check, T.BooleanType())] if check else [])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _own(vocabulary)
        for b in batches:
            # whole texts, but not more of them at once than memory is sure to hold
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                coded = [c.encode(t) for t in texts]
                ends = np.cumsum([0] + [len(x) // 4 for x in coded])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                columns, names = [*part.columns, lists], [*part.schema.names, ids]
                if check:
                    columns.append(pa.array([c.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(coded, texts, strict=True)], pa.bool_()))
                    names.append(check)
                yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """df with the text of an ids column."""
    kept = df.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _own(vocabulary)
        for b in batches:
            texts = pa.array([c.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, column])

    return kept.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = encode(docs, codec(spark), check="round_trip")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), ids.alias("ids_sha256"), "round_trip", "ids")
