"""Masking of low-complexity stretches by symmetric DUST scores.

The triplets of an interval score the number of their equal pairs, divided by
the number of triplets less one. An interval of at most `window` letters is
masked if its score is over `threshold` tenths and no interval inside it scores
higher. Both only depend on what is inside, so the result is the same for a
sequence and its reverse complement.

Equal pairs of all intervals of one length follow from those of the two
lengths below, so a batch of sequences is worked through by numpy, once for
each length. Letters other than A, C, G, T and U are in no interval. Long
sequences are worked through in pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, THRESHOLD = 64, 20
#: Letters that are worked through at once.
PIECE = 1 << 18
#: Values of letters; 4 is any other one.
VALUE = np.full(256, 4, np.uint8)
for _value, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    VALUE[list(_letters)] = _value


def low_complexity(letters: np.ndarray, window: int = WINDOW, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether each letter (as a byte) is to be masked."""
    n = len(letters)
    if n > PIECE + 2 * window:
        out = np.zeros(n, bool)
        for at in range(0, n, PIECE):
            first = max(0, at - window)
            out[at : at + PIECE] = low_complexity(letters[first : at + PIECE + window], window, threshold)[at - first : at - first + PIECE]
        return out
    v = VALUE[letters].astype(np.int16)
    if n < 4:
        return np.zeros(n, bool)
    t = 16 * v[:-2] + 4 * v[1:-1] + v[2:]
    unsound = np.concatenate([[0], np.cumsum((v[:-2] == 4) | (v[1:-1] == 4) | (v[2:] == 4))])
    m, change = len(t), np.zeros(n + 1, np.int32)
    # equal pairs of intervals of two lengths below, and the best score inside
    below2, below1, best = np.zeros(m + 1, np.int32), np.zeros(m, np.int32), np.zeros(m)
    for size in range(2, min(window - 2, m) + 1):
        k = m - size + 1
        pairs = below1[:k] + below1[1 : k + 1] - below2[1 : k + 1] + (t[:k] == t[size - 1 :])
        sound = unsound[size:] == unsound[:k]
        score = np.where(sound, pairs / (size - 1), -1.0)
        inside = np.maximum(best[:k], best[1 : k + 1])
        at = np.flatnonzero(sound & (10 * pairs > threshold * (size - 1)) & (score >= inside))
        np.add.at(change, at, 1)
        np.add.at(change, at + size + 2, -1)
        below2, below1, best = below1, pairs, np.maximum(inside, score)
    return np.cumsum(change)[:n] > 0


def masked(sequences: DataFrame, letter: str = "x", window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """Sequences with their low-complexity letters replaced; of both mates. Null stays null; other columns are kept."""
    columns = [c for c in ("nucleotides", "nucleotides2") if c in sequences.columns]

    def of(column: pa.Array) -> pa.Array:
        texts = [None if t is None else t.encode() for t in column.to_pylist()]
        # a gap that no interval crosses lies between any two
        raw = np.frombuffer(b"".join(t + b"\n\n\n" for t in texts if t is not None), np.uint8).copy()
        raw[low_complexity(raw, window, threshold)] = ord(letter)
        whole, at, out = raw.tobytes(), 0, []
        for t in texts:
            out.append(None if t is None else whole[at : at + len(t)].decode())
            at += 0 if t is None else len(t) + 3
        return pa.array(out, column.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([of(b.column(c)) if c in columns else b.column(c) for c in b.schema.names], schema=b.schema)

    return sequences.mapInArrow(run, sequences.schema)
