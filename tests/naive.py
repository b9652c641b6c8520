"""Plain Python versions that the engine is held against."""

from cladeforge.functions.alphabet import TOGGLE

CODE = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A"}


def revcomp(s):
    return "".join(COMPLEMENT[c] for c in reversed(s.upper()))


def encode(w):
    n = 0
    for c in w.upper():
        n = n * 4 + CODE[c]
    return n


def priority(w, scheme):
    code = min(encode(w), encode(revcomp(w))) if scheme.canonical else encode(w)
    return (code ^ (scheme.toggle & scheme.full)) & scheme.space_mask


def supermers(seq, scheme):
    """(location, kmers, minimizer) of a sequence of nucleotides."""
    out = []
    for p in range(len(seq) - scheme.k + 1):
        least = min(priority(seq[q : q + scheme.m], scheme) for q in range(p, p + scheme.k - scheme.m + 1))
        if out and out[-1][2] == least:
            out[-1][1] += 1
        else:
            out.append([p, 1, least])
    return [tuple(x) for x in out]


def segments(seq, k):
    """(start, text, sound) of maximal runs of nucleotides and of other letters."""
    out, at = [], 0
    while at < len(seq):
        good, end = seq[at].upper() in CODE, at
        while end < len(seq) and (seq[end].upper() in CODE) == good:
            end += 1
        out.append((at, seq[at:end], good))
        at = end
    return [x for x in out if len(x[1]) >= k]


def spans(seq, mate, scheme):
    """(flag, is_distinct, kmers, minimizer) in order."""
    out, last = [], None
    for part in [seq] if mate is None else [seq, None, mate]:
        if part is None:
            out.append((3, False, 1 - scheme.k, None))
            continue
        for _, text, good in segments(part, scheme.k):
            if not good:
                out.append((2, False, len(text) - scheme.k + 1, None))
                continue
            for _, n, rank in supermers(text.upper(), scheme):
                out.append((1, rank != last, n, rank))
                last = rank
    return out


class Tree:
    def __init__(self, nodes):
        self.parent = {t: (0 if t == 1 else p) for t, p, *_ in nodes}

    def path(self, t):
        out = []
        while t:
            out.append(t)
            t = self.parent[t]
        return out

    def lca(self, a, b):
        if not a or not b:
            return a or b
        up = set(self.path(a))
        return next(x for x in self.path(b) if x in up)

    def resolve(self, counts, required):
        """counts: taxon to k-mers, 0 for none."""
        scores = {t: sum(counts.get(x, 0) for x in self.path(t)) for t in counts if t}
        best, top = 0, max(scores.values(), default=0)
        for t, s in scores.items():
            if s == top and s > 0:
                best = self.lca(best, t)
        while best and sum(c for t, c in counts.items() if t and best in self.path(t)) < required:
            best = self.parent[best]
        return best


assert TOGGLE >> 63 == 1
