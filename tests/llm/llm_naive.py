"""Plain Python versions of the training-data operators."""

import hashlib
import re
from collections import Counter

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = words(lower_ascii(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def linked_components(texts, n, least):
    """texts: doc_id to text. doc_id to (size, component)."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    only = lambda x: re.sub("[^0-9]", "", x)
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text or ""):
            x = m.group()
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in x.split(".")) or kind == "card" and 14 <= len(only(x)) <= 19 and luhn(only(x)) or kind == "phone" and 10 <= len(only(x)) <= 15
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_text(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def quality_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(five)
    hit = {i + k for i, f in enumerate(five) if often[f] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n = len(w)
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def repeats(texts, length=200):
    """Row number to (n_bytes, n_removed, n_spans, sha) of a list of texts."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def fair_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """source to target, by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    rest = share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total > most * sizes[s]}
        if not over:
            target |= {s: rest * w[s] / total for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return target
