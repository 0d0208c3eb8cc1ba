"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_words(rows, length=50):
    rows = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in rows:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in rows:
        cut = [False] * len(w)
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < i:
                cut[k : k + length] = [True] * length
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def by_bytes(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        cut = [False] * len(b)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                cut[k : k + length] = [True] * length
            seen.add(s)
        spans = sum(c and not p for c, p in zip(cut, [False, *cut]))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return sorted(out)


def grams(text, k=5):
    w = WORD.findall(text or "")
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def classes(rows, threshold=0.8):
    rows = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, g in rows:
        for x in g:
            holders.setdefault(x, []).append(i)
    of = dict(rows)
    for pair in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        a, b = root(pair[0]), root(pair[1])
        if a != b and jaccard(of[pair[0]], of[pair[1]]) >= threshold:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}
