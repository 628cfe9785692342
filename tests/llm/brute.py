"""Plain restatements of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def components(texts: dict) -> dict:
    """{doc_id: (set size, smallest reachable doc_id)}"""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter()
    for ds in holders.values():
        ds.sort()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def without_repeats(texts: list, length=200) -> list:
    """(bytes, removed, spans, digest of what is left) of every text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        reach = 0
        for i in range(len(d)):
            if i <= len(d) - length and count[d[i : i + length]] > 1:
                reach = i + length
            gone[i] = i < reach
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(docs: dict, items: dict, least=0.8) -> dict:
    """{(doc, item): best similarity} over all item-sized windows."""
    out = {}
    for item, t in items.items():
        w = words(t)
        if not w:
            continue
        width = min(5, len(w))
        bag = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
        for doc, text in docs.items():
            v = words(text)
            if len(v) < width:
                continue
            runs = [tuple(v[i : i + width]) for i in range(len(v) - width + 1)]
            if not bag.keys() & set(runs):
                continue
            best, size = 0.0, min(len(w), len(v))
            for s in range(len(v) - size + 1):
                other = Counter(runs[s : s + size - width + 1])
                smaller = sum((bag & other).values())
                best = max(best, smaller / (sum(bag.values()) + sum(other.values()) - smaller))
            if best >= least:
                out[doc, item] = best
    return out
