"""Suffix arrays by induced sorting, in numpy.

Suffixes are S (smaller than the next) or L. The leftmost S of each run starts a substring that ends at the next such
place. Sorting these substrings by induction names them; the string of names is sorted in the same way again, and from the
sorted leftmost suffixes all others are induced, first L left to right, then S right to left. Inducing goes bucket by bucket: what
a bucket induces into later ones is placed at once, what it induces into itself in further rounds, as many as equal
symbols follow each other. A string of names with many symbols has tiny buckets; it is sorted by prefix doubling instead.
"""

from __future__ import annotations

import numpy as np

# Alphabets up to this size are induced bucket by bucket.
MOST_BUCKETS = 1500


def doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(s)
    rank, step = s.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 2)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


def classified(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end counts as smaller than any symbol."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    smaller = np.zeros(n, bool)
    following = np.searchsorted(change, np.arange(n))
    inside = following < len(change)
    at = change[following[inside]]
    smaller[inside] = s[at] < s[at + 1]
    return smaller


def grouped(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stable order by symbol, symbols, first place of each, size of each)."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
    return order, ordered[first], first, np.diff(np.append(first, len(ordered)))


def induced(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix order induced from leftmost suffixes, each bucket's in the order given."""
    n = len(s)
    out = np.full(n, -1, np.int64)
    sizes = np.bincount(s, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Leftmost suffixes stand at the ends of their buckets.
    order, found, first, count = grouped(s[leftmost])
    at = np.repeat(ends[found] - count - first, count) + np.arange(len(leftmost))
    out[at] = leftmost[order]
    held = np.zeros(symbols, np.int64)
    held[found] = count
    large = ~small
    head = starts.copy()

    def put_large(chunk: np.ndarray) -> None:
        before = chunk[chunk > 0] - 1
        before = before[large[before]]
        if len(before):
            order, found, first, count = grouped(s[before])
            out[np.repeat(head[found] - first, count) + np.arange(len(before))] = before[order]
            head[found] += count

    # The end of the string induces the last suffix.
    out[head[s[n - 1]]] = n - 1
    head[s[n - 1]] += 1
    used = np.flatnonzero(sizes)
    for c in used.tolist():
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            put_large(out[done:upto])
            done = upto
        if held[c]:
            put_large(out[ends[c] - held[c] : ends[c]])

    tail = ends.copy()

    def put_small(chunk: np.ndarray) -> None:
        before = chunk[chunk > 0] - 1
        before = before[small[before]]
        if len(before):
            order, found, first, count = grouped(s[before])
            out[np.repeat(tail[found] - 1 + first, count) - np.arange(len(before))] = before[order]
            tail[found] -= count

    for c in used[::-1].tolist():
        done = ends[c]
        while done > tail[c]:
            upto = tail[c]
            put_small(out[upto:done][::-1])
            done = upto
        put_small(out[starts[c] : head[c]][::-1])
    return out


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes of ``s`` (integers below ``symbols``) in order; a prefix comes before what it begins."""
    n = len(s)
    if n < 3 or symbols > MOST_BUCKETS:
        return doubled(s) if n else np.zeros(0, np.int64)
    # Sixteen bits let numpy sort symbols by counting.
    s = s.astype(np.uint16)
    small = classified(s)
    left = np.zeros(n, bool)
    left[1:] = small[1:] & ~small[:-1]
    places = np.flatnonzero(left)
    if not len(places):
        return induced(s, small, places, symbols)
    rough = induced(s, small, places, symbols)
    ordered = rough[left[rough]]
    # Substrings up to and with the next leftmost place; the last one runs to the end and equals no other.
    length = np.zeros(n, np.int64)
    length[places] = np.append(np.diff(places) + 1, n + 1)
    a, b = ordered[:-1], ordered[1:]
    differs = length[a] != length[b]
    alike, step = np.flatnonzero(~differs), 0
    while len(alike):
        alike = alike[length[a[alike]] > step]
        unequal = s[a[alike] + step] != s[b[alike] + step]
        differs[alike[unequal]] = True
        alike = alike[~unequal]
        step += 1
    names = np.zeros(n, np.int64)
    names[ordered[1:]] = np.cumsum(differs)
    found = int(names[ordered[-1]]) + 1
    if found < len(places):
        ordered = places[suffix_array(names[places], found)]
    return induced(s, small, ordered, symbols)


def common_prefixes(data: np.ndarray, order: np.ndarray, wanted: int) -> np.ndarray:
    """For each place the common prefix of its suffix with the one before it in order, up to ``wanted`` (a multiple of 8).

    Permuted common prefixes: indexed by place in the text. Eight bytes are compared at once, by pairs still equal.
    """
    n = len(data)
    padded = np.concatenate((data.astype(np.uint8), np.zeros(wanted + 8, np.uint8)))
    words = np.zeros(n + wanted, np.uint64)
    for i in range(8):
        words |= padded[i : i + n + wanted].astype(np.uint64) << np.uint64(8 * i)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(previous >= 0)
    for step in range(0, wanted, 8):
        unlike = words[at + step] ^ words[previous[at] + step]
        ended = unlike != 0
        # The lowest set bit tells how many bytes are alike.
        lowest = unlike[ended] & (~unlike[ended] + np.uint64(1))
        out[at[ended]] = step + (np.bitwise_count(lowest - np.uint64(1)) // 8)
        at = at[~ended]
        if not len(at):
            return out
    out[at] = wanted
    return out
