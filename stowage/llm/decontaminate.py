"""Benchmark items inside documents: SimHash of item-sized windows, multi-index blocks, exact weighted similarity.

For an item of m words every run of m words of a document is a window (a shorter document is one window). Items and windows
are bags of five-word shingles; their similarity is the sum of the smaller over the sum of the larger counts, and 0.8
or more is a leak. A window without a shingle in common with any item has similarity 0, so only windows around common
shingles are fingerprinted, at the sizes of the items met there. What is fingerprinted is the set of (shingle, occurrence number in the
bag), whose Jaccard similarity is that of the bags, repeats or not. Fingerprints of 64 bits within ``RADIUS`` of each other agree on
one of ``RADIUS + 1`` blocks at least, so block tables give every item within the radius; the radius is over three standard
deviations above the mean distance of bags at 0.8 exactly, and the best of all placements of a window counts.

Items of fewer than five words are one shingle of their length and match equal runs. Defined cases: null or empty texts and items without a
word match nothing; items with equal words are reported each; repeated documents each give their rows; empty tables give an
empty result; only the id and text columns are read. Items are handled in blocks of ``ITEMS`` at most.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.words import Hasher, chunks, mixed, shingles

WIDTH = 5
LEAST = (4, 5)
RADIUS = 21
# Items that one pass over the documents holds.
ITEMS = 50_000
MAP_BITS = 22


def fingerprints(bits: np.ndarray) -> np.ndarray:
    """64-bit integers of rows of 64 sums: a bit is set where the sum is positive."""
    return np.packbits(bits > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """-1 and 1 by bit, (n, 64)."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class Repeats:
    """How often the shingle of a place occurs in a range of places."""

    def __init__(self, found: np.ndarray):
        self.n = len(found)
        self.group = np.unique(found, return_inverse=True)[1].reshape(-1).astype(np.int64)
        self.any = self.n and int(self.group.max()) + 1 < self.n
        self.keys = np.sort(self.group * (self.n + 1) + np.arange(self.n))

    def within(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of the shingle of each place in first .. end - 1."""
        base = self.group * (self.n + 1)
        return np.searchsorted(self.keys, base + end) - np.searchsorted(self.keys, base + first)


def numbered(found: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence number); the first occurrence is the shingle itself."""
    return np.where(number == 0, found, mixed(found + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def running(hashes: np.ndarray) -> np.ndarray:
    """Sums of the signs of all hashes before a place, (n + 1, 64)."""
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(signs(hashes), axis=0, out=sums[1:])
    return sums


def block_edges(radius: int) -> list[int]:
    return [round(i * 64 / (radius + 1)) for i in range(radius + 2)]


class Items:
    """Fingerprints, block tables and bags of the items."""

    def __init__(self, ids: list, words: list[np.ndarray], radius: int = RADIUS):
        self.radius = radius
        self.ids, self.sizes, self.bags, self.short = [], [], [], defaultdict(list)
        prints, met = [], defaultdict(list)
        for item, w in zip(ids, words):
            if not len(w):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.sizes.append(len(w))
            if len(w) < WIDTH:
                self.short[(len(w), int(shingles(w, len(w))[0]))].append(k)
                self.bags.append({})
                prints.append(np.uint64(0))
                continue
            found = shingles(w, WIDTH)
            bag = Counter(found.tolist())
            self.bags.append(bag)
            at = np.arange(len(found))
            prints.append(fingerprints(signs(numbered(found, Repeats(found).within(0 * at, at))).sum(0, keepdims=True))[0])
            for s in bag:
                met[s].append(k)
        self.prints = np.array(prints, np.uint64)
        self.met = dict(met)
        self.known = np.array(sorted(met), np.uint64)
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[(self.known >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        self.short_sizes = sorted({n for n, _ in self.short})
        edges = block_edges(radius)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.tables = []
        long = [k for k, n in enumerate(self.sizes) if n >= WIDTH]
        for shift, mask in self.blocks:
            table = defaultdict(list)
            for k in long:
                table[int((self.prints[k] >> shift) & mask)].append(k)
            self.tables.append({v: np.array(ks) for v, ks in table.items()})

    def present(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that some item has."""
        at = np.flatnonzero(self.map[(hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        place = np.searchsorted(self.known, hashes[at])
        place[place == len(self.known)] = 0
        return at[self.known[place] == hashes[at]] if len(self.known) else at[:0]

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        """Every item whose fingerprint is within the radius: union of the blocks, then the distance."""
        lists = [t[v] for (shift, mask), t in zip(self.blocks, self.tables) if (v := int((fingerprint >> shift) & mask)) in t]
        if not lists:
            return np.zeros(0, np.int64)
        union = np.zeros(len(self.ids), bool)
        for ks in lists:
            union[ks] = True
        ks = np.flatnonzero(union)
        return ks[popcount(self.prints[ks] ^ fingerprint) <= self.radius]

    def leaks(self, words: np.ndarray, found: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, best similarity, first word of that window) in one document; hits: places of known shingles."""
        out: dict[int, tuple[float, int]] = {}
        if len(hits):
            wanted = sorted({self.sizes[k] for h in hits.tolist() for k in self.met[int(found[h])]})
            plain, repeats, at = running(found), Repeats(found), np.arange(len(found))
            counts = np.zeros(len(found) + 1, np.int64)
            counts[1:][hits] = 1
            np.cumsum(counts, out=counts)
            for size in wanted:
                n = min(size, len(words)) - WIDTH + 1
                starts = np.arange(max(0, len(words) - size) + 1)
                starts = starts[counts[starts + n] > counts[starts]]
                near: dict[int, np.ndarray] = {}
                come = left = plain
                if repeats.any:
                    # A shingle that comes into the window gets the next number in it; one that leaves takes the last number along.
                    came, gone = repeats.within(np.maximum(0, at - n + 1), at), repeats.within(at, np.minimum(len(at), at + n)) - 1
                    if came.any():
                        come, left = running(numbered(found, came)), running(numbered(found, gone))
                for s, f in zip(starts.tolist(), fingerprints(come[starts + n] - left[starts]).tolist()):
                    if f not in near:
                        near[f] = self.near(np.uint64(f))
                    bag = None
                    for k in near[f].tolist():
                        if self.sizes[k] != size:
                            continue
                        if bag is None:
                            bag = Counter(found[s : s + n].tolist())
                        other = self.bags[k]
                        smaller = sum(min(c, other[h]) for h, c in bag.items() if h in other)
                        larger = n + size - WIDTH + 1 - smaller
                        if LEAST[1] * smaller >= LEAST[0] * larger and smaller / larger > out.get(k, (0, 0))[0]:
                            out[k] = (smaller / larger, s)
        for size in self.short_sizes:
            for s, h in enumerate(shingles(words, size).tolist()):
                for k in self.short.get((size, h), ()):
                    out.setdefault(k, (1.0, s))
        return [(k, *v) for k, v in sorted(out.items())]


def words_of(texts: pa.Array) -> list[np.ndarray]:
    hasher, out = Hasher(), []
    for _, data, offsets in chunks(texts):
        hashes, rows = hasher.words(data, offsets)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_items: int = ITEMS) -> DataFrame:
    """(id, item_id, similarity, at_word) of every document and item that leaks into it; each document row by itself."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-items.count() // most_items))
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = pa.int64() if item_kind == "bigint" else None
    asked = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    results = []
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in held], words_of(pa.array([r["text"] for r in held], pa.string()))))

        def search(batches, shared=shared):
            index, hasher = shared.value, Hasher()
            for batch in batches:
                rows, item_ids, similarity, places = [], [], [], []
                for first, data, offsets in chunks(batch.column("text")):
                    hashes, owner = hasher.words(data, offsets)
                    bounds = np.searchsorted(owner, np.arange(len(offsets)))
                    every = shingles(hashes, WIDTH)
                    hits = index.present(every)
                    # A shingle counts if it ends in the document it starts in.
                    hits = hits[owner[hits] == owner[hits + WIDTH - 1]] if len(hits) else hits
                    touched = range(len(offsets) - 1) if index.short_sizes else np.unique(owner[hits]).tolist()
                    for row in touched:
                        a, b = int(bounds[row]), int(bounds[row + 1])
                        own = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b)] - a
                        for k, value, at in index.leaks(hashes[a:b], every[a : max(a, b - WIDTH + 1)], own):
                            rows.append(first + row)
                            item_ids.append(index.ids[k])
                            similarity.append(value)
                            places.append(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(item_ids, item_type), pa.array(similarity, pa.float64()), pa.array(places, pa.int64())],
                    ["id", "item_id", "similarity", "at_word"],
                )

        results.append(asked.mapInArrow(search, f"id {kind}, item_id {item_kind}, similarity double, at_word bigint"))
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out.withColumnRenamed("id", id_column)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with the columns they had.

    Documents are told apart by id and text, so documents without an id and repeated ids are judged by their own text.
    """
    names = docs.columns
    key = F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    found = leaks(docs.select(key.alias("key"), "text"), benchmark, id_column="key").select(F.col("key.id").alias("id"), F.col("key.digest").alias("digest")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    met = (F.col("key.id").eqNullSafe(F.col("id"))) & (F.col("key.digest") == F.col("digest"))
    return rows.join(found, met, "left_anti").select(*[F.col("row")[n].alias(n) for n in names])
