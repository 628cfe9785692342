"""Exact repeats of long byte strings, removed from the texts that hold them, by suffix arrays of shards.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere else, in the same text or another.

Every such string (a window) has one anchor: its least hashed ``GRAM`` bytes, the first of equals. Equal windows have equal anchors, and the
windows with the anchor at one place are a run; the bytes of a run are its context. Only contexts whose anchor occurs twice can repeat.
Equal contexts of an anchor are counted as one. The different contexts of an anchor meet in one shard of bounded size, whose suffix
array (induced sorting) and permuted common prefixes give every window that another context has too. An anchor with more
contexts than a shard holds is settled by counting its windows themselves, dealt out by their digests.

Digests of texts, contexts and windows have 128 bits. Defined cases: null is an empty text; texts shorter than ``LENGTH`` lose nothing;
copies of a long text lose all of it; repeated rows get equal results; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.storage import drop_stored, marked, marks, stored
from stowage.llm.suffix_array import common_prefixes, suffix_array
from stowage.llm.words import BASE, BASE_INVERSE, BYTE_VALUES, chunks, mixed, powers

LENGTH = 200
GRAM = 64
SHARD_BYTES = 2_000_000
# Contexts of one anchor that a shard takes.
MOST_CONTEXTS = 6_000
# A part of a text whose places fit 23 bits; parts overlap by a window.
PART = 1 << 22


def prefix_sums(data: np.ndarray, up: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


class Anchors:
    """Runs of windows by anchor, of one piece of text after another."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, first window, last window), windows counted from the start of their row."""
        n = len(data)
        if n < LENGTH:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        if len(self.up) < n + 1:
            self.up, self.down = powers(n + 1, BASE), powers(n + 1, BASE_INVERSE)
        sums = prefix_sums(data, self.up)
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1])
        # The hash above, the place below: the least is the first of the least hashes.
        keyed = (grams & ~np.uint64((1 << 23) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, done = LENGTH - GRAM + 1, 1
        least = keyed
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        place = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        windows = np.arange(len(place))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
        inside = windows + LENGTH <= offsets[row + 1]
        windows, place, row = windows[inside], place[inside], row[inside]
        if not len(windows):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        start = offsets[row[first]]
        return row[first], grams[place[first]].view(np.int64), windows[first] - start, windows[last] - start


def pieces(texts: pa.Array):
    """(first row, bytes, offsets, place of the piece in its row); a long row comes in overlapping parts."""
    for first, data, offsets in chunks(texts):
        if len(data) <= PART:
            yield first, data, offsets, 0
            continue
        for start in range(0, len(data) - LENGTH + 1, PART):
            part = data[start : start + PART + LENGTH - 1]
            yield first, part, np.array([0, len(part)]), start


def occurrences(docs: DataFrame) -> DataFrame:
    """(high, low, anchor, a, b): the runs of every text."""

    def find(batches):
        anchors = Anchors()
        for batch in batches:
            high, low = batch.column("high").to_numpy(), batch.column("low").to_numpy()
            for first, data, offsets, base in pieces(batch.column("text")):
                row, anchor, a, b = anchors.runs(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (high[first + row], low[first + row], anchor, a + base, b + base)], ["high", "low", "anchor", "a", "b"])

    return docs.mapInArrow(find, "high bigint, low bigint, anchor bigint, a bigint, b bigint")


def texts_with(docs: DataFrame, wanted: DataFrame, spans: str) -> DataFrame:
    """(high, low, text, spans) of the wanted texts, each text at least once.

    A filter of bounded size and a look at what a task has already sent keep most other rows from being moved; the join settles it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks(wanted, "high"))

    def chosen(batches):
        sent = set()
        for batch in batches:
            at = []
            for i in np.flatnonzero(marked(shared.value, batch.column("high").to_numpy())).tolist():
                key = (batch.column("high")[i].as_py(), batch.column("low")[i].as_py())
                if key not in sent:
                    sent.add(key)
                    at.append(i)
            yield batch.take(pa.array(at, pa.int64()))

    return docs.select("high", "low", "text").mapInArrow(chosen, "high bigint, low bigint, text string").join(wanted, ["high", "low"]).select("high", "low", "text", spans)


def contexts(texts: DataFrame) -> DataFrame:
    """(anchor, c1, c2, context, high, low, a, n): the bytes of each run, with a digest."""

    def cut(batches):
        for batch in batches:
            for text, high, low, runs in zip(batch.column("text"), batch.column("high").to_pylist(), batch.column("low").to_pylist(), batch.column("runs")):
                data, held = text.as_buffer().to_pybytes(), runs.values.flatten()
                anchor, a, b, n = held
                found = [data[x : y + LENGTH] for x, y in zip(a.to_pylist(), b.to_pylist())]
                digests = np.array([np.frombuffer(hashlib.blake2b(c, digest_size=16).digest(), "<i8") for c in found])
                yield pa.RecordBatch.from_arrays(
                    [anchor, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(found, pa.binary()), pa.array([high] * len(found), pa.int64()), pa.array([low] * len(found), pa.int64()), a, n],
                    ["anchor", "c1", "c2", "context", "high", "low", "a", "n"],
                )

    return texts.mapInArrow(cut, "anchor bigint, c1 bigint, c2 bigint, context binary, high bigint, low bigint, a bigint, n bigint")


def repeated_windows(found: list[bytes]) -> list[np.ndarray]:
    """Of each string the places of windows that occur elsewhere among the strings, by the suffix array of all."""
    lengths = np.array([len(c) for c in found])
    starts = np.cumsum(np.append(0, lengths[:-1] + 1))
    # Symbol 0 ends each string; bytes are one higher.
    s = np.zeros(int(lengths.sum() + len(found)), np.int64)
    raw = np.frombuffer(b"\0".join(found) + b"\0", np.uint8)
    s[:] = raw
    s += 1
    s[starts + lengths] = 0
    order = suffix_array(s, 257)
    common = common_prefixes(raw, order, LENGTH)
    # Windows inside a string. Those with equal symbols stand together in the order; an ending is no symbol of a text.
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + np.maximum(lengths - LENGTH + 1, 0), -1)
    whole = np.cumsum(edge[:-1]) > 0
    previous = np.full(len(s), -1, np.int64)
    previous[order[1:]] = order[:-1]
    at = np.flatnonzero((common >= LENGTH) & whole)
    at = at[whole[previous[at]]]
    alike = np.zeros(len(s), bool)
    alike[at] = alike[previous[at]] = True
    out = []
    for start, length in zip(starts.tolist(), lengths.tolist()):
        out.append(np.flatnonzero(alike[start : start + max(0, length - LENGTH + 1)]))
    return out


def runs_of(places: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(places):
        return [], []
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()


def by_shards(distinct: DataFrame) -> DataFrame:
    """(anchor, c1, c2, f, l): runs of repeated windows of contexts, anchor by anchor, in shards of whole anchors."""

    def settle(keys: list, found: list[bytes]):
        keyed, firsts, lasts = [], [], []
        for key, places in zip(keys, repeated_windows(found)):
            f, last = runs_of(places)
            keyed += [key] * len(f)
            firsts += f
            lasts += last
        columns = list(zip(*keyed)) if keyed else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (*columns, firsts, lasts)], ["anchor", "c1", "c2", "f", "l"])

    def shard(batches):
        keys, found, held = [], [], 0
        for batch in batches:
            for key, context in zip(zip(batch.column("anchor").to_pylist(), batch.column("c1").to_pylist(), batch.column("c2").to_pylist()), batch.column("context").to_pylist()):
                if held > SHARD_BYTES and key[0] != keys[-1][0]:
                    yield settle(keys, found)
                    keys, found, held = [], [], 0
                keys.append(key)
                found.append(context)
                held += len(context)
        if found:
            yield settle(keys, found)

    return distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shard, "anchor bigint, c1 bigint, c2 bigint, f bigint, l bigint")


def by_windows(distinct: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: windows are counted by digest."""

    def spread(batches):
        for batch in batches:
            for anchor, c1, c2, context in zip(*[batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "context")]):
                n = len(context) - LENGTH + 1
                made = np.array([np.frombuffer(hashlib.blake2b(context[i : i + LENGTH], digest_size=16).digest(), "<i8") for i in range(n)])
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (anchor, c1, c2)] + [pa.array(range(n), pa.int64()), pa.array(made[:, 0]), pa.array(made[:, 1])], ["anchor", "c1", "c2", "f", "w1", "w2"])

    rows = distinct.select("anchor", "c1", "c2", "context").mapInArrow(spread, "anchor bigint, c1 bigint, c2 bigint, f bigint, w1 bigint, w2 bigint")
    often = rows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return rows.join(often, ["w1", "w2"]).select("anchor", "c1", "c2", "f", F.col("f").alias("l"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("high"), F.xxhash64(F.lit(7), text).alias("low"))
    runs = stored(occurrences(docs), "runs")
    live = runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Copies of a text send the same runs: their number is kept.
    live_runs = runs.join(live, "anchor").groupBy("high", "low", "anchor", "a", "b").agg(F.count("*").alias("n"))
    spans = stored(live_runs.groupBy("high", "low").agg(F.collect_list(F.struct("anchor", "a", "b", "n")).alias("runs")), "live-runs")
    drop_stored(spark, runs)
    # Texts can come from several tasks; equal rows fall together here.
    found = stored(contexts(texts_with(docs, spans, "runs")), "contexts")
    # A text may have been sent by several tasks: its run counts once.
    once = found.groupBy("anchor", "c1", "c2", "high", "low", "a").agg(F.max("n").alias("n"))
    met = stored(once, "places")
    counted = met.groupBy("anchor", "c1", "c2").agg(F.sum("n").alias("n"))
    per_anchor = counted.groupBy("anchor").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n_all")).where("n_contexts > 1").select("anchor", "n_contexts")
    distinct = stored(found.groupBy("anchor", "c1", "c2").agg(F.min("context").alias("context")).join(per_anchor, "anchor"), "distinct-contexts")
    repeated = by_shards(distinct.where(F.col("n_contexts") <= MOST_CONTEXTS)).union(by_windows(distinct.where(F.col("n_contexts") > MOST_CONTEXTS)))
    # Of a context that occurs twice every window repeats.
    whole = found.select("anchor", "c1", "c2", F.lit(0).cast("bigint").alias("f"), (F.length("context") - LENGTH).cast("bigint").alias("l")).distinct().join(counted.where("n > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"])
    repeated = repeated.union(whole.select("anchor", "c1", "c2", "f", "l"))
    covered = met.join(repeated, ["anchor", "c1", "c2"]).select("high", "low", (F.col("a") + F.col("f")).alias("x"), (F.col("a") + F.col("l") + LENGTH).alias("y"))
    cover = stored(covered.groupBy("high", "low").agg(F.collect_list(F.struct("x", "y")).alias("cover")), "cover")
    drop_stored(spark, found, met, distinct)

    def cut(batches):
        for batch in batches:
            sizes, counts, digests = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("cover")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                x, y = (v.to_numpy() for v in spans.values.flatten())
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, x, 1)
                np.add.at(change, y, -1)
                gone = np.cumsum(change[:-1]) > 0
                sizes.append(int(gone.sum()))
                counts.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("high"), batch.column("low"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["high", "low", "n_removed", "n_spans", "kept"])

    changed = texts_with(docs, cover, "cover").mapInArrow(cut, "high bigint, low bigint, n_removed bigint, n_spans bigint, kept string").dropDuplicates(["high", "low"])
    rows = docs.select("doc_id", "high", "low", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    zero = F.lit(0).cast("bigint")
    return rows.join(changed, ["high", "low"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256")
    )
