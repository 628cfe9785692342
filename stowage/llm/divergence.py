"""How the sources of a language differ in their words: a divergence of every pair of sources, and the words that set a source apart.

Terms are runs of letters A-Z (lower-cased), a-z and characters beyond ASCII. A language keeps the terms found in a least number of its documents. They are the vocabulary of
minimal acyclic transducers, each over a range of sorted terms, which give every term its ordinal in lexicographic order. The texts are streamed through them a second time and
recounted by source and ordinal; ordinals break ties of value.

Shares are whole numbers of ``SCALE``-ths, smoothed by ``SMOOTH`` a term, and all sums are of integers, so results do not depend on any order.

A task counts its own texts first, so a frequent term sends a row per task and source. Terms meet their counts by range of (language, term);
a task holds one batch of counts, and ``SHARD_TERMS`` terms a transducer. What passes through the driver is the list of (language, source) groups: g groups of a
language have g * (g - 1) rows in the result, so it is the root of what the result holds, and more than ``MOST_GROUPS`` are refused.

Defined cases: null text, lang and source are empty; a source without terms has the least share of every term; a language that keeps no term has pairs of
value 0; rows count as documents of their own, repeated or not; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.storage import drop_stored, stored
from stowage.llm.transducer import Transducer
from stowage.llm.words import LOWER, chunks

LEAST_DOCS = 10
SCALE = 1_000_000_000
SMOOTH = 2
TOP_TERMS = 10
MOST_GROUPS = 1_000_000
SHARD_TERMS = 1 << 14
# Bytes of counts a task holds before it sends them on, and shares (sources x terms) it holds at once.
HELD_BYTES = 1 << 23
HELD_SHARES = 1 << 22

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[65:91] = TERM_BYTE[97:123] = TERM_BYTE[128:] = True


def binary_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that end at ``ends`` and follow each other in ``data``."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def terms_of(texts: pa.Array):
    """(row, term) of all terms of a batch, in pieces."""
    for first, data, offsets in chunks(texts):
        if not len(data):
            continue
        inside = TERM_BYTE[data]
        row_starts = offsets[:-1][np.diff(offsets) > 0]
        before = np.concatenate(([False], inside[:-1]))
        before[row_starts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False]))
        after[row_starts[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        rows = np.searchsorted(offsets, starts, "right") - 1 + first
        yield rows, binary_of(LOWER[data[inside]], np.cumsum(ends - starts))


def summed(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def counted(docs: DataFrame, lang_of: np.ndarray, numbers: dict, by_source: bool) -> DataFrame:
    """What each task counts of a language's terms: the documents with one (lang_no, term, n), or its occurrences by source
    (lang_no, term, sources, counts). A term may come several times.

    ``numbers`` numbers the (lang, source) groups, ``lang_of`` has their languages.
    """

    def count(batches):
        held, n_held = [], 0
        key = "source_no" if by_source else "lang_no"

        def out(table: pa.Table):
            if by_source:
                lang_no = pa.array(lang_of[table.column("source_no").to_numpy()])
                table = table.append_column("lang_no", lang_no).group_by(["lang_no", "term"], use_threads=False).aggregate([("source_no", "list"), ("n", "list")])
                table = table.rename_columns(["lang_no", "term", "sources", "counts"])
            yield from table.combine_chunks().to_batches(max_chunksize=20_000)
            pa.default_memory_pool().release_unused()

        for batch in batches:
            names = zip(*[batch.column(c).to_pylist() for c in ("lang", "source")])
            groups = np.array([numbers[x] for x in names], np.int32)
            groups = groups if by_source else lang_of[groups]
            for rows, terms in terms_of(batch.column("text")):
                if not by_source:
                    seen = pa.table({"row": rows, "term": terms}).group_by(["row", "term"], use_threads=False).aggregate([])
                    rows, terms = seen.column("row").to_numpy(), seen.column("term")
                table = summed([pa.table({key: groups[rows], "term": terms, "n": np.ones(len(rows), np.int64)})], [key, "term"])
                held.append(table)
                n_held += table.nbytes
                if n_held > 2 * HELD_BYTES:
                    held = [summed(held, [key, "term"])]
                    n_held = held[0].nbytes
                    if n_held > HELD_BYTES:
                        yield from out(held[0])
                        held, n_held = [], 0
        if held:
            yield from out(summed(held, [key, "term"]))

    kind = "sources array<int>, counts array<bigint>" if by_source else "n bigint"
    return docs.select("lang", "source", "text").mapInArrow(count, f"lang_no int, term binary, {kind}")


def groups_of(docs: DataFrame) -> list[tuple[str, str]]:
    """The (lang, source) groups in order; refused if their pairs could not be listed."""
    rows = docs.select("lang", "source").distinct().limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups, whose pairs are the result")
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0].encode(), r[1].encode()))


def recounted(docs: DataFrame, groups: list[tuple[str, str]], least_docs: int) -> DataFrame:
    """(lang_no, shard, ordinal, term, sources, counts) of every kept term: how often each source with the term has it.

    Shards and the ordinals in them ascend with the terms of a language.
    """
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in groups))}
    numbers = {g: i for i, g in enumerate(groups)}
    lang_of = np.array([langs[lang] for lang, _ in groups], np.int32)
    in_docs = counted(docs, lang_of, numbers, by_source=False).groupBy("lang_no", "term").agg(F.sum("n").alias("n"))
    kept = stored(in_docs.where(F.col("n") >= least_docs).select("lang_no", "term"), "divergence-kept")
    # Written before they are dealt out by range, which reads its input twice.
    counts = stored(counted(docs, lang_of, numbers, by_source=True), "divergence-counts")
    vocabulary = kept.select("lang_no", F.lit(0).alias("kind"), "term", F.array().cast("array<int>").alias("sources"), F.array().cast("array<bigint>").alias("counts"))
    both = vocabulary.unionByName(counts.withColumn("kind", F.lit(1)))
    dealt = both.repartitionByRange("lang_no", "term").sortWithinPartitions("lang_no", "kind", "term")

    def stream(batches):
        shard = TaskContext.get().partitionId()
        lang, waiting, machines, firsts, bases = None, [], [], [], []
        # The last term and its counts, which the next batch may add to.
        open_ = None

        def build():
            if waiting:
                machines.append(Transducer(waiting))
                firsts.append(waiting[0])
                bases.append(bases[-1] + machines[-2].n_terms if bases else 0)
                waiting.clear()

        def ordinals(terms: pa.Array) -> np.ndarray:
            """Ordinals in this shard; the terms ascend, so those of one transducer are a run."""
            out = np.full(len(terms), -1, np.int64)
            offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, 4 * terms.offset)
            data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
            cuts = []
            for first in firsts[1:]:
                low, high = (cuts[-1] if cuts else 0), len(terms)
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if terms[mid].as_py() < first else (low, mid)
                cuts.append(low)
            for machine, base, a, b in zip(machines, bases, [0, *cuts], [*cuts, len(terms)]):
                if b > a:
                    found = machine.ordinals(data, offsets[a : b + 1])
                    out[a:b] = np.where(found >= 0, found + base, -1)
            return out

        def rows(lang_no, place, terms, sizes, sources, counts, over: bool):
            """The sums of terms whose counts are all here; the last one waits unless its language is over.

            ``sizes`` says how many of the sources and counts belong to each row; places ascend.
            """
            nonlocal open_
            if open_ is not None:
                place, terms = np.append(open_[0], place), [open_[1], *terms]
                sizes, sources, counts = np.append(len(open_[2]), sizes), np.concatenate((open_[2], sources)), np.concatenate((open_[3], counts))
                open_ = None
            if not len(place):
                return
            each = np.repeat(place, sizes)
            order = np.lexsort((sources, each))
            each, sources, counts = each[order], sources[order], counts[order]
            fresh = np.flatnonzero(np.concatenate(([True], (each[1:] != each[:-1]) | (sources[1:] != sources[:-1]))))
            each, sources, counts = each[fresh], sources[fresh], np.add.reduceat(counts, fresh)
            edges = np.flatnonzero(np.diff(each, prepend=-1))
            names = [terms[i] for i in np.flatnonzero(np.diff(place, prepend=-1)).tolist()]
            if not over:
                a = int(edges[-1])
                open_ = (each[a], names[-1], sources[a:], counts[a:])
                each, sources, counts, edges, names = each[:a], sources[:a], counts[:a], edges[:-1], names[:-1]
            n = len(edges)
            if n:
                ends = pa.array(np.append(edges, len(each)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, lang_no, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(each[edges]), pa.array(names, pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(sources.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts))],
                    ["lang_no", "shard", "ordinal", "term", "sources", "counts"],
                )

        nothing = np.zeros(0, np.int64)
        last = (nothing, [], nothing, nothing, nothing, True)
        for batch in batches:
            lang_nos, kinds = batch.column("lang_no").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(lang_nos) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(lang_nos)]
            for a, b in zip(edges[:-1], edges[1:]):
                if lang_nos[a] != lang:
                    yield from rows(lang, *last)
                    lang, waiting, machines, firsts, bases = int(lang_nos[a]), [], [], [], []
                terms = batch.column("term").slice(a, b - a)
                if not kinds[a]:
                    for term in terms.to_pylist():
                        waiting.append(term)
                        if len(waiting) == SHARD_TERMS:
                            build()
                    continue
                build()
                place = ordinals(terms)
                hits = np.flatnonzero(place >= 0)
                taken = pa.array(hits + a)
                sources, counts = batch.column("sources").take(taken), batch.column("counts").take(taken)
                yield from rows(
                    lang, place[hits], batch.column("term").take(taken).to_pylist(), np.diff(sources.offsets.to_numpy()),
                    sources.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), False,
                )
        yield from rows(lang, *last)

    out = stored(dealt.mapInArrow(stream, "lang_no int, shard int, ordinal bigint, term binary, sources array<int>, counts array<bigint>"), "divergence-recount")
    drop_stored(docs.sparkSession, kept, counts)
    return out


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + SMOOTH) / whole) for 64-bit integers, by long division in steps of a thousand."""
    rest, quotient = counts + SMOOTH, np.zeros(np.broadcast_shapes(counts.shape, whole.shape), np.int64)
    for _ in range(3):
        quotient, rest = quotient * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return 1 + quotient


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so squares fit."""
    return (p - q) * (p - q) // (p + q)


def measured(recount: DataFrame, first: np.ndarray, totals: np.ndarray, terms: np.ndarray, top: int) -> DataFrame:
    """Sums over a batch of terms for every pair of sources, and each source's first candidates in it.

    ``first`` has the number of each language's first source (and the number of all at its end), ``totals`` the counted terms of each source,
    ``terms`` the kept terms of each language.
    """

    def measure(batches):
        for batch in batches:
            langs = batch.column("lang_no").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), len(langs)]
            for a, b in zip(edges[:-1], edges[1:]):
                lang = int(langs[a])
                low, n = int(first[lang]), int(first[lang + 1] - first[lang])
                step = max(1, HELD_SHARES // n)
                for start in range(a, b, step):
                    yield from block(batch.slice(start, min(step, b - start)), lang, low, n)

    def block(rows: pa.RecordBatch, lang: int, low: int, n: int):
        width = rows.num_rows
        lists = rows.column("sources")
        sizes = np.diff(lists.offsets.to_numpy())
        source, column, count = lists.flatten().to_numpy() - low, np.repeat(np.arange(width), sizes), rows.column("counts").flatten().to_numpy()
        table = np.zeros((n, width), np.int64)
        table[source, column] = count
        whole = totals[low : low + n] + 2 * int(terms[lang])
        p = shares(table, whole[:, None])
        for i in range(n - 1):
            sums = gap(p[i + 1 :], p[i]).sum(axis=1)
            m = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, low + i, np.int32)), pa.array(np.arange(low + i + 1, low + n, dtype=np.int32)), pa.array(sums), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], NAMES
            )
        q = shares(table.sum(axis=0), np.array(int(totals[low : low + n].sum()) + 2 * int(terms[lang]), np.int64))
        own, other = p[source, column], q[column]
        more = np.flatnonzero((own > other) & (count > 0))
        value, place = gap(own[more], other[more]), rows.column("ordinal").to_numpy()[column[more]]
        order = np.lexsort((place, rows.column("shard").to_numpy()[column[more]], -value, source[more]))
        more, value = more[order], value[order]
        begins = np.flatnonzero(np.diff(source[more], prepend=-1))
        rank = np.arange(len(more)) - np.repeat(begins, np.diff(np.append(begins, len(more))))
        more, value = more[rank < top], value[rank < top]
        at = pa.array(column[more])
        yield pa.RecordBatch.from_arrays(
            [pa.array((source[more] + low).astype(np.int32)), pa.nulls(len(more), pa.int32()), pa.array(value), rows.column("shard").take(at), rows.column("ordinal").take(at), rows.column("term").take(at)], NAMES
        )

    NAMES = ["a", "b", "value", "shard", "ordinal", "term"]
    return recount.mapInArrow(measure, "a int, b int, value bigint, shard int, ordinal bigint, term binary")


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for all other sources of the language, part ``term`` for the first ``top`` terms."""
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = groups_of(texts)
    out = "lang string, source string, part string, item string, value bigint, rank int"
    if not groups:
        return spark.createDataFrame([], out)
    recount = recounted(texts, groups, least_docs)
    langs = list(dict.fromkeys(lang for lang, _ in groups))
    of_lang = {lang: 0 for lang in langs}
    for lang, _ in groups:
        of_lang[lang] += 1
    first = np.cumsum([0, *of_lang.values()])
    totals, terms = np.zeros(len(groups), np.int64), np.zeros(len(langs), np.int64)
    occurrences = recount.select(F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("x.sources").agg(F.sum("x.counts").alias("n"))
    for r in occurrences.collect():
        totals[r["sources"]] = r["n"]
    for r in recount.groupBy("lang_no").count().collect():
        terms[r["lang_no"]] = r["count"]
    found = stored(measured(recount, first, totals, terms, top), "divergence-sums")
    bounds = [(i, lang, source, int(first[k]), int(first[k + 1]), bool(terms[k] == 0)) for i, ((lang, source), k) in enumerate(zip(groups, np.repeat(np.arange(len(langs)), np.diff(first)).tolist()))]
    named = spark.createDataFrame(bounds, "no int, lang string, source string, low int, high int, bare boolean")
    sums = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("value").alias("value"))
    # Without kept terms nothing was summed: all pairs are 0.
    bare = named.where("bare").select(F.col("no").alias("a"), F.explode(F.sequence("low", F.col("high") - 1)).alias("b"), F.lit(0).cast("long").alias("value")).where("a < b")
    both_ways = sums.unionByName(bare).select("value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b", "value")
    items = named.select(F.col("no").alias("b"), F.col("source").alias("item"))
    in_order = Window.partitionBy("a").orderBy(F.col("value").desc(), "item")
    pairs = both_ways.join(items, "b").select("a", F.lit("pair").alias("part"), "item", "value", F.row_number().over(in_order).alias("rank"))
    by_ordinal = Window.partitionBy("a").orderBy(F.col("value").desc(), "shard", "ordinal")
    words = found.where("b IS NULL").select("a", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value", F.row_number().over(by_ordinal).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(words).join(named.select(F.col("no").alias("a"), "lang", "source"), "a").select("lang", "source", "part", "item", "value", "rank")
