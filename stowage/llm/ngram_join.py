"""N-gram Jaccard join: grouped prefix join of documents as sets of word shingles, down to link classes.

Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of 0.8 or more; classes are
what links reach. Method: shingles are ordered rare first (by a tally of fixed size, then by hash; any common order is exact).
Sets that link share a shingle among the first n - ceil(0.8 n) + 1, their prefixes. Documents with equal prefix and size are one
group; groups that share a prefix shingle are paired, pairs are filtered by size and position, and the distinct sets
of both groups are verified by their full intersection.

A shingle that many groups hold is not paired out. First each group is compared with one hub per shingle, and what links is
merged; this repeats with other hubs while a good part of the sets merges. Then every remaining pair of different classes is verified. Pairs inside a class need no proof, so no link between classes is lost.
The result is classes alone: pairs within a class are not all verified, and how many links a document has is not given.

Defined cases: null, empty or blank text has an empty set, links with nothing and is its own class; fewer than five words
are one shingle; repeated rows are one class; a class's id is its smallest doc_id (nulls only if all are null); an empty table gives an
empty result; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.components import components
from stowage.llm.storage import drop_stored, marked, marks, release, stored, tally
from stowage.llm.words import mixed, shingle_sets

WIDTH = 5
# The similarity as a fraction.
LEAST = (4, 5)
# Counters of the shingle tally: a fixed size, exactness does not depend on it.
TALLY_BITS = 20
# Links found, one for so many sets, that call for another round of hubs.
MERGED_PART = 64


def prefix_size(n: int) -> int:
    return n - (LEAST[0] * n + LEAST[1] - 1) // LEAST[1] + 1


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    a = mixed(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mixed(values + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return tuple(mixed(np.array([a, b], np.uint64) + np.uint64(len(values))).view(np.int64).tolist())


def buckets(batch: pa.RecordBatch):
    held, n = [], 0
    for found in shingle_sets(batch.column("text"), WIDTH):
        held.append((found >> np.uint64(64 - TALLY_BITS)).astype(np.int64))
        n += len(found)
        if n > 400_000:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """Per document its set's size and digest, its group and its prefix, rare shingles first."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(tally(docs.select("text"), TALLY_BITS, buckets), (1 << 32) - 1).astype(np.uint32))

    def sign(batches):
        counts = shared.value
        for batch in batches:
            sizes, high, low, groups, prefixes = [], [], [], [], []
            for found in shingle_sets(batch.column("text"), WIDTH):
                n = len(found)
                k = prefix_size(n) if n else 0
                # Sorted by hash already, so a stable sort by count settles ties by hash.
                chosen = found[np.argsort(counts[(found >> np.uint64(64 - TALLY_BITS)).astype(np.int64)], kind="stable")[:k]]
                d = digest(found)
                sizes.append(n)
                high.append(d[0])
                low.append(d[1])
                groups.append(digest(chosen)[0] ^ n)
                prefixes.append(chosen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), *[pa.array(v, pa.int64()) for v in (sizes, high, low, groups)], lists(prefixes)],
                ["doc_id", "row_key", "n_shingles", "high", "low", "grp", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, row_key bigint, n_shingles bigint, high bigint, low bigint, grp bigint, prefix array<bigint>")


def postings_of(signed: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, grp, n, pos) of the prefixes at the wanted keys. A filter of bounded size keeps most others from being moved."""
    shared = signed.sparkSession.sparkContext.broadcast(marks(keys, "key"))

    def spread(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = np.diff(prefix.offsets.to_numpy())
            values = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(marked(shared.value, values))
            row = row[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[at]), pa.array(batch.column("grp").to_numpy()[row]), pa.array(batch.column("n_shingles").to_numpy()[row].astype(np.int32)), pa.array(pos[at].astype(np.int32))],
                ["key", "grp", "n", "pos"],
            )

    made = signed.select("grp", "n_shingles", "prefix").mapInArrow(spread, "key bigint, grp bigint, n int, pos int")
    return made.join(keys, "key").distinct()


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(row_key, high, low, text) with the digest of their set, of documents whose key is wanted, and of few others.

    A filter of bounded size keeps other texts from being moved; the caller's join settles it. A task sends a text once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks(keys, "row_key"))

    def chosen(batches):
        sent = set()
        for batch in batches:
            keys, at = batch.column("row_key").to_numpy(), []
            for i in np.flatnonzero(marked(shared.value, keys)).tolist():
                if int(keys[i]) not in sent:
                    sent.add(int(keys[i]))
                    at.append(i)
            part = batch.take(pa.array(at, pa.int64()))
            digests = [digest(f) for f in shingle_sets(part.column("text"), WIDTH)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row_key"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), part.column("text")],
                ["row_key", "high", "low", "text"],
            )

    return docs.select("row_key", "text").mapInArrow(chosen, "row_key bigint, high bigint, low bigint, text string")


def near_enough(a: str, b: str):
    """The filters of a pair of groups met at one shingle: sizes, and what can still be common after its positions.

    At the first common shingle nothing before it is common, so the bound holds for one of the pair's shingles at least.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (LEAST[1] * F.least(n, m) >= LEAST[0] * F.greatest(n, m)) & (rest * (LEAST[0] + LEAST[1]) >= LEAST[0] * (n + m))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link, by the full intersection of the sets."""
    sides = ("row_key", "high", "low")
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sides]), side)
    pairs = stored(pairs, "keyed-pairs")
    texts = texts_of(docs, pairs.select(F.col("a_row_key").alias("row_key")).union(pairs.select("b_row_key")).distinct())
    for side, name in (("a", "x"), ("b", "y")):
        held = texts.select(*[F.col(c).alias(f"{side}_{c}") for c in sides], F.col("text").alias(name))
        pairs = pairs.join(held, [f"{side}_{c}" for c in sides])

    def compare(batches):
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(shingle_sets(batch.column("x"), WIDTH), shingle_sets(batch.column("y"), WIDTH))):
                common = len(np.intersect1d(p, q, assume_unique=True))
                if LEAST[1] * common >= LEAST[0] * (len(p) + len(q) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    # Copies of a text can come from several tasks.
    return stored(pairs.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct(), "verified")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, class (a number, null for an empty set) and component_id of every document row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    signed = stored(signatures(docs), "signatures")
    release(spark)
    rows = stored(signed.drop("prefix", "grp"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")).alias("first")
    nodes = signed.where("n_shingles > 0").groupBy("high", "low").agg(first, F.min("grp").alias("grp"), F.count("*").alias("n_docs"))
    nodes = stored(nodes.select("high", "low", F.col("first.doc_id").alias("doc_id"), F.col("first.row_key").alias("row_key"), "grp", "n_docs", F.monotonically_increasing_id().alias("node")), "sets")

    # Prefix shingles that two groups hold.
    keys = signed.select("grp", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("grp").alias("x"), F.max("grp").alias("y"))
    keys = stored(keys.where("x <> y").select("key"), "keys")
    release(spark)
    postings = stored(postings_of(signed, keys), "postings")
    drop_stored(spark, signed, keys)
    release(spark)
    crowded = nodes.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp")
    wanted = stored(nodes.join(postings.select("grp").union(crowded).distinct(), "grp", "left_semi"), "wanted")
    release(spark)

    members = wanted.select("grp", "node", "n_docs")
    # The members of a group share prefix and size: compare each with the group's first.
    heads = members.join(crowded, "grp").groupBy("grp").agg(F.min("node").alias("a"))
    pairs = members.join(heads, "grp").where("node <> a").select("a", F.col("node").alias("b"))
    links = verified(pairs, docs, wanted)
    labels = relabelled(spark, members.select("node", F.col("node").alias("class")), links)
    n_sets = members.count()
    round_number, n_links = 0, n_sets
    while True:
        placed = stored(members.join(labels, "node").groupBy("grp", "class").agg(F.max("n_docs").alias("n_docs")), "placed")
        held = stored(postings.join(placed, "grp"), "held")
        # Sets with many copies are likely centres; later rounds try others.
        rank = F.struct(-F.col("n_docs") if not round_number else F.lit(0), F.xxhash64("grp", F.lit(round_number)), "grp", "n", "pos", "class")
        live = held.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.min(rank).alias("hub")).where("x <> y")
        live = stored(live.select("key", "hub.grp", "hub.n", "hub.pos", "hub.class"), "live")
        # The next step moves texts; what was moved up to here is not needed any more.
        release(spark)
        last = not n_links or MERGED_PART * n_links < n_sets
        if last:
            # Every pair of different classes that passes the filters, of groups and inside groups.
            one = stored(held.join(live.select("key"), "key", "left_semi").drop("n_docs"), "open")
            met = one.alias("p").join(one.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.class") < F.col("q.class")))
            within = members.join(crowded, "grp").join(labels, "node")
            inside = within.alias("p").join(within.alias("q"), (F.col("p.grp") == F.col("q.grp")) & (F.col("p.class") < F.col("q.class"))).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
        else:
            met = held.alias("p").join(live.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.class") != F.col("q.class")))
            inside = None
        met = met.where(near_enough("p", "q")).select(F.col("p.grp").alias("g"), F.col("p.class").alias("c"), F.col("q.grp").alias("h"), F.col("q.class").alias("d")).distinct()
        mine = members.join(labels, "node")
        pairs = met.join(mine.select(F.col("grp").alias("g"), F.col("class").alias("c"), F.col("node").alias("a")), ["g", "c"]).join(mine.select(F.col("grp").alias("h"), F.col("class").alias("d"), F.col("node").alias("b")), ["h", "d"]).select("a", "b")
        if inside is not None:
            pairs = pairs.union(inside)
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        links = verified(pairs, docs, wanted)
        n_links = links.count()
        if n_links:
            labels = relabelled(spark, labels, links)
        drop_stored(spark, placed, held, live, pairs, links)
        release(spark)
        if last:
            break
        round_number += 1

    named = nodes.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "class").select("high", "low", "class", "component_id"), "classes")
    out = rows.join(named, ["high", "low"], "left")
    alone = F.col("n_shingles") == 0
    drop_stored(spark, postings)
    return out.select("doc_id", "row_key", "n_shingles", F.when(~alone, F.col("class")).alias("class"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def relabelled(spark, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, class) after links between nodes merge their classes."""
    a = labels.select(F.col("node").alias("a"), F.col("class").alias("x"))
    b = labels.select(F.col("node").alias("b"), F.col("class").alias("y"))
    merged = components(links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    merged = merged.select(F.col("node").alias("class"), F.col("component").alias("target"))
    return stored(labels.join(merged, "class", "left").select("node", F.coalesce("target", "class").alias("class")), "labels")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each class, and all documents without words, with the columns they had.

    A row is known by its id and a 64-bit hash of id and text, so different rows are told apart unless they share an id, or have none, and a hash.
    """
    judged = classes(docs)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")
    stay = judged.where("n_shingles > 0").groupBy("class").agg(F.min(place).alias("first"))
    stay = stay.select(F.col("first.row_key").alias("key"), F.col("first.doc_id").alias("id"), F.lit(True).alias("single"))
    stay = stay.union(judged.where("n_shingles = 0").select("row_key", "doc_id", F.lit(False).alias("single")).distinct())
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").alias("row_id"))
    rows = rows.join(stay, (F.col("row_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id")))
    # Repeated rows share a key: one of them stays.
    first = F.row_number().over(Window.partitionBy("row_key", "row_id").orderBy("row"))
    once = rows.where("single").withColumn("place", first).where("place = 1").select("row")
    return once.union(rows.where("NOT single").select("row")).select(*[F.col("row")[n].alias(n) for n in names])
