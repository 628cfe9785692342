"""A Merkle manifest of a table of documents, and the audit that climbs it.

Every row is a leaf. The leaves of a source, by doc_id, are the leaves of a tree; its root is the source's subroot, and the subroots, by source, are the
leaves of a last tree, whose root is the dataset's. In a tree, runs of ``RUN`` consecutive nodes are hashed together until one node is left.

Built levels are stored as rows that link a node to an ancestor. A link spans ``HOP`` levels and keeps the siblings on its way, so that a climb
of h levels takes h / ``HOP`` joins, and only the links of leaves are as many as the rows. ``climb`` is a recursive query: it starts with
every leaf's own link and joins the link of the ancestor reached, appending a row of siblings and folding the hash at each step.

Positions come from a range-partitioned sort with offsets by partition; a group of children holds at most RUN ** HOP rows, whatever the size of a
source. Nothing but counts and the root passes through the driver.

Defined cases: a null value is hashed as ``-``; a null source is a source of its own, before all others; null doc_ids come first; rows with equal
doc_id are ordered by their leaf; repeated rows are leaves of their own; a source of one row is its leaf; an empty table has no root and gives no
rows; other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.storage import drop_stored, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, HOP = 3, 4
BLOCK = RUN**HOP
# The tree of subroots.
TOP = -1
PARTITION_BITS = 33
RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


def text_hash(hexes: Column) -> Column:
    """SHA-256 of a text, as bytes."""
    return F.unhex(F.sha2(hexes.cast("binary"), 256))


def leaf_hash(values: dict[str, Column]) -> Column:
    """The hash of a row: every field as ``-`` or its UTF-8 length, a colon and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return text_hash(F.concat(*parts))


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def source_key(source: Column) -> Column:
    """Bytes that sort as sources do, null first, and are never null."""
    return F.when(source.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), source.cast("string").cast("binary")))


def placed(df: DataFrame, group: str, order: list[str], purpose: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its group from 0, and ``n``, the rows of the group.

    Rows are sorted by range; a short table of groups by partition gives the offsets.
    """
    columns = df.columns
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered = stored(ordered.withColumn("__id", F.monotonically_increasing_id()), purpose).withColumn("__part", F.shiftright("__id", PARTITION_BITS))
    counts = numbered.groupBy(group, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__rows"))
    offsets = counts.selectExpr(
        group,
        "__part",
        "__first",
        f"coalesce(sum(__rows) OVER (PARTITION BY {group} ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __offset",
        f"sum(__rows) OVER (PARTITION BY {group}) AS n",
    )
    joined = numbered.join(offsets, [group, "__part"])
    return joined.select(*columns, (F.col("__id") - F.col("__first") + F.col("__offset")).alias("pos"), "n")


def above(hexes: Column) -> Column:
    """The next level of an array of hashes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hexes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(hexes, i * RUN + 1, F.lit(RUN)), "").cast("binary"), 256))


def linked(nodes: DataFrame, round_: int, keep: list[str], beyond: list[Column]) -> DataFrame:
    """Links of all nodes of a level: siblings by level and where they lead.

    ``nodes`` has tree, pos, n (nodes of the tree at this level) and hash. ``beyond`` is (tree, round, pos) above a tree's root.
    """
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash", *keep)))
    blocks = nodes.groupBy("tree", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(kids.alias("kids"))
    n_levels = F.lit(HOP)
    for k in range(HOP - 1, -1, -1):
        n_levels = F.when(F.col("n") <= RUN**k, k).otherwise(n_levels)
    blocks = blocks.withColumn("levels", n_levels).withColumn("h0", F.transform("kids.hash", hexed))
    for k in range(1, HOP + 1):
        below = F.col(f"h{k - 1}")
        blocks = blocks.withColumn(f"h{k}", F.when(F.col("levels") >= k, above(below)).otherwise(below))

    def steps(i: Column) -> Column:
        out = []
        for k in range(1, HOP + 1):
            row = F.col(f"h{k - 1}")
            at = F.floor(i / RUN ** (k - 1)).cast("int")
            start = F.floor(at / RUN).cast("int") * RUN
            before = F.array_join(F.slice(row, start + 1, at - start), "")
            after = F.array_join(F.slice(row, at + 2, start + RUN - 1 - at), "")
            out.append(F.struct(F.unhex(before).alias("before"), F.unhex(after).alias("after")))
        return F.slice(F.array(*out), 1, F.col("levels"))

    rows = F.transform("kids", lambda kid, i: F.struct(*[kid[c].alias(c) for c in ("pos", "hash", *keep)], steps(i).alias("steps")))
    last = F.col("n") <= BLOCK
    up = [F.col("tree"), F.lit(round_ + 1), F.col("block")]
    ends = [F.when(last, b).otherwise(a).cast(t).alias(c) for a, b, t, c in zip(up, beyond, ("long", "int", "long"), ("up_tree", "up_round", "up_pos"))]
    return blocks.select("tree", F.lit(round_).alias("round"), "n", *ends, F.unhex(F.element_at(f"h{HOP}", 1)).alias("up_hash"), F.inline(rows))


def built(nodes: DataFrame, keep: list[str], beyond: list[Column], purpose: str) -> list[DataFrame]:
    """Stored links of all levels of all trees, one table per HOP levels."""
    most, tables = nodes.agg(F.max("n")).first()[0], []
    while most:
        made = stored(linked(nodes, len(tables), keep, beyond), purpose)
        tables.append(made)
        most = (most + BLOCK - 1) // BLOCK
        if most == 1:
            break
        keep = []
        above = made.where((F.col("pos") % BLOCK == 0) & (F.col("n") > BLOCK))
        nodes = above.select("tree", F.expr(f"pos div {BLOCK}").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("up_hash").alias("hash"))
    return tables


# From the leaves up. ``upper`` holds the links of all nodes that are not leaves.
CLIMB = """
WITH RECURSIVE climb(tree, pos, hop, up_tree, up_round, up_pos, folded, siblings) AS (
  SELECT tree, pos, 0, up_tree, up_round, up_pos, {fold_leaf}, {siblings} FROM {leaves} AS link
  UNION ALL
  SELECT c.tree, c.pos, c.hop + 1, link.up_tree, link.up_round, link.up_pos, {fold_node}, {siblings}
  FROM climb AS c JOIN {upper} AS link ON link.tree = c.up_tree AND link.round = c.up_round AND link.pos = c.up_pos
)
SELECT tree, pos, hop, folded, siblings FROM climb"""
FOLD = "aggregate(link.steps, {start}, (h, s) -> unhex(sha2(cast(concat(lower(hex(s.before)), lower(hex(h)), lower(hex(s.after))) AS binary), 256)))"
SIBLINGS = "unhex(array_join(transform(link.steps, s -> concat(hex(s.before), hex(s.after))), ''))"


def climbed(leaves: DataFrame, upper: DataFrame) -> DataFrame:
    """A row per leaf and link on its way up: the siblings met and the hash folded so far, from the column ``altered``."""
    spark = leaves.sparkSession
    query = CLIMB.replace("{fold_leaf}", FOLD.replace("{start}", "link.altered")).replace("{fold_node}", FOLD.replace("{start}", "c.folded")).replace("{siblings}", SIBLINGS)
    # The climb holds a row per leaf and link, more than the limit meant to stop endless recursion; its depth stays limited.
    limit = spark.conf.get(RECURSION_ROWS)
    spark.conf.set(RECURSION_ROWS, "-1")
    try:
        return stored(spark.sql(query, leaves=leaves, upper=upper), "manifest-climb")
    finally:
        spark.conf.set(RECURSION_ROWS, limit)


def hashed(docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, doc_id, hash, altered): the leaf of every row, and the leaf with some fields replaced where a condition holds."""
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_hash(fields)
    changed = F.when(F.coalesce(where, F.lit(False)), leaf_hash(fields | altered)).otherwise(F.col("hash")) if altered else F.col("hash")
    return docs.select(*FIELDS, leaf.alias("hash")).select(source_key(F.col("source")).alias("key"), "doc_id", "hash", changed.alias("altered"))


def newlines_gone(docs: DataFrame) -> DataFrame:
    """The leaves, and those of a copy that lost the line breaks of every text whose doc_id has an even CRC-32."""
    return hashed(docs, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def audited(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf (see ``hashed``)."""
    spark = leaves.sparkSession
    kind = leaves.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    base = stored(leaves, "manifest-leaves")
    rows = placed(base, "key", ["doc_id", "hash", "altered"], "manifest-rows")
    # Trees are numbered in the order of their sources.
    sources = placed(base.select("key").distinct().withColumn("all", F.lit(0)), "all", ["key"], "manifest-sources")
    trees = stored(sources.select("key", F.col("pos").alias("tree"), F.col("n").alias("n_trees")), "manifest-trees")
    nodes = rows.join(trees, "key").select("tree", "pos", "n", "hash", "doc_id", "altered")
    levels = built(nodes, ["doc_id", "altered"], [F.lit(TOP), F.lit(0), F.col("tree")], "manifest-links")
    if not levels:
        return spark.createDataFrame([], out)
    subroots = None
    for level in levels:
        done = level.where((F.col("n") <= BLOCK) & (F.col("pos") == 0)).select("tree", F.col("up_hash").alias("subroot"))
        subroots = done if subroots is None else subroots.unionByName(done)
    subroots = stored(subroots, "manifest-subroots")
    counted = subroots.join(trees.select("tree", "n_trees"), "tree")
    top = built(counted.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("n_trees").alias("n"), F.col("subroot").alias("hash")), [], [F.lit(None)] * 3, "manifest-top")
    root = top[-1].first()["up_hash"].hex()
    link = ["tree", "round", "pos", "up_tree", "up_round", "up_pos", "steps"]
    upper = None
    for level in levels[1:] + top:
        upper = level.select(*link) if upper is None else upper.unionByName(level.select(*link))
    climb = climbed(levels[0].select(*link, "altered"), upper)
    siblings = F.transform(F.sort_array(F.collect_list(F.struct("hop", "siblings"))), lambda x: hexed(x["siblings"]))
    ways = climb.groupBy("tree", "pos").agg(F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"), hexed(F.max_by("folded", "hop")).alias("folded_root"))
    known = levels[0].select("tree", "pos", "doc_id", hexed(F.col("hash")).alias("leaf")).join(subroots, "tree")
    drop_stored(spark, base)
    return known.join(ways, ["tree", "pos"]).select(
        "doc_id", "leaf", hexed(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
