"""Warehouse layout tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.running import nulls_last, numbered, stacked
from stowage.session import cut_lineage, materialised

# Items of highest support that give the first bound, and how much larger the next trial is.
FIRST_ITEMS, STEP = 128, 8
# Items of an order that are paired with the rest of it in one task.
PART_ITEMS = 128
# An order of more items than this that holds over a 64th of all items is kept as a bit of its items; as many such orders at most.
LARGE_ITEMS, LARGE_SHARE, LARGE_ORDERS = 1024, 64, 4096
# Items that meet in one task, and the least number of blocks of items.
BLOCK_ITEMS, BLOCKS = 16384, 16
# Items of a block that are compared with the other block at once.
STRIPE = 64


def split_coordinates(locations: DataFrame) -> DataFrame:
    """X, Y and Z as text, from a description 'x,y,z'."""
    parts = F.split("description", ",")
    axes = {axis: F.try_element_at(parts, F.lit(i + 1)) for i, axis in enumerate("xyz")}
    return locations.withColumns({"location": F.trim("location"), **axes})


def shared_coordinates(locations: DataFrame) -> DataFrame:
    """Each location found at a coordinate, how often, and how many locations share the coordinate.

    One row per location, not one text per coordinate: descriptions without numbers can all fall on one.
    """
    placed = split_coordinates(locations).groupBy("x", "y", "z", "location").agg(F.count(F.lit(1)).alias("copies"))
    sharing = placed.groupBy(*[F.col(a).alias(f"_{a}") for a in "xyz"]).agg(F.count(F.lit(1)).alias("sharing"))
    same = F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")) & F.col("z").eqNullSafe(F.col("_z"))
    return placed.join(sharing, same).select("x", "y", "z", "location", "copies", "sharing")


def location_table(locations: DataFrame) -> DataFrame:
    """One row per location code with its coordinates; zone and capacities are unknown."""
    return split_coordinates(locations).select(
        "warehouse", "location", "description", "x", "y", "z",
        F.lit("NORMAL").alias("location_type"),
        F.lit(None).cast("string").alias("zone"),
        F.lit(None).cast("double").alias("volume_capacity"),
        F.lit(None).cast("double").alias("weight_capacity"),
    )


def duplicate_locations(locations: DataFrame) -> DataFrame:
    """Location codes that occur more than once, and how often."""
    return (
        locations.groupBy(F.trim("location").alias("location"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def consecutive_picks(lines: DataFrame) -> DataFrame:
    """How often two items follow each other in an order: a measure of its own, not the co-shipment pairs of W3.

    Lines of an order are numbered and each is paired with the next, so the work grows with the
    lines. Pairing every two items of an order would grow with the square of its size.
    """
    order = nulls_last(["lline", "item", *[c for c in lines.columns if c not in {"lord", "lline", "item"}]])
    # Lines without a number come last; they are spread by item, so that no level holds them all.
    numberless = F.lit(2**31 - 1) + F.pmod(F.crc32(F.coalesce("item", F.lit("")).cast("binary")), F.lit(4096))
    level = F.coalesce(F.col("lline").try_cast("int").cast("long"), numberless)
    placed = numbered(lines, ["lord"], level, order, "_at", "_size").select("lord", "item", "_at")
    following = placed.select("lord", F.col("item").alias("_next"), (F.col("_at") - 1).alias("_at"))
    return (
        placed.join(following, ["lord", "_at"])
        .where(F.col("item") != F.col("_next"))
        .groupBy(F.least("item", "_next").alias("item_a"), F.greatest("item", "_next").alias("item_b"))
        .agg(F.count(F.lit(1)).alias("co_occurrence"))
    )


def _pair_counts(picks: DataFrame) -> DataFrame:
    """How many orders hold both of two items, from distinct (lord, item).

    An order is cut into parts by item, and every part meets the whole order, so no order lies in one task.
    """
    sizes = picks.groupBy("lord").agg(F.ceil(F.count(F.lit(1)) / PART_ITEMS).cast("int").alias("_parts")).where("_parts > 0")
    sized = picks.join(sizes, "lord")
    part = F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int")
    first = sized.select("lord", part.alias("_part"), F.col("item").alias("item_a"))
    second = sized.select("lord", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("item").alias("item_b"))
    met = first.join(second, ["lord", "_part"]).where("item_a < item_b")
    return met.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("co_occurrence"))


def _large_orders(picks: DataFrame, n_items: int) -> DataFrame:
    """(lord, _at): the orders that hold a good share of all items, numbered. At most LARGE_SHARE times an item's mean support fit that."""
    sizes = picks.groupBy("lord").agg(F.count(F.lit(1)).alias("_items"))
    large = sizes.where((F.col("_items") > LARGE_ITEMS) & (F.col("_items") * LARGE_SHARE > n_items))
    best = large.orderBy(F.col("_items").desc(), "lord").limit(LARGE_ORDERS)
    return cut_lineage(best.select("lord", (F.row_number().over(Window.orderBy("lord")) - 1).alias("_at")))


def _item_bits(picks: DataFrame, large: DataFrame, words: int) -> DataFrame:
    """(item, _w0.., _rest): the large orders of an item as bits, and how many other orders it is in."""
    word, bit = F.floor(F.col("_at") / 64), F.expr("shiftleft(1L, _at % 64)")
    bits = [F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")).alias(f"_w{k}") for k in range(words)]
    placed = picks.join(large, "lord", "left")
    return placed.groupBy("item").agg(*bits, F.count(F.when(F.col("_at").isNull(), 1)).alias("_rest"), F.count("_at").alias("_large")).where("_large > 0").drop("_large")


def _pairs_by_bits(bits: DataFrame, words: int, bound: int) -> DataFrame:
    """(item_a, item_b, _common): in how many large orders both items are, of the pairs that can be in ``bound`` orders altogether.

    Items are dealt into blocks and every two blocks meet in a task, as rows of a few words that are compared in stripes; no pair is built
    that the bound rules out.
    """
    blocks = max(BLOCKS, -(-bits.count() // BLOCK_ITEMS))
    dealt = bits.withColumn("_own", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    first = dealt.select(*bits.columns, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.lit(blocks - 1))).alias("_j"), F.lit(False).alias("_second"))
    earlier = dealt.where("_own > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_own") - 1)).alias("_i"))
    second = earlier.select(*bits.columns, "_i", F.col("_own").alias("_j"), F.lit(True).alias("_second"))
    stripe = STRIPE

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        held = [rows[f"_w{k}"].to_numpy().view(np.uint64) for k in range(words)]
        rest, items = rows["_rest"].to_numpy(), rows["item"].combine_chunks()
        here = rows["_second"].to_numpy(zero_copy_only=False)
        own = rows["_i"][0] == rows["_j"][0]
        a, b = np.flatnonzero(~here), np.flatnonzero(~here if own else here)
        for at in range(0, len(a), stripe):
            some = a[at : at + stripe]
            common = np.zeros((len(some), len(b)), np.uint16)
            for word in held:
                common += np.bitwise_count(word[some][:, None] & word[b][None, :])
            able = common + np.minimum(rest[some][:, None], rest[b][None, :]) >= bound
            if own:
                able &= b[None, :] > some[:, None]
            x, y = np.nonzero(able)
            if len(x):
                yield pa.RecordBatch.from_arrays([items.take(pa.array(some[x])), items.take(pa.array(b[y])), pa.array(common[x, y].astype(np.int64))], ["_x", "_y", "_common"])

    # A task for every two blocks, however few bytes they are: the work is in the pairs.
    met = stacked(first, second).repartition(blocks * (blocks + 1) // 2, "_i", "_j").groupBy("_i", "_j")
    return met.applyInArrow(compared, "_x string, _y string, _common long").select(F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"), "_common")


def frequent_pairs(lines: DataFrame, count: int = 100) -> DataFrame:
    """The ``count`` item pairs that most orders hold both items of; ties go by item_a, item_b.

    A pair is in no more orders than its rarer item. So the ``count``-th pair among some items of highest support gives a bound,
    and only items at or above it can be in a pair that counts. A trial over more items raises the bound before all that are left are
    taken; the pairs of other items are never built. Orders that hold a good share of all items are compared as bits of their items. Lines without order or item are left out, an item counts once an order.
    """
    picks = materialised(lines.select("lord", "item").where("lord IS NOT NULL AND item IS NOT NULL").distinct())
    supports = cut_lineage(picks.groupBy("item").agg(F.count(F.lit(1)).alias("support")))
    large = _large_orders(picks, supports.count())
    words = -(-large.count() // 64)
    bits = materialised(_item_bits(picks, large, words)) if words else None
    others = materialised(picks.join(large, "lord", "left_anti")) if words else picks
    taken, bound = FIRST_ITEMS, 1
    while True:
        able = supports.where(F.col("support") >= bound)
        n_able = able.count()
        if taken < n_able:
            able = able.orderBy(F.col("support").desc(), "item").limit(taken)
        pairs = _pair_counts(others.join(able.select("item"), "item", "left_semi"))
        if words:
            # A pair that the bits leave out is below the bound, with or without its other orders.
            in_large = _pairs_by_bits(bits.join(able.select("item"), "item", "left_semi"), words, bound)
            both = F.coalesce("co_occurrence", F.lit(0)) + F.coalesce("_common", F.lit(0))
            pairs = pairs.join(in_large, ["item_a", "item_b"], "full").select("item_a", "item_b", both.alias("co_occurrence"))
        pairs = pairs.where(F.col("co_occurrence") >= bound)
        best = cut_lineage(pairs.orderBy(F.col("co_occurrence").desc(), "item_a", "item_b").limit(count))
        found, least = best.agg(F.count(F.lit(1)), F.min("co_occurrence")).first()
        if taken >= n_able:
            return best
        if found == count:
            bound = least
            # The items that are left may all have been in this trial.
            if supports.where(F.col("support") >= bound).count() <= taken:
                return best
        taken *= STEP


def top_pairs(pairs: DataFrame, item_locations: DataFrame, count: int = 100) -> DataFrame:
    """Of a pair table (``frequent_pairs``), the most frequent item pairs with the location of each item; items without one drop out."""
    best = pairs.orderBy(F.col("co_occurrence").desc(), "item_a", "item_b").limit(count)
    a = item_locations.select(F.col("item").alias("item_a"), F.col("location").alias("location_a"))
    b = item_locations.select(F.col("item").alias("item_b"), F.col("location").alias("location_b"))
    return best.join(a, "item_a").join(b, "item_b").select(
        "item_a", "item_b", "co_occurrence", "location_a", "location_b"
    )


def abc_classes(lines: DataFrame, subject: str, group: str = "warehouse", a: float = 0.8, b: float = 0.95) -> DataFrame:
    """Pick count and ABC class of items or locations by cumulative share of picks.

    Subjects with equally many picks share a class. Only the distinct pick counts are cumulated;
    there are at most about sqrt(2 * picks) of them.
    """
    picks = lines.groupBy(group, subject).agg(F.count(F.lit(1)).alias("picks"))
    steps = picks.groupBy(group, "picks").agg((F.count(F.lit(1)) * F.col("picks")).alias("_sum"))
    window = Window.partitionBy(group)
    upto = window.orderBy(F.col("picks").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = steps.select(
        group, "picks", (F.sum("_sum").over(upto) / F.sum("_sum").over(window)).alias("cumulative_share")
    )

    def letter(share: Column) -> Column:
        return F.when(share <= a, "A").when(share <= b, "B").otherwise("C")

    return picks.join(shares, [group, "picks"]).select(
        group, subject, "picks", "cumulative_share", letter(F.col("cumulative_share")).alias("abc_class")
    )


def stock_on_layout(locations: DataFrame, stock: DataFrame) -> DataFrame:
    """Every location with the stock it holds; empty locations stay."""
    held = stock.select("warehouse", "location", "item", "on_hand")
    return locations.select("warehouse", "location", "x", "y", "z").join(held, ["warehouse", "location"], "left")
