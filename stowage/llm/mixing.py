"""Mix sources to target weights: repetition rates per source, whole copies and one seeded chance copy per document.

Sources in code-point order, null last, weigh 5, 2, 1, repeating. They share a stated part of all words; a target stops at
a stated multiple of its source, and what is above is shared again by weight until no target is above.

Defined cases: null text has size 0; a source without words has target 0 and its documents are not taken; null is a
source of its own; documents with equal id and seed share their draw; an empty table gives an empty result; columns of
the input that clash with an added name are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
# Sources up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
DRAWS = 4294967296.0
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from documents with a column ``size``.

    The shares fill up like water: with sources in order of their limit per weight, the first k are full and the
    rest share what is left by weight, for the smallest k where that share is within the next limit.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(place) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (n + 1).cast("int"))
    limit = F.col("source_size") * most
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    here_on = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(here_on))
        .withColumn("open", F.col("level") <= F.col("limit") / F.col("weight"))
    )
    order = F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    final = F.min_by("level", F.when(F.col("open"), order))
    return leveled.withColumn("final", final.over(everything)).select(
        "source",
        "source_size",
        F.when(F.col("final").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("final") * F.col("weight"))).alias("target"),
    )


def draw(id_column, seed: str = SEED):
    """A number in [0, 1) that an id and a seed fix."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / DRAWS


def copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``n_copies``: floor(rate) and one more by chance."""
    sized = docs.withColumn("size", n_words(F.col(text)))
    targets = source_targets(sized, source, share=share, most=most)
    if docs.select(source).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.drop("source_size", "target", "n_copies").alias("d").join(targets.withColumnRenamed("source", "__source").alias("t"), F.col(f"d.{source}").eqNullSafe(F.col("t.__source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chance = (draw(F.col(id_column), seed) < rate - F.floor(rate)).cast("long")
    return joined.drop("__source").withColumn("n_copies", F.floor(rate) + chance)


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns it had."""
    names = docs.columns
    taken = copies(docs.select("*", F.struct("*").alias("__row")), id_column, text, source, seed)
    return taken.where("n_copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select(*[F.col("__row")[n].alias(n) for n in names])
