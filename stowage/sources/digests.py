"""Comparing two states of a table by digests, so that only what can differ is joined.

Keys are dealt into a fixed number of buckets. A bucket's digest is the number of its rows and two sums over the halves of a 64-bit hash of each row: it does
not depend on the order of rows, equal rows do not cancel out, and it is combined before the shuffle. Rows whose bucket has the same digest on both
sides are left out; a bucket that differs is kept whole, so a comparison by key gives the same result on what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
LOW_HALF = 0xFFFFFFFF


def bucket_of(keys: Sequence[Column], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, keys: Sequence[str], fields: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, low, high) of the rows' keys and fields. Nulls count by their place."""
    values = [F.col(c) for c in (*keys, *fields)]
    # A hash passes nulls over, so their places are hashed as well.
    row = F.xxhash64(*values, *[v.isNull() for v in values])
    return (
        df.select(bucket_of([F.col(k) for k in keys], buckets).alias("bucket"), row.alias("_row"))
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("_row").bitwiseAND(LOW_HALF)).alias("low"),
            F.sum(F.shiftrightunsigned("_row", 32)).alias("high"),
        )
    )


def differing_buckets(first: DataFrame, second: DataFrame) -> DataFrame:
    """The buckets whose digests differ or that only one side has."""
    there = second.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("n", "low", "high")])
    same = F.lit(True)
    for c in ("n", "low", "high"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return first.join(there, "bucket", "full").where(~same).select("bucket")


def in_buckets(df: DataFrame, keys: Sequence[str], buckets: DataFrame, n: int = BUCKETS) -> DataFrame:
    """The rows of some buckets; there are at most ``n`` of them, so their list goes to every task."""
    return df.withColumn("bucket", bucket_of([F.col(k) for k in keys], n)).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")


def alike(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with columns in the types that ``other`` has them in, so that equal values hash alike."""
    return df.withColumns({c: F.col(c).cast(other.schema[c].dataType) for c in columns})


def only_differing(
    first: DataFrame, second: DataFrame, keys: Sequence[str], fields: Sequence[str], first_digests: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the buckets that are equal, and the digests of the second. ``first_digests`` are used if known."""
    known = bucket_digests(first, keys, fields) if first_digests is None else first_digests
    found = bucket_digests(alike(second, first, (*keys, *fields)), keys, fields)
    differ = differing_buckets(known, found)
    same_kind = alike(second.select(*keys), first, keys)
    hashed = bucket_of([F.col(f"_k_{k}") for k in keys])
    typed = second.withColumns({f"_k_{k}": F.col(k).cast(same_kind.schema[k].dataType) for k in keys}).withColumn("bucket", hashed)
    return in_buckets(first, keys, differ), typed.join(F.broadcast(differ), "bucket", "left_semi").select(*second.columns), found
