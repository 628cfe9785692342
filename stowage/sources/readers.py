"""Reading and typing input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digits_to_date(digits: Column) -> Column:
    """A ``yyyyMMdd`` number as a date; anything unreadable gives null."""
    return F.try_to_timestamp(digits.cast("string"), F.lit("yyyyMMdd")).cast("date")


def cleaned(df: DataFrame, dates: Sequence[str] = ()) -> DataFrame:
    """Strings trimmed, NaN as null, and date columns parsed."""

    def column(field: T.StructField) -> Column:
        c = F.col(field.name)
        if field.name in dates:
            return digits_to_date(c).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.trim(c).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def read_query(
    spark: SparkSession,
    url: str,
    query: str,
    properties: Mapping[str, str],
    split: tuple[str, int, int, int] | None = None,
    dates: Sequence[str] = (),
) -> DataFrame:
    """A query against the order system over JDBC.

    ``split`` = (column, lower, upper, partitions) reads ranges of a numeric column in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**properties)
    if split is None:
        return cleaned(reader.option("query", query).load(), dates)
    column, lower, upper, partitions = split
    ranged = (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
    )
    return cleaned(ranged.load(), dates)


def narrowed(
    df: DataFrame, equals: Mapping[str, object] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Equality or list filters that are set, then a column list; both reach the scan."""
    for name, value in (equals or {}).items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(*value)) if value else df
        else:
            df = df.where(F.col(name) == value)
    return df.select(*columns) if columns else df


def read_parquet(
    spark: SparkSession,
    path: str,
    equals: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """S3: a stored table with optional filters and columns."""
    return narrowed(spark.read.parquet(path), equals, columns)


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], **parameters) -> DataFrame:
    """SQL over named tables (``{orders}``) with named parameters (``:day``)."""
    return spark.sql(query, args=parameters or None, **tables)


LOCATION_FILE = "WWHS string, WLOC string, WDESC string"


def read_locations_csv(spark: SparkSession, path: str, schema: str = LOCATION_FILE) -> DataFrame:
    """A location file; the coordinates stand comma-separated in the quoted description."""
    raw = spark.read.csv(path, header=True, schema=schema)
    return raw.select(
        F.trim("WWHS").alias("warehouse"), F.trim("WLOC").alias("location"), F.col("WDESC").alias("description")
    )


def enforce_types(df: DataFrame, types: Mapping[str, str] | T.StructType) -> DataFrame:
    """Cast the columns that are present; a value that does not convert becomes null."""
    if isinstance(types, T.StructType):
        types = {f.name: f.dataType.simpleString() for f in types.fields}
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in types.items() if name in df.columns})


def narrow_types(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Present columns in a target type, where that loses no value: integral doubles as integers, digits as numbers, midnights as dates.

    One pass over the table proves it for all columns. A column with a value that does not come back equal is refused by name; with
    ``strict=False`` it stays as it is.
    """
    wanted = {name: kind for name, kind in types.items() if name in df.columns}
    if not wanted:
        return df

    def lost(name: str, kind: str) -> Column:
        narrow = F.col(name).try_cast(kind)
        return F.coalesce(F.max(F.col(name).isNotNull() & ~narrow.try_cast(df.schema[name].dataType).eqNullSafe(F.col(name))), F.lit(False)).alias(name)

    losing = df.agg(*[lost(name, kind) for name, kind in wanted.items()]).first().asDict()
    refused = [name for name, loses in losing.items() if loses]
    if refused and strict:
        raise ValueError(f"columns that would lose values: {', '.join(f'{n} as {wanted[n]}' for n in refused)}")
    return df.withColumns({n: F.col(n).try_cast(kind) for n, kind in wanted.items() if n not in refused})


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail when a column is missing or holds nothing but nulls. Reads the table once."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in required]).first()
    empty = [c for c in required if not filled[c]]
    if empty:
        raise ValueError(f"columns without a value: {empty}")
    return df
