"""Committed versions of a table that is kept by month.

A write puts the new content of its months into a folder of its own and never touches one that is there. A version is a small table that names, for
every month, the folders that hold it; it counts once Spark has committed it, so readers see all of a change or nothing of it, and a version stays
readable while the next is written. Old versions go by age, and with them the folders that only they name.

    parts/_write=<id>/_month=2024-05/...   rows
    keys/_write=<id>/_month=2024-05/...    digests of the rows' keys, sorted, if the table has declared keys
    versions/00000012/...                  month, folder, least and greatest value of the first key

One writer at a time: of two that start from the same version, the second to commit fails.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "_month"
WRITE = "_write"
DIGEST = "_digest"
# Rows without a date, and rows whose year has not four digits; the latter are part of any range of dates.
UNDATED, BEYOND = "none", "other"
COMMITTED = "_SUCCESS"
MANIFEST = "month string, write string, least string, greatest string, keyless boolean, schema string"


class Part(NamedTuple):
    """The rows of a month that one write put there; least, greatest and keyless (a null is among them) are of the first key."""

    month: str
    write: str
    least: str | None = None
    greatest: str | None = None
    keyless: bool | None = None


def month_of(date: str) -> Column:
    day = F.col(date).cast("date")
    plain = F.year(day).between(1, 9999)
    return F.when(day.isNull(), UNDATED).when(plain, F.date_format(day, "yyyy-MM")).otherwise(BEYOND)


class Months(NamedTuple):
    """The months that a condition on the date can hold in: a list, or all from one to another."""

    chosen: frozenset[str] | None = None
    first: str | None = None
    last: str | None = None

    def holds(self, month: str) -> bool:
        if self.chosen is not None and month not in self.chosen:
            return False
        if self.first is None and self.last is None or month == BEYOND:
            return True
        return month != UNDATED and (self.first or "") <= month <= (self.last or "9999-99")

    def column(self) -> Column:
        out = F.lit(True)
        if self.chosen is not None:
            out = F.col(MONTH).isin(sorted(self.chosen))
        if self.first is not None or self.last is not None:
            inside = F.col(MONTH) != UNDATED
            if self.first is not None:
                inside = inside & (F.col(MONTH) >= self.first)
            if self.last is not None:
                inside = inside & (F.col(MONTH) <= self.last)
            out = out & ((F.col(MONTH) == BEYOND) | inside)
        return out


def implied(date: str, equals: dict | None, since: dt.date | None, until: dt.date | None) -> Months:
    """The months that rows can be in if their date is one of ``equals[date]`` and within ``since`` and ``until``."""
    label = lambda d: f"{d.year:04d}-{d.month:02d}"
    wanted = (equals or {}).get(date)
    chosen = None
    if wanted is not None and (not isinstance(wanted, (list, tuple, set)) or wanted):
        values = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        days = [v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v)[:10]) for v in values if v is not None]
        chosen = frozenset(map(label, days))
    return Months(chosen, since and label(since), until and label(until))


class Versions:
    """The versions under a folder. ``keep`` is how long versions stay readable that are not one of the last two."""

    def __init__(self, spark, root: str, keys: Sequence[str] = (), keep: dt.timedelta = dt.timedelta(days=1)):
        self.spark, self.root, self.keys, self.keep = spark, root.rstrip("/"), tuple(keys), keep

    # Folders.
    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _entries(self, folder: str) -> dict[str, float]:
        """Names in a folder with their age in seconds; none if it is not there."""
        files, path = self._path(folder)
        if not files.exists(path):
            return {}
        now = time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in files.listStatus(path)}

    def _remove(self, folder: str) -> None:
        files, path = self._path(folder)
        files.delete(path, True)

    # Versions.
    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        names = sorted(n for n in self._entries(f"{self.root}/versions") if n.isdigit())
        return [int(n) for n in names if COMMITTED in self._entries(f"{self.root}/versions/{n}")]

    def load(self, number: int | None = None) -> tuple[T.StructType, list[Part]]:
        """Schema and parts of a version, by default the last."""
        number = self.numbers()[-1] if number is None else number
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/versions/{number:08d}").collect()
        schema = next(r.schema for r in rows if r.month is None)
        return T.StructType.fromJson(json.loads(schema)), [Part(*r[:5]) for r in rows if r.month is not None]

    def commit(self, schema: T.StructType, parts: Iterable[Part], start: int | None) -> None:
        """Make a version from the parts, if ``start`` is still the last one."""
        numbers = self.numbers()
        if (numbers[-1] if numbers else None) != start:
            raise RuntimeError(f"{self.root} was changed by another writer")
        taken = [int(n) for n in self._entries(f"{self.root}/versions") if n.isdigit()]
        head = (None, None, None, None, None, json.dumps(schema.jsonValue()))
        rows = self.spark.createDataFrame([head, *[(*p, None) for p in parts]], MANIFEST)
        rows.coalesce(1).write.json(f"{self.root}/versions/{max(taken, default=0) + 1:08d}")

    def clean(self) -> None:
        """Remove versions over the age but the last two, and folders of that age that no version names."""
        age, numbers = self.keep.total_seconds(), self.numbers()
        ages = self._entries(f"{self.root}/versions")
        old = [n for n in numbers[:-2] if ages[f"{n:08d}"] >= age]
        named = {(p.write, p.month) for n in numbers if n not in old for p in self.load(n)[1]}
        for n in old:
            self._remove(f"{self.root}/versions/{n:08d}")
        for kind in ("parts", "keys"):
            for write, since in self._entries(f"{self.root}/{kind}").items():
                folder, id_ = f"{self.root}/{kind}/{write}", write.split("=", 1)[-1]
                if since < age:
                    continue
                months = [m for m in self._entries(folder) if m.startswith(f"{MONTH}=")]
                gone = [m for m in months if (id_, m.split("=", 1)[1]) not in named]
                for m in gone:
                    self._remove(f"{folder}/{m}")
                if len(gone) == len(months):
                    self._remove(folder)

    # Rows.
    def rows(self, schema: T.StructType, parts: Sequence[Part]) -> DataFrame:
        """The rows of parts, with their month."""
        full = T.StructType([*schema.fields, T.StructField(WRITE, T.StringType()), T.StructField(MONTH, T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], full).drop(WRITE)
        paths = [f"{self.root}/parts/{WRITE}={p.write}/{MONTH}={p.month}" for p in parts]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/parts").parquet(*paths).drop(WRITE)

    def write(self, df: DataFrame, date: str) -> list[Part]:
        """Store rows by month in a new folder, and the digests of their keys beside them."""
        id_ = uuid.uuid4().hex
        folder = f"{self.root}/parts/{WRITE}={id_}"
        # Rows of a month meet in few tasks, as many as its size asks for: no month is one task, no task writes a file for every month.
        df.withColumn(MONTH, month_of(date)).hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(folder)
        parts = [Part(m.split("=", 1)[1], id_) for m in sorted(self._entries(folder)) if m.startswith(f"{MONTH}=")]
        if not parts:
            self._remove(folder)
        if not parts or not self.keys:
            return parts
        written = self.rows(df.schema, parts)
        written.select(MONTH, digest(self.keys).alias(DIGEST)).hint("rebalance", MONTH).sortWithinPartitions(MONTH, DIGEST).write.partitionBy(MONTH).parquet(f"{self.root}/keys/{WRITE}={id_}")
        first = F.col(self.keys[0])
        bounds = written.groupBy(MONTH).agg(F.min(first).cast("string"), F.max(first).cast("string"), F.max(first.isNull())).collect()
        return [Part(r[0], id_, *r[1:]) for r in bounds]

    def months_of(self, schema: T.StructType, parts: Sequence[Part], rows: DataFrame, keys: Sequence[str]) -> set[str]:
        """The months that hold a key of ``rows``; a null matches a null.

        With declared keys, months whose range of the first key meets none of the rows are left out, then those where no digest is met; what is left is confirmed
        row by row. Without, all months are read.
        """
        wanted = rows.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in keys])
        suspects = list(parts)
        if self.keys and tuple(keys) == self.keys and suspects:
            kind, first = schema[keys[0]].dataType, keys[0]
            low, high, keyless = wanted.agg(F.min(first), F.max(first), F.max(F.col(first).isNull())).first()
            table = self.spark.createDataFrame([(i, *p) for i, p in enumerate(suspects)], "i int, month string, write string, least string, greatest string, keyless boolean")
            meets = (F.col("least").cast(kind) <= F.lit(high).cast(kind)) & (F.col("greatest").cast(kind) >= F.lit(low).cast(kind)) | (F.col("keyless") & F.lit(bool(keyless)))
            near = table.where(F.coalesce(meets, F.lit(False))).select("i").collect()
            suspects = [suspects[r.i] for r in near]
            if suspects:
                paths = [f"{self.root}/keys/{WRITE}={p.write}/{MONTH}={p.month}" for p in suspects]
                stored = self.spark.read.schema(f"{DIGEST} bigint, {WRITE} string, {MONTH} string").option("basePath", f"{self.root}/keys").parquet(*paths)
                met = stored.join(wanted.select(digest(keys).alias(DIGEST)).distinct(), DIGEST, "left_semi")
                found = {tuple(r) for r in met.select(WRITE, MONTH).distinct().collect()}
                suspects = [p for p in suspects if (p.write, p.month) in found]
        if not suspects:
            return set()
        here = wanted.distinct().select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        held = self.rows(schema, suspects).select(MONTH, *keys).join(here, same, "left_semi")
        return {r[0] for r in held.select(MONTH).distinct().collect()}


def digest(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])
