"""Changing stored tables.

A stored table with a date column is kept by month in committed versions (see ``versions``): a change rewrites the months it touches
into new folders, and one small table makes the version. Without a date column it is a catalog table: a rewrite goes to a new folder and
the table is pointed at it afterwards; the folder before the last one is removed. Either way readers see all of a change or nothing of it, new content
is complete on disk before old content goes, and a lost executor only repeats its own files.

An empty input changes nothing in any sink.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.running import first_rows, stacked
from stowage.sources.digests import bucket_digests, only_differing
from stowage.sources.readers import narrowed
from stowage.sources.versions import MONTH, UNDATED, Versions, implied, month_of

NEW = "_stored"
PREVIOUS = "stowage.previous"
# Spark's readers pass over names that begin so.
DIGESTS = "_digests-"


def _beside(new: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    old = stored.select(*keys, *[F.col(f).alias(f"_old_{f}") for f in fields], F.lit(True).alias(NEW))
    return new.join(old, list(keys), "left")


def _differs(field: str) -> Column:
    return ~F.col(field).eqNullSafe(F.col(f"_old_{field}"))


def _compared_fields(new: DataFrame, stored: DataFrame, keys: Sequence[str], exclude: Sequence[str]) -> list[str]:
    return [c for c in new.columns if c in stored.columns and c not in {*keys, *exclude}]


def _changed(new: DataFrame, stored: DataFrame, keys: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """The new and changed rows, beside the stored values of their compared fields."""
    fields = _compared_fields(new, stored, keys, exclude)
    different = F.col(NEW).isNull()
    for f in fields:
        different = different | _differs(f)
    return _beside(new, stored, keys, fields).where(different)


def changed_rows(
    new: DataFrame, stored: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Rows whose key is new or that differ from the stored row in any compared field."""
    return _changed(new, stored, keys, exclude).select(*new.columns)


def _entries(beside: DataFrame, fields: Sequence[str], keys: Sequence[str], as_of: dt.date, reason: str) -> DataFrame:
    entries = [
        F.when(
            F.col(NEW).isNotNull() & _differs(f),
            F.struct(
                F.lit(f).alias("field_name"),
                F.col(f"_old_{f}").cast("string").alias("old_value"),
                F.col(f).cast("string").alias("new_value"),
            ),
        )
        for f in fields
    ]
    return beside.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("_entry")).select(
        *keys, "_entry.*", F.lit(as_of).cast("date").alias("change_date"), F.lit(reason).alias("change_reason")
    )


def change_log(
    new: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    as_of: dt.date,
    monitor: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    reason: str = "Table update",
) -> DataFrame:
    """One row per monitored field that changed on a stored key, with the old and new value as text."""
    fields = _monitored(new, stored, keys, monitor, exclude)
    return _entries(_beside(new, stored, keys, fields), fields, keys, as_of, reason)


def _monitored(new, stored, keys, monitor, exclude) -> list[str]:
    return [f for f in _compared_fields(new, stored, keys, exclude) if monitor is None or f in monitor]


def last_per_key(new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one that sorts last by ``order``, then by all other columns (nulls first)."""
    rest = [c for c in new.columns if c not in {*keys, *order}]
    return first_rows(new, keys, [F.col(c).desc_nulls_last() for c in (*order, *rest)])


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Stored rows with the delivered columns of their new row, and the rows of new keys.

    Columns that ``new`` does not deliver keep their stored value; columns the table lacks are left out.
    Of several new rows of a key the last one counts (``last_per_key``). A null in a key matches a null.
    """
    keys = list(keys)
    delivered = [c for c in new.columns if c in stored.columns and c not in keys]
    fresh = last_per_key(fitted(new, stored.columns), keys, [c for c in order if c in stored.columns])
    here = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in delivered], F.lit(True).alias(NEW))
    there = stored.withColumn("_old", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = there.join(here, same, "full")

    def column(c: str) -> Column:
        if c in keys:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c)
        return (F.when(F.col(NEW), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in delivered else F.col(c)).alias(c)

    return met.select(*[column(c) for c in stored.columns])


def hot_zone_replaced(
    stored: DataFrame, new: DataFrame, date: str, as_of: dt.date, days: int = 180, keys: Sequence[str] = ()
) -> DataFrame:
    """The hot zone is dropped and the new rows are upserted by key into what is left.

    Rows without a date count as old. Keys are needed wherever new rows can be older than the zone: without them
    rows are only added.
    """
    start = F.lit(as_of - dt.timedelta(days=days)).cast("date")
    cold = stored.where(F.coalesce(F.col(date) < start, F.lit(True)))
    if keys:
        return upserted(cold, new, keys)
    return cold.unionByName(fitted(new, stored.columns), allowMissingColumns=True)


def without_blank_rows(df: DataFrame) -> DataFrame:
    """Rows that hold at least one value."""
    return df.na.drop("all")


def fitted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the declared columns that are present, in declared order."""
    return df.select(*[c for c in columns if c in df.columns])


class StoredTable:
    """A table whose files live under ``root``: with ``date`` by that column's month in versions, otherwise a catalog table.

    ``keys`` declares the key that upserts of a table by month look rows up by: a digest of it is kept beside every month. ``keep`` is how long old
    versions stay, besides the last two.
    """

    def __init__(self, spark, name: str, root: str, date: str | None = None, keys: Sequence[str] = (), keep: dt.timedelta = dt.timedelta(days=1)):
        self.spark = spark
        self.name = name
        self.root = root.rstrip("/")
        self.date = date
        self.versions = Versions(spark, self.root, keys, keep) if date else None

    def exists(self) -> bool:
        return bool(self.versions.numbers()) if self.date else self.spark.catalog.tableExists(self.name)

    def read(
        self,
        equals: Mapping[str, object] | None = None,
        columns: Sequence[str] | None = None,
        since: dt.date | None = None,
        until: dt.date | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """S3: the rows, with optional filters (see ``readers.narrowed``), dates (ends included) and columns.

        Conditions on the date column open only the months they can hold in. ``version`` reads an older version of a table by month.
        """
        if not self.date:
            self.spark.catalog.refreshTable(self.name)
            return narrowed(self.spark.table(self.name), equals, columns)
        schema, parts = self.versions.load(version)
        months = implied(self.date, dict(equals or {}), since, until)
        rows = self.versions.rows(schema, [p for p in parts if months.holds(p.month)]).where(months.column())
        day = F.col(self.date).cast("date")
        if since is not None:
            rows = rows.where(day >= F.lit(since))
        if until is not None:
            rows = rows.where(day <= F.lit(until))
        return narrowed(rows.drop(MONTH), equals, columns)

    def _folder(self, kind: str) -> str:
        return f"{self.root}/{kind}-{uuid.uuid4().hex}"

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def digests(self, keys: Sequence[str], fields: Sequence[str], known: DataFrame | None = None) -> DataFrame:
        """Bucket digests (see ``digests``) of a catalog table, kept in its folder; ``known`` are those of the present content, if they are."""
        location, name = self._location(), DIGESTS + "-".join([*keys, "", *fields])
        if name not in self._names(location):
            made = bucket_digests(self.read(), keys, fields) if known is None else known
            made.coalesce(1).write.parquet(f"{location}/{name}")
        return self.spark.read.parquet(f"{location}/{name}")

    def _staged(self, df: DataFrame) -> tuple[DataFrame, str]:
        folder = self._folder("staged")
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder), folder

    def _months(self, df: DataFrame) -> set[str]:
        """Distinct months of rows to write: bounded by the calendar."""
        if self.date not in df.columns:
            return {UNDATED}
        return {r[0] for r in df.select(month_of(self.date)).distinct().collect()}

    def _fitting(self, df: DataFrame) -> DataFrame:
        """The rows to write, in the table's columns."""
        rows = without_blank_rows(df)
        if self.exists():
            rows = fitted(rows, self.versions.load()[0].names if self.date else self.read().columns)
        return rows

    def _incoming(self, df: DataFrame) -> DataFrame | None:
        """The rows to write, in the table's columns; none if there is nothing to write."""
        rows = self._fitting(df)
        return None if rows.isEmpty() else rows

    def _location(self) -> str:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").collect()
        return rows[0]["data_type"]

    def _switch(self, df: DataFrame) -> None:
        """Write all of the table to a new folder and point the table at it, if there is a row."""
        folder = self._folder("rows")
        df.write.parquet(folder)
        if self.spark.read.schema(df.schema).parquet(folder).isEmpty():
            return self._remove(folder)
        if self.exists():
            properties = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}
            current = self._location()
            self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{folder}'")
            self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('{PREVIOUS}' = '{current}')")
            # Readers of the last content may still be at work; what was before it can go.
            if PREVIOUS in properties:
                self._remove(properties[PREVIOUS])
        else:
            self.spark.catalog.createTable(self.name, path=folder, source="parquet")
        self.spark.catalog.refreshTable(self.name)

    def _commit(self, df: DataFrame, replaced: Collection[str] | None = ()) -> None:
        """Make a version in which ``df`` is the whole content of the replaced months (None: of all, if there is a row) and is added to others."""
        start = (self.versions.numbers() or [None])[-1]
        parts = self.versions.load(start)[1] if start is not None else []
        kept = [p for p in parts if replaced is not None and p.month not in replaced]
        written = self.versions.write(df, self.date)
        if not written and replaced is None:
            return
        self.versions.commit(df.schema, kept + written, start)
        self.versions.clean()

    def _in_months(self, months: set[str]) -> DataFrame:
        schema, parts = self.versions.load()
        return self.versions.rows(schema, [p for p in parts if p.month in months]).where(F.col(MONTH).isin(sorted(months))).drop(MONTH)

    def append(self, df: DataFrame) -> None:
        """S9."""
        rows = self._incoming(df)
        if rows is None:
            return
        if self.date and self.exists():
            return self._commit(self._completed(rows))
        if not self.exists():
            return self.overwrite(rows)
        # What was known of the content no longer holds.
        location = self._location()
        for name in self._names(location):
            if name.startswith(DIGESTS):
                self._remove(f"{location}/{name}")
        rows.write.mode("append").format("parquet").option("path", location).saveAsTable(self.name)

    def _completed(self, rows: DataFrame) -> DataFrame:
        """The rows with all columns of the table, in its types."""
        schema, _ = self.versions.load()
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def overwrite(self, df: DataFrame) -> None:
        """S10. The rows are worked out once: whether there are any is seen from what was written."""
        rows = self._fitting(df)
        if self.date:
            return self._commit(self._completed(rows) if self.exists() else rows, None)
        self._switch(rows)

    def upsert(self, df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        """See ``upserted``. Only the months that hold one of the keys, and those the rows go to, are rewritten."""
        rows = self._incoming(df)
        if rows is None:
            return
        if not self.exists():
            return self.overwrite(last_per_key(rows, keys, order))
        if not self.date:
            return self._switch(upserted(self.read(), rows, keys, order))
        schema, parts = self.versions.load()
        touched = self._months(rows) | self.versions.months_of(schema, parts, rows, keys)
        self._commit(self._completed(upserted(self._in_months(touched), rows, keys, order)), touched)

    def regroup(self, df: DataFrame, combine: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ()) -> None:
        """Put rows of a table by month together with the stored rows of their months, and with those that share a key, by ``combine``."""
        rows = self._incoming(df)
        if rows is None:
            return
        if not self.exists():
            return self.overwrite(combine(rows))
        schema, parts = self.versions.load()
        touched = self._months(rows)
        if keys:
            touched |= self.versions.months_of(schema, parts, rows, keys)
        self._commit(self._completed(combine(stacked(self._in_months(touched), self._completed(rows)))), touched)

    def replace_hot_zone(
        self, df: DataFrame, date: str, as_of: dt.date, days: int = 180, keys: Sequence[str] = ()
    ) -> None:
        """See ``hot_zone_replaced``. The months of the zone are known by their names; no row is read to find them."""
        rows = self._incoming(df)
        if rows is None:
            return
        if not self.exists():
            return self.overwrite(last_per_key(rows, keys) if keys else rows)
        if self.date != date:
            whole = hot_zone_replaced(self.read(), rows, date, as_of, days, keys)
            return self._commit(self._completed(whole), None) if self.date else self._switch(whole)
        schema, parts = self.versions.load()
        zone = implied(date, None, as_of - dt.timedelta(days=days), None)
        touched = {p.month for p in parts if zone.holds(p.month)} | self._months(rows)
        if keys:
            touched |= self.versions.months_of(schema, [p for p in parts if p.month not in touched], rows, keys)
        self._commit(self._completed(hot_zone_replaced(self._in_months(touched), rows, date, as_of, days, keys)), touched)

    def write_changes(
        self,
        df: DataFrame,
        keys: Sequence[str],
        as_of: dt.date,
        log: StoredTable | None = None,
        monitor: Sequence[str] | None = None,
        exclude: Sequence[str] = (),
        dry_run: bool = False,
        reason: str = "Table update",
    ) -> tuple[DataFrame | None, DataFrame | None]:
        """Upsert what changed, then append the log; a dry run only returns both.

        Changes are compared once, in a catalog table only where bucket digests differ, and staged. What a dry run returns reads the staged rows; a run that writes removes
        them and returns the changes as (None, None), for they are in the table and its log.
        """
        if not self.exists():
            if not dry_run:
                self.overwrite(df)
            return df, None
        stored = self.read()
        before, now, fields = stored, df, _compared_fields(df, stored, keys, exclude)
        if not self.date:
            before, now, _ = only_differing(stored, df, keys, fields, self.digests(keys, fields))
        staged, folder = self._staged(_changed(now, before, keys, exclude))
        delta = staged.select(*df.columns)
        entries = _entries(staged, _monitored(df, stored, keys, monitor, exclude), keys, as_of, reason)
        if dry_run:
            return delta, entries
        if not delta.isEmpty():
            self.upsert(delta, keys)
            if log is not None:
                log.append(entries)
        self._remove(folder)
        return None, None


def export_csv(df: DataFrame, path: str) -> None:
    """A delta or log as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
