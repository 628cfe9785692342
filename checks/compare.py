"""Run registered queries beside their SQL and report differences: ``python -m checks.compare FOLDER [NAME...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import all_queries
from checks.registry import QUERIES, oracles
from checks.views import BASE_TABLES


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, sql: str | None) -> str | None:
    """None when both sides agree, else what differs."""
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got == want:
        kinds = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
        spark_kinds = dict(df.dtypes)
        pairs = {
            "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "date": "DATE",
            "boolean": "BOOLEAN",
        }
        wrong = {c: (spark_kinds[c], kinds[c]) for c in names if pairs.get(spark_kinds[c]) != kinds[c]}
        if wrong:
            return f"types {wrong}"
        return None if got else "no rows on either side"
    missing, extra = want - got, got - want
    head = f"{sum(got.values())} rows against {sum(want.values())}; {sum(missing.values())} missing"
    return f"{head}\n   columns {sorted(names)}\n   wanted {sorted(missing, key=str)[:3]}\n   got    {sorted(extra, key=str)[:3]}"


def main() -> int:
    folder, chosen = sys.argv[1], sys.argv[2:]
    all_queries.load()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    texts, failed = oracles(), 0
    names = [n for n in QUERIES if not chosen or any(n.startswith(c) for c in chosen)]
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, texts.get(name))
        except Exception as error:  # noqa: BLE001 - reported and counted
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        note = "" if name in texts else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s", flush=True)
        if problem:
            failed += 1
            print(f"   {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
