"""Stored tables, change detection and readers on small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stowage.params import ForecastParams
from stowage.sources import readers, tables

D = dt.date.fromisoformat
SCHEMA = "k string, a double, b string, day date"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept")
    yield tables.StoredTable(spark, "kept", str(tmp_path / "kept"))
    spark.sql("DROP TABLE IF EXISTS kept")


def keys(df):
    return sorted(r.k for r in df.collect())


def test_unchanged_row_with_a_null_is_not_new(spark):
    stored = frame(spark, ("x", 1.0, None, None), ("y", 1.0, "t", None))
    new = frame(spark, ("x", 1.0, None, None), ("y", 2.0, None, None), ("z", 1.0, "t", None))
    assert keys(tables.changed_rows(new, stored, ["k"])) == ["y", "z"]
    log = tables.change_log(new, stored, ["k"], D("2024-01-01"))
    assert sorted((r.k, r.field_name, r.old_value, r.new_value) for r in log.collect()) == [
        ("y", "a", "1.0", "2.0"), ("y", "b", "t", None),
    ]


def test_table_life_cycle(spark, table):
    table.append(frame(spark, ("x", 1.0, "t", D("2024-01-01")), (None, None, None, None)))
    table.append(frame(spark, ("y", 1.0, "t", D("2024-05-01"))))
    assert keys(table.read()) == ["x", "y"]
    table.upsert(frame(spark, ("y", 5.0, "t", D("2024-05-01")), ("z", 1.0, "t", D("2024-05-02"))), ["k"])
    assert keys(table.read()) == ["x", "y", "z"] and table.read().where("k = 'y'").first().a == 5.0
    table.replace_hot_zone(frame(spark, ("w", 1.0, "t", D("2024-05-03"))), "day", D("2024-05-10"), 30)
    assert keys(table.read()) == ["w", "x"]
    table.overwrite(frame(spark, ("v", 1.0, "t", None)))
    assert keys(table.read()) == ["v"]


def test_partial_columns_and_repeated_keys(spark):
    stored = frame(spark, ("x", 1.0, "keep", None), ("n", 1.0, "old", None))
    new = spark.createDataFrame([("x", 2.0), ("x", 3.0), ("y", 4.0), ("y", 1.0)], "k string, a double")
    got = tables.upserted(stored, new, ["k"])
    assert sorted((r.k, r.a, r.b) for r in got.collect()) == [("n", 1.0, "old"), ("x", 3.0, "keep"), ("y", 4.0, None)]
    none = tables.upserted(frame(spark, (None, 1.0, "t", None)), new.where("k = 'x'").selectExpr("CAST(NULL AS STRING) AS k", "a"), ["k"])
    assert [(r.k, r.a) for r in none.collect()] == [(None, 3.0)]


def test_rows_behind_the_hot_zone_replace_their_stored_rows(spark):
    stored = frame(spark, ("x", 1.0, "t", D("2001-03-01")), ("y", 1.0, "t", D("2001-08-01")))
    new = frame(spark, ("x", 2.0, "t", D("2001-03-01")), ("z", 2.0, "t", D("2001-08-02")))
    got = tables.hot_zone_replaced(stored, new, "day", D("2001-08-31"), keys=["k"])
    assert sorted((r.k, r.a) for r in got.collect()) == [("x", 2.0), ("z", 2.0)]


def test_an_empty_input_changes_nothing(spark, table):
    empty = frame(spark, ("x", 1.0, "t", None)).where("false")
    table.overwrite(frame(spark, ("x", 1.0, "t", D("2024-01-01"))))
    table.overwrite(empty)
    table.replace_hot_zone(empty, "day", D("2024-01-02"), 30)
    table.upsert(empty, ["k"])
    table.append(empty)
    assert keys(table.read()) == ["x"]


def test_only_touched_months_are_rewritten(spark, tmp_path):
    table = tables.StoredTable(spark, "monthly", str(tmp_path / "monthly"), "day")
    days = {"a": "2024-01-05", "b": "2024-02-05", "c": "2024-03-05", "d": "2024-04-05"}
    table.overwrite(frame(spark, *[(k, 1.0, "t", D(d)) for k, d in days.items()]))

    def files():
        return {month: {f for f in table.read().inputFiles() if f"={month}/" in f} for month in ("2024-01", "2024-02", "2024-03", "2024-04")}

    before = files()
    # The row of February moves to March: both months change, the others do not.
    table.upsert(frame(spark, ("b", 2.0, "t", D("2024-03-09"))), ["k"])
    after = files()
    assert after["2024-01"] == before["2024-01"] and after["2024-04"] == before["2024-04"]
    assert not after["2024-02"] and after["2024-03"] != before["2024-03"] and keys(table.read()) == ["a", "b", "c", "d"]
    table.replace_hot_zone(frame(spark, ("e", 3.0, "t", D("2024-04-06"))), "day", D("2024-04-10"), 7, ["k"])
    last = files()
    assert last["2024-01"] == before["2024-01"] and last["2024-03"] == after["2024-03"]
    assert keys(table.read()) == ["a", "b", "c", "e"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def monthly(spark, tmp_path, keys=("k",), **more):
    return tables.StoredTable(spark, "monthly", str(tmp_path / "monthly"), "day", keys=keys, **more)


DAYS = {"a": "2024-01-05", "b": "2024-02-05", "c": "2024-03-05", "d": "2024-04-05"}


def test_dated_reads_open_their_months(spark, tmp_path):
    table = monthly(spark, tmp_path)
    table.overwrite(frame(spark, *[(k, 1.0, "t", D(d)) for k, d in DAYS.items()], ("n", 1.0, "t", None)))
    df = table.read(since=D("2024-02-05"), until=D("2024-03-04"))
    assert keys(df) == ["b"] and "PartitionFilters: [" in plan_of(df) and "_month" in plan_of(df).split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("_month=")[1][:7] for f in df.inputFiles()} == {"2024-02", "2024-03"}
    assert keys(table.read({"day": [D("2024-04-05"), D("2024-01-06")]})) == ["d"]
    assert len(table.read({"day": D("2024-04-05")}).inputFiles()) == 1
    assert keys(table.read({"k": ["a", "n"]}, ["k"])) == ["a", "n"] and keys(table.read(until=D("2024-01-31"))) == ["a"]
    assert keys(table.read()) == ["a", "b", "c", "d", "n"]


def test_upserts_look_keys_up_in_the_index(spark, tmp_path, monkeypatch):
    rows = [(f"k{i:04d}", 1.0, "t", D("2024-01-01") + dt.timedelta(days=i)) for i in range(360)]
    table = monthly(spark, tmp_path)
    table.overwrite(frame(spark, *rows))
    opened = []
    real = table.versions.rows
    monkeypatch.setattr(table.versions, "rows", lambda schema, parts: opened.append({p.month for p in parts}) or real(schema, parts))
    # One key of February, and a new one: only February's rows are read, and December's, where both go.
    table.upsert(frame(spark, ("k0040", 2.0, "t", D("2024-12-01")), ("k9999", 2.0, "t", D("2024-12-02"))), ["k"])
    assert set().union(*opened) == {"2024-02", "2024-12"}
    want = {r[0]: r for r in rows} | {"k0040": ("k0040", 2.0, "t", D("2024-12-01")), "k9999": ("k9999", 2.0, "t", D("2024-12-02"))}
    assert {r.k: tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    # Keys beyond all ranges open no month but that of the new rows.
    opened.clear()
    table.upsert(frame(spark, ("z", 2.0, "t", D("2024-12-03"))), ["k"])
    assert set().union(*opened) == {"2024-12"}
    # Other keys than the declared ones are looked up in all months, with the same result.
    table.upsert(frame(spark, ("z", 5.0, "t", D("2024-11-03"))), ["k", "b"])
    assert [(r.a, r.day) for r in table.read({"k": "z"}).collect()] == [(5.0, D("2024-11-03"))]


@pytest.mark.parametrize("declared", [(), ("k", "b")])
def test_null_keys_meet_in_other_months(spark, tmp_path, declared):
    table = monthly(spark, tmp_path, declared)
    table.append(frame(spark, (None, 1.0, "t", D("2001-01-05")), ("x", 1.0, None, D("2001-02-05")), ("y", 1.0, "t", None)))
    table.upsert(frame(spark, (None, 9.0, "t", D("2001-03-05")), ("x", 9.0, None, D("2001-02-06")), ("y", 9.0, "t", D("2001-01-01"))), ["k", "b"])
    assert sorted((str(r.k), r.a, str(r.day)) for r in table.read().collect()) == [("None", 9.0, "2001-03-05"), ("x", 9.0, "2001-02-06"), ("y", 9.0, "2001-01-01")]
    table.replace_hot_zone(frame(spark, (None, 7.0, "t", D("2001-06-01"))), "day", D("2001-06-02"), 10, ["k", "b"])
    assert sorted((str(r.k), r.a) for r in table.read().collect()) == [("None", 7.0), ("x", 9.0), ("y", 9.0)]


def test_a_failed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = monthly(spark, tmp_path)
    table.overwrite(frame(spark, *[(k, 1.0, "t", D(d)) for k, d in DAYS.items()]))
    before = sorted(map(tuple, table.read().collect()))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table.versions, "commit", fails)
        with pytest.raises(OSError):
            table.upsert(frame(spark, ("a", 2.0, "t", D("2024-01-05")), ("d", 2.0, "t", D("2024-05-05"))), ["k"])
    assert sorted(map(tuple, table.read().collect())) == before
    # A version that Spark began and did not commit does not count either.
    (tmp_path / "monthly" / "versions" / "00000002").mkdir()
    assert sorted(map(tuple, table.read().collect())) == before
    table.upsert(frame(spark, ("a", 3.0, "t", D("2024-01-05"))), ["k"])
    assert table.versions.numbers() == [1, 3] and table.read({"k": "a"}).first().a == 3.0
    assert table.read(version=1).where("k = 'a'").first().a == 1.0


def test_a_version_is_read_while_the_next_is_written(spark, tmp_path):
    table = monthly(spark, tmp_path)
    table.overwrite(frame(spark, *[(k, 1.0, "t", D(d)) for k, d in DAYS.items()]))
    reader = table.read()
    table.overwrite(frame(spark, ("z", 1.0, "t", D("2024-06-01"))))
    assert keys(reader) == ["a", "b", "c", "d"] and keys(table.read()) == ["z"]
    start = table.versions.numbers()[0]
    with pytest.raises(RuntimeError, match="another writer"):
        table.versions.commit(reader.schema, [], start)


def test_old_versions_go_by_age(spark, tmp_path):
    table = monthly(spark, tmp_path, keep=dt.timedelta(0))
    for i, day in enumerate(["2024-01-01", "2024-02-01", "2024-01-02", "2024-01-03"]):
        table.upsert(frame(spark, ("x", float(i), "t", D(day)), ("stays", 1.0, "t", D("2024-07-01"))) if not i else frame(spark, ("x", float(i), "t", D(day))), ["k"])
    assert table.versions.numbers() == [3, 4]
    folders = {p.relative_to(tmp_path / "monthly" / "parts").as_posix().split("/")[1] for p in (tmp_path / "monthly" / "parts").glob("*/*") if p.is_dir()}
    assert folders == {"_month=2024-01", "_month=2024-07"} and len(list((tmp_path / "monthly" / "parts").glob("*/_month=2024-01"))) == 2
    assert keys(table.read()) == ["stays", "x"] == keys(table.read(version=3)) and table.read({"k": "x"}).first().a == 3.0
    kept = monthly(spark, tmp_path)
    for i in range(3):
        kept.append(frame(spark, (f"n{i}", 1.0, "t", D("2024-08-01"))))
    assert kept.versions.numbers() == [3, 4, 5, 6, 7]


def test_dates_beyond_four_digits_are_kept(spark, tmp_path):
    table = monthly(spark, tmp_path)
    table.append(spark.sql("SELECT 'x' AS k, 1D AS a, 't' AS b, DATE'2024-01-01' + INTERVAL 9000 YEAR AS day UNION ALL SELECT 'y', 1D, 't', DATE'2024-01-01'"))
    assert table.read().count() == 2 and table.read(since=D("2024-02-01")).select("k").collect()[0].k == "x"


def test_old_folders_go(spark, table, tmp_path):
    for value in (1.0, 2.0, 3.0, 4.0):
        table.overwrite(frame(spark, ("x", value, "t", None)))
    assert len(list((tmp_path / "kept").glob("rows-*"))) == 2 and table.read().first().a == 4.0


def test_dry_run_and_unchanged_input_write_nothing(spark, table, tmp_path):
    table.overwrite(frame(spark, ("x", 1.0, "t", None)))
    delta, log = table.write_changes(frame(spark, ("x", 2.0, "t", None)), ["k"], D("2024-01-01"), dry_run=True)
    assert keys(delta) == ["x"] and log.count() == 1 and table.read().first().a == 1.0
    files = sorted(table.read().inputFiles())
    table.write_changes(frame(spark, ("x", 1.0, "t", None)), ["k"], D("2024-01-01"))
    assert sorted(table.read().inputFiles()) == files
    table.write_changes(frame(spark, ("x", 3.0, "t", None)), ["k"], D("2024-01-01"))
    assert table.read().first().a == 3.0 and len(list(tmp_path.glob("kept/staged-*"))) == 1


def test_csv_round_trip(spark, tmp_path):
    source = tmp_path / "places.csv"
    source.write_text('WWHS,WLOC,WDESC\n5, A1 ,"1,2,3"\n5,A2,"4,5,6"\n')
    rows = readers.read_locations_csv(spark, str(source)).collect()
    assert [(r.location, r.description) for r in rows] == [("A1", "1,2,3"), ("A2", "4,5,6")]
    tables.export_csv(frame(spark, ("x", 1.0, "t", None)), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().k == "x"


def test_required_columns(spark):
    df = frame(spark, ("x", None, "t", None))
    assert readers.require_columns(df, ["k", "b"]) is df
    with pytest.raises(ValueError, match="missing"):
        readers.require_columns(df, ["k", "absent"])
    with pytest.raises(ValueError, match="without a value"):
        readers.require_columns(df, ["k", "a"])


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, ("x", 1.0, "t", None), ("y", 2.0, "u", None)).write.parquet(path)
    df = readers.read_parquet(spark, path, {"k": ["x"], "b": None}, ["k", "a"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.collect()[0].a == 1.0 and "ReadSchema: struct<k:string,a:double>" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,x)]" in plan


def test_unknown_parameters_are_rejected():
    with pytest.raises(TypeError):
        ForecastParams(horizon=3)


def test_bucket_digests_see_every_change(spark):
    from stowage.sources import digests

    schema = "k string, a double, b string"
    base = [("x", 1.0, None), ("x", 1.0, None), ("y", None, "t"), (None, 2.0, "u")]

    def differ(rows):
        first, second = (digests.bucket_digests(spark.createDataFrame(r, schema).repartition(3), ["k"], ["a", "b"]) for r in (base, rows))
        return digests.differing_buckets(first, second).count()

    assert differ(base[::-1]) == 0
    # A value that moves to the next column, a repeated row that goes with a pair, a row less.
    for rows in ([("x", 1.0, None)] * 2 + [("y", None, None), (None, 2.0, "u")], [("y", None, "t"), (None, 2.0, "u")], base[:3], [("x", 1.0, "")] + base[1:]):
        assert differ(rows) == 1
    swapped = [("p", "s", None)], [("p", None, "s")]
    a, b = (digests.bucket_digests(spark.createDataFrame(r, "k string, a string, b string"), ["k"], ["a", "b"]) for r in swapped)
    assert digests.differing_buckets(a, b).count() == 1


def snapshot_rows(n, **changed):
    return [(f"p{i}", "1", "i", "5", 100.0, float(changed.get(f"p{i}", 3)), 2.0, 1.0) for i in range(n)]


SNAPSHOT = "ponum string, poline string, item string, warehouse string, PQORD double, PQREC double, PCQTY double, PQTRANSIT double"


def test_a_snapshot_run_joins_only_what_changed(spark, tmp_path, monkeypatch):
    from stowage.plans import intake

    snapshot, log = (tables.StoredTable(spark, f"snap_{n}", str(tmp_path / n)) for n in ("rows", "log"))
    deliveries = spark.createDataFrame([], "ponum string, poline string")
    joined = []
    real = intake.snapshot_events

    def counting(before, now, *rest):
        joined.append((before.count(), now.count()))
        return real(before, now, *rest)

    monkeypatch.setattr(intake, "snapshot_events", counting)
    run = lambda rows, **more: intake.snapshot_run(snapshot, log, spark.createDataFrame(rows, SNAPSHOT), deliveries, D("2024-01-02"), **more)
    try:
        assert run(snapshot_rows(5000)) is None
        assert run(snapshot_rows(5000, p77=9)).count() == 1
        assert run(snapshot_rows(5000, p77=9)).count() == 0
        assert run(snapshot_rows(4999, p77=9)).count() == 1
        # One bucket holds about a third of a row on average.
        assert all(b <= 8 and n <= 8 for b, n in joined) and joined[1] == (0, 0)
        assert sorted((r.ponum, r.event_type, r.qty_delta) for r in log.read().collect()) == [("p4999", "RECEIPT", 1.0), ("p77", "RECEIPT", 6.0)]
        # The log was written, the snapshot was not: the run is repeated and tells nothing twice.
        with monkeypatch.context() as m:
            m.setattr(snapshot, "overwrite", lambda _: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                run(snapshot_rows(4999, p77=9, p5=8))
        run(snapshot_rows(4999, p77=9, p5=8))
        assert log.read().where("ponum = 'p5'").count() == 1 and snapshot.read().where("ponum = 'p5'").first().PQREC == 8.0
    finally:
        spark.sql("DROP TABLE IF EXISTS snap_rows")
        spark.sql("DROP TABLE IF EXISTS snap_log")


def test_digests_go_when_rows_are_added(spark, table):
    table.overwrite(frame(spark, ("x", 1.0, "t", None)))
    assert table.digests(["k"], ["a"]).count() == 1
    table.append(frame(spark, ("y", 1.0, "t", None)))
    assert table.digests(["k"], ["a"]).agg({"n": "sum"}).first()[0] == 2 and table.read().count() == 2
    table.write_changes(frame(spark, ("x", 1.0, "t", None), ("y", 2.0, "t", None)), ["k"], D("2024-01-01"))
    assert sorted((r.k, r.a) for r in table.read().collect()) == [("x", 1.0), ("y", 2.0)]


def test_narrowing_refuses_lossy_columns_by_name(spark):
    df = spark.createDataFrame([(1.0, 1.5, "7", None), (2.0, 2.0, "08", None), (None, None, None, None)], "a double, b double, c string, d double")
    got = readers.narrow_types(df, {"a": "int", "d": "bigint", "absent": "int"})
    assert got.dtypes == [("a", "int"), ("b", "double"), ("c", "string"), ("d", "bigint")] and [r.a for r in got.collect()] == [1, 2, None]
    with pytest.raises(ValueError, match="b as int, c as int"):
        readers.narrow_types(df, {"a": "int", "b": "int", "c": "int"})
    kept = readers.narrow_types(df, {"a": "smallint", "b": "int", "c": "int"}, strict=False)
    assert kept.dtypes == [("a", "smallint"), ("b", "double"), ("c", "string"), ("d", "double")]
    large = spark.createDataFrame([(3e10,)], "a double")
    assert readers.narrow_types(large, {"a": "int"}, strict=False).dtypes == [("a", "double")]
    assert readers.narrow_types(large, {"a": "bigint"}).first().a == 30_000_000_000


def test_an_overwrite_works_its_input_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, dt.date(2024, 1 + i % 3, 1)) for i in range(90)], "k int, day date").mapInArrow(counted, "k int, day date")
    grouped = rows.groupBy("day").agg(F.count("k").alias("n"))
    for name, date in (("once_whole", None), ("once_by_month", "day")):
        table = tables.StoredTable(spark, name, str(tmp_path / name), date)
        try:
            before = seen.value
            table.overwrite(grouped)
            assert seen.value - before == 90
            # An empty input changes nothing, and leaves nothing behind.
            table.overwrite(grouped.where("n < 0"))
            assert sorted(r.n for r in table.read().collect()) == [30, 30, 30]
            folders = [p.name for p in (tmp_path / name / "parts" if date else tmp_path / name).iterdir() if not p.name.startswith(".")]
            assert len(folders) == 1
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
