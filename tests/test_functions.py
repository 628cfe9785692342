"""Column expressions against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from checks.views import BASE_TABLES, Tables
from stowage.session import checkpoint_folder, materialised
from stowage.functions import modes, numeric, weeks
from stowage.functions.distribution import describe, described, quantile, smoothed
from stowage.functions.running import dated, first_rows, numbered, stacked


def test_half_even_rounds_ties_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.125,)], "x double")
    row = df.select(numeric.half_even(F.col("x")).alias("a"), numeric.half_even(F.col("x"), 2).alias("b")).collect()
    assert [r.a for r in row] == [2.0, 4.0, -2.0, 0.0]
    assert row[3].b == 0.12


def test_whole_ignores_noise(spark):
    df = spark.createDataFrame([(39.99999999999999,), (39.9,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(numeric.whole(F.col("x"))).collect()] == [40, 39, -1]


def test_inverse_normal_matches_the_library(spark):
    shares = [0.0001, 0.02, 0.3, 0.5, 0.85, 0.8999, 0.95, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in shares], "p double")
    got = [r[0] for r in df.select(numeric.inverse_normal(F.col("p"))).collect()]
    want = [statistics.NormalDist().inv_cdf(p) for p in shares]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12


def test_week_labels_around_new_year(spark):
    dates = [dt.date(2020, 12, 31), dt.date(2021, 1, 3), dt.date(2021, 1, 4), dt.date(2024, 12, 30)]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    rows = df.select(
        "d", weeks.week_label(F.col("d")).alias("label"), weeks.week_number(F.col("d")).alias("number"),
        weeks.history_label(F.col("d")).alias("history"), weeks.monday(F.col("d")).alias("monday"),
    ).select(
        "*", weeks.parse_week(F.col("label")).alias("a"), weeks.parse_week(F.col("number")).alias("b"),
        weeks.parse_week(F.col("history")).alias("c"), weeks.number_to_label(F.col("number")).alias("again"),
    ).collect()
    for r in rows:
        year, week, _ = r.d.isocalendar()
        assert r.label == f"{year}-{week:02d}W" == r.again
        assert r.number == year * 100 + week and r.history == f"{year}-W{week:02d}"
        assert r.a == r.b == r.c == r.monday


def test_unreadable_weeks_are_null(spark):
    df = spark.createDataFrame([("2024-99W",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(weeks.parse_week(F.col("t"))).collect()] == [None, None, None]


def test_mode_codes_and_vendor_types(spark):
    df = spark.createDataFrame(
        [("50 ", 1, "EDIC"), ("55", 99908, "LOCC"), (None, 2, "EXTC"), ("x", 3, "ANY"), ("20", 4, "ACGC")],
        "code string, vendor int, kind string",
    )
    rows = df.select(
        modes.mode_of_code(F.col("code")).alias("mode"), modes.vendor_type(F.col("kind"), F.col("vendor")).alias("kind")
    ).collect()
    assert [r.mode for r in rows] == ["Air", "Courier", "Truck", "Truck", "Vessel"]
    assert [r.kind for r in rows] == [
        "OVERSEA_DC", "INTERNAL", "OVERSEA_EXTERNAL", "DOMESTIC_EXTERNAL", "OVERSEA_EXTERNAL",
    ]


def test_mode_table_defaults(spark):
    for m in modes.MODES:
        expected = m.low + 7 if math.isinf(m.high) else (m.low + m.high) // 2
        assert m.default_days == expected
    assert modes.mode_table(spark).count() == 11


def test_numbering_one_group_that_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [("hot", f"2024-01-{rng.randint(1, 28):02d}", i) for i in range(3000)] + [("cold", None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, d string, i int").withColumn("d", F.col("d").cast("date"))
    got = numbered(df, ["k"], dated("d"), [F.col("i")], "n", "size").collect()
    hot = sorted((r for r in got if r.k == "hot"), key=lambda r: (r.d, r.i))
    assert [r.n for r in hot] == list(range(1, 3001)) and {r.size for r in hot} == {3000}
    assert sorted(r.n for r in got if r.k == "cold") == [1, 2, 3, 4, 5]


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    first = first_rows(df, ["k"], [F.col("id")])
    assert sorted((r.k, r.id) for r in first.collect()) == [(0, 0), (1, 1), (2, 2)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    # Once on every map task, once after the shuffle.
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2


def test_describe_and_smoothing_against_python(spark):
    rng = random.Random(5)
    values = [(g, rng.randint(1, 30), rng.randint(0, 12)) for g in ("a", "b") for _ in range(400)] + [("c", 1, 7)]
    df = spark.createDataFrame(values, "g string, d int, v int")
    stats = {r.g: r for r in describe(df, ["g"], "v", {"p60": 0.6, "p90": 0.9}).collect()}
    recent = {r.g: r.s for r in smoothed(df, ["g"], "d", "v", 0.3, "s").collect()}
    for g in "abc":
        mine = sorted(v for k, _, v in values if k == g)
        place = 0.6 * (len(mine) - 1)
        low, high = mine[math.floor(place)], mine[math.ceil(place)]
        assert stats[g].p60 == pytest.approx(low + (high - low) * (place - math.floor(place)))
        assert stats[g]["mean"] == pytest.approx(statistics.mean(mine)) and stats[g].samples == len(mine)
        counts = {v: mine.count(v) for v in set(mine)}
        assert stats[g].typical == min(v for v in counts if counts[v] == max(counts.values()))
        s = None
        for _, v in sorted((d, v) for k, d, v in values if k == g):
            s = v if s is None else 0.3 * v + 0.7 * s
        assert recent[g] == pytest.approx(s)
    assert stats["c"].std is None and stats["a"].std == pytest.approx(statistics.stdev([v for k, _, v in values if k == "a"]))


def test_described_is_describe_and_smoothed_without_group_buffers(spark):
    rng = random.Random(8)
    values = [(g, rng.choice([None, *range(1, 30)]), rng.choice([None, *range(12)])) for g in ("a", "b", None) for _ in range(200)] + [("c", 1, 7), ("d", 1, None)]
    df = spark.createDataFrame(values, "g string, d int, v int")
    both = described(df, ["g"], "d", "v", {"p60": 0.6, "p90": 0.9}, 0.3)
    assert "ObjectHashAggregate" not in both._jdf.queryExecution().executedPlan().toString()
    stats = {r.g: r for r in describe(df, ["g"], "v", {"p60": 0.6, "p90": 0.9}).collect()}
    recent = {r.g: r.s for r in smoothed(df, ["g"], "d", "v", 0.3, "s").collect()}
    found = {r.g: r for r in both.collect()}
    assert found.keys() == stats.keys() == {"a", "b", "c", None}
    for g, r in found.items():
        assert (r.samples, r.typical, r.p60, r.p90) == (stats[g].samples, stats[g].typical, pytest.approx(stats[g].p60), pytest.approx(stats[g].p90))
        assert r.mean == pytest.approx(stats[g]["mean"]) and r.recent == pytest.approx(recent[g])
        assert r.std == (None if stats[g].std is None else pytest.approx(stats[g].std))


def test_statistics_sort_a_group_by_value_and_by_date_only(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 5)], "g string, d int, v int")
    plan = described(df, ["g"], "d", "v", {"p60": 0.6}, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2
    plan = quantile(df, ["g"], "v", 0.9, "q")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_tables_derived_from_stored_lines_are_the_same(spark, tmp_path):
    day = dt.datetime(1996, 1, 2)
    rows = {
        "orders": ([(k, k % 3, "O", 1.0, day, "1-URGENT") for k in range(6)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (
            [(k % 6, k % 4, k % 5, k % 3, float(k), 2.0 * k, 0.0, 0.1, "ANR"[k % 3], "FO"[k % 2], day) for k in range(40)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
        "part": ([(k, "n", f"B{k}", "T", k, 3.0) for k in range(4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    }
    for name in BASE_TABLES:
        data, schema = rows.get(name, ([], "unused int"))
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("po_delivery", "po_in_transit", "item_warehouse", "freight", "lines")
    plain, stored = Tables(spark, str(tmp_path)), Tables(spark, str(tmp_path))
    stored.store("lines")
    for name in names:
        before, after = getattr(plain, name), getattr(stored, name)
        assert before.dtypes == after.dtypes and before.count() > 0
        assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    plan = stored.po_delivery._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "SortMergeJoin" not in plan


def test_sessions_bound_tasks_and_methods(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"


def test_grouping_over_a_union_counts_every_row(spark):
    left = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    counted = left.join(left.groupBy("k").count(), "k")
    both = stacked(counted, counted.withColumn("k", F.col("k") + 25))
    got = {r.k: r["count"] for r in both.groupBy("k").count().collect()}
    assert sum(got.values()) == 2000 and got[30] == 40 and got[0] == 20


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    assert checkpoint_folder("hdfs://store/x", "yarn") == "hdfs://store/x"
    assert checkpoint_folder(None, "local[2]")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_folder(None, master)


def test_statistics_of_a_group_take_two_windows(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in ((1, 3), (1, 5), (2, 3), (3, 9), (4, 5))], "k string, day date, v int")
    spread = described(rows, ["k"], "day", "v", {"p60": 0.6, "p90": 0.9}, 0.5)
    assert spread._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    (row,) = spread.collect()
    assert (row.samples, row.mean, row.typical, row.p60) == (5, 5.0, 3.0, 5.0) and abs(row.p90 - 7.4) < 1e-9 and row.recent == 0.5 * 5 + 0.25 * 9 + 0.125 * 3 + 0.0625 * 5 + 0.0625 * 3


def test_shuffle_files_go_with_their_job(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))
    before = held()
    stored = materialised(spark.range(400000).groupBy((F.col("id") % 300000).alias("k")).agg(F.sum("id").alias("s")))
    assert stored.count() == 300000
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
