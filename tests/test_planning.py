"""Hand-made demand: classes, models, safety stock, orders, and the invariants of the chain."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stowage.operators import classify, demand, evaluate, forecast, layout, mrp, projection, safety
from stowage.params import ClassifierParams, ForecastParams, OrderParams, SeriesParams
from stowage.plans.planning import plan_orders

AS_OF = dt.date(2024, 6, 5)
MONDAY = dt.date(2024, 6, 3)
WEEK = dt.timedelta(days=7)


def series(spark, values: dict[str, list[float]]):
    rows = [
        (item, "5", MONDAY - WEEK * (len(v) - 1 - i), float(x)) for item, v in values.items() for i, x in enumerate(v) if x or i == 0
    ]
    weekly = spark.createDataFrame(rows, "item string, warehouse string, week_start date, qty double")
    return demand.fill_weeks(weekly, AS_OF)


def metrics(spark, values, **params):
    prepared = classify.prepare_series(series(spark, values))
    return classify.series_metrics(prepared, params=ClassifierParams(**params))


def test_filled_series_has_no_gap(spark):
    filled = series(spark, {"a": [1, 0, 0, 2, 0, 3, 0, 0]}).orderBy("week_start").collect()
    assert [r.qty for r in filled] == [1, 0, 0, 2, 0, 3, 0, 0]
    assert all(b.week_start - a.week_start == WEEK for a, b in zip(filled, filled[1:])) and filled[-1].week_start == MONDAY


def test_demand_types(spark):
    values = {
        "new": [3, 0, 2, 1, 4], "single": [4] + [0] * 70, "sparse": [4, 0, 0, 0, 0, 0, 0, 0, 0, 5, 0, 0],
        "steady": [10, 11, 9, 10, 12, 10, 9, 11, 10, 10, 11, 9],
        "season": [40, 0, 0, 1] * 8,
    }
    got = {r.item: r for r in classify.classify(metrics(spark, values)).collect()}
    assert got["new"].demand_type == "New Item" and got["single"].demand_type == "Single Demand"
    assert got["single"].activity_level == "Dormant" and got["steady"].activity_level == "Active"
    assert got["sparse"].demand_type == "Intermittent Demand" and got["steady"].demand_type == "Steady Demand"
    assert got["new"].trend_slope is None and got["new"].seasonal_strength is None


def test_decomposition_of_a_line_and_of_a_period(spark):
    got = {r.item: r for r in metrics(spark, {"line": range(1, 41), "wave": [9, 1, 5, 1] * 6, "flat": [5] * 16}).collect()}
    # The top of the line is clipped at its own 95th percentile, which bends only the end.
    assert got["line"].trend_slope == pytest.approx(1.0, abs=0.06) and got["flat"].seasonal_strength == 0.0
    assert got["wave"].seasonal_strength == pytest.approx(statistics.mean(abs(v - 4) for v in (9, 1, 5, 1)))
    literal = metrics(spark, {"line": range(1, 41)}, decompose=False).first()
    assert literal.trend_slope is None and literal.seasonal_strength is None


def test_short_cuts(spark):
    master = spark.createDataFrame(
        [("old", "5", "Y", 0), ("kept", "5", None, 4), ("gone", "5", None, 0), ("live", "5", None, 0)],
        "item string, warehouse string, rpflag string, safety int",
    )
    got = {r.item: r for r in classify.classify_items(master, metrics(spark, {"live": [5] * 20, "old": [5] * 20})).collect()}
    assert set(got) == {"old", "kept", "live"}
    assert (got["old"].demand_type, got["old"].activity_level, got["old"].zero_ratio) == ("Replaced", "Dormant", 1.0)
    assert got["kept"].demand_type == "Stock Only" and got["live"].demand_type == "Steady Demand"


def test_croston_by_hand(spark):
    row = metrics(spark, {"a": [0.5, 0, 4, 0, 0, 0, 2, 0, 6]}).first()
    sizes, gaps = [0.5, 4, 2, 6], [1, 2, 4, 2]
    top = sorted([0.5, 0, 4, 0, 0, 0, 2, 0, 6])
    limit = top[7] + (top[8] - top[7]) * (0.95 * 8 - 7)
    z = p = None
    for x, g in zip(sizes, gaps):
        x = min(x, limit)
        z, p = (x, g) if z is None else (0.1 * x + 0.9 * z, 0.1 * g + 0.9 * p)
    assert row.croston_size == pytest.approx(z) and row.croston_interval == pytest.approx(p)


def test_steady_level_is_the_limit_of_the_bootstrap(spark):
    values = [3, 9, 1, 7, 7, 2, 8, 5, 5, 6, 4, 10]
    row = metrics(spark, {"a": values}).first()
    weights = [0.9 ** (len(values) - 1 - i) for i in range(len(values))]
    total, share = sum(weights), 0.0
    for x, w in sorted(zip(values, weights)):
        share += w / total
        if share >= 0.6:
            break
    assert row.steady_level == pytest.approx(min(x, 10))


def test_forecast_packing_and_forced_models(spark):
    m = metrics(spark, {"a": [2.0] * 20})
    packed = forecast.forecast(classify.classify(m)).first()
    assert packed.model == "Steady Demand" and packed.forecast_monthly == 8.0 and len(packed.forecast) == 12
    assert packed.forecast_json == "[" + ",".join(["2.0"] * 12) + "]"
    both = [forecast.forecast_with(m, name).first() for name in ("burst", "Burst Demand")]
    assert both[0].forecast == both[1].forecast and both[0].model == "Burst Demand"
    empty = m.withColumn("weeks", F.lit(None).cast("long"))
    assert forecast.forecast_with(empty, "STEADY").first().model == "empty"


def test_service_level_bounds(spark):
    df = spark.createDataFrame([(100.0, 30, 1.0), (None, 30, 1.0), (100.0, None, 1.0), (100.0, 30, float("inf")), (0.0, 30, 1.0)],
                               "cost double, lead int, cv double")
    got = [r[0] for r in df.select(safety.service_level(F.col("cost"), F.col("lead"), F.col("cv"))).collect()]
    raw = math.log1p(30) / math.log1p(360) / math.log1p(100)
    assert got[0] == round(0.85 + 0.1 / (1 + math.exp(-raw)), 4) and got[1:] == [0.85] * 4


def planned_row(spark, forecasts, **fields):
    base = dict(item="a", warehouse="5", demand_type="Steady Demand", activity_level="Active", safety=0.0, lead_days=14, moq=1, lot=1,
                vendor="V", available=0.0, in_transit=0.0, dynamic_safety=0.0, final_safety=0.0, service_level=0.9)
    row = {**base, **fields, "forecast": forecasts}
    return spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'array<double>' if k == 'forecast' else 'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for k, v in row.items()
    ))


def test_forecast_beyond_the_horizon_repeats_its_last_value(spark):
    row = mrp.static_orders(planned_row(spark, [1.0, 2.0], lead_days=28)).first()
    assert row.forecast_in_lead == 1 + 2 + 2 + 2 and row.recommended_qty == 7


def test_half_even_weeks_and_quantities(spark):
    # 17.5 days are 2.5 weeks and 24.5 days 3.5 weeks: both go to the even side.
    weeks = spark.createDataFrame([(17.5,), (24.5,)], "d double").select(mrp.static_weeks(F.col("d"))).collect()
    assert [r[0] for r in weeks] == [2, 4]
    assert mrp.static_orders(planned_row(spark, [2.5] * 12, lead_days=7)).first().recommended_qty == 2
    assert mrp.static_orders(planned_row(spark, [3.5] * 12, lead_days=7)).first().recommended_qty == 4


def test_order_reasons(spark):
    idle = dict(activity_level="Dormant", forecasts=[0.0] * 12)

    def reason(forecasts, **fields):
        return mrp.static_orders(planned_row(spark, forecasts, **fields), OrderParams(include_zero=True)).first().order_reason

    assert reason([5.0] * 12, available=1.0, in_transit=2.0) == "Replenish & On-Demand"
    assert reason([5.0] * 12, available=2.0, in_transit=1.0) == "Replenish"
    assert reason(idle["forecasts"], activity_level="Dormant", final_safety=3.0) == "SafetyStockTopUp"
    assert reason([1.0] * 12, activity_level="Dormant", available=-3.0, in_transit=-4.0) == "On-Demand"
    assert reason([0.0] * 12, available=5.0) is None


def test_parent_demand_goes_to_the_smallest_child(spark):
    weekly = spark.createDataFrame(
        [("p", "5", MONDAY, 2.0), ("c1", "5", MONDAY, 3.0), ("c2", "5", MONDAY, 4.0)], "item string, warehouse string, week_start date, qty double"
    )
    links = spark.createDataFrame([("p", "c2", "1", "Y"), ("p", "c1", "1", "Y"), ("p", "c0", "1", "N")],
                                  "parent string, child string, type string, using_existing string")
    got = {r.item: r.qty for r in demand.merge_parent_demand(weekly, links, weekly.select("item", "warehouse")).collect()}
    assert got == {"c1": 5.0, "c2": 4.0}


def test_stored_forecasts_fall_back_to_the_series(spark):
    table = spark.createDataFrame([("a", "5", "[1.0,2.0,3.0,4.0,5.0]", None, "m"), ("b", "5", None, 7.0, "m")],
                                  "item string, warehouse string, forecast_json string, forecast_monthly double, model string")
    got = {r.item: r for r in demand.stored_forecasts(table, table).collect()}
    assert got["a"].forecast_monthly == 10.0 and got["b"].forecast == [] and got["b"].forecast_monthly == 7.0


def test_projection_ends_at_opening_plus_changes(spark):
    arrivals = spark.createDataFrame([("a", "5", MONDAY + WEEK, 10.0), ("a", "5", MONDAY - WEEK, 99.0)],
                                     "item string, warehouse string, eta_date date, qty double")
    forecasts = spark.createDataFrame([("a", "5", [2.0] * 12), ("z", "5", [0.0] * 12)], "item string, warehouse string, forecast_rounded array<double>")
    stock = spark.createDataFrame([("a", "5", 7.0)], "item string, warehouse string, available double")
    moves = projection.virtual_transactions(arrivals, forecasts, AS_OF)
    rows = projection.projected_stock(stock, moves).orderBy("week_start", "change_type").collect()
    assert {r.item for r in rows} == {"a"} and rows[-1].projected == 7 + 10 - 24
    assert len(projection.virtual_transactions(arrivals, forecasts, AS_OF, drop_overdue=False).collect()) == 14


def test_plan_keeps_every_key_once_per_algorithm(spark):
    weekly = series(spark, {"a": [5] * 30, "b": [4, 0] * 15}).where("qty > 0")
    items = spark.createDataFrame([("a", 10.0, "V", None), ("b", 5.0, "V", None)], "item string, cost double, vendor string, rpflag string")
    iw = spark.createDataFrame([("a", "5", 14, 1, 5, 0), ("b", "5", 21, 1, 5, 0)], "item string, warehouse string, lead_days int, moq int, lot int, safety int")
    links = spark.createDataFrame([], "parent string, child string, type string, qty double, using_existing string")
    stock = spark.createDataFrame([("a", "5", 0.0, 0.0)], "item string, warehouse string, available double, on_order double")
    leads = spark.createDataFrame([("a", "5", 30.0, "Air")], "item string, warehouse string, p60_lead double, mode string")
    got = plan_orders(weekly, items, iw, links, stock, AS_OF, leads).collect()
    assert sorted((r.item, r.algorithm) for r in got) == [("a", "Dynamic"), ("a", "Static"), ("b", "Static")]
    smart = plan_orders(weekly, items, iw, links, stock, AS_OF, leads, dynamic_safety=True).collect()
    assert {r.item for r in smart} == {"a", "b"}


def test_report_levels(spark):
    rows = spark.createDataFrame(
        [("a", "5", 10.0, 8.0, 0.25, 0.8, "Y", "Steady Demand", "Active"), ("b", "5", 0.0, 2.0, None, 0.4, "N", "New Item", "Active")],
        "item string, warehouse string, actual double, predicted double, ape double, score double, covered string, demand_type string, activity_level string",
    )
    got = {(r.level, r.group_name): r for r in evaluate.forecast_report(rows).collect()}
    assert set(got) == {("Overall", "All"), ("DemandType", "Steady Demand"), ("ActivityLevel", "Active")}
    assert got[("Overall", "All")].bias == -0.2 and got[("Overall", "All")].rmse == 2.0
    assert evaluate.forecast_report(rows, ignore_inactive=False).where("level = 'Overall'").first()["items"] == 2


def test_consecutive_picks_grow_with_the_lines(spark):
    lines = spark.createDataFrame([("o", str(i), f"i{i % 3}") for i in range(1, 101)], "lord string, lline string, item string")
    got = layout.consecutive_picks(lines).collect()
    assert sum(r.co_occurrence for r in got) == 99 and all(r.item_a < r.item_b for r in got)


def plain_pairs(lines, count):
    orders, pairs = defaultdict(set), Counter()
    for lord, item in lines:
        if lord is not None and item is not None:
            orders[lord].add(item)
    for held in orders.values():
        pairs.update(combinations(sorted(held), 2))
    return sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda r: (-r[2], r[0], r[1]))[:count]


def test_frequent_pairs_with_one_large_order(spark):
    lines = [("large", f"i{i:04d}") for i in range(5000)]
    # Some thirty orders share the same few items, so that the bound is far above 1.
    lines += [(f"o{k}", f"i{(k * 7 + j * j) % 40:04d}") for k in range(400) for j in range(6)]
    lines += [("o1", "i0001")] * 3 + [(None, "i0001"), ("o2", None)]
    df = spark.createDataFrame(lines, "lord string, item string").repartition(6)
    trials = []
    real = layout._pair_counts
    layout._pair_counts = lambda picks: trials.append(picks.select("item").distinct().count()) or real(picks)
    try:
        got = [tuple(r) for r in layout.frequent_pairs(df).collect()]
    finally:
        layout._pair_counts = real
    assert got == plain_pairs(lines, 100)
    # Pairs are only built of items that can be in one of the hundred.
    assert trials and max(trials) <= layout.FIRST_ITEMS


def test_frequent_pairs_with_ties_and_few_rows(spark):
    lines = [(f"o{k}", f"i{(k + j) % 900}") for k in range(900) for j in range(3)]
    df = spark.createDataFrame(lines, "lord string, item string")
    assert [tuple(r) for r in layout.frequent_pairs(df, 50).collect()] == plain_pairs(lines, 50)
    assert layout.frequent_pairs(df.where("false")).collect() == []
    assert [tuple(r) for r in layout.frequent_pairs(df.where("lord = 'o1'")).collect()] == plain_pairs(lines[3:6], 100)


def test_run_metrics_equal_those_of_filled_weeks(spark):
    rng = random.Random(11)
    values = {"one": [3.0], "two": [3.0, 0.0], "four": [1.0, 0.0, 0.0, 2.0], "flat": [5.0] * 9, "idle": [2.0] + [0.0] * 200, "five": [1.0, 2.0, 0.0, 4.0, 8.0]}
    for k in range(60):
        n, share = rng.randrange(1, 330), rng.choice([0.02, 0.3, 0.8, 1.0])
        values[f"r{k}"] = [float(rng.choice([1, 2, 5, 40, -3 if k % 7 == 0 else 7])) if rng.random() < share or i == 0 else 0.0 for i in range(n)]
    values["below"] = [-4.0 if i % 2 else 0.0 for i in range(60)]
    rows = [(item, "5", MONDAY - WEEK * (len(v) - 1 - i), x) for item, v in values.items() for i, x in enumerate(v) if x or i == 0]
    weekly = spark.createDataFrame(rows, "item string, warehouse string, week_start date, qty double").cache()
    for series_params, models in ((SeriesParams(), ForecastParams()), (SeriesParams(decay=1.0, winsor_upper=None), ForecastParams(seasonal_baseline_weeks=3, steady_quantile=0.9))):
        want = classify.series_metrics(classify.prepare_series(demand.fill_weeks(weekly, AS_OF), params=series_params), models=models)
        got = classify.run_metrics(classify.run_lengths(weekly, AS_OF, params=series_params), series=series_params, models=models)
        assert got.dtypes == want.dtypes
        there = {r.item: r.asDict() for r in want.collect()}
        for r in got.collect():
            w = there.pop(r.item)
            for name, value in r.asDict().items():
                if name == "week_means":
                    assert value == pytest.approx(w[name]), (r.item, name)
                elif isinstance(value, float):
                    assert value == pytest.approx(w[name], abs=1e-7), (r.item, name)
                else:
                    assert value == w[name], (r.item, name)
        assert not there
    plan = classify.run_metrics(classify.run_lengths(weekly, AS_OF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_user_models_send_only_their_keys_to_python(spark):
    values = {"rising": [1.0] * 34 + [100.0 * k for k in range(1, 7)], "even": [10.0, 12.0] * 15, "gone": [4.0] + [0.0] * 60}
    weeks = classify.prepare_series(series(spark, values))
    classified = classify.classify(classify.series_metrics(weeks))
    kinds_ = {r.item: r.demand_type for r in classified.collect()}
    assert kinds_ == {"rising": "Trended Demand", "even": "Steady Demand", "gone": "Single Demand"}

    def last_but(rows, p):
        assert rows.num_rows == 40 and rows.column("week_start").to_pylist() == sorted(rows.column("week_start").to_pylist())
        return [rows.column("demand").to_pylist()[-1] + k for k in range(p.horizon_weeks)]

    models = {"Trended Demand": forecast.GroupedModel(last_but), "Single Demand": forecast.GroupedModel(lambda *_: 1 / 0)}
    got = {r.item: r for r in forecast.forecast(classified, models=models, series=weeks).collect()}
    # The user's model, the built-in one, and a cold start that no model is asked about.
    assert got["rising"].forecast[2] == got["rising"].forecast[0] + 2 and set(got["even"].forecast) == {12.0} and set(got["gone"].forecast) == {0.0}
    plain = forecast.forecast(classified)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plain and "Python" not in plain
    with pytest.raises(ValueError, match="need the series"):
        forecast.forecast(classified, models=models)
    forced = forecast.forecast_with(classified.where("item = 'even'"), "twice", models={"Twice Demand": lambda p: forecast.flat(F.lit(2.0), p.horizon_weeks)})
    assert forced.first().forecast == [2.0] * 12
    with pytest.raises(Exception, match="gives 1 values for 12 weeks"):
        forecast.forecast_with(classified.where("item = 'even'"), "Trended Demand", models={"Trended Demand": forecast.GroupedModel(lambda *_: [1.0])}, series=weeks).collect()


def test_week_means_bind_what_depends_on_the_key_alone(spark):
    # Three calendar look-ups a key; inside the lambda over the weeks there would be several for each of the 53.
    assert str(classify._week_means()).count("make_date") == 3


@pytest.mark.parametrize("largest", [3, 12])
def test_frequent_pairs_of_large_and_small_orders(spark, monkeypatch, largest):
    """Large orders as bits, others by their pairs: together what plain counting gives."""
    rng = random.Random(largest)
    for name, value in (("LARGE_ITEMS", largest), ("LARGE_SHARE", 20), ("FIRST_ITEMS", 4), ("BLOCKS", 3)):
        monkeypatch.setattr(layout, name, value)
    orders = {f"o{k}": {f"i{int(rng.random() ** 2 * 40)}" for _ in range(rng.choice([2, 5, 25]))} for k in range(150)}
    lines = spark.createDataFrame([(o, i) for o, items in orders.items() for i in items for _ in range(2)] + [(None, "i1"), ("o1", None)], "lord string, item string")
    counted = Counter(pair for items in orders.values() for pair in combinations(sorted(items), 2))
    expected = sorted(((-n, *pair) for pair, n in counted.items()))[:20]
    found = layout.frequent_pairs(lines, 20).collect()
    assert sorted((-r.co_occurrence, r.item_a, r.item_b) for r in found) == expected
    assert layout._large_orders(lines.dropna().distinct(), 40).count() > 64 // largest


def test_blocks_of_items_are_compared_in_stripes(spark, monkeypatch):
    """Every pair that can reach the bound is met once, within blocks and between them, and no row is made of another."""
    rng = random.Random(5)
    monkeypatch.setattr(layout, "BLOCKS", 4)
    monkeypatch.setattr(layout, "STRIPE", 3)
    held = {f"i{k}": ({o for o in range(100) if rng.random() < 0.3}, rng.randrange(3)) for k in range(60)}
    mask = lambda orders, w: sum(1 << (o % 64) for o in orders if o // 64 == w)
    signed = lambda n: n - 2**64 if n >= 2**63 else n
    rows = [(item, signed(mask(orders, 0)), signed(mask(orders, 1)), rest) for item, (orders, rest) in held.items()]
    bits = spark.createDataFrame(rows, "item string, _w0 bigint, _w1 bigint, _rest bigint")
    for bound in (1, 14):
        met = layout._pairs_by_bits(bits, 2, bound)
        expected = sorted(
            (a, b, len(held[a][0] & held[b][0])) for a, b in combinations(sorted(held), 2) if len(held[a][0] & held[b][0]) + min(held[a][1], held[b][1]) >= bound
        )
        assert sorted(tuple(r) for r in met.collect()) == expected
        assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    assert layout._pairs_by_bits(bits.limit(0), 2, 1).collect() == []
