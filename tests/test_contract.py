"""The registered queries agree with their SQL on the smallest tables (a selection; checks.compare runs all)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from checks import registry
from checks.compare import compare
from checks.views import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
SELECTION = (
    "gap_filled_demand", "demand_types", "static_orders", "numbered_sublines", "snapshot_events", "mode_correction", "transport_stats",
    "freight_by_vendor", "extract_in_transit", "changed_rows",
)


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_of_the_register_has_its_sql():
    contract.queries()
    assert set(registry.oracles()) == set(registry.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SELECTION)
def test_query_agrees(spark, database, name):
    contract.queries()
    assert compare(spark, database, FOLDER, name, contract.oracle_sql()[name]) is None


@pytest.mark.parametrize(
    "name, column, values",
    [
        ("shaped_types", "demand_type", "Steady Demand|Trended Demand|Seasonal Demand|Burst Demand|Intermittent Demand|Single Demand|New Item"),
        ("shaped_types", "activity_level", "Active|Occasional|Inactive|Dormant"),
        ("shaped_forecasts", "model", "Steady Demand|Trended Demand|Seasonal Demand|Burst Demand|Intermittent Demand|cold_start"),
        ("shaped_orders", "order_reason", "Replenish|Replenish & On-Demand|SafetyStockTopUp|On-Demand"),
    ],
)
def test_every_class_and_reason_occurs(spark, name, column, values):
    found = {r[0] for r in contract.queries()[name](spark, FOLDER).select(column).distinct().collect()}
    assert set(values.split("|")) <= found
