"""Runs that follow an extract: cleaned open lines, the snapshot of open orders, and post-extract updates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.orders import ORDER_LINE, flag_replaced, inherit_safety, mark_order_changes, order_changes, safety_transfers
from stowage.operators.po import PO_LINE, TRACKED, add_tail_lines, number_sublines, repair_remaining, snapshot_events
from stowage.session import cut_lineage, materialised
from stowage.sources.digests import only_differing
from stowage.sources.tables import StoredTable


def open_order_lines(in_transit: DataFrame) -> DataFrame:
    """E13 with T6-T8: open lines with repaired quantities, tail lines and unique sub-lines, as V1 needs them."""
    return number_sublines(add_tail_lines(repair_remaining(in_transit)), ("invoice_date",))


def snapshot_run(
    snapshot: StoredTable, log: StoredTable, current: DataFrame, deliveries: DataFrame, as_of: dt.date, dry_run: bool = False
) -> DataFrame | None:
    """The events since the stored snapshot go to the log, and the snapshot becomes the current one.

    Only buckets of lines whose digests changed are compared (see ``digests``); those of the snapshot are kept with it. The log is written first, without the
    events it has already, so a run that failed in between can be repeated. The first run has nothing to compare and gives none.
    """
    events, found = None, None
    fields = ["item", "warehouse", *TRACKED]
    if snapshot.exists():
        stored = snapshot.read()
        before, now, found = only_differing(stored, current, PO_LINE, fields, snapshot.digests(PO_LINE, fields))
        found = cut_lineage(found)
        events = materialised(snapshot_events(before, now, deliveries, as_of))
    if dry_run:
        return events
    if events is not None:
        told = events
        if log.exists():
            names = events.columns
            same = reduce(lambda a, c: a & F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")), names, F.lit(True))
            told = events.alias("e").join(log.read().where(F.col("snapshot_date") == F.lit(as_of)).alias("l"), same, "left_anti")
        log.append(told)
    snapshot.overwrite(current)
    if found is not None:
        snapshot.digests(PO_LINE, fields, found)
    return events


def post_extract_run(
    items: StoredTable,
    item_warehouse: StoredTable,
    raw_orders: StoredTable,
    links: DataFrame,
    clean_orders: DataFrame,
    as_of: dt.date,
    transfer_log: StoredTable | None = None,
    change_log: StoredTable | None = None,
    fields: Sequence[str] = ("qty",),
) -> None:
    """T13, T12, T11 on the stored tables, in this order. Logs are materialised before their table changes.

    Order lines are compared where the digests of their buckets differ (see ``digests``).
    """
    items.overwrite(flag_replaced(items.read(), links))
    transfers = materialised(safety_transfers(item_warehouse.read(), links))
    item_warehouse.overwrite(inherit_safety(item_warehouse.read(), links))
    if transfer_log is not None:
        transfer_log.append(transfers)
    unmarked = raw_orders.read().where(F.coalesce(F.col("is_changed"), F.lit(0)) == 0)
    raw, clean, _ = only_differing(unmarked, clean_orders, ORDER_LINE, list(fields))
    changes = materialised(order_changes(raw, clean, as_of, fields))
    raw_orders.overwrite(mark_order_changes(raw_orders.read(), clean_orders, as_of, fields))
    if change_log is not None:
        change_log.append(changes)
