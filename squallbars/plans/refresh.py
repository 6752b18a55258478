"""Refresh of the per-event range table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.functions import texts
from squallbars.operators import events as ev
from squallbars.operators import labels
from squallbars.operators.history import HORIZONS
from squallbars.operators.layout import over_bars
from squallbars.sources.merge_store import MergeStore
from squallbars.sources.store import upsert

col = F.col
KEYS = ["main_event", "datetime", "ticker"]
RANGES = [f"future_range_{h}h" for h in HORIZONS]


def event_ranges(bars: DataFrame, events: DataFrame, known: bool = False) -> DataFrame:
    """Forward ranges of every ticker at each hour with events, labelled by the hour's main event.

    With ``known``, ``known_1h`` and so on are the times of the bars that complete the ranges: before them nobody knows a range.
    """
    main = (texts.folded(events, "title")
            .select(F.date_trunc("hour", "date").alias("datetime"), "date", "event_id",
                    texts.main_event(col("_up")).alias("most_important_event"))
            .groupBy("datetime").agg(ev.main_event_of().alias("main_event")))
    times = [f"known_{h}h" for h in HORIZONS] if known else []
    measured = over_bars(bars, lambda df, w: df.select("*", *[
        labels.future_range(w, h).alias(f"future_range_{h}h") for h in HORIZONS], *[
        w.lead("datetime", h).alias(n) for h, n in zip(HORIZONS, times)]), back=1, ahead=max(HORIZONS))
    return measured.join(main, "datetime").select("ticker", "datetime", "main_event", *RANGES, *times)


def new_ranges(stored: DataFrame, bars: DataFrame, events: DataFrame) -> DataFrame:
    """Ranges of new events, and of stored rows that are still open.

    A stored row is open while one of its ranges is null: windows count rows, so over a gap in the bars no span of hours
    bounds them. Each ticker is measured anew from its first open row (or its last row, if none is open); a ticker without
    stored rows is measured whole.
    """
    still = reduce(Column.__or__, [col(c).isNull() for c in RANGES])
    marks = stored.groupBy("ticker").agg(F.coalesce(F.min(F.when(still, col("datetime"))), F.max("datetime")).alias("_mark"))
    due = bars.join(marks, "ticker", "left").filter(col("_mark").isNull() | (col("datetime") >= col("_mark"))).drop("_mark")
    first = due.agg(F.min("datetime")).scalar()
    return event_ranges(due, events.filter(col("date") >= first))


def update_ranges(stored: DataFrame | None, bars: DataFrame, events: DataFrame) -> DataFrame:
    """New and still open ranges merged into the stored rows."""
    return event_ranges(bars, events) if stored is None else upsert(stored, new_ranges(stored, bars, events), KEYS)


def refresh_store(store: MergeStore, bars: DataFrame, events: DataFrame) -> list[str]:
    """New and still open ranges merged into a store; only the months they fall in are read and written."""
    return store.merge(new_ranges(store.read(), bars, events))
