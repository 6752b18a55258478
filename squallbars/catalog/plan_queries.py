"""Queries over the assembled pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallbars.catalog.event_queries import BUCKETS_SQL, CHECK_SQL, _due
from squallbars.catalog.label_queries import T0_SQL
from squallbars.catalog.registry import query, rounded
from squallbars.catalog.sql import frame, lag, rd, with_tables
from squallbars.plans import preprocess
from squallbars.sources import inputs

_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (
    "fr1", "fr3", "fr6", "fr24", "path1", "path3", "path6", "path24", "dir_changes"))


@query("training_rows", with_tables("bars calendar", *T0_SQL, *BUCKETS_SQL, CHECK_SQL, recursive=True, body=f"""
SELECT ticker, datetime, {rd('fr3', 5)} AS trg_future_range_3h, trg_direction_1day, {rd('atr', 5)} AS atr, {rd('er', 5)} AS efficiency,
  news_count, main_event, currency_USD, event_INFLATION FROM g3 LEFT JOIN chk ON datetime = time_to_check WHERE {_COMPLETE}"""))
def training_rows(spark, sf_dir):
    events = inputs.calendar(spark, sf_dir)
    fitted = preprocess.EventPreprocessor().fit(events)
    out = preprocess.training_rows(inputs.bars(spark, sf_dir), events, fitted)
    return out.select("ticker", "datetime", *rounded("trg_future_range_3h", digits=5), "trg_direction_1day", *rounded("atr", digits=5),
                      F.round("kaufman_efficiency_ratio", 5).alias("efficiency"), "news_count", "main_event", "currency_USD",
                      "event_INFLATION")


_by = "PARTITION BY main_event, ticker ORDER BY datetime"


@query("event_rows", with_tables("bars calendar", *T0_SQL, *BUCKETS_SQL, CHECK_SQL,
                                 "x AS (SELECT * FROM chk JOIN g3 ON datetime = time_to_check)", recursive=True, body=f"""
SELECT ticker, rounded_time, main_event, {rd('fr6', 5)} AS future_range_6h,
  coalesce({rd(frame('avg', 'fr6', -5, -1, full=False, by=_by), 5)}, 0) AS mean_range_6h_5,
  coalesce({rd(lag('fr24', 1, _by), 5)}, 0) AS prev_range_24h FROM x"""))
def event_rows(spark, sf_dir):
    out = preprocess.event_rows(inputs.bars(spark, sf_dir), _due(spark, sf_dir))
    return out.select("ticker", "rounded_time", "main_event", *rounded("future_range_6h", "mean_range_6h_5", "prev_range_24h", digits=5))
