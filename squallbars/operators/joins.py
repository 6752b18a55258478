"""Joins of bars, event buckets and indicator series.

No broadcast hints: the planner and adaptive execution broadcast a side when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallbars.operators.layout import attach, fill_forward

col = F.col


def bars_with_events(bars: DataFrame, buckets: DataFrame, how: str = "left") -> DataFrame:
    """Each bar with the event bucket that is due at its time; a bucket reaches every ticker."""
    return bars.join(buckets, bars["datetime"] == buckets["time_to_check"], how)


def events_with_bars(buckets: DataFrame, bars: DataFrame, how: str = "left") -> DataFrame:
    return buckets.join(bars, buckets["time_to_check"] == bars["datetime"], how)


def next_bucket(buckets: DataFrame, now: Column, bucket: str = "rounded_time") -> DataFrame:
    """The first bucket after ``now``: a minimum over partial aggregates, not a sort."""
    rest = [c for c in buckets.columns if c != bucket]
    later = buckets.filter(col(bucket) > now)
    return (later.agg(F.min_by(F.struct(bucket, *rest), bucket).alias("b")).filter(col("b").isNotNull()).select("b.*"))


def latest_with_next(bars: DataFrame, buckets: DataFrame, now: Column) -> DataFrame:
    """Last bar of each ticker with the one upcoming bucket as extra columns."""
    last = (bars.filter(col("datetime") <= now).groupBy("ticker")
            .agg(F.max_by(F.struct(*[c for c in bars.columns if c != "ticker"]), "datetime").alias("b"))
            .select("ticker", "b.*"))
    upcoming = next_bucket(buckets, now).select(F.struct("*")).scalar()
    return last.withColumn("_next", upcoming).select("*", "_next.*").drop("_next")


def at_alert_hour(events: DataFrame, hours: DataFrame) -> DataFrame:
    """Distinct titles of medium and high events in the chosen hours."""
    rows = events.filter(col("importance") >= 0).withColumn("rounded_time", F.date_trunc("hour", "date"))
    return rows.join(hours, "rounded_time", "left_semi").select("rounded_time", "title").distinct()


def indicator_calendar(series: DataFrame) -> DataFrame:
    """Daily levels and differences of each series: last observation carried over calendar days.

    Differences are between observations. Each observation is expanded to the days until the next one.
    """
    w = Window.partitionBy("series").orderBy("date")
    obs = series.groupBy("series", F.to_date("date").alias("date")).agg(F.max_by("value", "date").alias("value"))
    steps = obs.select("series", "date", "value", (col("value") - F.lag("value").over(w)).alias("diff"),
                       F.lead("date").over(w).alias("_next"))
    last_day = series.agg(F.to_date(F.max("date"))).scalar()
    until = F.coalesce(F.date_sub("_next", 1), F.greatest(last_day, col("date")))
    days = steps.select("series", "value", "diff", F.explode(F.sequence("date", until)).alias("date"))
    return days


def join_indicators(rows: DataFrame, series: DataFrame, names: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Macro levels and differences of the row's UTC day as ``macro_<name>`` columns."""
    days = indicator_calendar(series)
    wide = days.groupBy("date").agg(*[
        F.max(F.when(col("series") == n, col(v))).alias(f"macro_{_slug(n)}{suffix}")
        for n in names for v, suffix in (("value", ""), ("diff", "_diff"))])
    return rows.withColumn("_day", F.to_date(ts)).join(wide.withColumnRenamed("date", "_day"), "_day", "left").drop("_day")


def _slug(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name.lower())


def with_range_history(rows: DataFrame, stats: DataFrame) -> DataFrame:
    return attach(rows, stats, ["ticker", "main_event"])


def daily_onto_hourly(bars: DataFrame, daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    joined = bars.join(daily, ["ticker", "datetime"], "left")
    return fill_forward(joined, ["ticker"], "datetime", {c: col(c) for c in columns})
