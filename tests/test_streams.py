"""Streams over several files and batches: late and repeated rows, eviction of state, batches run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from squallbars.sources.merge_store import MergeStore, by_day, by_hash, by_ticker_and_month
from squallbars.streaming import jobs

TICKS = "event_id long, event_type string, ts timestamp, value double"
BARS = "ticker string, datetime timestamp, open double, high double, low double, close double, volume long"
DAY = dt.datetime(2024, 3, 4)


def at(hour, minute=0):
    return DAY + dt.timedelta(hours=hour, minutes=minute)


class Feed:
    """A folder to which files are added, and the checkpoint and store of a stream that reads it."""

    def __init__(self, spark, path, schema, keys, layout):
        self.spark, self.path = spark, path
        self.store = MergeStore.create(spark.createDataFrame([], schema), f"{path}/store", keys, layout)

    def add(self, *rows):
        self.spark.createDataFrame([(i, "A", t, float(v)) for i, t, v in rows], TICKS).coalesce(1).write.mode("append").parquet(f"{self.path}/feed")

    def run(self, job, mode="append", store=None, **kw):
        return jobs.run_once(job(jobs.read_ticks(self.spark, f"{self.path}/feed", 1)), store or self.store, f"{self.path}/state", mode, **kw)

    def rows(self):
        return sorted(tuple(r) for r in self.store.read().collect())


@pytest.fixture
def bars(spark, tmp_path):
    return Feed(spark, str(tmp_path), BARS, ["ticker", "datetime"], by_ticker_and_month())


@pytest.fixture
def events(spark, tmp_path):
    return Feed(spark, str(tmp_path), "event_id long, ticker string, ts timestamp, value double", ["event_id"], by_hash("event_id", 2))


def test_late_rows_within_the_lateness_change_their_bar(bars):
    bars.add((1, at(10, 5), 5), (2, at(10, 50), 7))
    bars.add((3, at(11, 10), 6))
    bars.add((4, at(10, 1), 1), (5, at(10, 59), 9))  # an hour late
    bars.run(jobs.hourly_bars, "update")
    assert bars.rows() == [("A", at(10), 1.0, 9.0, 1.0, 9.0, 4), ("A", at(11), 6.0, 6.0, 6.0, 6.0, 1)]


def test_rows_behind_the_watermark_are_dropped_and_state_goes(bars):
    bars.add((1, at(5), 5))
    bars.add((2, at(20), 7))
    bars.add((4, at(20, 10), 7))
    bars.add((3, at(5, 30), 100))  # the watermark has been 18:00 since the batch before
    progress = bars.run(jobs.hourly_bars, "update")
    assert bars.rows() == [("A", at(5), 5.0, 5.0, 5.0, 5.0, 1), ("A", at(20), 7.0, 7.0, 7.0, 7.0, 2)]
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1 and state[-1]["numRowsTotal"] == 1


def test_a_stream_goes_on_where_it_stopped(bars):
    """State outlives the query: bars grow over three runs, and rows of earlier files aren't read again."""
    for k, value in enumerate((3, 8, 2)):
        bars.add((k, at(9, 10 * k), value))
        progress = bars.run(jobs.hourly_bars, "update")
        assert sum(p["numInputRows"] for p in progress) == 1
    assert bars.rows() == [("A", at(9), 3.0, 8.0, 2.0, 2.0, 3)]


def test_events_repeated_in_and_across_batches_are_stored_once(events):
    events.add((1, at(1), 1), (1, at(1), 1), (2, at(1, 5), 2))
    events.add((2, at(1, 5), 2), (3, at(2), 3))
    progress = events.run(jobs.new_events)
    assert events.rows() == [(1, "A", at(1), 1.0), (2, "A", at(1, 5), 2.0), (3, "A", at(2), 3.0)]
    events.add((9, at(9), 9))
    events.add((1, at(1), 1))  # behind the watermark, its state gone: dropped as late
    progress = events.run(jobs.new_events)
    assert len(events.rows()) == 4 and progress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_a_batch_run_again_changes_nothing(events):
    """The merge is done, then the driver fails before the batch is committed; the next run merges the batch again."""
    merged = []

    class Failing:
        def merge(self, rows):
            merged.append(events.store.merge(rows))
            raise RuntimeError("lost after the merge")

    events.add((1, at(1), 1), (2, at(1, 30), 2))
    with pytest.raises(Exception, match="lost after the merge"):
        events.run(jobs.new_events, store=Failing())
    first = events.rows()
    assert len(merged) == 1 and len(first) == 2
    progress = events.run(jobs.new_events)
    assert progress[0]["batchId"] == 0 and progress[0]["numInputRows"] == 2 and events.rows() == first


def test_alerts_come_once(spark, tmp_path):
    buckets = spark.createDataFrame([(at(10), at(11), 4), (at(12), at(13), 1), (at(15), at(16), 2)], "time_to_check timestamp, rounded_time timestamp, news_count int")
    alerts = Feed(spark, str(tmp_path), buckets.schema, ["time_to_check", "rounded_time"], by_day("time_to_check"))
    alerts.add((1, at(10, 5), 1), (2, at(10, 6), 1))
    alerts.add((3, at(10, 40), 1), (4, at(11), 1), (5, at(12, 30), 1))
    alerts.run(lambda ticks: jobs.due_alerts(ticks, buckets), change=lambda df: df.select(buckets.columns))
    assert alerts.rows() == [(at(10), at(11), 4), (at(12), at(13), 1)]


def test_stored_partitions_stay_single_files(bars):
    """Batches leave no folders behind: a month of a ticker is one small file however many batches it took."""
    import os

    for k in range(4):
        bars.add((k, at(k), k))
    bars.run(jobs.hourly_bars, "update")
    found = [n for _, _, names in os.walk(bars.store.path) for n in names if n.endswith(".parquet")]
    assert len(found) == 1 and bars.store.read().count() == 4 and bars.store.read().agg(F.sum("volume")).first()[0] == 4
