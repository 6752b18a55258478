"""Merging into a stored table: results against a dictionary, untouched files, plans."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from squallbars.plans.refresh import KEYS, RANGES, event_ranges, refresh_store
from squallbars.sources import store
from squallbars.sources.merge_store import MergeStore, by_hash, by_ticker_and_month
from test_refresh import _bars

SCHEMA = "ticker string, datetime timestamp, close double, note string"
KEY = ["ticker", "datetime"]


def files(path):
    """Data files by partition, with their times."""
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.relpath(folder, path), {})[n] = os.stat(f"{folder}/{n}").st_mtime_ns
    return out


def row(ticker, month, day, close, note=None):
    return ticker, dt.datetime(2024, month, day) if month else None, float(close), note


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merges_against_a_dictionary(spark, tmp_path):
    """Several merges with new, changed and repeated keys; null and empty keys are keys like others."""
    deal = random.Random(1)
    one = lambda n: [row(deal.choice(["A", "B", "a/b=c", "", None]), deal.choice([1, 2, 3, None]), deal.randrange(1, 5), deal.randrange(100), deal.choice(["x", None])) for _ in range(n)]
    want = {}
    for r in one(40):
        want.setdefault(r[:2], r)
    kept = MergeStore.create(frame(spark, list(want.values())), f"{tmp_path}/s", KEY, by_ticker_and_month())
    for _ in range(3):
        new = one(15)
        kept.merge(frame(spark, [r for r in new]), ["close"])
        for r in sorted(new, key=lambda r: (r[2], r[3] is not None, r[3] or "")):
            want[r[:2]] = r
    assert sorted(map(repr, map(tuple, kept.read().collect()))) == sorted(map(repr, want.values()))


def test_untouched_files_stay(spark, tmp_path):
    kept = MergeStore.create(frame(spark, [row(t, m, d, m) for t in "AB" for m in (1, 2, 3) for d in (1, 2)]), f"{tmp_path}/s", KEY, by_ticker_and_month())
    before = files(kept.path)
    assert len(kept.merge(frame(spark, [row("A", 2, 1, 7), row("A", 2, 9, 8)]))) == 1
    after = files(kept.path)
    assert {p for p in after if after[p] != before.get(p)} == {"_ticker=A/_month=2024-02"}
    assert all(len(names) == 1 for names in after.values())
    assert kept.merge(frame(spark, [])) == [] and files(kept.path) == after


def test_merge_reads_touched_partitions_only(spark, tmp_path):
    kept = MergeStore.create(frame(spark, [row(t, m, 1, m) for t in "AB" for m in (1, 2, 3)]), f"{tmp_path}/s", KEY, by_ticker_and_month())
    new = store.latest(frame(spark, [row("A", 2, 1, 7)]), KEY, ["close"])
    df = kept.merged(new, kept.touched(new))
    df.collect()
    text = plan(df)
    assert "SortAggregate" not in text and "PartitionFilters: [(concat_ws" in text
    for folder in ("_ticker=B", "_ticker=A/_month=2024-01"):  # what isn't touched need not even be there
        os.rename(f"{kept.path}/{folder}", f"{tmp_path}/{folder.replace('/', '-')}")
    assert {(r.ticker, r.close) for r in kept.merged(new, kept.touched(new)).collect()} == {("A", 7.0)}


def test_merging_twice_changes_nothing(spark, tmp_path):
    kept = MergeStore.create(frame(spark, [row("A", 1, d, d) for d in range(1, 9)]), f"{tmp_path}/s", KEY, by_ticker_and_month())
    new = frame(spark, [row("A", 1, 3, 50, "n"), row("A", 1, 3, 50, "m"), row("C", 1, 1, 1)])
    kept.merge(new)
    once = sorted(map(repr, kept.read().collect()))
    kept.merge(new)
    assert sorted(map(repr, kept.read().collect())) == once and len(once) == 9


def test_merge_that_fails_leaves_the_store(spark, tmp_path):
    kept = MergeStore.create(frame(spark, [row("A", 1, d, d) for d in range(1, 5)]), f"{tmp_path}/s", KEY, by_ticker_and_month())
    before = files(kept.path)
    with pytest.raises(Exception):
        kept.merge(frame(spark, [row("A", 1, 2, 1)]).withColumn("close", F.raise_error(F.lit("lost")).cast("double")))
    assert files(kept.path) == before


def test_layout_must_follow_from_keys(spark, tmp_path):
    kept = MergeStore.create(frame(spark, [row("A", 1, 1, 1)]), f"{tmp_path}/s", ["datetime"], by_hash("ticker", 4))
    with pytest.raises(Exception, match="ticker"):
        kept.merge(frame(spark, [row("A", 1, 1, 2)]))


def test_missing_and_further_columns(spark, tmp_path):
    kept = MergeStore.create(frame(spark, [row("A", 1, 1, 1, "x"), row("A", 1, 2, 1, "x")]), f"{tmp_path}/s", KEY, by_ticker_and_month())
    kept.merge(frame(spark, [row("A", 1, 1, 5, "y")]).drop("note").withColumn("other", F.lit(1)))
    assert {tuple(r)[2:] for r in kept.read().collect()} == {(5.0, None), (1.0, "x")} and kept.read().columns == ["ticker", "datetime", "close", "note"]


def test_upsert_neither_sorts_nor_combines_stored_rows(spark):
    stored, new = frame(spark, [row("A", 1, d, d) for d in range(1, 9)]), frame(spark, [row("A", 1, 3, 4), row("A", 1, 3, 5)])
    out = store.upsert(stored, new, KEY, ["close"])
    assert "Aggregate" not in plan(out) and out.count() == 8 and out.filter("close = 5").count() == 2


def test_hot_key_is_one_row_per_task_before_the_shuffle(spark):
    rows = spark.range(0, 50_000, 1, 4).select((F.col("id") >= 0).alias("k"), "id")
    out = store.latest(rows, ["k"], ["id"])
    assert out.collect()[0]["id"] == 49_999 and plan(out).count("WindowGroupLimit") >= 2


def test_range_store_refreshed_in_steps_equals_one_run(spark, tmp_path):
    bars = _bars(spark)
    events = bars.filter("ticker = 'A'").select(F.col("datetime").alias("date"), F.hash("datetime").cast("long").alias("event_id"), F.lit("CPI MoM").alias("title"))
    upto = lambda df, c, mark: df.filter(F.col(c) < mark)
    kept = MergeStore.create(event_ranges(upto(bars, "datetime", "2024-01-05"), upto(events, "date", "2024-01-05")), f"{tmp_path}/r", KEYS, by_ticker_and_month())
    for mark in ("2024-01-08 03:00:00", "2024-01-20"):
        refresh_store(kept, upto(bars, "datetime", mark), upto(events, "date", mark))
    columns = ["ticker", "datetime", "main_event", *RANGES]
    assert sorted(map(repr, kept.read().select(*columns).collect())) == sorted(map(repr, event_ranges(bars, events).select(*columns).collect()))
