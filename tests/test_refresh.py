"""Refreshes over gaps, crowded hours, scoring of every row."""

import datetime as dt

from pyspark.sql import functions as F

from squallbars.operators import aggregates, alerts, events, learners
from squallbars.plans.refresh import RANGES, update_ranges


def _bars(spark):
    """Hourly bars of two tickers on weekdays only."""
    start = dt.datetime(2024, 1, 1)
    hours = [start + dt.timedelta(hours=k) for k in range(24 * 15) if (start + dt.timedelta(hours=k)).weekday() < 5]
    rows = [(t, h, 10.0 + i % 7, 11.0 + i % 5, 9.0 - i % 3, 10.0 + i % 4) for t in "AB" for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "ticker string, datetime timestamp, open double, high double, low double, close double")


def test_refreshes_over_weekends_equal_one_run(spark):
    bars = _bars(spark)
    events = bars.filter("ticker = 'A'").select(F.col("datetime").alias("date"), F.hash("datetime").cast("long").alias("event_id"), F.lit("CPI MoM").alias("title"))
    stored = None
    for mark in ("2024-01-05 20:00:00", "2024-01-08 03:00:00", "2024-01-12 23:00:00", "2024-01-20 00:00:00"):
        stored = update_ranges(stored, bars.filter(F.col("datetime") < mark), events.filter(F.col("date") < mark)).cache()
        stored.count()
    key = ["ticker", "datetime", "main_event"]
    assert sorted(map(tuple, stored.select(*key, *RANGES).collect()), key=str) == sorted(map(tuple, update_ranges(None, bars, events).select(*key, *RANGES).collect()), key=str)


def test_crowded_hour_has_numbered_pages(spark):
    rows = spark.range(2500).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("date"), F.lit("t").alias("title"))
    out = events.records_per_bucket(rows.withColumn("hour", F.date_trunc("hour", "date")), "hour", ["event_id"]).collect()
    assert sorted((r.page, len(r.records)) for r in out) == [(0, 1000), (1, 1000), (2, 500)]
    assert [x.event_id for r in sorted(out, key=lambda r: r.page) for x in r.records] == list(range(2500))


def test_every_page_has_the_digest_total(spark):
    groups = spark.createDataFrame([(1, 0.0, "1")], "user_id int, offset double, levels string")
    rows = spark.range(23).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("date"), F.lit("t").alias("title"), F.lit(1).alias("importance"))
    out = alerts.digests(groups, rows, lambda date, offset: F.to_date(date), page=10).collect()
    assert [(r.page, r.n_events, r.body.count("\n") + 1) for r in sorted(out, key=lambda r: r.page)] == [(0, 23, 10), (1, 23, 10), (2, 23, 3)]


def test_digests_of_every_offset_and_set(spark):
    """All sets of levels at several offsets against plain lists; no join deals events by their level."""
    groups = spark.createDataFrame([(u, o, s) for u, (o, s) in enumerate((o, s) for o in (-3.5, 0.0, 5.5) for s in ("-1", "0,1", "-1,0,1", "1", ""))] + [(99, 0.0, "1")],
                                   "user_id int, offset double, levels string")
    rows = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 37 % 60 * 60).alias("date"),
                                  F.concat(F.lit("t"), "id").alias("title"), (F.col("id") % 4 - 1).cast("int").alias("importance"))
    out = alerts.digests(groups, rows, lambda date, offset: F.to_date(date), page=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "level#" in line]
    events = sorted((r.date, r.event_id, r.title, r.importance) for r in rows.collect())
    got = {}
    for r in out.orderBy("page").collect():
        got.setdefault((r.offset, r.levels), []).append(r)
    assert set(got) == {(o, s) for o in (-3.5, 0.0, 5.5) for s in ("-1", "0,1", "-1,0,1", "1")}
    for (offset, levels), pages in got.items():
        titles = [t for _, _, t, i in events if str(i) in levels.split(",")]
        lines = [line for p in pages for line in p.body.split("\n")]
        assert [line.split("<b>")[1].split("</b>")[0] for line in lines] == titles and all(p.n_events == len(titles) for p in pages)
        assert all(len(p.body.split("\n")) == 7 for p in pages[:-1])


def test_readers_of_one_digest_are_spread(spark):
    """One digest of many pages and users: every user has every page once, and no task has more than a few tiles of them."""
    settings = spark.range(6000).select(F.col("id").alias("user_id"), F.lit(3.5).cast("decimal(3,1)").alias("user_timezone"), F.lit(True).alias("daily_alerts"),
                                        F.lit(False).alias("show_low_importance"), F.lit(True).alias("show_medium_importance"), F.lit(False).alias("show_high_importance"))
    rows = spark.range(4200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("date"), F.lit("t").alias("title"), F.lit(0).alias("importance"))
    out = alerts.subscriber_digests(settings, rows, F.to_timestamp(F.lit("2024-01-01")), 3).select("user_id", "page", "n_events", F.spark_partition_id().alias("task")).toPandas()
    assert len(out) == 6000 * 9 and len(out[["user_id", "page"]].drop_duplicates()) == len(out) and set(out.page) == set(range(9)) and set(out.n_events) == {4200}
    assert out.groupby("task").size().max() <= 32_768


def test_rows_with_missing_features_are_scored(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 3), float("nan") if i % 7 == 0 else float(i), i % 2, 1.0) for i in range(60)],
                                 "id int, a double, b double, y int, weight double")
    model = learners.binary_learner(["a", "b"], "y", maxIter=2).fit(rows)
    assert model.transform(rows).count() == 60


def test_any_number_of_category_values(spark):
    rows = spark.range(6000).select(F.concat(F.lit("v"), F.col("id") % 5500).alias("currency"), F.lit(0).alias("bucket"))
    out = events.category_sums(rows, "bucket", ["currency"])
    assert out.count() == 5500 and out.agg(F.sum("n")).first()[0] == 6000


def test_ngrams_count_in_their_row(spark):
    """Counts and document numbers with repeated ids, a null id and empty texts; a document's terms are not dealt one by one."""
    texts = [(1, "aa bb aa bb cc"), (2, "bb aa"), (2, "aa bb cc cc"), (3, ""), (4, None), (None, "aa bb dd"), (None, "dd"), (5, "cc cc cc")]
    rows = spark.createDataFrame(texts, "doc long, text string")
    for kept in (texts, texts[:2] + texts[3:]):
        count, seen = {}, {}
        for d, t in kept:
            w = (t or "").split()
            for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
                count[g] = count.get(g, 0) + 1
                seen.setdefault(g, set()).update({d} - {None})
        for least in (1, 2, 3):
            some = rows if kept is texts else rows.filter("not (doc <=> 2 and text like '%cc%')")
            out = aggregates.ngram_counts(some, "text", "doc", (1, 2), min_df=least, stop_words=[])
            assert {r.word: r["count"] for r in out.collect()} == {g: n for g, n in count.items() if least == 1 or len(seen[g]) >= least}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(word" in line and "doc#" in line.split("ENSURE")[0]]
