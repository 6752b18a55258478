"""Scalar rules, merging, folds, calibration and learners on hand-made rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallbars.functions import texts, times
from squallbars.operators import events as ev
from squallbars.operators import folds, learners, metrics
from squallbars.sources import clean, store

col = F.col


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_nearest_slot_edges(spark):
    cases = [("2024-01-01 10:19:59", "10:00", "10:00"), ("2024-01-01 10:20:00", "10:30", "10:00"),
             ("2024-01-01 10:29:59", "10:30", "10:00"), ("2024-01-01 10:30:00", "10:30", "11:00"),
             ("2024-01-01 10:49:00", "10:30", "11:00"), ("2024-01-01 10:50:00", "11:00", "11:00"),
             ("2024-01-01 10:59:59", "11:00", "11:00"), ("2024-01-01 10:00:00", "10:00", "10:00")]
    df = spark.createDataFrame([(ts(a), b, c) for a, b, c in cases], "t timestamp, half string, hour string")
    out = df.select("half", "hour", F.date_format(times.nearest_slot(col("t"), "30min"), "HH:mm").alias("h2"),
                    F.date_format(times.nearest_slot(col("t"), "h"), "HH:mm").alias("hr")).collect()
    assert all(r["half"] == r["h2"] and r["hour"] == r["hr"] for r in out)
    assert df.select(times.nearest_slot(col("t"), "x").alias("n")).first()["n"] is None


def test_business_day_and_sunday(spark):
    days = pd.date_range("2024-01-01", periods=14)
    df = spark.createDataFrame(pd.DataFrame({"d": days}))
    out = df.select("d", times.previous_business_day(col("d")).alias("p"), times.next_sunday(F.to_date("d")).alias("s")).toPandas()
    for d, p, s in out.itertuples(index=False):
        assert pd.Timestamp(p) == d - pd.offsets.BDay(1)
        ahead = 6 - d.weekday()
        assert pd.Timestamp(s) == d + pd.Timedelta(days=ahead or 7)


def test_main_event_ties_and_no_main_events(spark):
    rows = [(1, ts("2024-01-01 10:05:00"), "FOMC Minutes"), (2, ts("2024-01-01 10:01:00"), "CPI MoM"),
            (3, ts("2024-01-01 11:00:00"), "Bank Holiday"), (4, ts("2024-01-01 11:10:00"), None)]
    df = spark.createDataFrame(rows, "event_id long, date timestamp, title string").withColumns(
        {"importance": F.lit(1), "source": F.lit("Fed"), "indicator": F.lit("x")})
    out = {r["rounded_time"].hour: r for r in ev.aggregate_buckets(ev.with_bucket(ev.event_features(df).drop("source"))).collect()}
    assert out[10]["main_event"] == "Inflation_rate"
    assert out[11]["main_event"] == "No main events" and out[11]["news_count"] == 1 and out[11]["key_event_count"] == 0


def test_unseen_category_gives_zeros(spark):
    a = spark.createDataFrame([("x",), (None,)], "category string")
    b = spark.createDataFrame([("y",)], "category string")
    vocabulary = ev.fit_vocabulary(a, ["category"])
    assert vocabulary == {"category": ["None", "x"]}
    assert ev.encode(b, vocabulary).first().asDict() == {"category_x": 0}


def test_economic_values(spark):
    cases = [("1,234.5", 1234.5), ("-2.5%", -0.025), ("$3", 3.0), ("about 12.5 jobs", 12.5), ("n/a", None), ("", None),
             (None, None), ("x%", None)]
    df = spark.createDataFrame(cases, "v string, want double")
    for r in df.select("want", texts.economic_value(col("v")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_field_names_match_plain_pattern(spark):
    import re

    cases = ["Source: a b | Usual Effect: x", "no colon here", "a:b:c d: 9x: y :", "  lead: 3 two words: z"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", texts.field_names(col("t")).alias("f")).collect():
        assert r["f"] == re.findall(r"[A-Za-z][A-Za-z\s]*:", r["t"])


def test_records_split_into_pages(spark):
    rows = [(i, ts("2024-01-01 10:00:00") + dt.timedelta(seconds=i), f"t{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "event_id long, date timestamp, title string").withColumn("hour", F.date_trunc("hour", "date"))
    out = ev.records_per_bucket(df, "hour", ["event_id"], page=10).orderBy("page").collect()
    assert [len(r["records"]) for r in out] == [10, 10, 5]
    assert [x["event_id"] for r in out for x in r["records"]] == list(range(25))


def test_upsert_last_wins_and_insert_absent(spark):
    stored = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, n int, v double")
    new = spark.createDataFrame([("b", 2, 5.0), ("b", 3, 6.0), ("c", 1, 7.0)], "k string, n int, v double")
    out = {r["k"]: r["v"] for r in store.upsert(stored, new, ["k"], ["n"]).collect()}
    assert out == {"a": 1.0, "b": 6.0, "c": 7.0}
    assert {r["k"] for r in store.insert_absent(stored, new.union(new), "k").collect()} == {"c"}
    once = store.upsert(stored, new, ["k"], ["n"])
    assert sorted(map(tuple, store.upsert(once, new, ["k"], ["n"]).collect())) == sorted(map(tuple, once.collect()))


def test_standardize_keeps_only_dated_rows(spark):
    raw = spark.createDataFrame([("1", "high", "2024-01-01 10:00:00"), ("x", "1", "2024-01-02"), ("3", "0", "bad")],
                                "id string, importance string, date string")
    out = clean.standardize_events(raw).orderBy("date").collect()
    assert [(r["event_id"], r["importance"]) for r in out] == [(1, None), (None, 1)]


def test_month_end_steps_accumulate(spark):
    days = pd.date_range("2019-11-30", "2021-03-05", freq="D") + pd.Timedelta(hours=6)
    df = spark.createDataFrame(pd.DataFrame({"t": days}))
    got = df.limit(1).select(folds.block_folds(df, "t", 3, 3, 3).alias("f")).first()["f"]
    start, want = pd.Timestamp("2019-11-30 06:00"), []
    val = start + pd.DateOffset(months=3)
    while val <= days[-1]:
        want.append(val)
        val = val + pd.DateOffset(months=3)
    assert [pd.Timestamp(x["val_start"]) for x in got] == want


def test_folds_train_before_validation(spark):
    days = pd.date_range("2019-01-01", "2021-12-31", freq="D")
    df = spark.createDataFrame(pd.DataFrame({"t": days, "q": days.to_period("Q").astype(str)}))
    s = folds.summary(df, "t", folds.block_folds(df, "t", 12, 3, 3)).toPandas()
    assert len(s) and (s.train_to < s.val_from).all()
    assert folds.validation_rows(df, "q", folds.last_period_folds(df, "q", 2)).select("q").distinct().count() == 2
    with pytest.raises(Exception, match="not enough periods"):
        folds.summary(df, "q", folds.last_period_folds(df, "q", 50)).count()


def test_single_class_has_no_roc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    row = metrics.binary_metrics(df, "y", "p").first()
    assert row["roc_auc"] is None and row["pr_auc"] == 1.0


def test_best_threshold_takes_the_lowest_of_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)] * 3, "y int, p double")
    assert metrics.best_threshold(df, "y", "p", min_recall=0.4).first()["threshold"] == 0.9
    assert metrics.best_threshold(df, "y", "p", min_recall=2.0).first()["threshold"] == pytest.approx(0.6)


def test_kappa_with_missing_grade(spark):
    y, p = [0, 0, 2, 2, 5, 5], [0, 2, 2, 5, 5, 0]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    pos = {v: i for i, v in enumerate(sorted(set(y) | set(p)))}
    a, b = np.array([pos[v] for v in y]), np.array([pos[v] for v in p])
    expected = np.mean([(i - j) ** 2 for i in a for j in b])
    assert metrics.quadratic_kappa(df, "y", "p").first()["qwk"] == pytest.approx(1 - np.mean((a - b) ** 2) / expected)


def test_quantile_forest_orders_and_covers(spark):
    rng = np.random.default_rng(3)
    x = rng.random(1500)
    pdf = pd.DataFrame({"x": x, "y": 10 * x + rng.normal(size=1500)})
    df = spark.createDataFrame(pdf)
    out = learners.fit_quantiles(["x"], "y", bins=60, numTrees=6, maxDepth=4)(df)(df).toPandas()
    assert (out.pred_q1 <= out.pred_q5).all() and (out.pred_q5 <= out.pred_q9).all()
    assert 0.7 < ((out.y >= out.pred_q1) & (out.y <= out.pred_q9)).mean() < 0.92
    assert abs((out.y - out.pred_q5).mean()) < 0.5


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "y int")
    got = {r["y"]: r["w"] for r in learners.balanced_weights(df, "y").groupBy("y").agg(F.max("weight").alias("w")).collect()}
    assert got == {0: pytest.approx(40 / 60), 1: pytest.approx(2.0)}


def test_quantile_query_validates_six_weeks_or_all(spark, sf_dir, monkeypatch):
    from squallbars.catalog import model_queries

    seen = {}
    monkeypatch.setattr(learners, "fit_quantiles", lambda features, label, **params: seen.update(params=params))
    monkeypatch.setattr(learners, "walk_forward", lambda rows, on, bounds, fit: seen.update(rows=rows, bounds=bounds) or rows.withColumn(
        "pred_q1", F.lit(0.0)).withColumn("pred_q5", F.lit(1.0)).withColumn("pred_q9", F.lit(2.0)))
    model_queries.quantile_walk_forward(spark, sf_dir)
    weeks = seen["rows"].select("period").distinct().count()
    validated = folds.validation_rows(seen["rows"], "period", seen["bounds"]).select("period").distinct().count()
    assert seen["params"] == {} and validated == min(6, weeks - 1)
