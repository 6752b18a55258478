"""Calibrated forecasts, sigmoid calibration by its score equations, pairwise tests of many classes, rank bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallbars.operators import aggregates, folds, learners, metrics
from squallbars.operators.layout import attach_small


def test_sigmoid_solves_its_score_equations(spark):
    """At the maximum of the likelihood, errors sum to 0, by themselves and weighted by the score."""
    rng = np.random.default_rng(2)
    score = rng.random(4_000).round(3)
    y = (rng.random(4_000) < 1 / (1 + np.exp(3 - 5 * score))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": score}))
    out = learners.calibrate(df, "y", "p", "sigmoid")(df).select((F.col("calibrated") - F.col("y")).alias("e"), "p").agg(F.sum("e"), F.sum(F.col("e") * F.col("p"))).first()
    assert abs(out[0]) < 0.5 and abs(out[1]) < 0.5
    shifted = learners.calibrate(df, "y", "p", "sigmoid")(df).select("p", "calibrated").distinct().orderBy("p").toPandas()
    assert (shifted.calibrated.diff().dropna() > 0).all()
    logit = np.log(shifted.calibrated / (1 - shifted.calibrated))
    np.testing.assert_allclose(np.polyfit(shifted.p, logit, 1), np.polyfit(shifted.p[[0, len(shifted) - 1]], logit.iloc[[0, -1]], 1), rtol=1e-6)


def test_forecast_calibrates_before_its_threshold(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.random(n)
    pdf = pd.DataFrame({"id": range(n), "x": x, "z": rng.random(n), "y": (rng.random(n) < 0.15 + 0.5 * (x > 0.7)).astype(int), "period": np.arange(n) % 6})
    df = spark.createDataFrame(pdf)
    forecast = learners.binary_forecast(df, "period", folds.last_period_folds(df, "period", 3), ["x", "z"], "y", beta=0.5, maxIter=3, maxDepth=3)
    assert forecast.oof.count() == n // 2 and set(forecast.oof.select("fold").distinct().toPandas().fold) == {0, 1, 2}
    means = forecast.oof.agg(F.avg("y"), F.avg("calibrated"), F.avg("prob")).first()
    assert means[1] == pytest.approx(means[0], abs=1e-9) and abs(means[2] - means[0]) > 0.02  # class weights lift raw scores
    raw, own = (metrics.binary_metrics(forecast.oof, "y", c).first()["brier_score"] for c in ("prob", "calibrated"))
    assert own < raw
    want = metrics.best_threshold(forecast.oof, "y", "calibrated", 0.5).first()["threshold"]
    assert forecast.threshold.first()["threshold"] == want
    scored = forecast.score(df.select("id", "x", "z")).toPandas()
    assert len(scored) == n and (scored.flag == (scored.calibrated >= want)).all() and 0 < scored.flag.sum() < n


def test_pairs_of_three_thousand_classes(spark):
    """All pairs once, from blocks: no row holds all classes, and no window runs over all pairs."""
    k = 3_000
    df = spark.range(k * 3).select((F.col("id") % k).cast("int").alias("c"), (F.col("id") * 7 % 11 + F.col("id") % k / 100.0).alias("x"))
    out = aggregates.pairwise_tests(df, "c", "x")
    total = out.agg(F.count("*"), F.count_if(F.col("A") < F.col("B")), F.sum(F.hash("A", "B").cast("long"))).first()
    assert total[0] == total[1] == k * (k - 1) // 2
    a, b = 5, 2_999
    rows = {c: np.array([(c + i * k) * 7 % 11 + c / 100.0 for i in range(3)]) for c in (a, b)}
    se = np.sqrt(sum(v.var(ddof=1) / 3 for v in rows.values()))
    got = out.filter((F.col("A") == a) & (F.col("B") == b)).collect()
    assert len(got) == 1 and got[0].t_stat == pytest.approx((rows[a].mean() - rows[b].mean()) / se)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_small_tables_are_sent_only_when_small(spark, monkeypatch):
    from squallbars.operators import layout

    big, small = spark.range(1000).withColumn("k", F.col("id") % 7), spark.range(7).select(F.col("id").alias("k"), F.col("id").alias("v"))
    plan = lambda: attach_small(big, small, ["k"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(layout, "BROADCAST_ROWS", 3)
    monkeypatch.setitem(vars(layout), "BROADCAST_ROWS", 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_quantile_forest_with_few_values(spark):
    """A target of three values has three bins, and forecasts are among its values."""
    pdf = pd.DataFrame({"x": np.arange(300) % 3 + 0.0, "y": np.arange(300) % 3 * 10.0})
    df = spark.createDataFrame(pdf)
    out = learners.fit_quantiles(["x"], "y", numTrees=4, maxDepth=3, featureSubsetStrategy="all")(df)(df).toPandas()
    assert set(out.pred_q5) <= {0.0, 10.0, 20.0} and (out.pred_q5 == out.y).all()


def test_rescaled_range_of_many_windows():
    """The matrix against one window at a time: plain, flat in part, flat, and with a price of 0."""
    from squallbars.operators.indicators import HURST_SIZES, rescaled_range

    rng = np.random.default_rng(6)
    windows = np.exp(rng.normal(size=(40, 100)).cumsum(axis=1) / 50)
    windows[1, 20:60] = windows[1, 20]
    windows[2] = 3.0
    windows[3, 50] = 0.0
    got = rescaled_range(windows)
    for k, prices in enumerate(windows):
        points = []
        steps = np.diff(np.log(prices)) if (prices > 0).all() else []
        for size in HURST_SIZES:
            found = []
            for i in range(len(steps) // size):
                block = steps[i * size:(i + 1) * size]
                walk = np.cumsum(block - block.mean())
                if block.std() > 0:
                    found.append((walk.max() - walk.min()) / block.std())
            if found:
                points.append((np.log(size), np.log(np.mean(found))))
        want = np.polyfit(*np.array(points).T, 1)[0] if len(points) > 1 else np.nan
        np.testing.assert_allclose(got[k], want, rtol=1e-9)


def test_a_hundred_thousand_category_values(spark):
    """Ids without a collect; the wide form says that it can't."""
    from squallbars.operators import events

    n = 100_000
    rows = spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("currency"), F.when(F.col("id") % 2 == 0, "x").alias("scale"))
    ids = events.category_ids(rows, ["currency", "scale"])
    got = ids.agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(got) == (n + 1, 0, n, n + 1)
    ends = {r["value"]: r["id"] for r in ids.filter("value IN ('v0', 'v99999', 'x')").collect()}
    assert ends == {"v0": 0, "v99999": n - 1, "x": n}
    coded = events.encode_sparse(rows, ids, "id", ["currency", "scale"])
    assert tuple(coded.agg(F.count("*"), F.sum(F.size("ids"))).first()) == (n, n + n // 2)
    assert coded.filter("id = 0").first()["ids"] == [0, n] and len(coded.filter("id = 99999").first()["ids"]) == 1
    with pytest.raises(ValueError, match="encode_sparse"):
        events.fit_vocabulary(rows, ["currency", "scale"])


def test_unknown_values_have_no_id(spark):
    from squallbars.operators import events

    schema = "id int, currency string, scale string"
    ids = events.category_ids(spark.createDataFrame([(1, "USD", "K"), (2, "EUR", None), (3, "Other", "M")], schema), ["currency", "scale"])
    assert [(r["column"], r["value"]) for r in ids.orderBy("id").collect()] == [("currency", "EUR"), ("currency", "USD"), ("scale", "K"), ("scale", "M")]
    new = spark.createDataFrame([(7, "USD", "M"), (8, "GBP", None), (9, None, "K")], schema)
    assert {r["id"]: r["ids"] for r in events.encode_sparse(new, ids, "id", ["currency", "scale"]).collect()} == {7: [1, 3], 8: [], 9: [2]}
