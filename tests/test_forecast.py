"""The path from bars and events to alerts: nothing later than its time is seen, and every model's columns are there."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallbars.functions import vocab
from squallbars.operators import alerts, history
from squallbars.plans import forecast


def test_known_stats_match_loops(spark):
    """Ranges count from the bar that completes them; a range that completes at the row's own time is known."""
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    ranges, rows = [], []
    for ticker in ("A", "B"):
        for event in ("CPI", "GDP"):
            hours = np.sort(rng.choice(400, 40, replace=False))
            for h in hours:
                late = {f"known_{k}h": start + dt.timedelta(hours=int(h) + k + int(h) % 3) if h + k < 390 else None for k in (1, 24)}
                ranges.append({"ticker": ticker, "main_event": event, "datetime": start + dt.timedelta(hours=int(h)), **late,
                               **{f"future_range_{k}h": float(rng.integers(1, 9)) if late[f"known_{k}h"] is not None else None for k in (1, 24)}})
    for ticker, event, step in (("A", "CPI", 3), ("B", "GDP", 7), ("A", "none", 50)):
        rows += [{"ticker": ticker, "main_event": event, "datetime": start + dt.timedelta(hours=h, minutes=len(event)), "x": h} for h in range(0, 420, step)]
    schema = "ticker string, main_event string, datetime timestamp, known_1h timestamp, known_24h timestamp, future_range_1h double, future_range_24h double"
    clean = [tuple(None if pd.isna(v) else v for v in (r["ticker"], r["main_event"], r["datetime"], r["known_1h"], r["known_24h"],
                                                       r["future_range_1h"], r["future_range_24h"])) for r in ranges]
    got = history.with_known_stats(spark.createDataFrame(pd.DataFrame(rows)), spark.createDataFrame(clean, schema), windows=(2, 5),
                                   horizons=(1, 24)).toPandas()
    assert len(got) == len(rows) and set(got.columns) == {"ticker", "main_event", "datetime", "x", *history.known_columns((2, 5), (1, 24))}
    for g in got.to_dict("records"):
        for k in (1, 24):
            seen = sorted((r[f"known_{k}h"], r[f"future_range_{k}h"]) for r in ranges if r["ticker"] == g["ticker"] and r["main_event"] == g["main_event"]
                          and r[f"known_{k}h"] is not None and r[f"known_{k}h"] <= g["datetime"])
            values = [v for _, v in seen]
            want = {f"prev_range_{k}h": values[-1] if values else None}
            for n in (2, 5):
                last = values[-n:]
                want |= {f"{s}_range_{k}h_{n}": f(last) if last else None for s, f in (("min", min), ("mean", np.mean), ("max", max))}
            for name, v in want.items():
                assert pd.isna(g[name]) if v is None else g[name] == pytest.approx(v), (g, name)


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    start, hours = dt.datetime(2024, 1, 1), 420
    bars = []
    for k, ticker in enumerate(("AA", "BB")):
        close = 100.0
        for h in range(hours):
            step = rng.normal() * (3 if (h // 40) % 2 else 1)
            o, close = close, max(5.0, close + step)
            bars.append((ticker, start + dt.timedelta(hours=h), o, max(o, close) + rng.random(), min(o, close) - rng.random() * 0.5, close, 10))
    events = [(i, start + dt.timedelta(hours=4 * i, minutes=15), "CPI MoM" if i % 2 else "GDP Growth Rate QoQ", i % 3 - 1) for i in range(hours // 4)]
    events = spark.createDataFrame(events, "event_id long, date timestamp, title string, importance int")
    hour = F.date_trunc("hour", "date")
    buckets = events.select(hour.alias("rounded_time"), (hour - F.expr("interval 1 hour")).alias("time_to_check"), F.lit(1).alias("news_count"),
                            (F.col("importance") == 1).cast("int").alias("high_impact_count"), F.lit(0).alias("key_event_count"),
                            F.when(F.col("event_id") % 2 == 1, "Inflation").otherwise("GDP").alias("main_event"))
    bars = spark.createDataFrame(bars, "ticker string, datetime timestamp, open double, high double, low double, close double, volume long")
    return bars, events, buckets


def test_forecast_reads_nothing_later_than_its_time(spark, market):
    bars, events, buckets = market
    now = F.lit("2024-01-15 10:30:00").cast("timestamp")
    small = {"binary": {"maxIter": 2, "maxDepth": 2}, "classes": {"numTrees": 3, "maxDepth": 2}, "quantiles": {"numTrees": 3, "maxDepth": 2, "bins": 20},
             "ordinal": {"maxIter": 2, "maxDepth": 2}}
    other = bars.withColumns({c: F.when(F.col("datetime") > now, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    inputs = [[df.orderBy("ticker", "datetime").toPandas() for df in forecast.forecast_inputs(b, events, buckets, now, 5)] for b in (bars, other)]
    for one, two in zip(*inputs):
        pd.testing.assert_frame_equal(one, two)
    training = inputs[0][0]
    assert len(training) > 100 and training.datetime.max() < pd.Timestamp("2024-01-14 11:00") and set(forecast.FEATURES) <= set(training.columns)
    model = forecast.Forecaster(options=small).fit(spark.createDataFrame(training))
    out = model.predict(spark.createDataFrame(inputs[0][1])).orderBy("ticker").toPandas()
    assert list(out.ticker) == ["AA", "BB"] and (out.datetime == pd.Timestamp("2024-01-15 10:00")).all()
    assert (out.rounded_time == pd.Timestamp("2024-01-15 12:00")).all()
    for name in forecast.NOISE:
        assert out[name].between(0, 1).all()
    for name in forecast.RANGES:
        assert all(q.p10 <= q.p50 <= q.p90 for q in out[name])
    assert out.direction_changes.notna().all() and set(out.regime_1d) | set(out.regime_2d) <= {"Trend", "Flat", "None"}
    found = alerts.alerts(forecast.states(spark.createDataFrame(out[["ticker", *forecast.NOISE, *forecast.REGIMES, "direction_changes"]]).withColumns({
        n: alerts.ordered_quantiles(F.lit(1.0), F.lit(9.0), F.lit(9.0)) for n in forecast.RANGES}))).toPandas()
    want = {(p, m, t) for p, limits in vocab.RISK_THRESHOLDS.items() for m in forecast.NOISE for t, v in zip(out.ticker, out[m]) if v > limits[m]}
    want |= {(p, c, t) for p in vocab.RISK_THRESHOLDS for c in ("movement_1h", "movement_24h") for t in out.ticker}
    assert set(found.itertuples(index=False, name=None)) == want


def test_no_bucket_ahead_gives_no_row(spark, market):
    bars, _, buckets = market
    rows = bars.withColumns({"trange": F.lit(1.0), "atr": F.lit(1.0), "kaufman_efficiency_ratio": F.lit(0.5), "prev_daily_atr": F.lit(2.0)})
    schema = "ticker string, datetime timestamp, main_event string, " + ", ".join(f"future_range_{h}h double, known_{h}h timestamp" for h in history.HORIZONS)
    empty = spark.createDataFrame([], schema)
    assert forecast.live_rows(rows, buckets, empty, F.lit("2025-01-01").cast("timestamp")).count() == 0
    some = forecast.live_rows(rows, buckets, empty, F.lit("2024-01-03").cast("timestamp"))
    assert some.count() == 2 and some.filter("prev_range_1h IS NULL").count() == 2


def test_a_label_of_one_class_is_a_share(spark):
    out = forecast._constant("SFP", 0.0)(spark.range(2)).toPandas()
    assert list(out.SFP) == [0.0, 0.0]
