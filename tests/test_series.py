"""Series operators against pandas, with chunks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallbars.operators import indicators as ind
from squallbars.operators import labels
from squallbars.operators.layout import (Frames, asof_join, bucket_levels, exact_quantiles, fill_forward, number_rows, over_bars,
                                         over_series, running_totals)
from squallbars.operators.smoothing import wilder


def walk(n, ticker, seed, flat=0):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(size=n).round(2))
    if flat:
        close[:flat] = close[0]
    open_ = np.r_[close[0], close[:-1]]
    high = np.maximum(open_, close) + (0 if flat else rng.random(n).round(2))
    low = np.minimum(open_, close) - (0 if flat else rng.random(n).round(2))
    hours = np.cumsum(rng.integers(1, 30, n))
    return pd.DataFrame({"ticker": ticker, "datetime": pd.Timestamp("2020-01-01") + pd.to_timedelta(hours, "h"),
                         "open": open_, "high": high, "low": low, "close": close})


@pytest.fixture(scope="module")
def bars(spark):
    pdf = pd.concat([walk(400, "AAA", 1), walk(37, "BBB", 2), walk(1, "CCC", 3), walk(60, "DDD", 4, flat=60)])
    return pdf.reset_index(drop=True), spark.createDataFrame(pdf).repartition(5)


def per_ticker(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("ticker")]).reset_index(drop=True)


def collect(df):
    return df.toPandas().sort_values(["ticker", "datetime"]).reset_index(drop=True)


def true_range(g):
    before = g.close.shift(1)
    tr = pd.concat([g.high - g.low, (g.high - before).abs(), (g.low - before).abs()], axis=1).max(axis=1)
    return tr.where(before.notna())


def test_rolling_windows_match_pandas_across_chunks(bars):
    pdf, df = bars
    got = collect(over_bars(df, lambda d, w: d.select("*", w.roll(F.avg, "close", 21).alias("m"),
                                                     w.fwd(F.max, "high", 5).alias("f"),
                                                     w.fwd(F.sum, "close", 5, head_gap=True).alias("g"),
                                                     w.lag("close", 7).alias("l")), back=21, ahead=5, chunk_rows=32))
    want = per_ticker(pdf, lambda g: g.assign(
        m=g.close.rolling(21).mean(), f=g.high.rolling(5).max().shift(-5), g=g.close.shift(-5).rolling(5).sum(),
        l=g.close.shift(7)))
    assert len(got) == len(want)
    for c in "mfgl":
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9)


@pytest.mark.parametrize("chunk", [16, 64, 1000])
@pytest.mark.parametrize("n", [2, 14, 50])
def test_wilder_matches_recursive_mean(bars, n, chunk):
    pdf, df = bars

    def build(d, w):
        return wilder(ind.with_true_range(d, w), w, {"atr": ("trange", n)})

    got = collect(over_bars(df, build, back=4, chunk_rows=chunk if n > 2 else min(chunk, 500)))
    want = per_ticker(pdf, lambda g: g.assign(atr=true_range(g).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()))
    np.testing.assert_allclose(got.atr.astype(float), want.atr, rtol=1e-9)


def test_wilder_skips_missing_values(bars):
    pdf, df = bars
    holes = df.withColumn("x", F.when(F.dayofmonth("datetime") % 3 != 0, F.col("close")))
    got = collect(over_bars(holes, lambda d, w: wilder(d, w, {"e": ("x", 5)}, warm=0), back=2, chunk_rows=20))
    x = pdf.assign(x=pdf.close.where(pdf.datetime.dt.day % 3 != 0))
    want = per_ticker(x, lambda g: g.assign(e=g.x.ewm(alpha=1 / 5, adjust=False, min_periods=5, ignore_na=True).mean()))
    np.testing.assert_allclose(got.e.astype(float), want.e, rtol=1e-9)


def test_adx_does_not_depend_on_chunks(bars):
    _, df = bars

    def build(d, w):
        return ind.with_adx(ind.with_true_range(d, w), w, 14)

    small, large = (collect(over_bars(df, build, back=4, chunk_rows=k)) for k in (25, 2000))
    for c in ("adx", "adxr", "dmp", "dmn"):
        np.testing.assert_allclose(small[c].astype(float), large[c].astype(float), rtol=1e-8)


def test_direction_changes_and_swing_failure_match_loops(bars):
    pdf, df = bars
    n, period, ahead = 6, 24, 8

    def flips(g):
        out = [None] * len(g)
        o, h, l, c = (g[k].to_numpy() for k in ("open", "high", "low", "close"))
        for t in range(len(g) - n + 1):
            hi, lo, up, count = h[t], l[t], c[t] > o[t], 0
            for i in range(t, t + n):
                if not up and h[i] > hi:
                    hi, up, count = h[i], True, count + 1
                elif up and l[i] < lo:
                    lo, up, count = l[i], False, count + 1
            out[t] = count
        return out

    def failures(g):
        out = [0] * len(g)
        h, l, c = (g[k].to_numpy() for k in ("high", "low", "close"))
        for t in range(period, len(g) - ahead + 1):
            top, low = h[t - period:t].max(), l[t - period:t].min()
            nxt = lambda j: c[j + 1] if j + 1 < len(c) else np.nan
            bear = any((h[j] > top and c[j] <= top) or (c[j] > top and nxt(j) <= top) for j in range(t, t + ahead))
            bull = any((l[j] < low and c[j] >= low) or (c[j] < low and nxt(j) >= low) for j in range(t, t + ahead))
            last, mid = c[t + ahead - 1], (top + low) / 2
            out[t] = int((bear and last < mid) or (bull and last > mid))
        return out

    def build(d, w):
        d = d.withColumn("next_close", w.lead("close"))
        return d.select("*", labels.direction_changes(w, n).alias("flips"), labels.swing_failure(w, period, ahead).alias("sfp"))

    got = collect(over_bars(df, build, back=25, ahead=10, chunk_rows=40))
    want = per_ticker(pdf, lambda g: g.assign(flips=flips(g), sfp=failures(g)))
    assert [None if pd.isna(x) else int(x) for x in got.flips] == [None if pd.isna(x) else int(x) for x in want.flips]
    assert got.sfp.tolist() == want.sfp.tolist()
    assert got.sfp.sum() > 0


def test_features_do_not_read_the_future(bars):
    pdf, df = bars
    cut = pdf[pdf.ticker == "AAA"].datetime.iloc[300]

    def build(d, w):
        d = ind.with_atr(ind.with_true_range(d, w), w, atr=14).withColumn("step", ind.close_step(w))
        return d.select("*", ind.efficiency_ratio(w, 10).alias("er"), ind.zscore(w, "atr", 10).alias("z"))

    whole, past = (collect(over_bars(x, build, back=22, chunk_rows=64)) for x in (df, df.filter(F.col("datetime") <= cut)))
    merged = past.merge(whole, on=["ticker", "datetime"], suffixes=("", "_all"))
    assert len(merged) == len(past)
    for c in ("atr", "er", "z"):
        np.testing.assert_allclose(merged[c].astype(float), merged[f"{c}_all"].astype(float), rtol=1e-9)


def test_labels_do_not_read_past_their_horizon(bars):
    pdf, df = bars
    cut = pdf[pdf.ticker == "AAA"].datetime.iloc[200]
    moved = df.withColumn("high", F.when(F.col("datetime") > cut, F.col("high") + 50).otherwise(F.col("high")))
    run = lambda x: collect(over_bars(x, lambda d, w: d.withColumn("y", labels.future_range(w, 6)), back=1, ahead=6, chunk_rows=50))
    a, b = run(df), run(moved)
    keep = (a.ticker == "AAA") & (a.datetime <= pdf[pdf.ticker == "AAA"].datetime.iloc[194])
    np.testing.assert_allclose(a.y[keep].astype(float), b.y[keep].astype(float))
    later = (a.ticker == "AAA") & (a.datetime == cut)
    assert (a.y[later] != b.y[later]).all()


def test_flat_bars_divide_safely(bars):
    _, df = bars

    def build(d, w):
        d = ind.with_true_range(d, w).withColumn("step", ind.close_step(w))
        return d.select("*", ind.efficiency_ratio(w, 5).alias("er"), ind.body_share().alias("share"),
                        ind.custom_efficiency(w, 5).alias("ce"))

    flat = collect(over_bars(df, build, back=7)).query("ticker == 'DDD'")
    assert (flat.er.iloc[5:] == 0).all() and flat.share.isna().all() and flat.ce.isna().all()


def test_bar_without_low_has_no_range_volatility(bars):
    pdf, df = bars
    cut = pdf[pdf.ticker == "AAA"].datetime.iloc[100]
    holed = df.withColumn("low", F.when((F.col("ticker") == "AAA") & (F.col("datetime") == cut), 0.0).otherwise(F.col("low")))
    got = collect(over_bars(holed.withColumn("hl2", ind.log_range_squared()),
                            lambda d, w: d.withColumn("pk", ind.parkinson(w, 10)), back=10)).query("ticker == 'AAA'")
    assert got.pk.isna().tolist() == [i < 9 or 100 <= i < 110 for i in range(len(got))]


def test_number_rows_global_and_keyed(bars):
    pdf, df = bars
    got = number_rows(df, [], "datetime", ["ticker"], "month").toPandas().sort_values("_row")
    want = pdf.sort_values(["datetime", "ticker"])
    assert got._row.tolist() == list(range(len(pdf)))
    assert got.ticker.tolist() == want.ticker.tolist()


def test_fill_forward_and_asof(spark, bars):
    pdf, df = bars
    holes = df.withColumn("x", F.when(F.minute("datetime") + F.dayofmonth("datetime") % 5 == 0, F.col("close")))
    got = collect(fill_forward(holes, ["ticker"], "datetime", {"x": F.col("x")}))
    src = pdf.assign(x=pdf.close.where(pdf.datetime.dt.day % 5 == 0))
    want = per_ticker(src, lambda g: g.assign(x=g.x.ffill()))
    np.testing.assert_allclose(got.x.astype(float), want.x)

    right = pd.DataFrame({"datetime": pd.date_range("2020-01-03", periods=60, freq="5D"), "level": np.arange(60.0)})
    got = collect(asof_join(df, spark.createDataFrame(right), [], "datetime", ["level"]))
    want = pd.merge_asof(pdf.sort_values("datetime"), right, on="datetime").sort_values(["ticker", "datetime"])
    np.testing.assert_allclose(got.level.astype(float), want.level)
    near = collect(asof_join(df, spark.createDataFrame(right), [], "datetime", ["level"], tolerance="1 day"))
    want = pd.merge_asof(pdf.sort_values("datetime"), right, on="datetime", tolerance=pd.Timedelta("1D")).sort_values(["ticker", "datetime"])
    np.testing.assert_allclose(near.level.astype(float), want.level)


@pytest.mark.parametrize("bits", [0, 4, 20])
def test_exact_quantiles_with_a_dominant_value(spark, bits):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 3000), "x": rng.normal(size=3000) * 10.0 ** rng.integers(-3, 4, 3000)})
    pdf.loc[pdf.index % 3 == 0, "x"] = 7.5
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["k"], "x", [0.0, 0.1, 0.5, 0.9, 1.0]).toPandas().set_index("k")
    want = pdf.groupby("k").x.quantile([0.0, 0.1, 0.5, 0.9, 1.0]).unstack()
    np.testing.assert_allclose(got.loc[["a", "b"]].to_numpy(float), want.loc[["a", "b"]].to_numpy(), rtol=1e-12)
    cum = running_totals(df, ["k"], "x", {"n": F.count(F.lit(1))}, bits=bits).toPandas().sort_values(["k", "x"])
    assert (cum.cum_n == cum.groupby("k").n.cumsum()).all()


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_of_wide_values(spark, descending):
    """Values of all sizes and signs, no key: cumulative counts exact, and no window over more than 2^10 groups or the octaves."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random(20_000), rng.normal(size=5_000) * 10.0 ** rng.integers(-300, 300, 5_000), [0.0, -0.0, 5e-324, -5e-324, 1.7e308], rng.integers(-50, 50, 3_000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = running_totals(df, [], "x", {"n": F.count(F.lit(1))}, descending=descending)
    got = out.toPandas().sort_values("x", ascending=not descending)
    assert got.n.sum() == len(x) and (got.cum_n == got.n.cumsum()).all() and (got.total_n == len(x)).all()
    levels = spark.createDataFrame(pd.DataFrame({"x": x})).select(*[c.alias(f"g{i}") for i, c in enumerate(bucket_levels(F.col("x"), 20))])
    assert levels.select("g0").distinct().count() <= 4_096
    for k in (1, 2):
        groups = [f"g{i}" for i in range(k + 1)]
        assert levels.select(*groups).distinct().groupBy(*groups[:-1]).count().agg(F.max("count")).first()[0] <= 1_024


def test_result_does_not_depend_on_partitions(bars):
    _, df = bars
    run = lambda x: collect(over_series(x, lambda d, w: d.withColumn("m", w.roll(F.stddev_samp, "close", 9)), ["ticker"],
                                        "datetime", back=9, chunk_rows=30))
    pd.testing.assert_frame_equal(run(df.coalesce(1)), run(df.repartition(13, "close")))
    assert isinstance(Frames(["ticker"], "datetime"), Frames)
