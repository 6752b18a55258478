"""Feature and label pipelines over bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.functions import times
from squallbars.operators import indicators as ind
from squallbars.operators import labels
from squallbars.operators.layout import attach, attach_small, exact_quantiles, fill_forward, over_bars, safe_chunk
from squallbars.operators.layout import Frames
from squallbars.operators.smoothing import wilder
from squallbars.session import shared

col = F.col
DAY_COLUMNS = [f"day_range_{k}" for k in (1, 2, 3, 4)] + [f"day_change_{k}" for k in (1, 2, 3, 4)] + ["prev_daily_atr"]
LAGGED = ["kaufman_efficiency_ratio", "wick_ratio", "relative_range", "zscore_atr", "fast_vs_slow_atr",
          "normalized_bb_width", "distance_from_sma", "adx", "di_spread", "tr_over_atr", "atr_short_over_long",
          "abs_log_return_sum", "vvov"]
PLAIN = ["trange", "atr", "atr_normalized", "custom_efficiency_ratio", "adxr", "dmp", "dmn", "realized_vol_short",
         "realized_vol_long", "realized_vol_ratio", "parkinson_vol", "parkinson_vol_over_atr", "log_return"]


def resample_daily(bars: DataFrame) -> DataFrame:
    """Daily OHLC from finer bars; days without bars do not appear."""
    return (bars.groupBy("ticker", F.date_trunc("day", "datetime").alias("day"))
            .agg(F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "datetime").alias("close"))
            .withColumnRenamed("day", "datetime"))


def daily_block(bars: DataFrame, period: int = 21, point_in_time: bool = False) -> DataFrame:
    """Lagged daily ranges, daily changes and the previous day's ATR, one row per day.

    ``point_in_time`` also lags the changes, which otherwise read the day's own close.
    """
    shift = 1 if point_in_time else 0

    def build(df: DataFrame, w: Frames) -> DataFrame:
        df = ind.with_atr(ind.with_true_range(df, w), w, atr=period)
        df = df.withColumn("span", col("high") - col("low"))
        cols = {f"day_range_{k}": w.lag("span", k) for k in (1, 2, 3, 4)}
        for k in (1, 2, 3, 4):
            now = w.lag("close", shift) if shift else col("close")
            cols[f"day_change_{k}"] = F.try_divide(now, w.lag("close", k + shift)) - 1
        cols["prev_daily_atr"] = w.lag("atr", 1)
        return df.select("*", *[c.alias(n) for n, c in cols.items()])

    out = over_bars(resample_daily(bars), build, back=6, unit="year", chunk_rows=safe_chunk(6, 0, period))
    return out.select("ticker", "datetime", *DAY_COLUMNS)


def attach_daily(bars: DataFrame, period: int = 21, point_in_time: bool = False) -> DataFrame:
    """Daily values on the midnight bar, carried forward; a day without one keeps the previous values."""
    joined = bars.join(daily_block(bars, period, point_in_time), ["ticker", "datetime"], "left")
    return fill_forward(joined, ["ticker"], "datetime", {c: col(c) for c in DAY_COLUMNS})


def add_features(bars: DataFrame, period: int = 21, timeframe: str = "hourly",
                 point_in_time: bool = False) -> DataFrame:
    """All price features: indicators, the daily block, time parts, sessions and 13 lag blocks."""
    hourly = timeframe == "hourly"
    slow, sma = (100, 240) if hourly else (period * 2, period)
    short = max(3, period // 3)
    long = max(short + 1, period * 3)
    n_short, n_long = max(2, period // 2), max(period + 1, period * 2)
    bars = shared(bars)
    base = attach_daily(bars, period, point_in_time) if hourly else bars

    def build(df: DataFrame, w: Frames) -> DataFrame:
        df = ind.with_true_range(df, w)
        df = df.select("*", ind.close_step(w).alias("step"), ind.log_return(w).alias("log_return"),
                       ind.log_range_squared().alias("hl2"),
                       *[c.alias(k) for k, c in ind.directional_moves(w).items()])
        df = wilder(shared(df), w, {"atr": ("trange", period), "_slow": ("trange", slow), "_sma_atr": ("trange", sma),
                            "_short": ("trange", n_short), "_long": ("trange", n_long),
                            "_sp": ("_pdm", period), "_sm": ("_mdm", period)})
        df = shared(ind.with_directional_lines(shared(df), w, period, "atr"))
        vol_s, vol_l = w.roll(F.stddev_samp, "log_return", short), w.roll(F.stddev_samp, "log_return", long)
        pk = ind.parkinson(w, period)
        cols = {
            "atr_normalized": ind.ratio("atr", "close"),
            "kaufman_efficiency_ratio": ind.efficiency_ratio(w, period),
            "custom_efficiency_ratio": ind.custom_efficiency(w, period),
            "wick_ratio": ind.body_share(),
            "relative_range": ind.zscore(w, "trange", period * 5),
            "zscore_atr": ind.zscore(w, "atr", period, eps=0),
            "fast_vs_slow_atr": ind.ratio("atr", "_slow"),
            "normalized_bb_width": F.try_divide(ind.band_width(w, period), col("atr")),
            "distance_from_sma": F.try_divide(ind.sma_gap(w, sma), col("_sma_atr")),
            "tr_over_atr": F.try_divide(col("trange"), col("atr") + ind.EPS),
            "realized_vol_short": vol_s, "realized_vol_long": vol_l,
            "realized_vol_ratio": F.try_divide(vol_s, vol_l + ind.EPS),
            "parkinson_vol": pk, "parkinson_vol_over_atr": F.try_divide(pk, col("atr") + ind.EPS),
            "atr_short_over_long": F.try_divide(col("_short"), col("_long") + ind.EPS),
            "abs_log_return_sum": w.roll(F.sum, F.abs("log_return"), short),
            "vvov": F.try_divide(w.roll(F.stddev_samp, "atr", period), w.roll(F.avg, "atr", period) + ind.EPS),
        }
        df = df.select("*", *[c.alias(n) for n, c in cols.items()])
        lags = {n: c for f in LAGGED for n, c in ind.lag_block(w, f).items()}
        return df.select("*", *[c.alias(n) for n, c in lags.items()])

    back = max(sma, period * 5, long) + 50
    out = over_bars(base, build, back=back, chunk_rows=safe_chunk(back, 0, n_short))
    extra = dict(times.parts(col("datetime")))
    if hourly:
        extra |= times.sessions(col("datetime"))
        extra["sin_hour"] = times.hour_wave(col("datetime"))["sin_hour"]
    return (out.drop("step", "hl2", "_slow", "_sma_atr", "_short", "_long")
            .select("*", *[c.alias(n) for n, c in extra.items()]))


def label_inputs(bars: DataFrame, period: int = 21) -> DataFrame:
    """Only the features that labels read: true range, ATR, efficiency ratio and the previous day's ATR."""
    base = attach_daily(shared(bars), period)

    def build(df: DataFrame, w: Frames) -> DataFrame:
        df = ind.with_true_range(df, w).withColumn("step", ind.close_step(w))
        df = ind.with_atr(df, w, atr=period)
        return df.withColumn("kaufman_efficiency_ratio", ind.efficiency_ratio(w, period))

    back = period + 1
    out = over_bars(base, build, back=back, chunk_rows=safe_chunk(back, 0, period))
    return out.select(*LABEL_INPUTS)


LABEL_INPUTS = ["ticker", "datetime", "open", "high", "low", "close", "trange", "atr", "kaufman_efficiency_ratio",
                "prev_daily_atr"]
RANGE_CAPS = {1: 10, 3: 15, 6: 20, 24: 25}
_CUTS = {"er24": "_er24", "move48": "_past48", "path6": "trg_overall_future_range_6h",
         "path24": "trg_overall_future_range_24h"}


def label_cuts(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Lower and upper quartile per ticker of several columns, in one distributed pass."""
    long = frame.select("ticker", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), col(c).cast("double").alias("value")) for n, c in columns.items()])).alias("m"))
    cuts = exact_quantiles(long.select("ticker", "m.*"), ["ticker", "metric"], "value", [0.25, 0.75])
    return cuts.groupBy("ticker").agg(*[
        F.max(F.when(col("metric") == n, col(q))).alias(f"{n}_{q}") for n in columns for q in ("q0", "q1")])


def set_targets(features: DataFrame, look_forward: int = 6, cuts: DataFrame | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """All labels, with the feature columns in ``keep`` carried along.

    ``cuts`` (from ``label_cuts`` on training rows) replaces the whole-sample quartiles.
    """
    inputs = features.select(*LABEL_INPUTS, *[c for c in keep if c not in LABEL_INPUTS])

    def build(df: DataFrame, w: Frames) -> DataFrame:
        df = df.select("*", F.abs(col("open") - col("close")).alias("body"), w.lead("close").alias("next_close"))
        cols = {}
        for h, cap in RANGE_CAPS.items():
            cols[f"trg_future_range_{h}h"] = labels.clip(F.try_divide(labels.future_range(w, h), col("atr")), high=cap)
            cols[f"trg_overall_future_range_{h}h"] = labels.future_efficiency(w, h)
        cols["trg_big_doji"] = labels.big_wick_ahead(w, 6, 0.3, 1.5)
        cols["trg_dir_changes"] = labels.direction_changes(w, look_forward)
        cols["trg_is_extremum_breakout"] = labels.double_breakout(w, 48, look_forward)
        cols["trg_is_sfp"] = labels.swing_failure(w, 24, 8)
        cols["_er24"] = w.frame(F.avg, "kaufman_efficiency_ratio", 0, 23)
        cols["_move24"] = w.lead("close", 23) - col("close")
        cols["_move48"] = w.lead("close", 47) - col("close")
        cols["_past48"] = F.abs(col("close") - w.lag("close", 48))
        return df.select("*", *[c.alias(n) for n, c in cols.items()])

    out = over_bars(inputs, build, back=50, ahead=max(49, look_forward + 1))
    if cuts is None:
        out = shared(out)
        cuts = label_cuts(out, _CUTS)
    out = attach_small(out, cuts, ["ticker"])
    slope = labels.angle(F.lit(0.0), col("_move48"), col("move48_q1"))
    changes = col("trg_dir_changes")
    final = {
        "trg_direction_1day": F.when(labels.all_of(col("_er24") > col("er24_q1"),
                                                   F.abs("_move24") > col("prev_daily_atr") * 0.70), "Trend")
        .when(labels.sure(col("_er24") < col("er24_q0")), "Flat").otherwise("None"),
        "trg_direction_2day": F.when(labels.all_of(F.abs(slope) >= 35, F.abs("_move48") > col("prev_daily_atr")), "Trend")
        .when(labels.sure(F.abs(slope) < 20), "Flat").otherwise("None"),
        "trg_is_chaos_3h": labels.all_of(changes > 2, col("trg_future_range_3h") >= 2),
        "trg_is_chaos_6h": labels.all_of(col("trg_overall_future_range_6h") >= col("path6_q1"),
                                         col("trg_future_range_6h") >= 2, changes > 1),
        "trg_is_chaos_24h": labels.all_of(col("trg_overall_future_range_24h") >= col("path24_q1"),
                                          col("trg_future_range_24h") >= 3, changes > 1),
        **{f"trg_future_range_{h}h_log": F.log1p(f"trg_future_range_{h}h") for h in RANGE_CAPS},
    }
    out = out.select("*", *[c.alias(n) for n, c in final.items()])
    return out.select("ticker", "datetime", *keep, *[c for c in out.columns if c.startswith("trg_")])
