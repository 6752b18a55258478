"""Technical indicators as column builders over a laid-out frame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squallbars.operators.layout import Frames
from squallbars.operators.smoothing import wilder

EPS = 1e-9
col = F.col


def true_range(w: Frames) -> Column:
    before = w.lag("close")
    return F.when(before.isNotNull(), F.greatest(
        col("high") - col("low"), F.abs(col("high") - before), F.abs(col("low") - before)))


def with_true_range(df: DataFrame, w: Frames) -> DataFrame:
    return df.withColumn("trange", true_range(w))


def with_atr(df: DataFrame, w: Frames, **periods: int) -> DataFrame:
    """Add one ATR column per ``name=period``; needs ``trange``."""
    return wilder(df, w, {name: ("trange", n) for name, n in periods.items()})


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, b)


def zscore(w: Frames, c: str, n: int, eps: float = EPS) -> Column:
    spread = w.roll(F.stddev_samp, c, n)
    return F.try_divide(col(c) - w.roll(F.avg, c, n), spread + eps if eps else spread)


def efficiency_ratio(w: Frames, n: int) -> Column:
    """Net move over path length; 0 on a flat path, null while the path is incomplete. Needs ``step``."""
    path = w.roll(F.sum, "step", n)
    return F.when(path == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(col("close") - w.lag("close", n)), path))


def close_step(w: Frames) -> Column:
    return F.abs(col("close") - w.lag("close"))


def window_range(w: Frames, n: int) -> Column:
    return w.roll(F.max, "high", n) - w.roll(F.min, "low", n)


def custom_efficiency(w: Frames, n: int) -> Column:
    return F.try_divide(w.roll(F.sum, "trange", n), window_range(w, n))


def body_share(eps: float = EPS) -> Column:
    """Candle body over true range; eps is added after the division."""
    return F.try_divide(F.abs(col("open") - col("close")), col("trange")) + eps


def band_width(w: Frames, n: int, width: float = 3.0, ddof: int = 0) -> Column:
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    return 2 * width * w.roll(spread, "close", n)


def sma_gap(w: Frames, n: int) -> Column:
    """Distance of the outer wick from the moving average."""
    sma = w.roll(F.avg, "close", n)
    return F.when(F.coalesce(col("close") > sma, F.lit(False)), col("high") - sma).otherwise(sma - col("low"))


def log_return(w: Frames) -> Column:
    growth = F.try_divide(col("close"), w.lag("close"))
    return F.when(growth > 0, F.ln(growth))


def log_range_squared() -> Column:
    share = F.try_divide(col("high"), F.when(col("low") != 0, col("low")))
    return F.when(share.isNotNull(), F.pow(F.ln(F.greatest(share, F.lit(1e-12))), 2))


def parkinson(w: Frames, n: int) -> Column:
    """Needs ``hl2`` = squared log range; null when a bar has no low."""
    return F.sqrt(w.roll(F.avg, "hl2", n) / (4 * math.log(2)))


def directional_moves(w: Frames) -> dict[str, Column]:
    """Up and down moves of the extremes; the smaller one counts as zero."""
    up, down = col("high") - w.lag("high"), w.lag("low") - col("low")
    return {"_pdm": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0),
            "_mdm": F.when((down > up) & (down > 0), down).when(down.isNotNull(), 0.0)}


def with_directional_lines(df: DataFrame, w: Frames, n: int, smooth_range: str, lag_adxr: int = 2) -> DataFrame:
    """adx, adxr, dmp, dmn, di_spread from the smoothed range and smoothed moves ``_sp``, ``_sm``."""
    lines = df.select("*", (100 * ratio("_sp", smooth_range)).alias("dmp"),
                      (100 * ratio("_sm", smooth_range)).alias("dmn"))
    spread = lines.withColumn("_dx", F.when(col("dmp").isNotNull(), F.coalesce(
        100 * F.try_divide(F.abs(col("dmp") - col("dmn")), col("dmp") + col("dmn")), F.lit(0.0))))
    out = wilder(spread, w, {"adx": ("_dx", n)})
    return out.select("*", ((col("adx") + w.lag("adx", lag_adxr)) / 2).alias("adxr"),
                      (col("dmp") - col("dmn")).alias("di_spread")).drop("_pdm", "_mdm", "_sp", "_sm", "_dx")


def with_adx(df: DataFrame, w: Frames, n: int, lag_adxr: int = 2) -> DataFrame:
    """Wilder directional movement index; needs ``trange``."""
    moves = df.select("*", *[c.alias(k) for k, c in directional_moves(w).items()])
    smooth = wilder(moves, w, {"_str": ("trange", n), "_sp": ("_pdm", n), "_sm": ("_mdm", n)})
    return with_directional_lines(smooth, w, n, "_str", lag_adxr).drop("_str")


def lag_block(w: Frames, f: str) -> dict[str, Column]:
    """Lags, rolling means, day extremes, position in the day range and session change of one feature."""
    low, high = w.roll(F.min, f, 24), w.roll(F.max, f, 24)
    span = F.when(high - low == 0, F.lit(1e-6)).otherwise(high - low)
    return {
        **{f"{f}_lag_{k}": w.lag(f, k) for k in (1, 8, 24, 48)},
        f"{f}_roll_mean_4": w.roll(F.avg, f, 4),
        f"{f}_roll_mean_8": w.roll(F.avg, f, 8),
        f"{f}_roll_min_24": low,
        f"{f}_roll_max_24": high,
        f"{f}_relative_position_24": F.try_divide(col(f) - low, span),
        f"{f}_diff_8": col(f) - w.lag(f, 8),
    }


def rolling_entropy(w: Frames, c: str, n: int, bins: int = 10) -> Column:
    """Base-2 entropy of an equal-width histogram of the last n values; needs the frame to be full."""
    values = w.frame(F.collect_list, c, -(n - 1), 0)
    low, high = F.array_min(values), F.array_max(values)
    width = F.when(high > low, (high - low) / bins)

    def bin_of(x: Column) -> Column:
        place = F.floor((x - F.when(high > low, low).otherwise(low - 0.5)) / F.coalesce(width, F.lit(1.0 / bins)))
        return F.least(place, F.lit(bins - 1)).cast("int")

    placed = F.transform(values, bin_of)
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                         lambda b: F.size(F.filter(placed, lambda p: p == b)) / F.lit(float(n)))
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


TRIPLES = ("volume", "range", "dni")


def before_windows(w: Frames, k: int) -> dict[str, Column]:
    """Volume sum, 3-bar range and directional noise of the window that ends one bar ago; needs ``body``."""
    return {f"volume_{k}_before": w.frame(F.sum, "volume", -k, -1),
            f"range_{k}_before": w.frame(F.max, "high", -3, -1) - w.frame(F.min, "low", -3, -1),
            f"dni_{k}_before": F.try_divide(w.frame(F.sum, "body", -k, -1), w.frame(F.sum, "trange", -k, -1))}


def before_after(w: Frames, name: str, k: int) -> dict[str, Column]:
    """A window's value, the value k+1 bars later, and their ratio; needs the ``before`` column."""
    before, after = col(f"{name}_{k}_before"), w.lead(f"{name}_{k}_before", k + 1)
    return {f"{name}_{k}_before": before, f"{name}_{k}_after": after,
            f"{name}_{k}_ratio": F.try_divide(before.cast("double"), after)}


HURST_SIZES = (8, 12, 16, 24, 32, 48)


@F.pandas_udf(T.DoubleType())
def hurst_exponent(windows: pd.Series) -> pd.Series:
    """Rescaled-range slope of log increments over sub-windows of full windows, all of one length; null for others."""
    out = pd.Series(np.nan, index=windows.index, dtype=float)
    full = windows[windows.notna()]
    if len(full):
        out[full.index] = rescaled_range(np.array(full.tolist(), dtype=float))
    return out.astype(object).where(out.notna(), None)


def rescaled_range(prices: np.ndarray) -> np.ndarray:
    """Slopes for a matrix with a window in each row; NaN where a price isn't positive or fewer than two sizes count.

    A size counts where one of its blocks varies at least. Slopes are least squares of log mean ranges on log sizes.
    """
    with np.errstate(all="ignore"):
        steps = np.diff(np.log(np.where(prices > 0, prices, np.nan)), axis=1)
        sizes = [s for s in HURST_SIZES if s <= steps.shape[1] // 2]
        logs = []
        for size in sizes:
            blocks = steps[:, :steps.shape[1] // size * size].reshape(len(steps), -1, size)
            walk = np.cumsum(blocks - blocks.mean(axis=2, keepdims=True), axis=2)
            spread = blocks.std(axis=2)
            ratio = np.where(spread > 0, (walk.max(axis=2) - walk.min(axis=2)) / spread, np.nan)
            varied = (spread > 0).sum(axis=1)
            logs.append(np.log(np.where(varied > 0, np.nansum(ratio, axis=1) / varied, np.nan)))
        y = np.array(logs).T
        x = np.where(np.isnan(y), np.nan, np.log(np.array(sizes, dtype=float)))
        counted = (~np.isnan(y)).sum(axis=1)
        x0, y0 = (np.nansum(v, axis=1) / counted for v in (x, y))
        dx = x - x0[:, None]
        slope = np.nansum(dx * (y - y0[:, None]), axis=1) / np.nansum(dx * dx, axis=1)
    return np.where((counted >= 2) & ~np.isnan(steps).any(axis=1), slope, np.nan)
