"""Forward-looking labels as column builders over a laid-out frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from squallbars.operators.layout import ROW, Frames

col = F.col


def sure(test: Column) -> Column:
    """A predicate on missing values is false."""
    return F.coalesce(test, F.lit(False))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if high is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(float(high))))
    if low is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(float(low))))
    return out


def future_range(w: Frames, n: int, skip: int = 0, head_gap: bool = False) -> Column:
    """Highest high minus lowest low over rows t+1+skip..t+n+skip."""
    out = w.frame(F.max, "high", 1 + skip, n + skip) - w.frame(F.min, "low", 1 + skip, n + skip)
    return F.when(col(ROW) >= n - 1, out) if head_gap else out


def future_path(w: Frames, n: int) -> Column:
    return w.fwd(F.sum, "trange", n, head_gap=True)


def future_efficiency(w: Frames, n: int) -> Column:
    """Sum of bar ranges over the total range ahead."""
    return F.try_divide(w.fwd(F.sum, col("high") - col("low"), n, head_gap=True),
                        future_range(w, n, head_gap=True) + 1e-6)


def future_trend_strength(w: Frames, c: str, n: int, strong: float = 30) -> Column:
    top = w.fwd(F.max, c, n, head_gap=True)
    return F.when(top > strong, top).otherwise(w.fwd(F.min, c, n, head_gap=True))


def big_wick_ahead(w: Frames, n: int = 4, share: float = 0.5, atr_coef: float = 1) -> Column:
    """1 when any of the next bars is long against ATR with a small body; needs ``body``."""
    flag = sure((col("trange") > col("atr") * atr_coef) & (F.try_divide(col("body"), col("trange")) < share))
    return F.coalesce(w.frame(F.max, flag.cast("int"), 1, n, full=False), F.lit(0))


def volatility_grade(w: Frames, n: int = 4, grades: int = 7) -> Column:
    """Largest k with the n-bar range ahead above k ATR."""
    ahead, out = future_range(w, n, head_gap=True), None
    for k in range(grades, 0, -1):
        test = ahead > col("atr") * k
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(0)


def double_breakout(w: Frames, channel: int, n: int) -> Column:
    """Both ends of a channel that ends at the next bar are exceeded within n bars."""
    top, low = w.frame(F.max, "high", 2 - channel, 1), w.frame(F.min, "low", 2 - channel, 1)
    return sure((w.fwd(F.max, "high", n, head_gap=True) > top) & (w.fwd(F.min, "low", n, head_gap=True) < low))


def bars_ahead(w: Frames, n: int, *fields: str) -> Column:
    """Array of the n bars from t on, null near the end of the series."""
    bar = F.struct(*[col(f) for f in fields])
    return w.frame(F.collect_list, bar, 0, n - 1)


def direction_changes(w: Frames, n: int) -> Column:
    """Flips between new highs and new lows over n bars; an extreme moves only on a flip."""
    bars = bars_ahead(w, n, "open", "high", "low", "close")
    first = bars[0]
    start = F.struct(first["low"].alias("lo"), first["high"].alias("hi"),
                     (first["close"] > first["open"]).alias("up"), F.lit(0).alias("flips"))

    def step(acc: Column, bar: Column) -> Column:
        to_up, to_down = ~acc["up"] & (bar["high"] > acc["hi"]), acc["up"] & (bar["low"] < acc["lo"])
        return F.struct(
            F.when(to_down, bar["low"]).otherwise(acc["lo"]).alias("lo"),
            F.when(to_up, bar["high"]).otherwise(acc["hi"]).alias("hi"),
            F.when(to_up, True).when(to_down, False).otherwise(acc["up"]).alias("up"),
            (acc["flips"] + F.when(to_up | to_down, 1).otherwise(0)).alias("flips"))

    return F.when(bars.isNotNull(), F.aggregate(bars, start, step, lambda acc: acc["flips"]))


def swing_failure(w: Frames, period: int, n: int) -> Column:
    """1 when a channel break fails within n bars and the last close crosses its middle; needs ``next_close``."""
    top, low = w.frame(F.max, "high", -period, -1), w.frame(F.min, "low", -period, -1)
    bars = bars_ahead(w, n, "high", "low", "close", "next_close")
    middle = (top + low) / 2

    def fails_up(b: Column) -> Column:
        return ((b["high"] > top) & (b["close"] <= top)) | sure((b["close"] > top) & (b["next_close"] <= top))

    def fails_down(b: Column) -> Column:
        return ((b["low"] < low) & (b["close"] >= low)) | sure((b["close"] < low) & (b["next_close"] >= low))

    last = bars[n - 1]["close"]
    hit = (F.exists(bars, fails_up) & (last < middle)) | (F.exists(bars, fails_down) & (last > middle))
    return sure(hit).cast("int")


def trend_or_flat(strength: Column, trend: float, flat: float) -> Column:
    return F.when(strength > trend, "Trend").when(strength < flat, "Flat").otherwise("None")


def angle(first: Column, last: Column, unit_move: Column) -> Column:
    return F.degrees(F.atan(F.try_divide(last - first, unit_move)))


def breakout_category(w: Frames, n: int = 8, spans: tuple[int, ...] = (24, 48, 96, 144)) -> Column:
    """Rank of the longest look-back whose high and low are both exceeded ahead; 0 if none."""
    top, low = w.fwd(F.max, "high", n, head_gap=True), w.fwd(F.min, "low", n, head_gap=True)
    out = None
    for rank in range(len(spans), 0, -1):
        span = spans[rank - 1]
        test = (top > w.roll(F.max, "high", span)) & (low < w.roll(F.min, "low", span))
        out = F.when(test, rank) if out is None else out.when(test, rank)
    return out.otherwise(0)


def stop_run(w: Frames, n: int, stop: float, neutral: float = 0.3, head_gap: bool = True) -> dict[str, Column]:
    """Expansion (range over 3 ATR), whipsaw (both stops hit), and whether price came back."""
    top, low = w.fwd(F.max, "high", n, head_gap=head_gap), w.fwd(F.min, "low", n, head_gap=head_gap)
    close, reach = col("close"), col("atr") * stop
    expansion = sure(top - low > col("atr") * 3)
    whipsaw = sure((top > close + reach) & (low < close - reach))
    returned = sure(F.abs(w.lead("close", n) - close) < col("atr") * neutral)
    return {"expansion": expansion.cast("int"), "chaos": (expansion | whipsaw).cast("int"),
            "neutral_chaos": (whipsaw & returned).cast("int"), "strong_move": (whipsaw & ~returned).cast("int")}


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, [sure(t) for t in tests])
