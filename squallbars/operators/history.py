"""Per-key history: latest rows, statistics of the last rows, lagged statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 6, 24)
WINDOWS = (5, 20)


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Latest n rows per key. The rank limit is applied before the shuffle, so a task sees n rows per map task."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), *[F.col(t).desc() for t in ties])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def range_stats(ranges: DataFrame, keys: Sequence[str] = ("ticker", "main_event"), order: str = "datetime",
                windows: Sequence[int] = WINDOWS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Latest value and min, mean, max of the last rows per (ticker, main event) and horizon."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    ranked = ranges.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max(windows))
    aggs = [F.max(F.when(F.col("_k") == 1, F.col(f"future_range_{h}h"))).alias(f"prev_range_{h}h") for h in horizons]
    for n in windows:
        for h in horizons:
            value = F.when(F.col("_k") <= n, F.col(f"future_range_{h}h"))
            aggs += [F.min(value).alias(f"min_range_{h}h_{n}"), F.avg(value).alias(f"mean_range_{h}h_{n}"),
                     F.max(value).alias(f"max_range_{h}h_{n}")]
    return ranked.groupBy(*keys).agg(*aggs)


def lagged_stats(w, value: str | Column, n: int) -> dict[str, Column]:
    """Mean, min and max of up to n rows before the current one."""
    return {"mean": w.frame(F.avg, value, -n, -1, full=False), "min": w.frame(F.min, value, -n, -1, full=False),
            "max": w.frame(F.max, value, -n, -1, full=False)}


def lagged_target_stats(ranges: DataFrame, keys: Sequence[str], order: str = "datetime",
                        windows: Sequence[int] = WINDOWS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Mean, min, max over the previous 5 and 20 events of the same key and the previous value; missing is 0."""
    from squallbars.operators.layout import over_series

    def build(df, w):
        cols = {}
        for h in horizons:
            value = f"future_range_{h}h"
            for n in windows:
                cols |= {f"{s}_range_{h}h_{n}": c for s, c in lagged_stats(w, value, n).items()}
            cols[f"prev_range_{h}h"] = w.lag(value)
        return df.select("*", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in cols.items()])

    return over_series(ranges, build, keys, order, back=max(windows), unit="year")


def known_stats(ranges: DataFrame, windows: Sequence[int] = WINDOWS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Latest value and min, mean, max of the last rows per (ticker, main event, horizon), from the time ``known`` on.

    ``ranges`` has ``future_range_<h>h`` and ``known_<h>h``; a range that is still open has no row.
    """
    from squallbars.operators.layout import over_series

    long = ranges.select("ticker", "main_event", F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"future_range_{h}h").alias("prev"), F.col(f"known_{h}h").alias("known"))
        for h in horizons])).alias("r")).select("ticker", "main_event", "r.*").filter("prev IS NOT NULL AND known IS NOT NULL")

    def build(df, w):
        stats = {f"{name}_{n}": w.frame(agg, "prev", 1 - n, 0, full=False)
                 for n in windows for name, agg in (("min", F.min), ("mean", F.avg), ("max", F.max))}
        return df.select("*", *[c.alias(n) for n, c in stats.items()])

    return over_series(long, build, ["ticker", "main_event", "horizon"], "known", back=max(windows), unit="year")


def with_known_stats(rows: DataFrame, ranges: DataFrame, time: str = "datetime", windows: Sequence[int] = WINDOWS,
                     horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Add to each row the statistics of its (ticker, main event) that are known at its time; null where none is.

    (ticker, ``time``) identifies a row. Training rows and live rows get the same columns by the same rule, so no row looks ahead.
    All horizons go through one as-of join in long form.
    """
    from squallbars.operators.layout import asof_join

    values = ["prev", *[f"{s}_{n}" for n in windows for s in ("min", "mean", "max")]]
    asked = rows.select("ticker", "main_event", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
                        F.col(time).alias("known"), F.lit(True).alias("asked"))
    found = asof_join(asked, known_stats(ranges, windows, horizons), ["ticker", "main_event", "horizon"], "known", values)
    names = {(h, v): f"{v.split('_')[0]}_range_{h}h" + (f"_{v.split('_')[1]}" if "_" in v else "") for h in horizons for v in values}
    wide = found.groupBy("ticker", F.col("known").alias(time)).agg(*[
        F.max(F.when(F.col("horizon") == h, F.col(v))).alias(n) for (h, v), n in names.items()])
    return rows.join(wide, ["ticker", time], "left")


def known_columns(windows: Sequence[int] = WINDOWS, horizons: Sequence[int] = HORIZONS) -> list[str]:
    """Names of the columns that `with_known_stats` adds."""
    return [f"prev_range_{h}h" for h in horizons] + [f"{s}_range_{h}h_{n}" for n in windows for h in horizons for s in ("min", "mean", "max")]
