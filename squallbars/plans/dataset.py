"""Rows for learning: a few features with one label per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.operators import indicators as ind
from squallbars.operators import joins, labels
from squallbars.operators.layout import over_bars, safe_chunk

col = F.col
FEATURES = ["tr_over_atr", "efficiency", "atr_normalized", "wick_ratio", "hour", "weekday", "news_count",
            "high_impact_count"]


def model_frame(bars: DataFrame, buckets: DataFrame, period: int = 21) -> DataFrame:
    """Features, the due event bucket, and labels of the four tasks for every bar.

    Labels are null where the future is incomplete and features where the past is: such rows are forecast all the same, and
    `labelled` leaves out those that a task cannot learn from.
    """
    def build(df, w):
        df = ind.with_true_range(df, w).withColumn("step", ind.close_step(w))
        df = ind.with_atr(df, w, atr=period)
        return df.select(
            "*", F.try_divide(col("trange"), col("atr") + ind.EPS).alias("tr_over_atr"),
            ind.efficiency_ratio(w, period).alias("efficiency"), ind.ratio("atr", "close").alias("atr_normalized"),
            ind.body_share().alias("wick_ratio"), F.hour("datetime").alias("hour"), F.weekday("datetime").alias("weekday"),
            F.try_divide(labels.future_range(w, 3), col("atr")).alias("range_3h"),
            labels.direction_changes(w, 6).alias("turns"),
            F.abs(w.lead("close", 6) - col("close")).alias("_move"))

    rows = over_bars(bars, build, back=period + 1, ahead=7, chunk_rows=safe_chunk(period + 1, 7, period))
    joined = joins.bars_with_events(rows, buckets).fillna({"news_count": 0, "high_impact_count": 0, "wick_ratio": 0.0})
    regime = labels.trend_or_flat(F.try_divide(col("_move"), col("atr")), 1.5, 0.5)
    return joined.select("ticker", "datetime", *FEATURES, labels.clip(col("range_3h"), high=15).alias("range_3h"),
                         (col("range_3h") >= 2).cast("int").alias("is_wide"), regime.alias("regime"),
                         col("turns").cast("double").alias("turns"))


def labelled(rows: DataFrame) -> DataFrame:
    """Rows whose labels are known."""
    return rows.dropna(subset=["range_3h", "is_wide", "regime", "turns"])
