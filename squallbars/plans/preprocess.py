"""Fitted preprocessing of events and prices, and their merge into training and live rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.operators import events as ev
from squallbars.operators import joins
from squallbars.operators.history import lagged_target_stats
from squallbars.plans import features

col = F.col


@dataclass
class EventPreprocessor:
    """Event buckets with a frozen vocabulary and column list."""

    method: str = "hourly"
    crop: str = "1st"
    vocabulary: dict[str, list[str]] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)

    def fit(self, events: DataFrame) -> EventPreprocessor:
        self.vocabulary = ev.fit_vocabulary(ev.event_features(events))
        self.columns = self._run(events).columns
        return self

    def transform(self, events: DataFrame) -> DataFrame:
        if not self.columns:
            raise ValueError("fit the preprocessor first")
        return ev.align(self._run(events), self.columns)

    def _run(self, events: DataFrame) -> DataFrame:
        return ev.preprocess(events, self.vocabulary, self.method, self.crop)


@dataclass
class PricePreprocessor:
    """Price features with currencies per row and a frozen column list."""

    period: int = 21
    timeframe: str = "hourly"
    columns: list[str] = field(default_factory=list)

    def fit(self, bars: DataFrame) -> PricePreprocessor:
        self.columns = self._run(bars).columns
        return self

    def transform(self, bars: DataFrame) -> DataFrame:
        out = self._run(bars)
        return ev.align(out, self.columns) if self.columns else out

    def _run(self, bars: DataFrame) -> DataFrame:
        pair = F.replace(col("ticker"), F.lit("/"), F.lit(""))
        named = bars.withColumns({"base_currency": F.left(pair, F.length(pair) - 3), "quote_currency": F.right(pair, F.lit(3))})
        return features.add_features(named, self.period, self.timeframe)


def training_rows(bars: DataFrame, events: DataFrame, preprocessor: EventPreprocessor, look_forward: int = 6) -> DataFrame:
    """Labels and light features of every bar with its due event bucket; rows without complete labels are dropped."""
    kept = ["atr", "trange", "kaufman_efficiency_ratio"]
    labelled = features.set_targets(features.label_inputs(bars), look_forward, keep=kept)
    complete = labelled.dropna(subset=[c for c in labelled.columns if c.startswith("trg_")])
    return joins.bars_with_events(complete, preprocessor.transform(events))


def event_rows(bars: DataFrame, buckets: DataFrame, look_forward: int = 6) -> DataFrame:
    """Event-centric rows: each bucket with the labels of every ticker at its due time and lagged label statistics."""
    labelled = features.set_targets(features.label_inputs(bars), look_forward)
    joined = joins.events_with_bars(buckets, labelled, "inner").withColumnsRenamed(
        {f"trg_future_range_{h}h": f"future_range_{h}h" for h in (1, 3, 6, 24)})
    return lagged_target_stats(joined, ["main_event", "ticker"], "datetime")
