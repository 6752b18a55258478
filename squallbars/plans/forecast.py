"""From bars and events to alerts: training rows, the row of the next event per ticker, eleven models, flags and alerts.

Everything is taken as of one time: bars after it, and ranges that were still open then, are not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.operators import alerts, history, joins, learners
from squallbars.operators import indicators as ind
from squallbars.plans import features
from squallbars.plans.refresh import event_ranges
from squallbars.session import shared

col = F.col
PRICE = ["tr_over_atr", "efficiency", "atr_normalized", "atr_over_daily", "wick_ratio", "hour", "weekday"]
EVENT = ["news_count", "high_impact_count", "key_event_count"]
FEATURES = [*PRICE, *EVENT, *history.known_columns()]
NOISE = {"SFP": "trg_is_sfp", "Extremum Breakout": "trg_is_extremum_breakout", "Big Spike": "trg_big_doji", "Chaos": "trg_is_chaos_24h"}
REGIMES = {"regime_1d": "trg_direction_1day", "regime_2d": "trg_direction_2day"}
RANGES = {f"range_{h}h": f"trg_future_range_{h}h" for h in history.HORIZONS}
SWINGS = "trg_dir_changes"
TARGETS = [*NOISE.values(), *REGIMES.values(), *RANGES.values(), SWINGS]
MOST_SWINGS = 24


def price_features() -> list[Column]:
    """Features of a bar from the columns that labels read."""
    named = {"tr_over_atr": F.try_divide(col("trange"), col("atr")), "efficiency": col("kaufman_efficiency_ratio"),
             "atr_normalized": F.try_divide(col("atr"), col("close")), "atr_over_daily": F.try_divide(col("atr"), col("prev_daily_atr")),
             "wick_ratio": ind.body_share(), "hour": F.hour("datetime"), "weekday": F.weekday("datetime")}
    return [named[n].alias(n) for n in PRICE]


def as_of(bars: DataFrame, now: Column) -> DataFrame:
    return bars.filter(col("datetime") <= now)


def training_rows(priced: DataFrame, buckets: DataFrame, ranges: DataFrame, look_forward: int = 6) -> DataFrame:
    """A row for each ticker at the due time of each bucket: features, the range history known then, and complete labels.

    ``priced`` comes from `features.label_inputs`, ``ranges`` from `event_ranges` with ``known``.
    """
    labelled = features.set_targets(priced, look_forward, keep=[c for c in features.LABEL_INPUTS if c not in ("ticker", "datetime")])
    rows = joins.events_with_bars(buckets, labelled.dropna(subset=TARGETS), "inner")
    rows = rows.select("ticker", "datetime", "main_event", *price_features(), *EVENT, *[col(t) for t in TARGETS])
    return history.with_known_stats(rows, ranges)


def live_rows(priced: DataFrame, buckets: DataFrame, ranges: DataFrame, now: Column) -> DataFrame:
    """One row per ticker: its last bar, the next bucket after ``now`` and the range history known at that bar.

    No row where no bucket follows.
    """
    rows = joins.latest_with_next(priced, buckets, now).filter(col("rounded_time").isNotNull())
    rows = rows.select("ticker", "datetime", "close", "rounded_time", "main_event", *price_features(), *EVENT)
    return history.with_known_stats(rows, ranges)


Score = Callable[[DataFrame], DataFrame]


@dataclass
class Forecaster:
    """Models of four kinds of noise, two regimes, four ranges and the number of swings."""

    columns: Sequence[str] = field(default_factory=lambda: FEATURES)
    options: dict[str, dict] = field(default_factory=dict)
    scores: dict[str, Score] = field(default_factory=dict)

    def fit(self, rows: DataFrame) -> Forecaster:
        """Fit every model; ``options`` has learner parameters by kind (binary, classes, quantiles, ordinal).

        A noise label of one class only has no model: its probability is the share of that class.
        Rows are dealt and sorted by (ticker, datetime) first, since forests draw rows by their place: reruns agree.
        """
        rows = rows.repartition("ticker", "datetime").sortWithinPartitions("ticker", "datetime")
        rows = shared(rows.withColumns({t: col(t).cast("int") for t in NOISE.values()} | {SWINGS: col(SWINGS).cast("double")}))
        shares = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(t) for t in NOISE.values()]).first()
        if not shares["n"]:
            raise ValueError("no training row has all labels")
        own = {k: self.options.get(k, {}) for k in ("binary", "classes", "quantiles", "ordinal")}
        for name, t in NOISE.items():
            fitted = learners.fit_binary(self.columns, t, **own["binary"])(rows) if 0 < shares[t] < 1 else None
            self.scores[name] = _adding(fitted, {name: col("prob")}) if fitted else _constant(name, float(shares[t]))
        for name, t in REGIMES.items():
            self.scores[name] = _adding(learners.fit_classes(self.columns, t, **own["classes"])(rows), {name: col("predicted")}, t)
        for name, t in RANGES.items():
            q = alerts.ordered_quantiles(col("pred_q1"), col("pred_q5"), col("pred_q9"))
            self.scores[name] = _adding(learners.fit_quantiles(self.columns, t, **own["quantiles"])(rows), {name: q})
        swings = learners.fit_ordinal(self.columns, SWINGS, MOST_SWINGS, **own["ordinal"])(rows)
        self.scores["direction_changes"] = _adding(swings, {"direction_changes": F.round("y_continuous", 2)})
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows with a probability per kind of noise, the regimes, ordered quantiles of the ranges, and swings."""
        for score in self.scores.values():
            rows = score(rows)
        return rows


def _adding(score: Score, new: dict[str, Column], label: str | None = None) -> Score:
    """A model's scores as new columns beside all others; ``label`` stands for the indexed label that live rows lack."""
    def add(df: DataFrame) -> DataFrame:
        given = df if label is None or label in df.columns else df.withColumn(label, F.lit(None).cast("string"))
        return score(given).select(*df.columns, *[c.alias(n) for n, c in new.items()])

    return add


def _constant(name: str, share: float) -> Score:
    return lambda df: df.withColumn(name, F.lit(share))


def states(predicted: DataFrame) -> DataFrame:
    """Market state per ticker, from probabilities and the thresholds of each risk profile."""
    return alerts.market_state(predicted.withColumns({m: alerts.risk_flags(col(m), m) for m in NOISE}))


def forecast_inputs(bars: DataFrame, events: DataFrame, buckets: DataFrame, now: Column, period: int = 21) -> tuple[DataFrame, DataFrame]:
    """Training rows and live rows of what was known at ``now``.

    ``buckets`` have ``rounded_time``, ``time_to_check``, ``main_event`` and the counts.
    """
    past = shared(as_of(bars, now))
    priced = shared(features.label_inputs(past, period))
    ranges = shared(event_ranges(past, events, known=True))
    return training_rows(priced, buckets, ranges), live_rows(priced, buckets, ranges, now)


def next_event_forecast(bars: DataFrame, events: DataFrame, buckets: DataFrame, now: Column, period: int = 21,
                        options: dict[str, dict] | None = None) -> DataFrame:
    """Fit on what was known at ``now`` and forecast the next bucket for every ticker: `live_rows` with predictions."""
    training, live = forecast_inputs(bars, events, buckets, now, period)
    return Forecaster(options=options or {}).fit(training).predict(shared(live))
