"""Declared schemas of the stored tables and of the raw files."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


L, I, S, D, TS, B = (T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType())

EVENTS = _struct(
    ("event_id", L), ("title", S), ("country", S), ("indicator", S), ("category", S), ("period", S),
    ("referenceDate", TS), ("source", S), ("source_url", S), ("actual", D), ("previous", D), ("forecast", D),
    ("actualRaw", D), ("previousRaw", D), ("forecastRaw", D), ("currency", S), ("importance", I), ("date", TS),
    ("ticker", S), ("unit", S), ("comment", S), ("scale", S),
)
PRICES = _struct(("datetime", TS), ("ticker", S), ("open", D), ("high", D), ("low", D), ("close", D))
DAILY_PRICES = PRICES
RANGES = _struct(
    ("ticker", S), ("datetime", TS), ("main_event", S), ("future_range_1h", D), ("future_range_3h", D),
    ("future_range_6h", D), ("future_range_24h", D),
)
QUANTILES = _struct(("p10", D), ("p50", D), ("p90", D))
PREDICTIONS = _struct(
    ("rounded_date", TS), ("ticker", S), ("range_1h", QUANTILES), ("range_3h", QUANTILES), ("range_6h", QUANTILES),
    ("range_24h", QUANTILES), ("is_chaos", I), ("is_breakout", I), ("is_spike", I), ("is_sfp", I),
)
USER_SETTINGS = _struct(
    ("user_id", L), ("user_timezone", T.DecimalType(3, 1)), ("daily_alerts", B), ("weekly_alerts", B),
    ("chaos_alerts", B), ("show_low_importance", B), ("show_medium_importance", B), ("show_high_importance", B),
    ("ml_risk_level", S),
)
COMMA_BARS = _struct(("datetime", S), ("open", D), ("high", D), ("low", D), ("close", D))
TAB_BARS = _struct(("time", S), ("open", D), ("high", D), ("low", D), ("close", D), ("volume", L), ("spread", I))
CALENDAR_CSV = _struct(
    ("id", S), ("title", S), ("country", S), ("indicator", S), ("period", S), ("source", S), ("currency", S),
    ("importance", S), ("date", S), ("actual", S), ("previous", S), ("forecast", S),
)
INDICATOR_CSV = _struct(("date", S), ("value", S))
