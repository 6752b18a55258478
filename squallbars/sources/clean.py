"""Standardising raw extracts: types, time zones, missing values, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]


def standardize_events(raw: DataFrame) -> DataFrame:
    """Timestamps and integers coerced (bad values become null), rows without date dropped, id named event_id."""
    cols = []
    for name in raw.columns:
        c = F.col(name)
        if name in ("date", "referenceDate"):
            c = F.try_to_timestamp(c.cast("string"))
        elif name in ("id", "importance"):
            c = F.floor(c.try_cast("double")).cast("long" if name == "id" else "int")
        cols.append(c.alias("event_id" if name == "id" else name))
    return raw.select(*cols).dropna(subset=["date"])


def standardize_prices(raw: DataFrame, ticker: Column | str) -> DataFrame:
    """The six price columns from any extract: time column by name, missing OHLC columns null."""
    when = next((c for c in ("datetime", "time") if c in raw.columns), raw.columns[0])
    values = [F.col(c).try_cast("double").alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c)
              for c in OHLC]
    name = F.lit(ticker) if isinstance(ticker, str) else ticker
    return raw.select(F.try_to_timestamp(F.col(when).cast("string")).alias("datetime"), name.alias("ticker"),
                      *values).dropna(subset=["datetime"])


def merge_pages(*pages: DataFrame, key: str = "id") -> DataFrame:
    """Union of paged extracts without repeated ids."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out.dropDuplicates([key])


def truncated_pages(rows: DataFrame, page: Sequence[str], cap: int = 2000) -> DataFrame:
    """Pages whose row count reached the extract's cap and so may be incomplete."""
    return (rows.groupBy(*page).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("maybe_truncated", F.col("rows") >= cap))


def month_ranges(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """First and last day of every month between two date columns of a one-row-per-range frame."""
    first = F.explode(F.sequence(F.trunc(F.col(start), "month"), F.trunc(F.col(end), "month"),
                                 F.expr("interval 1 month")))
    return bounds.select(first.alias("first_day")).select("first_day", F.last_day("first_day").alias("last_day"))


def clean_daily(raw: DataFrame, today: Column) -> DataFrame:
    """Daily bars dated before today, with the day as ``datetime``."""
    return raw.withColumn("datetime", F.to_date("date")).drop("date").filter(F.col("datetime") < today)


def clean_epoch_bars(raw: DataFrame, digits: int = 5) -> DataFrame:
    """Terminal bars: epoch seconds to timestamps, prices rounded half-even, unused volume dropped."""
    out = raw.withColumn("datetime", F.timestamp_seconds("time")).drop("time", "real_volume")
    scale = float(10 ** digits)
    return out.select(*[(F.rint(F.col(c) * scale) / scale).alias(c) if c in OHLC else F.col(c) for c in out.columns])


def repeated_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))
