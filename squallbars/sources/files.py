"""CSV scans with declared schemas, and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars import schemas
from squallbars.sources.clean import standardize_events


def _series_name() -> Column:
    """Name before ``_H1.csv`` or ``.csv``, or the value of the innermost ``key=value`` folder."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, r"=([^/=]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+?)(?:_H1)?\.csv[^/]*$", 1))


def read_comma_bars(spark: SparkSession, path: str) -> DataFrame:
    """One comma file per pair with a header: datetime, open, high, low, close."""
    return (spark.read.schema(schemas.COMMA_BARS).option("header", True).option("recursiveFileLookup", True).csv(path)
            .select(_series_name().alias("ticker"), F.try_to_timestamp("datetime").alias("datetime"),
                    "open", "high", "low", "close"))


def read_tab_bars(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """One tab file per pair without names: time, open, high, low, close, volume, spread."""
    return (spark.read.schema(schemas.TAB_BARS).option("sep", "\t").option("header", header)
            .option("recursiveFileLookup", True).csv(path)
            .select(_series_name().alias("ticker"), F.try_to_timestamp("time").alias("datetime"), "open", "high", "low",
                    "close", "volume", "spread"))


def read_calendar(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Calendar file pruned to the wanted columns, with UTC dates, in time order."""
    rows = spark.read.schema(schemas.CALENDAR_CSV).option("header", True).csv(path)
    return standardize_events(rows).select(*columns).orderBy("date", "event_id")


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """A folder of two-column series; the file or folder names the series, the last value of a date wins."""
    rows = (spark.read.schema(schemas.INDICATOR_CSV).option("header", True).option("recursiveFileLookup", True).csv(path)
            .select(_series_name().alias("series"), F.try_to_timestamp("date").alias("date"),
                    F.col("value").try_cast("double").alias("value")))
    return rows.dropna(subset=["date"])


def write_csv(df: DataFrame, path: str, by: Sequence[str] = (), sep: str = ",", header: bool = True,
              mode: str = "errorifexists") -> None:
    """CSV per key: rows of a key are spread over tasks by file size, not gathered in one."""
    writer = df.write.mode(mode).option("header", header).option("sep", sep)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_table(df: DataFrame, path: str, if_exists: str = "append", by: Sequence[str] = ()) -> None:
    """Append to or replace a Parquet table."""
    writer = df.write.mode({"append": "append", "replace": "overwrite"}[if_exists])
    (writer.partitionBy(*by) if by else writer).parquet(path)
