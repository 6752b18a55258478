"""Domain tables derived from the supplied Parquet tables, always over all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squallbars.functions.times import ordered_rank

CURRENCIES = ["USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "NZD"]
COUNTRIES = ["US", "DE", "GB", "JP", "AU", "CA", "CH", "NZ"]
TITLES = [
    "Core Inflation Rate YoY", "CPI MoM", "Fed Interest Rate Decision", "Non Farm Payrolls",
    "GDP Growth Rate QoQ Prel", "FOMC Minutes", "Manufacturing PMI Flash", "Services PMI Final", "PMI",
    "Retail Sales MoM", "Unemployment Rate", "Balance of Trade", "President Speech", "Presidential Election",
    "Bank Holiday", None,
]
SOURCES = ["Federal Reserve", "Bureau of Labor Statistics", "Ministry of Finance", "S&P Global", "Unknown Desk", None]
PERIODS = ["Jan", "Q3", "2024", None]
CATEGORIES = ["Prices", "Labour", "GDP", "Money", None]
SCALES = ["K", "M", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    """values[index] as an array literal lookup."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def bars_from_ticks(rows: DataFrame, rank: Column, ts: str = "ts", unit: str = "hour", price: str = "value") -> DataFrame:
    """OHLC bars by partial aggregation: one shuffle on (ticker, bar)."""
    return (rows.groupBy("ticker", F.date_trunc(unit, F.col(ts)).alias("datetime"))
            .agg(F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, rank).alias("close"), F.count(F.lit(1)).alias("volume")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), ordered_rank("ts", "event_id"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    rank = F.struct("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return bars_from_ticks(rows, rank, unit="day")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economic-calendar events, one per row of the events table."""
    i, v = F.col("event_id"), F.col("value")
    title = _pick(TITLES, F.floor(i / 7) % len(TITLES))
    previous = F.round(v * 0.95, 2)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("date"), ((i % 3) - 1).cast("int").alias("importance"),
        _pick(CURRENCIES, i % 8).alias("currency"), _pick(COUNTRIES, i % 8).alias("country"),
        title.alias("title"),
        F.when(title.rlike("Speech|Holiday"), F.lit("Calendar")).otherwise(title).alias("indicator"),
        _pick(SOURCES, i % 6).alias("source"), _pick(PERIODS, i % 4).alias("period"),
        _pick(CATEGORIES, i % 5).alias("category"), _pick(SCALES, i % 3).alias("scale"),
        v.alias("actual"), previous.alias("previous"),
        F.when(i % 10 == 0, v).otherwise(F.round((v + previous) / 2, 3)).alias("forecast"))


def indicator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("series"),
                     F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("date"))
            .agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("value")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows for metrics: binary, class, quantile and ordinal predictions."""
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.date_trunc("week", F.col("ts").cast("timestamp")).alias("fold"),
        F.col("event_type").alias("label"), (F.col("event_type") == "purchase").cast("int").alias("y_true"),
        ((i * 37) % 1000 / 1000.0).alias("score"), v.alias("actual"), (v * 0.5).alias("q10"),
        (v * (0.8 + (i % 5) / 10.0)).alias("q50"), (v * 1.7 - F.when(i % 7 == 0, v * 1.5).otherwise(0.0)).alias("q90"),
        _pick(["click", "error", "purchase", "signup", "view"], (i * 13) % 5).alias("predicted"),
        (i % 8).cast("int").alias("grade"), ((i * 29) % 90 / 10.0 - 0.5).alias("grade_pred"))


def user_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), ((k % 53) / 2.0 - 12).cast("decimal(3,1)").alias("user_timezone"),
        (k % 2 == 0).alias("daily_alerts"), (k % 3 == 0).alias("weekly_alerts"), (k % 5 == 0).alias("chaos_alerts"),
        (k % 2 == 1).alias("show_low_importance"), (k % 3 != 1).alias("show_medium_importance"),
        (k % 5 != 2).alias("show_high_importance"),
        _pick(["Conservative", "Base", "Aggressive"], k % 3).alias("ml_risk_level"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
