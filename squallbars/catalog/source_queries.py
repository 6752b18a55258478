"""Queries over sources, sinks, predicates, sorting and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from squallbars.catalog.registry import query, r
from squallbars.catalog.sql import with_tables
from squallbars.catalog.text_queries import FEATURE_SQL, FLAG_SQL, HI, LO, NOW
from squallbars.operators import aggregates as agg
from squallbars.operators import events as ev
from squallbars.session import shared, shared_dir
from squallbars.sources import clean, files, inputs, store
from squallbars.sources.merge_store import MergeStore, by_ticker_and_month

col = F.col
KEY = ["ticker", "datetime"]
OHLC = clean.OHLC


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# ---- file scans and sinks ---------------------------------------------------------------------------
@query("s01_comma_bars", with_tables("bars", body="SELECT ticker, datetime, open, high, low, close FROM bars"))
def comma_bars(spark, sf_dir):
    path = _fresh(spark, "comma")
    rows = inputs.bars(spark, sf_dir).select("ticker", _text("datetime").alias("datetime"), *OHLC)
    files.write_csv(rows, path, ["ticker"])
    return files.read_comma_bars(spark, path)


@query("s02_tab_bars", with_tables("dbars", body="SELECT ticker, datetime, open, high, low, close, volume, 2 AS spread FROM dbars"))
def tab_bars(spark, sf_dir):
    path = _fresh(spark, "tab")
    rows = inputs.daily_bars(spark, sf_dir).select("ticker", _text("datetime").alias("time"), *OHLC, "volume",
                                                   F.lit(2).alias("spread"))
    files.write_csv(rows, path, ["ticker"], sep="\t", header=False)
    return files.read_tab_bars(spark, path)


@query("s03_calendar_scan", with_tables("calendar", body="SELECT event_id, title, currency, importance, date_trunc('second', date) AS date FROM calendar"))
def calendar_scan(spark, sf_dir):
    path = _fresh(spark, "calendar")
    rows = inputs.calendar(spark, sf_dir).select(
        col("event_id").cast("string").alias("id"), "title", "country", "indicator", "period", "source", "currency",
        col("importance").cast("string").alias("importance"), _text("date").alias("date"), "actual", "previous", "forecast")
    files.write_csv(rows, path)
    return files.read_calendar(spark, path, ["event_id", "title", "currency", "importance", "date"])


@query("s04_indicator_folder", with_tables("series", body="SELECT series, date, value FROM series"))
def indicator_folder(spark, sf_dir):
    path = _fresh(spark, "indicators")
    rows = inputs.indicator_series(spark, sf_dir).select("series", _text("date").alias("date"), "value")
    files.write_csv(rows, path, ["series"])
    return files.read_indicators(spark, path)


@query("s05_table_scan", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def table_scan(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", col("o_orderdate").cast("timestamp").alias("o_orderdate"),
                                                        "o_totalprice")


@query("s06_csv_sink", with_tables("dbars", body="SELECT ticker, year(datetime) AS year, count(*) AS rows FROM dbars GROUP BY 1, 2"))
def csv_sink(spark, sf_dir):
    path = _fresh(spark, "sink")
    rows = inputs.daily_bars(spark, sf_dir).withColumn("year", F.year("datetime"))
    files.write_csv(rows, path, ["ticker", "year"])
    back = spark.read.schema("open double, high double, low double, close double, volume long, ticker string, year long").csv(path, header=True)
    return back.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("rows"))


@query("s07_append_and_replace", with_tables("bars", body=f"""
SELECT ticker, count(*) AS rows, max(datetime) AS latest FROM bars WHERE datetime < TIMESTAMP '{HI}' GROUP BY 1"""))
def append_and_replace(spark, sf_dir):
    path = _fresh(spark, "prices")
    rows = inputs.bars(spark, sf_dir)
    files.write_table(rows, path, "replace")
    files.write_table(rows.filter(col("datetime") < F.lit(LO).cast("timestamp")), path, "replace")
    files.write_table(rows.filter(col("datetime").between(F.lit(LO).cast("timestamp"), F.lit(HI).cast("timestamp"))
                                  & (col("datetime") < F.lit(HI).cast("timestamp"))), path, "append")
    return spark.read.schema(rows.schema).parquet(path).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"),
                                                                             F.max("datetime").alias("latest"))


# ---- merging ----------------------------------------------------------------------------------------
@query("s08_upsert_prices", with_tables("bars", body=f"""
SELECT ticker, datetime, CASE WHEN datetime >= TIMESTAMP '{LO}' THEN round(close + 1, 6) ELSE close END AS close FROM bars"""))
def upsert_prices(spark, sf_dir):
    rows = shared(inputs.bars(spark, sf_dir).select(*KEY, "close"))
    new = rows.filter(col("datetime") >= F.lit(LO).cast("timestamp"))
    twice = new.withColumn("seq", F.lit(1)).unionByName(new.withColumns({"close": r(col("close") + 1), "seq": F.lit(2)}))
    kept = MergeStore.create(rows.filter(col("datetime") < F.lit(HI).cast("timestamp")), _fresh(spark, "prices"), KEY, by_ticker_and_month())
    kept.merge(twice, ["seq"])
    return kept.read()


@query("s09_insert_if_absent", with_tables("calendar", body=f"""
SELECT event_id, title FROM calendar WHERE date >= TIMESTAMP '{HI}'"""))
def insert_if_absent(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir)
    stored = rows.filter(col("date") < F.lit(HI).cast("timestamp"))
    return store.insert_absent(stored, rows.unionByName(rows), "event_id").select("event_id", "title")


@query("s10_upsert_ranges", with_tables("bars", body=f"""
SELECT ticker, datetime, 'GDP' AS main_event, CASE WHEN datetime >= TIMESTAMP '{LO}' THEN round(high - low + 1, 6)
  ELSE round(high - low, 6) END AS future_range_1h FROM bars"""))
def upsert_ranges(spark, sf_dir):
    rows = shared(inputs.bars(spark, sf_dir)).select(*KEY, F.lit("GDP").alias("main_event"), r(col("high") - col("low")).alias("future_range_1h"))
    new = rows.filter(col("datetime") >= F.lit(LO).cast("timestamp")).withColumn("future_range_1h", r(col("future_range_1h") + 1))
    kept = MergeStore.create(rows, _fresh(spark, "ranges"), ["main_event", "datetime", "ticker"], by_ticker_and_month())
    kept.merge(new)
    return kept.read()


@query("s11_newer_than_stored", with_tables("bars", f"""
m AS (SELECT ticker, max(datetime) AS mark FROM bars WHERE datetime < TIMESTAMP '{LO}' AND ticker <> 'view' GROUP BY 1)""", body="""
SELECT b.ticker, b.datetime, close FROM bars b LEFT JOIN m USING (ticker)
WHERE b.datetime >= coalesce(mark + INTERVAL 1 HOUR, (SELECT max(datetime) FROM bars) - INTERVAL 10 DAY)"""))
def newer_than_stored(spark, sf_dir):
    rows = shared(inputs.bars(spark, sf_dir))
    stored = rows.filter((col("datetime") < F.lit(LO).cast("timestamp")) & (col("ticker") != "view"))
    return store.newer_than_stored(stored, rows, ["ticker"], default_days=10).select(*KEY, "close")


# ---- standardising ----------------------------------------------------------------------------------
@query("s12_standardize_events", with_tables("calendar", body="""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE importance END AS importance, date_trunc('second', date) AS date, title
FROM calendar WHERE event_id % 13 <> 0"""))
def standardize_events(spark, sf_dir):
    i = col("event_id")
    raw = inputs.calendar(spark, sf_dir).select(
        i.cast("string").alias("id"), F.when(i % 11 == 0, "high").otherwise(col("importance").cast("string")).alias("importance"),
        F.when(i % 13 == 0, "soon").otherwise(_text("date")).alias("date"), "title")
    return clean.standardize_events(raw)


@query("s13_standardize_prices", with_tables("bars", body="""
SELECT ticker, datetime, CASE WHEN volume % 2 = 0 THEN NULL ELSE open END AS open, high, CAST(NULL AS DOUBLE) AS low, close FROM bars"""))
def standardize_prices(spark, sf_dir):
    raw = inputs.bars(spark, sf_dir).select(
        _text("datetime").alias("time"), "ticker", F.when(col("volume") % 2 == 0, "-").otherwise(col("open").cast("string")).alias("open"),
        col("high").cast("string").alias("high"), "close")
    return clean.standardize_prices(raw, col("ticker"))


@query("s14_merge_pages", "SELECT event_id AS id, event_type FROM events")
def merge_pages(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(col("event_id").alias("id"), "event_type", col("ts").cast("timestamp").alias("ts"))
    first = rows.filter(col("ts") < F.lit(HI).cast("timestamp"))
    second = rows.filter(col("ts") >= F.lit(LO).cast("timestamp")).drop("ts")
    return clean.merge_pages(first, second).select("id", "event_type")


@query("s14_truncated_pages", with_tables("calendar", body="""
SELECT date_trunc('day', date)::TIMESTAMP AS page, count(*) AS rows, count(*) >= 330 AS maybe_truncated FROM calendar GROUP BY 1"""))
def truncated_pages(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).withColumn("page", F.date_trunc("day", "date"))
    return clean.truncated_pages(rows, ["page"], 330)


@query("s15_month_ranges", """
SELECT m AS first_day, m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS last_day FROM (SELECT unnest(generate_series(
  date_trunc('month', min(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM orders)""")
def month_ranges(spark, sf_dir):
    span = inputs.table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    out = clean.month_ranges(span, "a", "b")
    return out.select(*[col(c).cast("timestamp").alias(c) for c in out.columns])


@query("s16_clean_daily", with_tables("dbars", body="SELECT ticker, datetime, close FROM dbars WHERE datetime < TIMESTAMP '2000-01-01'"))
def clean_daily(spark, sf_dir):
    raw = inputs.daily_bars(spark, sf_dir).select("ticker", (col("datetime") + F.expr("interval 7 hours")).alias("date"), "close")
    return clean.clean_daily(raw, F.to_date(F.lit("2000-01-01"))).select("ticker", col("datetime").cast("timestamp").alias("datetime"), "close")


@query("s17_clean_epoch_bars", with_tables("dbars", body=f"""
SELECT ticker, datetime, {', '.join(f'round_even({c} * 100000, 0) / 100000 AS {c}' for c in OHLC)}, volume FROM dbars"""))
def clean_epoch(spark, sf_dir):
    raw = inputs.daily_bars(spark, sf_dir).select("ticker", F.unix_seconds("datetime").alias("time"), *OHLC, "volume",
                                                  F.lit(0).alias("real_volume"))
    return clean.clean_epoch_bars(raw)


# ---- predicates and projections ---------------------------------------------------------------------
@query("p01_date_range", with_tables("calendar", body=f"""
SELECT event_id, date FROM calendar WHERE date BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'"""))
def date_range(spark, sf_dir):
    lo, hi = (F.to_timestamp(F.lit(x)) for x in (LO, HI))
    return inputs.calendar(spark, sf_dir).filter(col("date").between(lo, hi)).select("event_id", "date")


@query("p02_digest_rows", with_tables("calendar", body=f"""
SELECT event_id, date, importance, title FROM calendar WHERE date >= TIMESTAMP '{LO}' AND date < TIMESTAMP '2024-01-06' AND importance IN (0, 1)"""))
def digest_rows(spark, sf_dir):
    lo = F.to_timestamp(F.lit(LO))
    rows = inputs.calendar(spark, sf_dir)
    keep = (col("date") >= lo) & (col("date") < lo + F.expr("interval 1 day")) & col("importance").isin(0, 1)
    return rows.filter(keep).select("event_id", "date", "importance", "title").orderBy("date", "event_id")


@query("p03_day_equality", with_tables("calendar", body=f"SELECT event_id, date FROM calendar WHERE CAST(date AS DATE) = DATE '{LO}'"))
def day_equality(spark, sf_dir):
    lo = F.to_timestamp(F.lit(LO))
    return inputs.calendar(spark, sf_dir).filter((col("date") >= lo) & (col("date") < lo + F.expr("interval 1 day"))).select("event_id", "date")


@query("p04_weekdays", with_tables("bars", body="SELECT ticker, datetime FROM bars WHERE isodow(datetime) < 6"))
def weekdays(spark, sf_dir):
    return inputs.bars(spark, sf_dir).filter(F.weekday("datetime") < 5).select(*KEY)


@query("p05_set_predicates", with_tables("calendar", body="""
SELECT event_id, currency, country FROM calendar WHERE currency <> 'CHF' AND country <> 'JP' AND currency IN ('USD', 'EUR', 'GBP', 'JPY')"""))
def set_predicates(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).select("event_id", "currency", "country")
    return rows.filter((col("currency") != "CHF") & (col("country") != "JP") & col("currency").isin("USD", "EUR", "GBP", "JPY"))


@query("p06_drop_nulls", with_tables("calendar", body="SELECT event_id, title, source FROM calendar WHERE title IS NOT NULL AND source IS NOT NULL"))
def drop_nulls(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("event_id", "title", "source", "scale").dropna(subset=["title", "source"]).drop("scale")


@query("p07_drop_catch_all", with_tables("calendar", FEATURE_SQL, body=f"""
SELECT count(*) AS rows, {', '.join(f'CAST(sum({e}) AS BIGINT) AS {n}' for n, e in FLAG_SQL)} FROM feats"""))
def drop_catch_all(spark, sf_dir):
    feats = ev.event_features(inputs.calendar(spark, sf_dir))
    encoded = ev.encode(feats, ev.fit_vocabulary(feats))
    flags = [c for c in encoded.columns if c.split("_")[0] in ("category", "currency", "country", "source", "scale", "mie")
             or c.startswith(("stage_release_", "calc_period_"))]
    return encoded.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in flags])


@query("p08_align_schema", with_tables("calendar", body="SELECT event_id, importance, 0 AS never_seen, currency FROM calendar"))
def align_schema(spark, sf_dir):
    return ev.align(inputs.calendar(spark, sf_dir), ["event_id", "importance", "never_seen", "currency"])


@query("p09_fill_nulls", with_tables("calendar", body="""
SELECT event_id, coalesce(title, 'missing') AS title, coalesce(source, 'missing') AS source, coalesce(CASE WHEN event_id % 5 = 0
  THEN NULL ELSE actual END, 0) AS actual FROM calendar"""))
def fill_nulls(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).select("event_id", "title", "source", F.when(col("event_id") % 5 != 0, col("actual")).alias("actual"))
    return rows.fillna({"title": "missing", "source": "missing", "actual": 0.0})


@query("p10_pair_split", """
SELECT c_custkey, substr(replace(pair, '/', ''), 1, 3) AS base, right(replace(pair, '/', ''), 3) AS quote FROM
(SELECT c_custkey, substr(c_mktsegment, 1, 3) || '/' || right(c_mktsegment, 3) AS pair FROM customer)""")
def pair_split(spark, sf_dir):
    pair = F.concat(F.substring("c_mktsegment", 1, 3), F.lit("/"), F.right(col("c_mktsegment"), F.lit(3)))
    joined = F.replace(pair, F.lit("/"), F.lit(""))
    return inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", F.substring(joined, 1, 3).alias("base"), F.right(joined, F.lit(3)).alias("quote"))


@query("p11_period_masks", with_tables("dbars", body="""
SELECT CASE WHEN datetime < TIMESTAMP '1999-01-01' THEN 'train' WHEN datetime < TIMESTAMP '2000-06-01' THEN 'val' ELSE 'test' END AS split,
  count(*) AS rows, min(datetime) AS first_bar, max(datetime) AS last_bar FROM dbars GROUP BY 1"""))
def period_masks(spark, sf_dir):
    a, b = (F.to_timestamp(F.lit(x)) for x in ("1999-01-01", "2000-06-01"))
    split = F.when(col("datetime") < a, "train").when(col("datetime") < b, "val").otherwise("test")
    return (inputs.daily_bars(spark, sf_dir).groupBy(split.alias("split"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first_bar"), F.max("datetime").alias("last_bar")))


@query("p12_missing_profile", with_tables("calendar", body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM calendar"
    for c in ("event_id", "title", "source", "period", "category", "scale"))))
def missing_profile(spark, sf_dir):
    return agg.missing_profile(inputs.calendar(spark, sf_dir).select("event_id", "title", "source", "period", "category", "scale"))


# ---- sorting and sets -------------------------------------------------------------------------------
@query("o01_mixed_sort", with_tables("calendar", body="SELECT event_id, importance, date FROM calendar"))
def mixed_sort(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("event_id", "importance", "date").orderBy(col("importance").desc(), "date", "event_id")


@query("o02_first_after", with_tables("calendar", body=f"""
SELECT min(date_trunc('hour', date)) AS rounded_time FROM calendar WHERE date_trunc('hour', date) > TIMESTAMP '{NOW}'"""))
def first_after(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).select(F.date_trunc("hour", "date").alias("rounded_time"))
    return rows.filter(col("rounded_time") > F.to_timestamp(F.lit(NOW))).orderBy("rounded_time").limit(1)


@query("o03_top_frequencies", """
SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10""")
def top_frequencies(spark, sf_dir):
    counts = inputs.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(col("n").desc(), "user_id").limit(10)


@query("o04_keep_first", with_tables("calendar", body="""
SELECT title, event_id, date FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY importance DESC, date, event_id) AS k
  FROM calendar) WHERE k = 1"""))
def keep_first(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).select("title", "event_id", "date", "importance")
    return clean.repeated_first(rows, ["title"], [-col("importance"), col("date"), col("event_id")]).drop("importance")


@query("u01_concat_frames", with_tables("bars dbars", body="""
SELECT ticker, datetime, close, volume FROM bars UNION ALL SELECT ticker, datetime, close, NULL FROM dbars"""))
def concat_frames(spark, sf_dir):
    a = inputs.bars(spark, sf_dir).select(*KEY, "close", "volume")
    return a.unionByName(inputs.daily_bars(spark, sf_dir).select(*KEY, "close"), allowMissingColumns=True)


STITCH_SQL = f"""
cut AS (SELECT ticker, min(datetime) AS c FROM bars WHERE datetime >= TIMESTAMP '{HI}' AND ticker <> 'error' GROUP BY 1)"""
STITCH_BODY = f"""
SELECT b.ticker, datetime, close, 'old' AS origin FROM bars b LEFT JOIN cut USING (ticker) WHERE c IS NULL OR datetime < c
UNION ALL SELECT ticker, datetime, round(close * 2, 6), 'new' FROM bars WHERE datetime >= TIMESTAMP '{HI}' AND ticker <> 'error'"""


def _stitched(spark, sf_dir):
    rows = shared(inputs.bars(spark, sf_dir).select(*KEY, "close"))
    new = rows.filter((col("datetime") >= F.to_timestamp(F.lit(HI))) & (col("ticker") != "error"))
    return store.stitch(rows.withColumn("origin", F.lit("old")),
                        new.withColumns({"close": r(col("close") * 2), "origin": F.lit("new")}), ["ticker"])


@query("j09_source_stitch", with_tables("bars", STITCH_SQL, body=STITCH_BODY))
def source_stitch(spark, sf_dir):
    return _stitched(spark, sf_dir)


@query("u02_cutover_union", with_tables("bars", STITCH_SQL, body=f"""
SELECT ticker, origin, count(*) AS rows, min(datetime) AS first_bar, max(datetime) AS last_bar FROM ({STITCH_BODY}) GROUP BY 1, 2"""))
def cutover_union(spark, sf_dir):
    return _stitched(spark, sf_dir).groupBy("ticker", "origin").agg(
        F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first_bar"), F.max("datetime").alias("last_bar"))


@query("u03_set_difference", with_tables("dbars", body="""
SELECT ticker, datetime FROM (SELECT DISTINCT ticker FROM dbars), (SELECT DISTINCT datetime FROM dbars) EXCEPT SELECT ticker, datetime FROM dbars"""))
def set_difference(spark, sf_dir):
    """Days on which some ticker has a bar, less each ticker's own days."""
    rows = inputs.daily_bars(spark, sf_dir)
    tickers = rows.agg(F.collect_set("ticker")).scalar()
    per_day = rows.groupBy("datetime").agg(F.collect_set("ticker").alias("has"))
    return per_day.select(F.explode(F.array_except(tickers, "has")).alias("ticker"), "datetime")


@query("u04_distinct", with_tables("calendar", body="SELECT DISTINCT title, currency FROM calendar"))
def distinct(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("title", "currency").distinct()
