"""Queries over calendar events: bucket aggregates, neighbours, joins with bars, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallbars.catalog.bar_queries import BASE_SQL, KEY, N
from squallbars.catalog.registry import query, r, rounded
from squallbars.catalog.sql import BY, frame, lag, lead, rd, rds, roll, wilder, with_tables
from squallbars.catalog.text_queries import FEATURE_SQL, FLAG_SQL, LOCAL_SQL, NOW, map_sql, quoted, rules_sql, slot_sql
from squallbars.functions import vocab
from squallbars.operators import aggregates as agg
from squallbars.operators import events as ev
from squallbars.operators import history, indicators as ind, joins
from squallbars.operators.layout import over_bars, over_series
from squallbars.session import shared
from squallbars.sources import inputs

col = F.col
WEIGHT_SQL = map_sql("mie", vocab.MAIN_EVENT_WEIGHTS, 0)
_sums = [f"event_{n}" for n in vocab.EVENT_CLASSES] + ["is_calendar", "is_president"]
_sum_sql = {**{c: c for c in _sums}, **{n: e for n, e in FLAG_SQL if not n.startswith("scale_")}}


def main_sql(group: str, ts: str = "date") -> str:
    return (f"coalesce(first(mie ORDER BY {WEIGHT_SQL} DESC, {ts}, event_id), '{vocab.NO_MAIN_EVENT}')")


BUCKETS_SQL = (
    FEATURE_SQL,
    f"""buckets AS (SELECT date_trunc('hour', date) AS rounded_time, count(title) AS news_count,
  count(*) FILTER (importance = 1) AS high_impact_count, count(mie) AS key_event_count, {main_sql('')} AS main_event,
  {', '.join(f'CAST(sum({e}) AS INT) AS {n}' for n, e in _sum_sql.items())} FROM feats GROUP BY 1)""")


def _encoded(spark, sf_dir):
    feats = ev.event_features(inputs.calendar(spark, sf_dir))
    return ev.encode(feats, ev.fit_vocabulary(feats))


def _buckets(spark, sf_dir):
    return ev.aggregate_buckets(ev.with_bucket(_encoded(spark, sf_dir)))


def _light_buckets(spark, sf_dir):
    return ev.aggregate_buckets(ev.with_bucket(ev.event_features(inputs.calendar(spark, sf_dir)).drop("source"))).select(
        "rounded_time", "news_count", "high_impact_count", "key_event_count", "main_event")


@query("a01_bucket_counts", with_tables("calendar", *BUCKETS_SQL, body="""
SELECT rounded_time, news_count, high_impact_count, key_event_count FROM buckets"""))
def bucket_counts(spark, sf_dir):
    return _light_buckets(spark, sf_dir).drop("main_event")


@query("a02_main_event", with_tables("calendar", *BUCKETS_SQL, body="SELECT rounded_time, main_event FROM buckets"))
def main_event(spark, sf_dir):
    return _light_buckets(spark, sf_dir).select("rounded_time", "main_event")


@query("a03_one_hot_sums", with_tables("calendar", *BUCKETS_SQL, body=f"SELECT rounded_time, {', '.join(_sum_sql)} FROM buckets"))
def one_hot_sums(spark, sf_dir):
    return _buckets(spark, sf_dir).select("rounded_time", *_sum_sql)


@query("a03_category_sums", with_tables("calendar", body=" UNION ALL ".join(f"""
SELECT date_trunc('hour', date) AS rounded_time, '{c}' AS "column", {c} AS value, count(*) AS n FROM calendar
WHERE NOT regexp_matches(lower('{c}_' || coalesce({c}, 'None')), '(other|none)$') GROUP BY 1, 3""" for c in ("currency", "country", "scale"))))
def category_sums(spark, sf_dir):
    """The sums of one-hot columns in long form, for any number of values."""
    return ev.category_sums(ev.with_bucket(inputs.calendar(spark, sf_dir)), "rounded_time", ["currency", "country", "scale"])


RICH_SQL = (
    f"""typed AS (SELECT *, {rules_sql('title', vocab.EVENT_TYPE_RULES, "'OTHER'")} AS event_type, importance + 1 AS impact_rank,
  {slot_sql('date', '30min')} AS slot FROM calendar)""",
    f"typed2 AS (SELECT *, {map_sql('event_type', vocab.TYPE_WEIGHTS, 1)} AS event_weight FROM typed)",
    "kinds AS (SELECT slot, event_type, count(*) AS c FROM typed2 GROUP BY 1, 2)",
    "tot AS (SELECT slot, sum(c) AS t FROM kinds GROUP BY 1)",
    f"""rich AS (SELECT slot, count(*) AS news_count, count(*) FILTER (impact_rank = 2) AS high_impact_count,
  count(*) FILTER (event_type IN ({', '.join(quoted(k) for k in vocab.KEY_TYPES)})) AS key_event_count,
  CAST(sum(impact_rank) AS BIGINT) AS sum_impact, CAST(sum(event_weight) AS BIGINT) AS sum_event_weight,
  max(event_weight) AS max_event_weight,
  {', '.join(f"count(*) FILTER (event_type = '{k}') AS has_{k.lower()}" for k in vocab.KEY_TYPES)}
  FROM typed2 GROUP BY 1)""",
    "dom AS (SELECT slot, first(event_type ORDER BY c DESC, event_type) AS dominant_event_type FROM kinds GROUP BY 1)",
    """ent AS (SELECT slot, CASE WHEN count(*) > 1 THEN -sum(c / t * ln(c / t)) ELSE 0 END AS event_entropy
  FROM kinds JOIN tot USING (slot) GROUP BY 1)""")


def _rich(spark, sf_dir):
    return ev.rich_buckets(ev.typed(inputs.calendar(spark, sf_dir)))


@query("a05_rich_buckets", with_tables("calendar", *RICH_SQL, body="""
SELECT slot, news_count, high_impact_count, key_event_count, sum_impact, sum_event_weight, max_event_weight FROM rich"""))
def rich(spark, sf_dir):
    return _rich(spark, sf_dir).select("slot", "news_count", "high_impact_count", "key_event_count", "sum_impact",
                                       "sum_event_weight", "max_event_weight")


@query("a06_dominant_type", with_tables("calendar", *RICH_SQL, body="SELECT slot, dominant_event_type FROM dom"))
def dominant(spark, sf_dir):
    return _rich(spark, sf_dir).select("slot", "dominant_event_type")


@query("a07_type_entropy", with_tables("calendar", *RICH_SQL, body=f"SELECT slot, {rd('event_entropy')} AS event_entropy FROM ent"))
def entropy(spark, sf_dir):
    return _rich(spark, sf_dir).select("slot", r("event_entropy").alias("event_entropy"))


@query("a08_presence_flags", with_tables("calendar", *RICH_SQL, body="SELECT slot, " + ", ".join(
    f"has_{k.lower()}" for k in vocab.KEY_TYPES) + " FROM rich"))
def presence(spark, sf_dir):
    return _rich(spark, sf_dir).select("slot", *[f"has_{k.lower()}" for k in vocab.KEY_TYPES])


@query("j08_bucket_aggregate_join", with_tables("calendar", *RICH_SQL, body=f"""
SELECT rich.*, dominant_event_type, {rd('event_entropy')} AS event_entropy FROM rich JOIN dom USING (slot)
JOIN ent USING (slot)"""))
def bucket_join(spark, sf_dir):
    out = _rich(spark, sf_dir)
    return out.select(*[c for c in out.columns if c != "event_entropy"], r("event_entropy").alias("event_entropy"))


@query("a09_stable_hour", with_tables("calendar", *RICH_SQL, body=f"""
SELECT slot, first({LOCAL_SQL} ORDER BY impact_rank DESC, event_id) AS stable_hour FROM typed2 GROUP BY 1"""))
def stable_hour(spark, sf_dir):
    rows = ev.typed(inputs.calendar(spark, sf_dir))
    return rows.groupBy("slot").agg(F.max_by("local_hour", F.struct("impact_rank", -col("event_id"))).alias("stable_hour"))


@query("a11_top_event", with_tables("calendar", *RICH_SQL, body="""
SELECT slot, event_id, title, currency, importance, actual FROM (SELECT *, row_number() OVER (PARTITION BY slot
  ORDER BY impact_rank DESC, event_id) AS k FROM typed2) WHERE k = 1"""))
def top_event(spark, sf_dir):
    rows = ev.typed(inputs.calendar(spark, sf_dir)).select("slot", "event_id", "title", "currency", "importance",
                                                           "actual", "impact_rank")
    return ev.top_event(rows, "slot").drop("impact_rank")


@query("a12_events_per_hour", with_tables("calendar", body="""
SELECT hour, page, string_agg(event_id || ':' || coalesce(title, '-') || ':' || currency, '|' ORDER BY date, event_id) AS records
FROM (SELECT *, date_trunc('hour', date) AS hour, (row_number() OVER (PARTITION BY date_trunc('hour', date) ORDER BY date, event_id) - 1) // 1000 AS page FROM calendar)
GROUP BY 1, 2"""))
def events_per_hour(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "date"))
    out = ev.records_per_bucket(rows, "hour", ["event_id", "title", "currency"])
    line = F.transform("records", lambda x: F.concat_ws(":", x["event_id"].cast("string"),
                                                        F.coalesce(x["title"], F.lit("-")), x["currency"]))
    return out.select("hour", "page", F.array_join(line, "|").alias("records"))


@query("a13_frequencies", with_tables("calendar", body=f"""
SELECT date_trunc('week', date)::TIMESTAMP AS fold, title, count(*) AS n,
  {rd('count(*) / sum(count(*)) OVER (PARTITION BY date_trunc(' + "'week'" + ', date))')} AS share FROM calendar GROUP BY date_trunc('week', date), title"""))
def frequencies(spark, sf_dir):
    rows = inputs.calendar(spark, sf_dir).withColumn("fold", F.date_trunc("week", "date"))
    return agg.frequencies(rows, ["title"], ["fold"]).withColumn("share", r("share"))


@query("a13_overall_frequencies", with_tables("calendar", body=f"""
SELECT importance, count(*) AS n, {rd('count(*) / sum(count(*)) OVER ()')} AS share FROM calendar GROUP BY 1"""))
def overall_frequencies(spark, sf_dir):
    return agg.frequencies(inputs.calendar(spark, sf_dir), ["importance"]).withColumn("share", r("share"))


@query("a14_frequent_sources", with_tables("calendar", """
c AS (SELECT country, source, count(*) AS n FROM calendar WHERE source IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, source DESC) AS k FROM c)""", body="""
SELECT event_id, country, CASE WHEN source IN (SELECT source FROM k WHERE k <= 2 AND n > 50) THEN source ELSE 'OTHER' END
  AS source FROM calendar"""))
def frequent_sources(spark, sf_dir):
    return ev.frequent_sources(inputs.calendar(spark, sf_dir), 2, 50).select("event_id", "country", "source")


# ---- neighbours -------------------------------------------------------------------------------------
_B = "ORDER BY rounded_time"


@query("w03_neighbour_buckets", with_tables("calendar", *BUCKETS_SQL, body=f"""
SELECT rounded_time, {', '.join(f"coalesce(lag({c}) OVER ({_B}), 0) AS prev_hour_{c}, coalesce(lead({c}) OVER ({_B}), 0) AS next_hour_{c}" for c in ('news_count', 'high_impact_count'))},
  lag(main_event) OVER ({_B}) AS prev_hour_main_event, lead(main_event) OVER ({_B}) AS next_hour_main_event FROM buckets"""))
def neighbours(spark, sf_dir):
    out = ev.neighbour_features(_light_buckets(spark, sf_dir))
    return out.select("rounded_time", *[f"{s}_hour_{c}" for s in ("prev", "next")
                                        for c in ("news_count", "high_impact_count", "main_event")])


@query("w04_half_hours_between", with_tables("calendar", *BUCKETS_SQL, body=f"""
SELECT rounded_time, {rd(f'coalesce((epoch(rounded_time) - epoch(lag(rounded_time) OVER ({_B}))) / 1800, 0)')}
  AS time_passed_from_last_events,
  {rd(f'coalesce((epoch(lead(rounded_time) OVER ({_B})) - epoch(rounded_time)) / 1800, 0)')} AS time_left_to_next_events
FROM buckets"""))
def half_hours(spark, sf_dir):
    out = ev.neighbour_features(_light_buckets(spark, sf_dir))
    return out.select("rounded_time", *rounded("time_passed_from_last_events", "time_left_to_next_events"))


@query("w05_hours_since_key_event", with_tables("calendar", *BUCKETS_SQL, body=f"""
SELECT rounded_time, {rd(f'(epoch(rounded_time) - epoch(lag(rounded_time) OVER ({_B}))) / 3600')} AS since_any,
  {rd(f"(epoch(rounded_time) - epoch(last_value(CASE WHEN main_event <> '{vocab.NO_MAIN_EVENT}' THEN rounded_time END IGNORE NULLS) OVER ({_B} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 3600")} AS since_key
FROM buckets"""))
def since_key(spark, sf_dir):
    rows = shared(_light_buckets(spark, sf_dir))
    out = ev.hours_since(rows, F.lit(True), "since_any")
    out = ev.hours_since(out, col("main_event") != vocab.NO_MAIN_EVENT, "since_key")
    return out.select("rounded_time", *rounded("since_any", "since_key"))


_kt = ", ".join(quoted(k) for k in vocab.KEY_TYPES)
_past = "OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("w06_last_key_event", with_tables("calendar", *RICH_SQL, body=f"""
SELECT slot, last_value(CASE WHEN dominant_event_type IN ({_kt}) THEN dominant_event_type END IGNORE NULLS) {_past} AS last_key_event_name,
  {rd(f"(epoch(slot) - epoch(last_value(CASE WHEN dominant_event_type IN ({_kt}) THEN slot END IGNORE NULLS) {_past})) / 3600")} AS last_key_event_hours_ago,
  {rd(f"(epoch(slot) - epoch(last_value(CASE WHEN high_impact_count > 0 THEN slot END IGNORE NULLS) {_past})) / 3600")} AS last_max_impact_hours_ago
FROM rich JOIN dom USING (slot)"""))
def last_key_event(spark, sf_dir):
    rows = shared(_rich(spark, sf_dir))
    is_key = col("dominant_event_type").isin(vocab.KEY_TYPES)
    out = ev.hours_since(rows, is_key, "last_key_event_hours_ago", "slot",
                         {"last_key_event_name": col("dominant_event_type")})
    out = ev.hours_since(out, col("high_impact_count") > 0, "last_max_impact_hours_ago", "slot")
    return out.select("slot", "last_key_event_name", *rounded("last_key_event_hours_ago", "last_max_impact_hours_ago"))


@query("w02_day_counts_and_ranks", with_tables("calendar", body="""
SELECT event_id, count(*) OVER (PARTITION BY date_trunc('day', date)) AS news_count_per_day,
  rank() OVER (PARTITION BY date_trunc('day', date) ORDER BY importance DESC) AS importance_rank_per_day FROM calendar"""))
def day_ranks(spark, sf_dir):
    return ev.day_counts_and_ranks(inputs.calendar(spark, sf_dir)).select(
        "event_id", "news_count_per_day", "importance_rank_per_day")


# ---- joins ------------------------------------------------------------------------------------------
CHECK_SQL = "chk AS (SELECT *, rounded_time - INTERVAL 1 HOUR AS time_to_check FROM buckets)"


def _due(spark, sf_dir):
    return _light_buckets(spark, sf_dir).withColumn("time_to_check", ev.time_to_check(col("rounded_time")))


@query("j01_bars_with_events", with_tables("bars calendar", *BUCKETS_SQL, CHECK_SQL, body="""
SELECT ticker, datetime, close, rounded_time, news_count, high_impact_count, main_event FROM bars
LEFT JOIN chk ON datetime = time_to_check"""))
def bars_with_events(spark, sf_dir):
    out = joins.bars_with_events(inputs.bars(spark, sf_dir), _due(spark, sf_dir))
    return out.select(*KEY, "close", "rounded_time", "news_count", "high_impact_count", "main_event")


@query("j02_events_with_bars", with_tables("bars calendar", *BUCKETS_SQL, CHECK_SQL, body="""
SELECT rounded_time, main_event, ticker, close FROM chk LEFT JOIN bars ON datetime = time_to_check"""))
def events_with_bars(spark, sf_dir):
    return joins.events_with_bars(_due(spark, sf_dir), inputs.bars(spark, sf_dir)).select(
        "rounded_time", "main_event", "ticker", "close")


@query("j03_bars_at_main_events", with_tables("bars calendar", *BUCKETS_SQL, body="""
SELECT ticker, datetime, close, main_event FROM bars JOIN buckets ON datetime = rounded_time"""))
def bars_at_events(spark, sf_dir):
    b = _light_buckets(spark, sf_dir).select(col("rounded_time").alias("datetime"), "main_event")
    return inputs.bars(spark, sf_dir).join(b, "datetime").select(*KEY, "close", "main_event")


@query("j04_latest_with_next_bucket", with_tables("bars calendar", *BUCKETS_SQL, body=f"""
SELECT l.ticker, l.datetime, l.close, n.rounded_time, n.news_count, n.main_event FROM (SELECT ticker,
  max(datetime) AS datetime, arg_max(close, datetime) AS close FROM bars WHERE datetime <= TIMESTAMP '{NOW}' GROUP BY 1) l,
  (SELECT * FROM buckets WHERE rounded_time > TIMESTAMP '{NOW}' ORDER BY rounded_time LIMIT 1) n"""))
def latest_with_next(spark, sf_dir):
    out = joins.latest_with_next(inputs.bars(spark, sf_dir), _light_buckets(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return out.select(*KEY, "close", "rounded_time", "news_count", "main_event")


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("j07_indicator_asof", with_tables("dbars series", f"""
s1 AS (SELECT series, date, value, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS diff FROM series)""", body=f"""
SELECT ticker, datetime, {', '.join(f"CASE WHEN b.datetime <= (SELECT max(date) FROM series) THEN v{i}.value END AS macro_{joins._slug(p)}, CASE WHEN b.datetime <= (SELECT max(date) FROM series) THEN {rd(f'v{i}.diff', 2)} END AS macro_{joins._slug(p)}_diff" for i, p in enumerate(_PRIOS))}
FROM dbars b {' '.join(f"ASOF LEFT JOIN (SELECT * FROM s1 WHERE series = '{p}') v{i} ON b.datetime >= v{i}.date" for i, p in enumerate(_PRIOS))}"""))
def indicator_asof(spark, sf_dir):
    series = inputs.indicator_series(spark, sf_dir)
    rows = inputs.daily_bars(spark, sf_dir)
    out = joins.join_indicators(rows, series, _PRIOS)
    slugs = [joins._slug(p) for p in _PRIOS]
    return out.select(
        *KEY, *[f"macro_{s}" for s in slugs], *[r(f"macro_{s}_diff", 2).alias(f"macro_{s}_diff") for s in slugs])


@query("j07_asof_join", with_tables("dbars", """
s AS (SELECT c_custkey AS k, CAST(DATE '1995-01-01' + CAST(c_custkey * 11 % 2000 AS INT) AS TIMESTAMP) AS seen, c_acctbal AS bal
  FROM customer)""", """
s2 AS (SELECT seen, max(bal) AS bal FROM s GROUP BY seen)""", body="""
SELECT ticker, datetime, close, bal FROM dbars ASOF LEFT JOIN s2 ON datetime >= seen"""))
def asof(spark, sf_dir):
    from squallbars.operators.layout import asof_join

    at = F.date_add(F.to_date(F.lit("1995-01-01")), (col("c_custkey") * 11 % 2000).cast("int")).cast("timestamp")
    right = (inputs.table(spark, sf_dir, "customer").groupBy(at.alias("datetime")).agg(F.max("c_acctbal").alias("bal")))
    return asof_join(inputs.daily_bars(spark, sf_dir), right, [], "datetime", ["bal"]).select(*KEY, "close", "bal")


@query("j10_titles_at_alert_hour", with_tables("calendar", *BUCKETS_SQL, body="""
SELECT DISTINCT date_trunc('hour', date) AS rounded_time, title FROM calendar WHERE importance >= 0 AND
  date_trunc('hour', date) IN (SELECT rounded_time FROM buckets WHERE key_event_count >= 3)"""))
def at_alert_hour(spark, sf_dir):
    hours = _light_buckets(spark, sf_dir).filter("key_event_count >= 3").select("rounded_time")
    return joins.at_alert_hour(inputs.calendar(spark, sf_dir), hours)


# ---- range history ----------------------------------------------------------------------------------
HZ = history.HORIZONS
RANGES_SQL = (*BUCKETS_SQL, "fr AS (SELECT *, " + ", ".join(
    f"({frame('max', 'high', 1, h)}) - ({frame('min', 'low', 1, h)}) AS future_range_{h}h" for h in HZ) + " FROM bars)",
    f"ranges AS (SELECT ticker, datetime, main_event, {', '.join(f'future_range_{h}h' for h in HZ)} FROM fr JOIN buckets "
    "ON datetime = rounded_time)")


def _ranges(spark, sf_dir):
    from squallbars.plans.refresh import event_ranges

    return event_ranges(inputs.bars(spark, sf_dir), inputs.calendar(spark, sf_dir))


STATS = ([f"prev_range_{h}h" for h in HZ]
         + [f"{s}_range_{h}h_{w}" for w in (5, 20) for h in HZ for s in ("min", "mean", "max")])
STATS_SQL = """stats AS (SELECT ticker, main_event, {p}, {s} FROM (SELECT *, row_number() OVER (PARTITION BY ticker,
  main_event ORDER BY datetime DESC) AS k FROM ranges) GROUP BY 1, 2)""".format(
    p=", ".join(f"max(CASE WHEN k = 1 THEN future_range_{h}h END) AS prev_range_{h}h" for h in HZ),
    s=", ".join(f"{a}(CASE WHEN k <= {w} THEN future_range_{h}h END) AS {n}_range_{h}h_{w}"
                for w in (5, 20) for h in HZ for a, n in (("min", "min"), ("avg", "mean"), ("max", "max"))))


@query("a10_range_stats", with_tables("bars calendar", *RANGES_SQL, STATS_SQL, body=f"SELECT ticker, main_event, {rds(*STATS)} FROM stats"))
def range_stats(spark, sf_dir):
    return history.range_stats(_ranges(spark, sf_dir)).select("ticker", "main_event", *rounded(*STATS))


@query("j05_bars_with_range_history", with_tables("bars calendar", *RANGES_SQL, STATS_SQL, body=f"""
SELECT r.ticker, r.datetime, r.main_event, {', '.join(f'{rd(s)} AS {s}' for s in STATS[:8])} FROM ranges r LEFT JOIN stats
  USING (ticker, main_event)"""))
def range_history(spark, sf_dir):
    rows = shared(_ranges(spark, sf_dir))
    return joins.with_range_history(rows, history.range_stats(rows)).select(*KEY, "main_event", *rounded(*STATS[:8]))


@query("l15_update_ranges", with_tables("bars calendar", *RANGES_SQL, body=f"""
SELECT ticker, datetime, main_event, {rds(*[f'future_range_{h}h' for h in HZ])} FROM ranges"""))
def update_ranges(spark, sf_dir):
    from squallbars.plans.refresh import update_ranges as update

    events, bars, stored = shared(inputs.calendar(spark, sf_dir)), shared(inputs.bars(spark, sf_dir)), None
    for mark in ("2024-01-09 05:00:00", "2024-01-16 00:00:00", "2024-01-16 11:00:00"):  # both tables end at each mark
        at = F.lit(mark).cast("timestamp")
        stored = shared(update(stored, bars.filter(col("datetime") < at), events.filter(col("date") < at)))
    out = update(stored, bars, events)
    return out.select(*KEY, "main_event", *rounded(*[f"future_range_{h}h" for h in HZ]))


EVBY = "PARTITION BY main_event, ticker ORDER BY datetime"


@query("w07_lagged_target_stats", with_tables("bars calendar", *RANGES_SQL, body=f"""
SELECT ticker, datetime, main_event, {', '.join(
    f"coalesce({rd(frame(a, f'future_range_{h}h', -w, -1, full=False, by=EVBY))}, 0) AS {n}_range_{h}h_{w}"
    for h in HZ for w in (5, 20) for a, n in (('avg', 'mean'), ('min', 'min'), ('max', 'max')))},
  {', '.join(f"coalesce({rd(lag(f'future_range_{h}h', 1, EVBY))}, 0) AS prev_range_{h}h" for h in HZ)} FROM ranges"""))
def lagged_target_stats(spark, sf_dir):
    out = history.lagged_target_stats(_ranges(spark, sf_dir), ["main_event", "ticker"])
    return out.select(*KEY, "main_event", *rounded(*[f"{n}_range_{h}h_{w}" for h in HZ for w in (5, 20)
                                                     for n in ("mean", "min", "max")], *[f"prev_range_{h}h" for h in HZ]))


KNOWN_STATS = history.known_columns()
_KNOWN_BY = "PARTITION BY ticker, main_event, horizon ORDER BY known"
KNOWN_SQL = (*RANGES_SQL, "ahead AS (SELECT ticker, datetime, " + ", ".join(f"{lead('datetime', h)} AS known_{h}h" for h in HZ) + " FROM bars)",
             "known_long AS (" + " UNION ALL ".join(
                 f"SELECT ticker, main_event, {h} AS horizon, future_range_{h}h AS prev, known_{h}h AS known FROM ranges "
                 f"JOIN ahead USING (ticker, datetime) WHERE known_{h}h IS NOT NULL" for h in HZ) + ")",
             "known_stats AS (SELECT *, " + ", ".join(
                 f"{frame(a, 'prev', 1 - w, 0, full=False, by=_KNOWN_BY)} AS {n}_{w}"
                 for w in (5, 20) for a, n in (("min", "min"), ("avg", "mean"), ("max", "max"))) + " FROM known_long)")
_known_cols = ", ".join(f"{rd(f's{h}.prev')} AS prev_range_{h}h" for h in HZ) + ", " + ", ".join(
    f"{rd(f's{h}.{n}_{w}')} AS {n}_range_{h}h_{w}" for w in (5, 20) for h in HZ for n in ("min", "mean", "max"))
_known_joins = " ".join(f"ASOF LEFT JOIN (SELECT * FROM known_stats WHERE horizon = {h}) s{h} ON q.ticker = s{h}.ticker "
                        f"AND q.main_event = s{h}.main_event AND q.datetime >= s{h}.known" for h in HZ)


def known_sql(columns: str) -> str:
    """Rows of ``q`` with the statistics known at their time."""
    return f"SELECT {columns}, {_known_cols} FROM q {_known_joins}"


@query("w07_known_range_history", with_tables("bars calendar", *KNOWN_SQL, CHECK_SQL, """
q AS (SELECT ticker, datetime, rounded_time, main_event FROM chk JOIN bars ON datetime = time_to_check)""", body=known_sql(
    "q.ticker, q.datetime, q.rounded_time, q.main_event")))
def known_range_history(spark, sf_dir):
    """Each due event with the statistics of the earlier ranges of its kind that were complete by then."""
    from squallbars.plans.refresh import event_ranges

    bars = shared(inputs.bars(spark, sf_dir))
    rows = joins.events_with_bars(_due(spark, sf_dir), bars, "inner").select(*KEY, "rounded_time", "main_event")
    out = history.with_known_stats(rows, event_ranges(bars, inputs.calendar(spark, sf_dir), known=True))
    return out.select(*KEY, "rounded_time", "main_event", *rounded(*KNOWN_STATS))


TYBY = "PARTITION BY dominant_event_type, ticker ORDER BY datetime"
TYPED_SQL = (*RICH_SQL[:1], RICH_SQL[1], *RICH_SQL[2:], BASE_SQL,
             """tr AS (SELECT ticker, datetime, dominant_event_type, trange / nullif(close, 0) AS norm FROM t0
  JOIN dom ON datetime = slot)""")


def _typed_ranges(spark, sf_dir):
    def build(df, w):
        return df.select("ticker", "datetime", F.try_divide(ind.true_range(w), col("close")).alias("norm"), "_own", "_chunk", "_row")

    bars = over_bars(inputs.bars(spark, sf_dir), build, back=1)
    types = _rich(spark, sf_dir).select(col("slot").alias("datetime"), "dominant_event_type")
    return bars.join(types, "datetime")


@query("w08_lagged_by_type", with_tables("bars calendar", *TYPED_SQL, body=f"""
SELECT ticker, datetime, dominant_event_type, {', '.join(
    f"{rd(frame(a, 'norm', -5, -1, full=False, by=TYBY))} AS prev_5_{n}" for a, n in (('avg', 'mean'), ('min', 'min'), ('max', 'max')))},
  {rd(lag('norm', 1, TYBY))} AS prev_this_event FROM tr"""))
def lagged_by_type(spark, sf_dir):
    def build(df, w):
        cols = {f"prev_5_{n}": c for n, c in history.lagged_stats(w, "norm", 5).items()} | {"prev_this_event": w.lag("norm")}
        return df.select("*", *[c.alias(n) for n, c in cols.items()])

    out = over_series(_typed_ranges(spark, sf_dir), build, ["dominant_event_type", "ticker"], "datetime", back=5)
    return out.select(*KEY, "dominant_event_type", *rounded("prev_5_mean", "prev_5_min", "prev_5_max", "prev_this_event"))


_tb, _gb = "PARTITION BY dominant_event_type ORDER BY datetime, ticker", "ORDER BY datetime, ticker"


@query("w09_lagged_by_event_and_overall", with_tables("bars calendar", *TYPED_SQL, body=f"""
SELECT ticker, datetime, {', '.join(f"coalesce({rd(frame('avg', 'norm', -w, -1, full=False, by=_tb))}, 0) AS lag_target_event_{w}" for w in (5, 20))},
  coalesce({rd(frame('avg', 'norm', -50, -1, full=False, by=_gb))}, 0) AS lag_target_overall_50 FROM tr"""))
def lagged_overall(spark, sf_dir):
    rows = _typed_ranges(spark, sf_dir)
    by_type = over_series(rows, lambda df, w: df.select("*", *[
        F.coalesce(w.frame(F.avg, "norm", -n, -1, full=False), F.lit(0.0)).alias(f"lag_target_event_{n}") for n in (5, 20)]),
        ["dominant_event_type"], "datetime", back=20, ties=["ticker"], unit="day")
    out = over_series(by_type, lambda df, w: df.withColumn(
        "lag_target_overall_50", F.coalesce(w.frame(F.avg, "norm", -50, -1, full=False), F.lit(0.0))),
        [], "datetime", back=50, ties=["ticker"], unit="day")
    return out.select(*KEY, *rounded("lag_target_event_5", "lag_target_event_20", "lag_target_overall_50"))


@query("w13_tail_per_group", with_tables("bars calendar", *RANGES_SQL, body="""
SELECT ticker, datetime, main_event FROM (SELECT *, row_number() OVER (PARTITION BY ticker, datetime, main_event
  ORDER BY datetime DESC) AS k FROM ranges) WHERE k <= 50"""))
def tail_per_group(spark, sf_dir):
    """The last 50 rows of each (ticker, hour, event): the hour is part of the key, as in the stored table."""
    return history.latest_rows(_ranges(spark, sf_dir), ["ticker", "datetime", "main_event"], "datetime", 50).select(*KEY, "main_event")


@query("w13_tail_per_event", with_tables("bars calendar", *RANGES_SQL, body="""
SELECT ticker, datetime, main_event FROM (SELECT *, row_number() OVER (PARTITION BY ticker, main_event
  ORDER BY datetime DESC) AS k FROM ranges) WHERE k <= 50"""))
def tail_per_event(spark, sf_dir):
    """The last 50 hours of each (ticker, event)."""
    return history.latest_rows(_ranges(spark, sf_dir), ["ticker", "main_event"], "datetime", 50).select(*KEY, "main_event")


# ---- reports ----------------------------------------------------------------------------------------
BA_SQL = (BASE_SQL, f"""ba AS (SELECT ticker, datetime, ({frame('max', 'high', -6, -1)}) - ({frame('min', 'low', -6, -1)}) AS range_before,
  ({frame('max', 'high', 1, 6)}) - ({frame('min', 'low', 1, 6)}) AS range_after FROM t0)""",
          *RICH_SQL[:2], """te AS (SELECT * FROM (SELECT date_trunc('hour', date) AS datetime, importance, event_type,
  row_number() OVER (PARTITION BY date_trunc('hour', date) ORDER BY importance DESC, event_id) AS k FROM typed2) WHERE k = 1)""",
          "bt AS (SELECT * FROM ba JOIN te USING (datetime))")


def _before_after(spark, sf_dir):
    def build(df, w):
        return df.select("*", (w.frame(F.max, "high", -6, -1) - w.frame(F.min, "low", -6, -1)).alias("range_before"),
                         (w.frame(F.max, "high", 1, 6) - w.frame(F.min, "low", 1, 6)).alias("range_after"))

    rows = ev.typed(inputs.calendar(spark, sf_dir)).select(F.date_trunc("hour", "date").alias("datetime"), "event_id",
                                                           "importance", "impact_rank", "event_type")
    top = ev.top_event(rows, "datetime")
    return over_bars(inputs.bars(spark, sf_dir), build, back=6, ahead=6).join(top, "datetime")


@query("a15_group_means", with_tables("bars calendar", *BA_SQL, body=f"""
SELECT importance, {rd('avg(range_before)')} AS before, {rd('avg(range_after)')} AS after FROM bt GROUP BY 1"""))
def group_means(spark, sf_dir):
    return _before_after(spark, sf_dir).groupBy("importance").agg(
        r(F.avg("range_before")).alias("before"), r(F.avg("range_after")).alias("after"))


P_SQL = """(SELECT list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
  * pow(greatest(cos(({a} + ({top} - {a}) * i / 4000) / sqrt({v})), 0), {v} - 1))) * ({top} - {a}) / 12000)"""


def p_sql(t: str, v: str) -> str:
    top = f"least(pi() / 2 * sqrt({v}), 60.0)"
    a = f"least(atan(abs({t}) / sqrt({v})) * sqrt({v}), {top})"
    return P_SQL.format(a=a, top=top, v=v) + " / " + P_SQL.format(a="0.0", top=top, v=v)


@query("a21_paired_test", with_tables("bars calendar", *BA_SQL, """
g AS (SELECT event_type, avg(range_before) AS mean_before, avg(range_after) AS mean_after, count(*) AS n,
  avg(range_before - range_after) / (stddev_samp(range_before - range_after) / sqrt(count(*))) AS t_stat FROM bt
  WHERE range_before - range_after IS NOT NULL GROUP BY 1)""", body=f"""
SELECT event_type, {rds('mean_before', 'mean_after', 't_stat')}, n, {rd(p_sql('t_stat', '(n - 1)::DOUBLE'))} AS p_value,
  {p_sql('t_stat', '(n - 1)::DOUBLE')} < 0.05 AS significance FROM g"""))
def paired_test(spark, sf_dir):
    out = agg.paired_test(_before_after(spark, sf_dir), "event_type", "range_before", "range_after")
    return out.select("event_type", "n", *rounded("mean_before", "mean_after", "t_stat", "p_value"), "significance")


@query("a22_pairwise_tests", with_tables("bars calendar", *BA_SQL, """
m AS (SELECT event_type AS k, avg(range_before) AS m, var_samp(range_before) AS v, count(*) AS n FROM bt
  WHERE range_before IS NOT NULL GROUP BY 1)""", """
p AS (SELECT a.k AS A, b.k AS B, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t_stat,
  pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS dof,
  (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) * (1 - 3.0 / (4 * (a.n + b.n) - 9)) AS hedges
  FROM m a JOIN m b ON a.k < b.k)""", f"p2 AS (SELECT *, {p_sql('t_stat', 'dof')} AS p_unc FROM p)", body=f"""
SELECT A, B, {rds('t_stat', 'dof', 'hedges', 'p_unc', digits=5)}, {rd('least(1, p_unc * count(*) OVER ())', 5)} AS p_corr FROM p2"""))
def pairwise_tests(spark, sf_dir):
    out = agg.pairwise_tests(_before_after(spark, sf_dir), "event_type", "range_before")
    return out.select("A", "B", *rounded("t_stat", "dof", "hedges", "p_unc", "p_corr", digits=5))


@query("a16_ticker_summary", with_tables("bars", body=f"""
SELECT ticker, {rd('avg(close)')} AS mean, {rd('stddev_samp(close)')} AS std, min(close) AS min, max(close) AS max,
  arg_min(open, datetime) AS first_open, arg_max(close, datetime) AS last_close, CAST(sum(volume) AS BIGINT) AS volume,
  count(*) AS rows FROM bars GROUP BY 1"""))
def ticker_summary(spark, sf_dir):
    return agg.summary(inputs.bars(spark, sf_dir), ["ticker"]).withColumns({"mean": r("mean"), "std": r("std")})


@query("a17_annualised_volatility", with_tables("bars", body=f"""
SELECT ticker, {rd('stddev_samp(chg) * sqrt(252)')} AS volatility FROM (SELECT ticker, close / nullif({lag('close')}, 0) - 1 AS chg
  FROM bars) GROUP BY 1"""))
def annualised(spark, sf_dir):
    out = over_bars(inputs.bars(spark, sf_dir), lambda df, w: df.withColumn(
        "chg", F.try_divide(col("close"), w.lag("close")) - 1), back=1)
    return out.groupBy("ticker").agg(r(F.stddev_samp("chg") * (252 ** 0.5)).alias("volatility"))


@query("a18_describe", with_tables("bars", body=f"""
SELECT ticker, count(close) AS count, {rd('avg(close)')} AS mean, {rd('stddev_samp(close)')} AS std, min(close) AS min,
  max(close) AS max, {', '.join(f"{rd(f'quantile_cont(close, {q})')} AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))}
FROM bars GROUP BY 1"""))
def describe(spark, sf_dir):
    bars = shared(inputs.bars(spark, sf_dir))
    out = agg.describe(bars, "close", ["ticker"])
    return out.withColumns({c: r(c) for c in ("mean", "std", "p25", "p50", "p75")})


@query("a19_histogram", with_tables("bars", """
b AS (SELECT min(close) AS lo, max(close) AS hi, count(*) AS n FROM bars)""", body=f"""
SELECT ticker, CAST(least(floor((close - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin,
  {rd('min(lo + least(floor((close - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20))')} AS left_edge, count(*) AS n,
  {rd('count(*) / max(b.n)')} AS share FROM bars, b GROUP BY 1, 2"""))
def histogram(spark, sf_dir):
    out = agg.histogram(shared(inputs.bars(spark, sf_dir)), "close", 20, ["ticker"])
    return out.withColumns({"left_edge": r("left_edge"), "share": r("share")})


@query("a20_correlation", with_tables("bars", BASE_SQL, f"""
c AS (SELECT ticker, ({roll('sum', 'body', 12)}) / nullif(({roll('sum', 'trange', 12)}), 0) AS dni,
  (({roll('max', 'high', 12)}) - ({roll('min', 'low', 12)})) / nullif(({roll('sum', 'trange', 12)}), 0) AS eff FROM t0)""",
    body=f"SELECT {rd('corr(eff, dni)')} AS correlation FROM c"))
def correlation(spark, sf_dir):
    def build(df, w):
        df = ind.with_true_range(df, w).withColumn("body", F.abs(col("open") - col("close")))
        path = w.roll(F.sum, "trange", 12)
        return df.select("*", F.try_divide(ind.window_range(w, 12), path).alias("eff"),
                         F.try_divide(w.roll(F.sum, "body", 12), path).alias("dni"))

    return over_bars(inputs.bars(spark, sf_dir), build, back=13).agg(r(F.corr("eff", "dni")).alias("correlation"))


_LABELS = ["click", "error", "purchase", "signup", "view"]


@query("a23_crosstab", with_tables("scored", body="SELECT label, " + ", ".join(
    f"count(*) FILTER (predicted = '{v}') AS predicted_{v}" for v in _LABELS) + " FROM scored GROUP BY 1"))
def crosstab(spark, sf_dir):
    return agg.crosstab(inputs.scored(spark, sf_dir), "label", "predicted", _LABELS)


@query("a24_target_distribution", with_tables("scored", body=f"""
SELECT fold, label, count(*) AS n, {rd('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY fold)')} AS pct FROM scored GROUP BY 1, 2"""))
def target_distribution(spark, sf_dir):
    out = agg.frequencies(inputs.scored(spark, sf_dir), ["label"], ["fold"])
    return out.select("fold", "label", "n", r(col("share") * 100).alias("pct"))


@query("a24_range_description", with_tables("bars calendar", *RANGES_SQL, body=" UNION ALL ".join(f"""
SELECT '{h}h' AS target, count(future_range_{h}h) AS count, {rd(f'avg(future_range_{h}h)')} AS mean, {rd(f'stddev_samp(future_range_{h}h)')} AS std,
  {rd(f'min(future_range_{h}h)')} AS min, {rd(f'quantile_cont(future_range_{h}h, 0.25)')} AS p25, {rd(f'quantile_cont(future_range_{h}h, 0.5)')} AS p50,
  {rd(f'quantile_cont(future_range_{h}h, 0.75)')} AS p75, {rd(f'max(future_range_{h}h)')} AS max FROM ranges""" for h in HZ)))
def range_description(spark, sf_dir):
    """Distribution of every range target, described in one long pass."""
    long = _ranges(spark, sf_dir).select(F.explode(F.array(*[
        F.struct(F.lit(f"{h}h").alias("target"), col(f"future_range_{h}h").alias("value")) for h in HZ])).alias("t")).select("t.*")
    out = agg.describe(shared(long.filter(col("value").isNotNull())), "value", ["target"])
    return out.select("target", "count", *rounded("mean", "std", "min", "p25", "p50", "p75", "max"))


@query("a25_missing_business_days", with_tables("dbars", """
s AS (SELECT ticker, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 DAY)) AS day FROM dbars GROUP BY 1)""",
    body="SELECT ticker, day FROM s WHERE isodow(day) < 6 AND (ticker, day) NOT IN (SELECT (ticker, datetime) FROM dbars)"))
def missing_days(spark, sf_dir):
    days = agg.missing_business_days(inputs.daily_bars(spark, sf_dir), keys=["ticker"])
    return days.select("ticker", col("day").cast("timestamp").alias("day"))


@query("a26_last_bar_with_atr", with_tables("bars", BASE_SQL, wilder("t0", "a", {"atr": ("trange", 14)}), recursive=True, body=f"""
SELECT ticker, datetime, close, {rd('atr', 5)} AS atr FROM (SELECT *, row_number() OVER (PARTITION BY ticker
  ORDER BY datetime DESC) AS k FROM t0 LEFT JOIN a USING (ticker, datetime)) WHERE k = 1"""))
def last_with_atr(spark, sf_dir):
    out = over_bars(inputs.bars(spark, sf_dir),
                    lambda df, w: ind.with_atr(ind.with_true_range(df, w), w, atr=14), back=1)
    last = out.groupBy("ticker").agg(F.max_by(F.struct("datetime", "close", "atr"), "datetime").alias("b"))
    return last.select("ticker", "b.datetime", "b.close", r("b.atr", 5).alias("atr"))


_STOP = ["the", "and", "of", "to", "in", "is", "it", "for", "on", "with", "as", "at", "by", "be", "an", "or", "this", "that"]


@query("x16_ngrams", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({', '.join(quoted(s) for s in _STOP)})) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS word FROM w)
SELECT word, count(*) AS count FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""")
def ngrams(spark, sf_dir):
    return agg.ngram_counts(inputs.documents(spark, sf_dir), "text", "doc_id", (1, 2), min_df=5, stop_words=_STOP)
