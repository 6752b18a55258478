"""Queries over text and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from squallbars.catalog.registry import query, r
from squallbars.catalog.sql import rd, with_tables
from squallbars.functions import texts, times, vocab
from squallbars.operators import events as ev
from squallbars.session import shared
from squallbars.sources import inputs

col = F.col
LO, HI, NOW = "2024-01-05", "2024-01-12", "2024-01-10 09:30:00"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_sql(c: str, rules, default: str = "NULL") -> str:
    arms = []
    for needed, any_of, label in rules:
        tests = [f"contains(upper(coalesce({c}, 'none')), {quoted(n)})" for n in needed]
        if any_of:
            tests.append("(" + " OR ".join(f"contains(upper(coalesce({c}, 'none')), {quoted(n)})" for n in any_of) + ")")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {quoted(label)}")
    return f"CASE {' '.join(arms)} ELSE {default} END"


def hits_sql(c: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce({c}, 'none')), {quoted(w)}) AS INT)" for w in words) + ")"


def best_sql(c: str, classes) -> str:
    counts = "[" + ", ".join(hits_sql(c, ws) for ws in classes.values()) + "]"
    names = "[" + ", ".join(quoted(n) for n in classes) + "]"
    return (f"CASE WHEN list_max({counts}) = 0 THEN 'OTHER' ELSE {names}[list_position({counts}, list_max({counts}))] END")


def map_sql(c: str, table: dict, default) -> str:
    lit = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


# ---- classification ---------------------------------------------------------------------------------
@query("x01_classify_source", with_tables("calendar", body=f"""
SELECT event_id, {best_sql('source', vocab.SOURCE_CLASSES)} AS source_class FROM calendar"""))
def classify_source(spark, sf_dir):
    rows = texts.folded(inputs.calendar(spark, sf_dir), "source")
    return rows.select(
        "event_id", texts.best_class(col("_low"), vocab.SOURCE_CLASSES).alias("source_class"))


@query("x01_classify_document_source", f"""
SELECT doc_id, {best_sql('text', vocab.SOURCE_CLASSES)} AS source_class FROM documents""")
def classify_document_source(spark, sf_dir):
    return texts.folded(inputs.documents(spark, sf_dir), "text").select(
        "doc_id", texts.best_class(col("_low"), vocab.SOURCE_CLASSES).alias("source_class"))


@query("x02_class_counts", "SELECT doc_id, " + ", ".join(
    f"{hits_sql('text', ws)} AS event_{n}" for n, ws in vocab.EVENT_CLASSES.items()) + " FROM documents")
def class_counts(spark, sf_dir):
    counts = texts.keyword_counts(col("_low"), vocab.EVENT_CLASSES)
    return texts.folded(inputs.documents(spark, sf_dir), "text").select("doc_id", *[c.alias(f"event_{n}") for n, c in counts.items()])


@query("x03_news_class", f"SELECT doc_id, {best_sql('text', vocab.NEWS_CLASSES)} AS news_class FROM documents")
def news_class(spark, sf_dir):
    return texts.folded(inputs.documents(spark, sf_dir), "text").select(
        "doc_id", texts.best_class(col("_low"), vocab.NEWS_CLASSES).alias("news_class"))


_months = "|".join(vocab.MONTH_TOKENS)


@query("x04_release_period", with_tables("calendar", body=f"""
SELECT event_id, CASE WHEN regexp_matches(upper(coalesce(period, 'none')), '{_months}') THEN 'M'
  WHEN regexp_matches(upper(coalesce(period, 'none')), 'Q1|Q2|Q3|Q4') THEN 'Q' END AS release_period FROM calendar"""))
def release_period(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("event_id", texts.release_period(col("period")).alias("release_period"))


_stage = [(["PREL"], [], "Preliminary"), (["FLASH"], [], "Flash"), (["FINAL"], [], "Final")]
_calc = [(["MOM"], [], "MoM"), (["QOQ"], [], "QoQ"), (["YOY"], [], "YoY")]


@query("x05_release_stage", with_tables("calendar", body=f"SELECT event_id, {rules_sql('title', _stage)} AS stage FROM calendar"))
def release_stage(spark, sf_dir):
    return texts.folded(inputs.calendar(spark, sf_dir), "title").select("event_id", texts.release_stage(col("_up")).alias("stage"))


@query("x06_calculation_period", with_tables("calendar", body=f"SELECT event_id, {rules_sql('title', _calc)} AS calc FROM calendar"))
def calculation_period(spark, sf_dir):
    return texts.folded(inputs.calendar(spark, sf_dir), "title").select("event_id", texts.calculation_period(col("_up")).alias("calc"))


@query("x07_main_event", with_tables("calendar", body=f"""
SELECT event_id, {rules_sql('title', vocab.MAIN_EVENT_RULES)} AS main_event FROM calendar"""))
def main_event(spark, sf_dir):
    return texts.folded(inputs.calendar(spark, sf_dir), "title").select("event_id", texts.main_event(col("_up")).alias("main_event"))


@query("x08_event_type", with_tables("calendar", body=f"""
SELECT event_id, {rules_sql('title', vocab.EVENT_TYPE_RULES, "'OTHER'")} AS event_type,
  {rules_sql('title', vocab.SPECIFIC_TYPE_RULES, "'OTHER'")} AS specific_type FROM calendar"""))
def event_type(spark, sf_dir):
    return texts.folded(inputs.calendar(spark, sf_dir), "title").select(
        "event_id", texts.event_type(col("_up")).alias("event_type"),
        texts.specific_type(col("_up")).alias("specific_type"))


_cleaned = ("array_to_string(list_transform(string_split(trim(regexp_replace(upper(coalesce(indicator, 'none')), "
            "'\\s+(MOM|YOY|QOQ|ANNUAL|FLASH|PREL|FINAL).*', '', 'i')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")


@query("x09_specific_event", with_tables("calendar", body=f"""
SELECT event_id, {rules_sql('title', vocab.SPECIFIC_NAME_RULES, f"CASE WHEN upper(coalesce(indicator, 'none')) NOT IN ('CALENDAR', 'HOLIDAYS', 'NONE', 'NAN') THEN {_cleaned} END")} AS specific_event FROM calendar"""))
def specific_event(spark, sf_dir):
    return texts.folded(inputs.calendar(spark, sf_dir), "title").select(
        "event_id", texts.specific_name(col("_up"), col("indicator")).alias("specific_event"))


@query("x10_flags", with_tables("calendar", body="""
SELECT event_id, CAST(coalesce(indicator = 'Calendar', false) AS INT) AS is_calendar,
  CAST(contains(lower(coalesce(title, 'none')), 'president') AS INT) AS is_president,
  CAST(contains(lower(coalesce(title, 'none')), 'election') AS INT) AS is_election FROM calendar"""))
def flags(spark, sf_dir):
    rows = ev.event_features(inputs.calendar(spark, sf_dir))
    return rows.select("event_id", "is_calendar", "is_president", "is_election")


FEATURE_SQL = f"""feats AS (SELECT event_id, date, title, importance, category, currency, country, scale, actual,
  {best_sql('source', vocab.SOURCE_CLASSES)} AS source, {rules_sql('title', _stage)} AS stage_release,
  {rules_sql('title', _calc)} AS calc_period, {rules_sql('title', vocab.MAIN_EVENT_RULES)} AS mie,
  {', '.join(f"{hits_sql('title', ws)} AS event_{n}" for n, ws in vocab.EVENT_CLASSES.items())},
  CAST(coalesce(indicator = 'Calendar', false) AS INT) AS is_calendar,
  CAST(contains(lower(coalesce(title, 'none')), 'president') AS INT) AS is_president FROM calendar)"""
VOCAB = {
    "category": [v for v in inputs.CATEGORIES if v], "currency": inputs.CURRENCIES, "country": inputs.COUNTRIES,
    "source": ["CENTRAL_BANK", "OFFICIAL_STATS", "GOV_MINISTRY", "RATING_AGENCY"],
    "stage_release": ["Preliminary", "Flash", "Final"], "calc_period": ["MoM", "QoQ", "YoY"],
    "scale": [v for v in inputs.SCALES if v],
    "mie": ["Core_Inflation_rate", "Inflation_rate", "Interest_Rate_Decision", "NFP", "GDP", "FOMC",
            "PMI_Manufacturing", "PMI_Services", "PMI", "Retail_Sales", "Unemployment_rate", "Balance_of_Trade"],
}
FLAG_SQL = [(f"{c}_{v}", f"CAST(coalesce({c}, 'None') = '{v}' AS INT)") for c, vs in VOCAB.items() for v in vs]


@query("x11_one_hot", with_tables("calendar", FEATURE_SQL, body=f"""
SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in FLAG_SQL)} FROM feats"""))
def one_hot(spark, sf_dir):
    feats = ev.event_features(inputs.calendar(spark, sf_dir))
    return ev.encode(feats, ev.fit_vocabulary(feats)).select("event_id", *[n for n, _ in FLAG_SQL])


_pairs = " UNION ALL ".join(f"SELECT event_id, '{c}' AS c, coalesce({c}, 'None') AS v FROM feats" for c in VOCAB)


@query("x11_sparse_codes", with_tables("calendar", FEATURE_SQL, f"p AS ({_pairs})", """
k AS (SELECT * FROM p WHERE NOT regexp_matches(lower(c || '_' || v), '(other|none)$')), """ """
ids AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS id FROM (SELECT DISTINCT c, v FROM k))""", body="""
SELECT event_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id), '') AS ids FROM feats LEFT JOIN k USING (event_id) LEFT JOIN ids USING (c, v) GROUP BY 1"""))
def sparse_codes(spark, sf_dir):
    """The encoding of category values as ids, for any number of values."""
    feats = shared(ev.event_features(inputs.calendar(spark, sf_dir)).select("event_id", *ev.CATEGORICAL))
    coded = ev.encode_sparse(feats, ev.category_ids(feats), "event_id")
    return coded.select("event_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("x12_event_features", with_tables("calendar", FEATURE_SQL, body=f"""
SELECT event_id, {', '.join(f'event_{n}' for n in vocab.EVENT_CLASSES)}, is_calendar, is_president, mie, source,
  stage_release, calc_period FROM feats"""))
def event_features(spark, sf_dir):
    rows = ev.event_features(inputs.calendar(spark, sf_dir))
    return rows.select("event_id", *[f"event_{n}" for n in vocab.EVENT_CLASSES], "is_calendar", "is_president", "mie",
                       "source", "stage_release", "calc_period")


_raw = ("CASE event_id % 6 WHEN 0 THEN '$' || CAST(event_id AS VARCHAR) || ',000' WHEN 1 THEN CAST(event_id AS VARCHAR) "
        "|| '.5%' WHEN 2 THEN 'about -' || CAST(event_id AS VARCHAR) || ' jobs' WHEN 3 THEN ' £12.25 ' WHEN 4 THEN 'n/a' END")
_txt = f"translate(trim({_raw}), ',$€£', '')"


@query("x13_economic_value", f"""
SELECT event_id, round(CASE WHEN contains({_txt}, '%') THEN TRY_CAST(replace({_txt}, '%', '') AS DOUBLE) / 100.0::DOUBLE
  ELSE coalesce(TRY_CAST({_txt} AS DOUBLE), TRY_CAST(regexp_extract({_txt}, '-?\\d+\\.?\\d*') AS DOUBLE)) END, 6)
  AS value_norm FROM events""")
def economic_value(spark, sf_dir):
    i = col("event_id")
    raw = (F.when(i % 6 == 0, F.concat(F.lit("$"), i.cast("string"), F.lit(",000")))
           .when(i % 6 == 1, F.concat(i.cast("string"), F.lit(".5%")))
           .when(i % 6 == 2, F.concat(F.lit("about -"), i.cast("string"), F.lit(" jobs")))
           .when(i % 6 == 3, " £12.25 ").when(i % 6 == 4, "n/a"))
    return inputs.table(spark, sf_dir, "events").select("event_id", r(texts.economic_value(raw)).alias("value_norm"))


@query("x14_rank_and_weight", with_tables("calendar", body=f"""
SELECT event_id, {map_sql(rules_sql('title', vocab.EVENT_TYPE_RULES, "'OTHER'"), vocab.TYPE_WEIGHTS, 1)} AS event_weight,
  CASE importance WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS impact_rank FROM calendar"""))
def rank_and_weight(spark, sf_dir):
    label = F.element_at(F.array(F.lit("Low Impact Expected"), F.lit("Medium Impact Expected"),
                                 F.lit("High Impact Expected")), col("importance") + 2)
    return texts.folded(inputs.calendar(spark, sf_dir), "title").select(
        "event_id", texts.lookup(texts.event_type(col("_up")), vocab.TYPE_WEIGHTS, 1).alias("event_weight"),
        texts.lookup(label, vocab.IMPACT_RANKS, 0).alias("impact_rank"))


_detail = ("'Source: ' || coalesce(source, '') || ' | Measures: ' || coalesce(title, 'n/a') || ' | Frequency: monthly' "
           "|| CASE WHEN event_id % 2 = 0 THEN ' | Speaker: chair ' || currency ELSE '' END")


def _with_detail(spark, sf_dir):
    text = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("")), F.lit(" | Measures: "),
                    F.coalesce("title", F.lit("n/a")), F.lit(" | Frequency: monthly"),
                    F.when(col("event_id") % 2 == 0, F.concat(F.lit(" | Speaker: chair "), "currency")).otherwise(""))
    return inputs.calendar(spark, sf_dir).withColumn("detail", text)


@query("x15_detail_fields", with_tables("calendar", f"d AS (SELECT event_id, {_detail} AS detail FROM calendar)", body="""
SELECT event_id, """ + ", ".join(
    f"nullif(regexp_extract(detail, '{f}:\\s*([^|]+)', 1), '') AS {f.lower().replace(' ', '_')}"
    for f in vocab.DETAIL_FIELDS) + " FROM d"))
def detail_fields(spark, sf_dir):
    return _with_detail(spark, sf_dir).select("event_id", *[
        texts.detail_field(col("detail"), f).alias(f.lower().replace(" ", "_")) for f in vocab.DETAIL_FIELDS])


@query("x15_field_frequency", """
SELECT field, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[A-Za-z][A-Za-z\\s]*:')) AS field FROM pages)
GROUP BY field""")
def field_frequency(spark, sf_dir):
    names = F.explode(texts.field_names(col("html")))
    return (inputs.table(spark, sf_dir, "pages").select(names.alias("field")).groupBy("field")
            .agg(F.count(F.lit(1)).alias("n")))


_html = "coalesce({c}, 'N/A')"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _html = f"replace({_html}, '{_a}', '{_b}')"


@query("x17_event_line", with_tables("calendar", body=f"""
SELECT event_id, '• <b>' || {_html.format(c="title || ' & <' || currency || '>'")} || '</b> when ' ||
  strftime(date, '%Y-%m-%d %H:%M') || ' UTC+00:00 importance ' ||
  CASE importance WHEN -1 THEN 'Low' WHEN 0 THEN 'Medium' ELSE '<b>High</b>' END AS line FROM calendar"""))
def event_line(spark, sf_dir):
    from squallbars.operators.alerts import event_line as line

    title = F.concat("title", F.lit(" & <"), "currency", F.lit(">"))
    return inputs.calendar(spark, sf_dir).select("event_id", line(title, col("date"), F.lit(0.0), col("importance")).alias("line"))


@query("x18_valid_offset", with_tables("settings", body="""
SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 0.0::DOUBLE WHEN CAST(user_timezone AS DOUBLE) * 1.2 BETWEEN -12 AND 14
  THEN round(CAST(user_timezone AS DOUBLE) * 1.2, 6) ELSE 0.0::DOUBLE END AS offset_hours FROM settings"""))
def valid_offset(spark, sf_dir):
    raw = F.when(col("user_id") % 7 == 0, "not a number").otherwise(
        (col("user_timezone").cast("double") * 1.2).cast("string"))
    return inputs.user_settings(spark, sf_dir).select("user_id", r(texts.valid_offset(raw)).alias("offset_hours"))


# ---- time scalars -----------------------------------------------------------------------------------
@query("d01_time_buckets", with_tables("calendar", body="""
SELECT event_id, date_trunc('hour', date) AS hourly, date_trunc('day', date)::TIMESTAMP AS daily,
  date_trunc('week', date)::TIMESTAMP AS weekly FROM calendar"""))
def time_buckets(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select(
        "event_id", *[times.bucket(col("date"), m).alias(m) for m in ("hourly", "daily", "weekly")])


def slot_sql(c: str, freq: str) -> str:
    step = 1800 if freq == "30min" else 3600
    up = (f"(minute({c}) BETWEEN 20 AND 29 OR minute({c}) BETWEEN 50 AND 59)" if freq == "30min" else f"minute({c}) >= 30")
    units = f"epoch_us({c}) / {step}e6"
    return f"make_timestamp(CAST(CASE WHEN {up} THEN ceil({units}) ELSE floor({units}) END AS BIGINT) * {step}000000)"


@query("d02_nearest_slot", with_tables("calendar", body=f"""
SELECT event_id, {slot_sql('date', '30min')} AS half_hour, {slot_sql('date', 'h')} AS hour FROM calendar"""))
def nearest_slot(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("event_id", times.nearest_slot(col("date"), "30min").alias("half_hour"),
                                                 times.nearest_slot(col("date"), "h").alias("hour"))


@query("d03_calendar_parts", with_tables("dbars", body="""
SELECT ticker, datetime, CAST(week(datetime) AS INT) AS week, CAST(month(datetime) AS INT) AS month,
  CAST(quarter(datetime) AS INT) AS quarter, CAST(isodow(datetime) - 1 AS INT) AS dayofweek,
  CAST(day(datetime) AS INT) AS day, CAST(hour(datetime) AS INT) AS hour FROM dbars"""))
def calendar_parts(spark, sf_dir):
    return inputs.daily_bars(spark, sf_dir).select(
        "ticker", "datetime", *[c.alias(n) for n, c in times.parts(col("datetime")).items()])


_shifted = "datetime + INTERVAL 1 HOUR * ((year(datetime) * 31 + day(datetime)) % 24)"
SESSION_SQL = """CAST(CASE WHEN month(t) BETWEEN 3 AND 10 THEN hour(t) BETWEEN 7 AND 15 ELSE hour(t) BETWEEN 8 AND 16 END
  AS INT) AS is_europe, CAST(CASE WHEN month(t) BETWEEN 3 AND 10 THEN hour(t) BETWEEN 13 AND 21
  ELSE hour(t) BETWEEN 14 AND 22 END AS INT) AS is_usa, CAST(hour(t) < 9 AS INT) AS is_asia"""


@query("d04_sessions", with_tables("dbars", f"h AS (SELECT ticker, {_shifted} AS t FROM dbars)",
                                   body=f"SELECT ticker, t, {SESSION_SQL} FROM h"))
def sessions(spark, sf_dir):
    t = col("datetime") + F.make_dt_interval(hours=(F.year("datetime") * 31 + F.dayofmonth("datetime")) % 24)
    return (inputs.daily_bars(spark, sf_dir).select("ticker", t.alias("t"))
            .select("ticker", "t", *[c.alias(n) for n, c in times.sessions(col("t")).items()]))


@query("d05_hour_wave", with_tables("calendar", body=f"""
SELECT event_id, CASE WHEN abs(s) < 1e-9 THEN 0 ELSE {rd('s')} END AS sin_hour, CASE WHEN abs(c) < 1e-9 THEN 0
  ELSE {rd('c')} END AS cos_hour FROM (SELECT event_id, sin(hour(date) * 2 * pi() / 24) AS s,
  cos(hour(date) * 2 * pi() / 24) AS c FROM calendar)"""))
def hour_wave(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select(
        "event_id", *[r(c).alias(n) for n, c in times.hour_wave(col("date")).items()])


LOCAL_SQL = ("CAST(hour(timezone(" + map_sql("currency", vocab.CURRENCY_ZONES, "'UTC'")
             + ", timezone('UTC', date))) AS INT)")


@query("d06_local_hour", with_tables("calendar", body=f"SELECT event_id, {LOCAL_SQL} AS local_hour FROM calendar"))
def local_hour(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("event_id", times.local_hour(col("date"), col("currency")).alias("local_hour"))


BDAY_SQL = "CAST({d} AS DATE) - CASE isodow({d}) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END"


@query("d07_time_to_check", with_tables("calendar", body=f"""
SELECT event_id, date_trunc('hour', date) - INTERVAL 1 HOUR AS hourly,
  ({BDAY_SQL.format(d='date')})::TIMESTAMP AS daily FROM calendar"""))
def time_to_check(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select(
        "event_id", ev.time_to_check(times.bucket(col("date"))).alias("hourly"),
        ev.time_to_check(times.bucket(col("date"), "daily"), "daily").alias("daily"))


@query("d08_time_zones", with_tables("calendar", body="""
SELECT event_id, timezone('Europe/Moscow', timezone('UTC', date)) AS moscow,
  timezone('UTC', timezone('Australia/Sydney', date)) AS sydney_to_utc, date + INTERVAL 90 MINUTE AS plus_90 FROM calendar"""))
def time_zones(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select(
        "event_id", F.from_utc_timestamp("date", "Europe/Moscow").alias("moscow"),
        F.to_utc_timestamp("date", "Australia/Sydney").alias("sydney_to_utc"),
        times.shift_hours(col("date"), F.lit(1.5)).alias("plus_90"))


@query("d09_day_and_week_bounds", with_tables("calendar", body="""
SELECT event_id, date_trunc('day', date)::TIMESTAMP AS day_start, date_trunc('day', date)::TIMESTAMP + INTERVAL 1 DAY AS day_end,
  CAST(date AS DATE) + CAST(CASE WHEN isodow(date) = 7 THEN 7 ELSE 7 - isodow(date) END AS INT)::INT + INTERVAL 0 DAY AS next_sunday FROM calendar"""))
def bounds(spark, sf_dir):
    start = F.date_trunc("day", "date")
    return inputs.calendar(spark, sf_dir).select(
        "event_id", start.alias("day_start"), (start + F.expr("interval 1 day")).alias("day_end"),
        times.next_sunday(F.to_date("date")).cast("timestamp").alias("next_sunday"))


_left = f"CAST(floor(epoch_us(date) / 1e6 - epoch(TIMESTAMP '{NOW}')) AS BIGINT)"


@query("d10_time_left", with_tables("calendar", f"l AS (SELECT event_id, {_left} AS s FROM calendar)", body="""
SELECT event_id, CAST(floor(s / 3600.0) AS BIGINT) || ' hours ' ||
  CAST(floor((s - floor(s / 3600.0) * 3600) / 60) AS BIGINT) || ' minutes' AS time_left FROM l"""))
def time_left(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select(
        "event_id", times.time_left(col("date"), F.lit(NOW).cast("timestamp")).alias("time_left"))


@query("d11_trigger_times", with_tables("calendar", body=f"""
SELECT DISTINCT date_trunc('hour', date) - INTERVAL 1 HOUR AS trigger_time FROM calendar
WHERE importance >= 0 AND date >= TIMESTAMP '{NOW}' AND date < TIMESTAMP '2024-01-11 23:59:59.999999'
  AND date_trunc('hour', date) - INTERVAL 1 HOUR >= TIMESTAMP '{NOW}'"""))
def trigger_times(spark, sf_dir):
    from squallbars.operators.alerts import trigger_times as triggers

    return triggers(inputs.calendar(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("d12_release_delay", with_tables("calendar", body=f"""
SELECT event_id, CAST(floor((epoch_us(date + INTERVAL 37 HOUR) - epoch_us(TIMESTAMP '{NOW}')) / 86400e6) AS BIGINT) AS days,
  {rd(f"(epoch_us(date + INTERVAL 37 HOUR) - epoch_us(TIMESTAMP '{NOW}')) / 3600e6")} AS hours FROM calendar"""))
def release_delay(spark, sf_dir):
    nxt = F.try_to_timestamp((col("date") + F.expr("interval 37 hours")).cast("string"))
    gap = times.seconds(nxt) - times.seconds(F.lit(NOW).cast("timestamp"))
    return inputs.calendar(spark, sf_dir).select("event_id", F.floor(gap / 86400).alias("days"), r(gap / 3600).alias("hours"))


@query("d13_wrapped_offset", with_tables("calendar", "o AS (SELECT event_id, 22 - hour(date) AS raw FROM calendar)", body="""
SELECT event_id, CAST(CASE WHEN raw > 12 THEN raw - 24 WHEN raw <= -12 THEN raw + 24 ELSE raw END AS INT) AS gmt FROM o"""))
def wrapped_offset(spark, sf_dir):
    return inputs.calendar(spark, sf_dir).select("event_id", times.wrapped_offset(22, F.hour("date")).alias("gmt"))


@query("d14_year_month", with_tables("dbars", body="""
SELECT strftime(datetime, '%Y-%m') AS year_month, count(*) AS bars FROM dbars GROUP BY 1"""))
def year_month(spark, sf_dir):
    return (inputs.daily_bars(spark, sf_dir).groupBy(F.date_format("datetime", "yyyy-MM").alias("year_month"))
            .agg(F.count(F.lit(1)).alias("bars")))
