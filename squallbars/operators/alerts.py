"""Forecast post-processing, alert selection and user digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallbars.functions import texts, times, vocab
from squallbars.session import shared

col = F.col
NOISE_MODELS = ["SFP", "Extremum Breakout", "Big Spike", "Chaos"]


def event_line(title: Column, date: Column, offset: Column, importance: Column) -> Column:
    """One escaped digest line with local time, offset and importance label."""
    local = times.shift_hours(date, offset)
    whole = F.floor(F.abs(offset))
    zone = F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad(whole.cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(((F.abs(offset) - whole) * 60).cast("int").cast("string"), 2, "0"))
    label = texts.lookup(importance.cast("string"), {str(k): v for k, v in vocab.IMPORTANCE_LABELS.items()}, "Unknown")
    return F.concat(F.lit("• <b>"), texts.html_escape(title), F.lit("</b> when "),
                    F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(" UTC"), zone, F.lit(" importance "), label)


def trigger_times(events: DataFrame, now: Column) -> DataFrame:
    """One hour before each bucket with a medium or high event, from now to the end of tomorrow."""
    end = F.date_trunc("day", now) + F.expr("interval 2 days") - F.expr("interval 1 microsecond")
    hour = F.date_trunc("hour", "date")
    return (events.filter((col("importance") >= 0) & (col("date") >= now) & (col("date") < end))
            .select((hour - F.expr("interval 1 hour")).alias("trigger_time")).distinct()
            .filter(col("trigger_time") >= now))


def risk_flags(prob: Column, model: str) -> Column:
    """Map of risk profile to whether the probability exceeds the profile's threshold."""
    return F.create_map(*[x for profile, t in vocab.RISK_THRESHOLDS.items()
                          for x in (F.lit(profile), prob > F.lit(t[model]))])


def ordered_quantiles(low: Column, mid: Column, high: Column) -> Column:
    """Predicted quantiles repaired to be non-decreasing."""
    q = F.array_sort(F.array(low, mid, high))
    return F.struct(q[0].alias("p10"), q[1].alias("p50"), q[2].alias("p90"))


def market_state(predictions: DataFrame) -> DataFrame:
    """Nested forecast, regime, noise flags and statistics per ticker."""
    forecast = F.struct(*[col(f"range_{h}h") for h in (1, 3, 6, 24)])
    noise = F.struct(*[F.struct(*[F.element_at(col(m), p).alias(m) for m in NOISE_MODELS]).alias(p)
                       for p in vocab.RISK_THRESHOLDS])
    return predictions.select("ticker", forecast.alias("forecast"),
                              F.struct(col("regime_1d").alias("short"), col("regime_2d").alias("long")).alias("regime"),
                              noise.alias("noise"), F.struct("direction_changes").alias("stats"))


def alerts(states: DataFrame) -> DataFrame:
    """One row per alert: (risk profile, category, ticker); range alerts hold for every profile."""
    big = [F.when(col("forecast.range_1h.p50") >= vocab.MOVE_1H_ATR, F.lit("movement_1h")),
           F.when(col("forecast.range_24h.p50") >= vocab.MOVE_24H_ATR, F.lit("movement_24h"))]
    per_profile = [_profile_rows(p, big) for p in vocab.RISK_THRESHOLDS]
    return states.select("ticker", F.explode(F.concat(*per_profile)).alias("a")).select("a.profile", "a.category", "ticker")


def _profile_rows(profile: str, shared_alerts: Sequence[Column]) -> Column:
    hits = F.array_compact(F.array(*shared_alerts, *[F.when(col(f"noise.{profile}")[m], F.lit(m)) for m in NOISE_MODELS]))
    return F.transform(hits, lambda c: F.struct(F.lit(profile).alias("profile"), c.alias("category")))


def alert_summary(alert_rows: DataFrame, states: DataFrame) -> DataFrame:
    """Per risk profile: whether any ticker has an alert, and the tickers of each category in order."""
    categories = ["movement_1h", "movement_24h", *NOISE_MODELS]
    lists = [F.array_sort(F.collect_set(F.when(col("category") == c, col("ticker")))).alias(c) for c in categories]
    found = alert_rows.groupBy("profile").agg(*lists)
    profiles = states.limit(1).select(F.explode(F.array(*[F.lit(p) for p in vocab.RISK_THRESHOLDS])).alias("profile"))
    none = F.array().cast("array<string>")
    out = profiles.join(found, "profile", "left")
    return out.select("profile", F.exists(F.array(*[F.size(F.coalesce(col(c), none)) for c in categories]), lambda n: n > 0).alias("any_alert"),
                      *[F.coalesce(col(c), none).alias(c) for c in categories])


def subscriber_digests(settings: DataFrame, events: DataFrame, day: Column, gmt: int) -> DataFrame:
    """The daily digest of each subscriber whose offset is due; users without events have no row."""
    groups = digest_groups(settings.join(daily_subscribers(settings, gmt), "user_id", "left_semi"))
    return addressed(groups, daily_digests(groups, events, day))


TILE_USERS, TILE_PAGES = 2048, 4
MOST_TASKS = 20_000


def addressed(groups: DataFrame, pages: DataFrame, users: int = TILE_USERS, most: int = TILE_PAGES) -> DataFrame:
    """Every page of a digest beside each of its users.

    The rows are users times pages, and few digests have all users. So a digest is dealt in tiles of about ``users`` users and
    ``most`` pages: a page is copied once per block of users, a user once per block of pages, and there are as many tasks as tiles.
    """
    from squallbars.operators.layout import attach_small

    keys, tile = ["offset", "levels"], ["_digest", "_users", "_pages"]
    groups, pages = shared(groups), shared(pages)
    sizes = (groups.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / users).alias("_u"))
             .join(pages.groupBy(*keys).agg((F.floor(F.max("page") / most) + 1).alias("_p")), keys))
    sizes = shared(sizes.withColumn("_digest", F.monotonically_increasing_id()))  # a number, as joins deal decimals anew
    tasks = min(max(sizes.agg(F.sum(col("_u") * col("_p"))).first()[0] or 1, 1), MOST_TASKS)

    def blocks(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), col(count) - 1))

    def placed(df: DataFrame) -> DataFrame:
        return attach_small(df, sizes, keys).filter(col("_u").isNotNull())

    readers = placed(groups).withColumn("_users", F.pmod(F.xxhash64("user_id"), "_u")).withColumn("_pages", blocks("_p"))
    copies = placed(pages).withColumn("_pages", F.floor(col("page") / most)).withColumn("_users", blocks("_u")).drop(*keys)
    left, right = (df.drop("_u", "_p").repartition(tasks, *tile) for df in (readers, copies))
    return left.join(right.hint("merge"), tile).select(*groups.columns, *[c for c in pages.columns if c not in keys])


def user_importance(settings: DataFrame) -> Column:
    """Importance levels the user wants, in order."""
    names = ((-1, "show_low_importance"), (0, "show_medium_importance"), (1, "show_high_importance"))
    return F.array_compact(F.array(*[F.when(col(n), F.lit(i)) for i, n in names]))


def daily_subscribers(settings: DataFrame, gmt: int) -> DataFrame:
    return settings.filter(col("daily_alerts") & (F.floor("user_timezone") == gmt)).select("user_id")


def digest_groups(settings: DataFrame) -> DataFrame:
    """Users with the key of the digest they share: UTC offset and importance set."""
    return settings.select("user_id", col("user_timezone").cast("double").alias("offset"),
                           F.concat_ws(",", F.transform(user_importance(settings), lambda i: i.cast("string"))).alias("levels"))


MOST_DIGESTS = 10_000


def digests(groups: DataFrame, events: DataFrame, day_of, page: int = 500) -> DataFrame:
    """Ordered lines per (offset, importance set, local day, page).

    Users outnumber the distinct (offset, set) pairs, which are few by construction (27 hours in half
    steps, seven sets; more than ``MOST_DIGESTS`` are an error): each digest is built once and users refer to it, instead of
    users times events. The pairs are one small value beside each event, so no row is dealt by its level, and an event's line is
    written once for each offset, before it goes to the sets that want it.
    A digest of more than ``page`` lines has several rows; ``n_events`` counts the whole digest on each.
    """
    sets = groups.filter("levels <> ''").groupBy("offset").agg(F.collect_set("levels").alias("sets"))
    few = F.coalesce(F.sum(F.size("sets")), F.lit(0)) <= MOST_DIGESTS
    offers = sets.agg(F.when(few, F.collect_list(F.struct("offset", "sets"))).otherwise(F.raise_error(F.lit("too many offsets and importance sets")))).scalar()

    def wants(levels: Column) -> Column:
        return F.array_contains(F.split(levels, ","), col("level"))

    placed = events.withColumns({"level": col("importance").cast("string"), "_offers": offers})
    own = F.filter("_offers", lambda o: F.exists(o["sets"], wants))
    lines = (placed.select(*events.columns, "level", F.explode(own).alias("_o")).withColumn("offset", col("_o.offset"))
             .withColumn("day", day_of(col("date"), col("offset"))).filter(col("day").isNotNull())
             .withColumn("line", event_line(col("title"), col("date"), col("offset"), col("importance"))))
    rows = lines.select("offset", "day", "date", "event_id", "line", F.explode(F.filter(col("_o.sets"), wants)).alias("levels"))
    from squallbars.operators.layout import number_rows

    keys = ["offset", "levels", "day"]
    numbered = number_rows(rows, keys, "date", ["event_id"], unit="hour", out="_n")
    pages = (numbered.groupBy(*keys, F.floor(col("_n") / page).alias("page"))
             .agg(F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list(F.struct("_n", "line"))).alias("l")))
    return pages.select(*keys, "page", F.sum("_c").over(Window.partitionBy(*keys)).alias("n_events"),
                        F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def daily_alerts(predictions: DataFrame, impulse: str, bar: str) -> DataFrame:
    """Tickers with an impulse or bar-type alert for the day."""
    flags = predictions.select("ticker", (col(impulse) > vocab.DAILY_THRESHOLD).alias("impulse_bar"),
                               (col(bar) > vocab.DAILY_THRESHOLD).alias("bar_type"))
    return flags.filter("impulse_bar or bar_type")


def daily_digests(groups: DataFrame, events: DataFrame, day: Column) -> DataFrame:
    """Digests of one UTC day, each user group seeing its own importance levels and local times."""
    todays = events.filter((col("date") >= day) & (col("date") < day + F.expr("interval 1 day")))
    return digests(groups, todays, lambda date, offset: day)


def weekly_digests(groups: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """Digests from today to the end of the coming Sunday, one per local day."""
    end = F.date_add(times.next_sunday(F.to_date(today)), 1).cast("timestamp")
    week = events.filter((col("date") >= F.date_trunc("day", today)) & (col("date") < end))
    return digests(groups, week, lambda date, offset: F.date_trunc("day", times.shift_hours(date, offset)))


def toggle(settings: DataFrame, flag: str) -> DataFrame:
    return settings.withColumn(flag, ~col(flag))
