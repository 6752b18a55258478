"""Calendar events: text features, encoding, time buckets and bucket aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.functions import texts, times, vocab
from squallbars.operators.layout import attach_small, fill_forward, number_rows, over_series

col = F.col
CATEGORICAL = ["category", "currency", "country", "source", "stage_release", "calc_period", "scale", "mie"]
SUM_PREFIXES = ("category", "currency", "country", "source", "event", "stage_release", "calc_period", "is_calendar",
                "is_president", "mie_")


def event_features(events: DataFrame) -> DataFrame:
    """Stage, period, source class, nine class counts, main event and flags of each event."""
    low, up = col("_low"), col("_up")
    counts = texts.keyword_counts(low, vocab.EVENT_CLASSES)
    kept = [c for c in events.columns if c != "source"]
    out = texts.folded(events, "title", _source="source").select(
        *kept, texts.best_class(col("_source"), vocab.SOURCE_CLASSES).alias("source"),
        texts.release_stage(up).alias("stage_release"), texts.calculation_period(up).alias("calc_period"),
        *[c.alias(f"event_{n}") for n, c in counts.items()], texts.main_event(up).alias("most_important_event"),
        texts.is_calendar(col("indicator")).alias("is_calendar"), texts.mentions(low, "president").alias("is_president"),
        texts.mentions(low, "election").alias("is_election"))
    return out.withColumn("mie", col("most_important_event"))


WIDEST = 5_000


def category_pairs(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value), from the distinct combinations of the columns; nulls read None."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_category(col(c)).alias("value")) for c in columns]))
    return features.select(*columns).distinct().select(pairs.alias("p")).select("p.*").distinct()


def fit_vocabulary(features: DataFrame, columns: Sequence[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Sorted category values per column, each of which becomes a column of the encoded frame.

    A schema holds `WIDEST` of them at most: more are an error, and `category_ids` with `encode_sparse`, or `category_sums`, take
    any number without gathering them.
    """
    rows = category_pairs(features, columns).limit(WIDEST + 1).collect()
    if len(rows) > WIDEST:
        raise ValueError(f"more than {WIDEST} category values: use category_ids and encode_sparse")
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}


def _catch_all(column: Column, value: Column) -> Column:
    return F.lower(F.concat_ws("_", column, value)).rlike("(other|none)$")


def category_ids(features: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(column, value, id) of every category value but catch-alls: ids count from 0 in the order of column and value.

    Values are ranked by dealt ranges and stay distributed, however many there are.
    """
    kept = category_pairs(features, columns).filter(~_catch_all(col("column"), col("value")))
    return number_rows(kept, [], "column", ["value"], out="id")


def encode_sparse(features: DataFrame, ids: DataFrame, key: str, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(key, ids): the ascending ids of a row's category values, the places of its ones in a vector as wide as ``ids``.

    Unknown values have no id. Ids are looked up for each distinct combination of values, not for each row.
    """
    rows = features.select(key, *[as_category(col(c)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]))
    combos = rows.select(*columns).distinct()
    coded = (combos.select("*", pairs.alias("p")).select(*columns, "p.*").join(ids, ["column", "value"])
             .groupBy(*columns).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    return attach_small(rows, coded, columns).select(key, F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))


def category_sums(features: DataFrame, bucket: str, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Counts per (bucket, column, value) in long form, for any number of values; catch-all values dropped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_category(col(c)).alias("value")) for c in columns]))
    rows = features.groupBy(bucket, *columns).agg(F.count(F.lit(1)).alias("_n")).select(bucket, "_n", pairs.alias("p"))
    return rows.filter(~_catch_all(col("p.column"), col("p.value"))).groupBy(bucket, col("p.column").alias("column"), col("p.value").alias("value")).agg(F.sum("_n").alias("n"))


def as_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def encode(features: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per known category value; unseen values give all zeros; catch-all columns dropped."""
    kept = [c for c in features.columns if c not in vocabulary]
    flags = [(as_category(col(c)) == v).cast("int").alias(f"{c}_{v}") for c, vs in vocabulary.items() for v in vs]
    return drop_catch_all(features.select(*kept, *flags))


def drop_catch_all(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.lower().endswith(("other", "none")) and c != "source_url"])


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the fitted columns in order; missing ones are zero."""
    return df.select(*[col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


def with_bucket(events: DataFrame, method: str = "hourly", crop: str = "1st") -> DataFrame:
    """Add ``rounded_time``: start of the bucket, or the nearest hour with ``crop='2nd'``."""
    slot = times.nearest_slot(col("date"), "h") if (method, crop) == ("hourly", "2nd") else times.bucket(col("date"), method)
    return events.withColumn("rounded_time", slot)


def main_event_of(date: str = "date", row_id: str = "event_id") -> Column:
    """Main event with the highest weight in the group; earliest on ties; a fixed text when none.

    Labels are aggregated as positions in the fixed list, and the order as one decimal, so that the
    whole bucket aggregation runs as a hash aggregation.
    """
    names = F.array(*[F.lit(n) for n in vocab.MAIN_EVENT_WEIGHTS])
    label = col("most_important_event")
    weight = texts.lookup(label, vocab.MAIN_EVENT_WEIGHTS, 0).cast("decimal(1,0)")
    earlier = times.ordered_rank(date, row_id).cast("decimal(36,0)")
    rank = weight * F.expr("cast('1000000000000000000000000000000000000' as decimal(37,0))") - earlier
    best = F.max_by(F.coalesce(F.array_position(names, label), F.lit(0)).cast("int"), rank)
    return F.coalesce(F.get(names, best - 1), F.lit(vocab.NO_MAIN_EVENT))


def aggregate_buckets(encoded: DataFrame, bucket: str = "rounded_time") -> DataFrame:
    """Counts, main event and category sums per bucket in one aggregation."""
    sums = [c for c, kind in encoded.dtypes if c.startswith(SUM_PREFIXES) and kind in ("int", "bigint")
            and c not in ("event_id", "is_election", bucket)]
    return encoded.groupBy(bucket).agg(
        F.count("title").alias("news_count"), F.count_if(col("importance") == 1).alias("high_impact_count"),
        F.count("most_important_event").alias("key_event_count"), main_event_of().alias("main_event"),
        *[F.sum(c).cast("int").alias(c) for c in sums])


def neighbour_features(buckets: DataFrame, bucket: str = "rounded_time") -> DataFrame:
    """Values and distances (in half hours) of the previous and next bucket; missing numbers are 0."""
    def build(df, w):
        cols = {}
        for c in ("news_count", "high_impact_count", "main_event"):
            cols[f"prev_hour_{c}"], cols[f"next_hour_{c}"] = w.lag(c), w.lead(c)
        at = F.unix_seconds(bucket)
        cols["time_passed_from_last_events"] = (at - F.lag(at).over(w.base)) / 1800
        cols["time_left_to_next_events"] = (F.lead(at).over(w.base) - at) / 1800
        cols["last_important_event_in_hours"] = (at - F.lag(at).over(w.base)) / 3600
        zero = [n for n in cols if not n.endswith("main_event") and n != "last_important_event_in_hours"]
        return df.select("*", *[(F.coalesce(c, F.lit(0)) if n in zero else c).alias(n) for n, c in cols.items()])

    return over_series(buckets, build, [], bucket, back=1, ahead=1, unit="year")


def hours_since(buckets: DataFrame, mask: Column, name: str, bucket: str = "rounded_time",
                carry: dict[str, Column] | None = None) -> DataFrame:
    """Hours since the last earlier bucket where ``mask`` holds, plus carried values of that bucket."""
    values = {f"_at_{name}": F.when(mask, col(bucket)), **{k: F.when(mask, v) for k, v in (carry or {}).items()}}
    out = fill_forward(buckets, [], bucket, values, strict=True, unit="year")
    gap = (F.unix_seconds(bucket) - F.unix_seconds(f"_at_{name}")) / 3600
    return out.withColumn(name, gap).drop(f"_at_{name}")


def time_to_check(bucket: Column, method: str = "hourly") -> Column:
    """When a forecast for the bucket is due: an hour, or a business day, before."""
    if method == "daily":
        return times.previous_business_day(bucket).cast("timestamp")
    return times.hours_before(bucket, 1)


def preprocess(events: DataFrame, vocabulary: dict[str, list[str]] | None = None, method: str = "hourly",
               crop: str = "1st") -> DataFrame:
    """Events to model-ready buckets: features, encoding, aggregation, neighbours, due time."""
    features = event_features(events)
    encoded = encode(features, vocabulary or fit_vocabulary(features))
    buckets = neighbour_features(aggregate_buckets(with_bucket(encoded, method, crop)))
    return buckets.withColumn("time_to_check", time_to_check(col("rounded_time"), method))


# ---- richer bucket aggregates -----------------------------------------------------------------------
def typed(events: DataFrame, freq: str = "30min") -> DataFrame:
    """Event type, weight, impact rank 0..2, key flag and half-hour slot of each event."""
    kinds = texts.folded(events, "title").select(*events.columns, texts.event_type(col("_up")).alias("event_type"))
    return kinds.select(
        "*", (col("importance") + 1).alias("impact_rank"), texts.lookup(col("event_type"), vocab.TYPE_WEIGHTS, 1).alias("event_weight"),
        col("event_type").isin(vocab.KEY_TYPES).alias("is_key_event"), times.nearest_slot(col("date"), freq).alias("slot"),
        times.local_hour(col("date"), col("currency")).alias("local_hour"))


def rich_buckets(rows: DataFrame, bucket: str = "slot", key_types: Sequence[str] = vocab.KEY_TYPES) -> DataFrame:
    """Counts, impact sums, dominant type, type entropy and presence counts per bucket.

    Two levels: per (bucket, type), then per bucket, so a crowded bucket is combined early.
    """
    kinds = rows.groupBy(bucket, "event_type").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(col("impact_rank") == 2).alias("high"),
        F.count_if("is_key_event").alias("key"), F.sum("impact_rank").alias("impact"),
        F.sum("event_weight").alias("weight"), F.max("event_weight").alias("top_weight"))
    total = F.sum("c")
    entropy = F.ln(total) - F.sum(col("c") * F.ln("c")) / total
    return kinds.groupBy(bucket).agg(
        total.alias("news_count"), F.sum("high").alias("high_impact_count"), F.sum("key").alias("key_event_count"),
        F.sum("impact").alias("sum_impact"), F.sum("weight").alias("sum_event_weight"),
        F.max("top_weight").alias("max_event_weight"),
        F.min_by("event_type", F.struct(-col("c"), "event_type")).alias("dominant_event_type"),
        F.when(F.count(F.lit(1)) > 1, entropy).otherwise(0.0).alias("event_entropy"),
        *[F.coalesce(F.sum(F.when(col("event_type") == k, col("c"))), F.lit(0)).alias(f"has_{k.lower()}")
          for k in key_types])


def top_event(rows: DataFrame, bucket: str) -> DataFrame:
    """The whole row of the highest-impact event per bucket; lowest id on ties."""
    rest = [c for c in rows.columns if c != bucket]
    best = F.max_by(F.struct(*rest), F.struct("impact_rank", -col("event_id")))
    return rows.groupBy(bucket).agg(best.alias("e")).select(bucket, "e.*")


def records_per_bucket(rows: DataFrame, bucket: str, fields: Sequence[str], page: int = 1000) -> DataFrame:
    """Ordered list of records per bucket, in pages of bounded size."""
    numbered = number_rows(rows, [bucket], "date", ["event_id"], unit="minute", out="_n")
    return (numbered.groupBy(bucket, F.floor(col("_n") / page).alias("page"))
            .agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("r"))
            .select(bucket, "page", F.transform("r", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("records")))


def day_counts_and_ranks(events: DataFrame) -> DataFrame:
    """Per event: events on its day and its importance rank on that day, from counts per (day, importance)."""
    dated = events.withColumn("day", F.to_date("date"))
    cells = dated.groupBy("day", "importance").agg(F.count(F.lit(1)).alias("_n"))
    per_day = cells.groupBy("day").agg(F.collect_list(F.struct("importance", "_n")).alias("_cells"),
                                       F.sum("_n").alias("news_count_per_day"))
    above = F.aggregate("_cells", F.lit(0).cast("long"), lambda acc, x: acc + F.when(
        x["importance"] > col("importance"), x["_n"]).otherwise(F.lit(0).cast("long")))
    return dated.join(per_day, "day", "left").withColumn("importance_rank_per_day", above + 1).drop("_cells")


def frequent_sources(events: DataFrame, n: int = 3, min_count: int = 1000) -> DataFrame:
    """Sources outside every country's n most frequent (and frequent enough) ones become OTHER."""
    from squallbars.operators.history import latest_rows

    counts = (events.filter(col("source").isNotNull()).groupBy("country", "source")
              .agg(F.count(F.lit(1)).alias("n")))
    top = latest_rows(counts, ["country"], "n", n, ties=["source"]).filter(col("n") > min_count)
    keep = top.select("source").distinct().withColumn("_keep", F.lit(True))
    joined = events.join(keep, "source", "left")
    return joined.withColumn("source", F.when(col("_keep"), col("source")).otherwise("OTHER")).drop("_keep")
