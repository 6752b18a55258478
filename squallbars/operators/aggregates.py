"""Report tables: frequencies, summaries, histograms and tests, all by partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.operators.layout import attach, attach_small, exact_quantiles, number_rows
from squallbars.session import shared

col = F.col


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, most first: one aggregation turned on its side."""
    counts = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("missing")) for c in df.columns]))
    return counts.select(pairs.alias("p")).select("p.*").orderBy(col("missing").desc(), "column")


def frequencies(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Count and share of each value, overall or within a group."""
    counts = df.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    if within:
        totals = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_total"))
        counts = attach(counts, totals, list(within))
    else:
        counts = counts.withColumn("_total", df.agg(F.count(F.lit(1))).scalar())
    return counts.withColumn("share", col("n") / col("_total")).drop("_total")


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max of a column."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                                  F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    quarts = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    if keys:
        out = attach(basic, quarts, keys)
    else:
        out = basic.withColumn("_q", quarts.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")
    return out.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})


def histogram(df: DataFrame, value: str, bins: int, hue: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the whole value range; shares of all rows, split by hue."""
    rows = df.filter(col(value).isNotNull())
    bounds = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"),
                               F.count(F.lit(1)).alias("n"))).scalar()
    width = (col("_b.hi") - col("_b.lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(col(value) - col("_b.lo"), width)), F.lit(0))
    binned = rows.withColumn("_b", bounds).select(
        *hue, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), col("_b.n").alias("_n"),
        (col("_b.lo") + F.least(place, F.lit(bins - 1)) * width).alias("left_edge"))
    return (binned.groupBy(*hue, "bin").agg(F.min("left_edge").alias("left_edge"), F.count(F.lit(1)).alias("n"),
                                            (F.count(F.lit(1)) / F.max("_n")).alias("share")))


def summary(bars: DataFrame, keys: Sequence[str], order: str = "datetime") -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"), F.min("close").alias("min"),
        F.max("close").alias("max"), F.min_by("open", order).alias("first_open"), F.max_by("close", order).alias("last_close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("rows"))


def two_sided_p(t: Column, df: Column, steps: int = 4000) -> Column:
    """Two-sided p-value of Student's t by Simpson's rule on the angle form of its density.

    Meant for result tables with one row per class or pair.
    """
    top = F.least(F.atan(F.lit(1.0)) * 2 * F.sqrt(df), F.lit(60.0))
    start = F.least(F.atan(F.abs(t) / F.sqrt(df)) * F.sqrt(df), top)

    def area(a: Column, b: Column) -> Column:
        h = (b - a) / steps
        terms = F.sequence(F.lit(0), F.lit(steps))

        def add(acc: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return acc + weight * F.pow(F.greatest(F.cos((a + h * i) / F.sqrt(df)), F.lit(0.0)), df - 1)

        return F.aggregate(terms, F.lit(0.0), add) * h / 3

    return area(start, top) / area(F.lit(0.0), top)


def paired_test(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Paired t-test per class."""
    gap = col(before) - col(after)
    moments = df.filter(gap.isNotNull()).groupBy(key).agg(
        F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"), F.avg(gap).alias("_m"),
        F.stddev_samp(gap).alias("_s"), F.count(F.lit(1)).alias("n"))
    t = F.try_divide(col("_m"), col("_s") / F.sqrt("n"))
    out = moments.withColumn("t_stat", t).withColumn("p_value", two_sided_p(col("t_stat"), (col("n") - 1).cast("double")))
    return out.withColumn("significance", col("p_value") < 0.05).drop("_m", "_s")


PAIR_BLOCK = 256


def pairwise_tests(df: DataFrame, key: str, value: str) -> DataFrame:
    """Welch test, Hedges' g and Bonferroni-corrected p for each pair of classes.

    Pairs are formed from one moments row per class, never from data rows: classes are numbered and dealt to pairs of blocks of
    ``PAIR_BLOCK``, so a task meets the classes of two blocks however many there are.
    """
    moments = df.filter(col(value).isNotNull()).groupBy(key).agg(
        F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    rows = number_rows(moments.filter(col(key).isNotNull()), [], key, out="_i").withColumn("_b", F.floor(col("_i") / PAIR_BLOCK))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_b").alias("last"))
    side = F.struct(col(key).alias("k"), "m", "v", "n", "_i")
    upper = rows.select(side.alias("a"), col("_b").alias("_x"), F.explode(F.sequence("_b", size.select("last").scalar())).alias("_y"))
    lower = rows.select(side.alias("b"), col("_b").alias("_y"), F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("_x"))
    pairs = upper.join(lower, ["_x", "_y"]).filter(col("a._i") < col("b._i"))
    va, vb = col("a.v") / col("a.n"), col("b.v") / col("b.n")
    dof = F.pow(va + vb, 2) / (F.pow(va, 2) / (col("a.n") - 1) + F.pow(vb, 2) / (col("b.n") - 1))
    pooled = F.sqrt(((col("a.n") - 1) * col("a.v") + (col("b.n") - 1) * col("b.v")) / (col("a.n") + col("b.n") - 2))
    hedges = F.try_divide(col("a.m") - col("b.m"), pooled) * (1 - 3 / (4 * (col("a.n") + col("b.n")) - 9))
    out = pairs.select(col("a.k").alias("A"), col("b.k").alias("B"),
                       F.try_divide(col("a.m") - col("b.m"), F.sqrt(va + vb)).alias("t_stat"), dof.alias("dof"),
                       hedges.alias("hedges"))
    out = out.withColumn("p_unc", two_sided_p(col("t_stat"), col("dof")))
    tests = size.select(col("n") * (col("n") - 1) / 2).scalar()
    return out.withColumn("p_corr", F.least(F.lit(1.0), col("p_unc") * tests))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts per row value with one column per listed value."""
    return (df.groupBy(rows).agg(*[F.count_if(col(columns) == v).alias(f"{columns}_{v}") for v in values]))


def missing_business_days(bars: DataFrame, ts: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    """Weekdays between first and last bar without any bar, for each key."""
    span = bars.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    return days.join(bars.select(*keys, F.to_date(ts).alias("day")).distinct(), [*keys, "day"], "left_anti")


def _with_documents(listed: DataFrame, doc: str) -> DataFrame:
    """Per term of the lists ``g``, how often it occurs and in how many documents (a missing id is none).

    A list is sorted and its runs counted inside the row, so terms go to their sums without the document. Rows of documents that
    have several are summed by document first.
    """
    runs = listed.select(doc, F.sort_array("g").alias("g")).select(doc, "g", F.array_compact(
        F.transform("g", lambda x, i: F.when(F.coalesce(F.get("g", i - 1) != x, F.lit(True)), i))).alias("at"))
    once = F.transform("at", lambda a, k: F.struct(F.get("g", a).alias("word"), (F.coalesce(F.get("at", k + 1), F.size("g")) - a).cast("long").alias("c")))
    again = shared(listed.filter(col(doc).isNotNull()).groupBy(doc).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(doc, F.lit(True).alias("_again")))

    def terms(rows: DataFrame) -> DataFrame:
        # Exploded as computed: of a column, Spark would test the size first, and compute the lists anew for each term.
        return rows.select(doc, F.explode(once).alias("t")).select(doc, "t.word", "t.c")

    repeated = not again.isEmpty()
    marked = attach_small(runs, again, [doc]) if repeated else runs
    alone = terms(marked.filter(col("_again").isNull()) if repeated else marked)
    parts = alone.select("word", "c", F.when(col(doc).isNotNull(), 1).otherwise(0).alias("d"))
    if repeated:
        by_document = terms(marked.filter("_again")).groupBy("word", doc).agg(F.sum("c").alias("c"))
        parts = parts.unionByName(by_document.select("word", "c", F.lit(1).alias("d")))
    return parts.groupBy("word").agg(F.sum("c").alias("count"), F.sum("d").alias("documents"))


def ngram_counts(df: DataFrame, text: str, doc: str, sizes: tuple[int, int] = (1, 2), min_df: int = 1,
                 max_features: int | None = None, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Total count per word or phrase; terms in fewer than ``min_df`` documents are left out.

    Tokens are runs of two or more word characters; phrases are built after stop words are removed
    (default: Spark's English list).
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda x: ~x.isin(list(stop_words)))
    tokens = df.filter(col(text).isNotNull()).select(doc, words.alias("w"))
    grams, phrase = [], col("w")
    for n in range(1, sizes[1] + 1):
        if n > 1:
            phrase = F.array_compact(F.zip_with(phrase, F.slice("w", n, F.greatest(F.size("w"), F.lit(1))),
                                                lambda a, b: F.concat(a, F.lit(" "), b)))
        if n >= sizes[0]:
            grams.append(phrase)
    listed = tokens.select(doc, F.concat(*grams).alias("g"))
    if min_df <= 1:
        out = listed.select(F.explode("g").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    else:
        out = _with_documents(listed, doc).filter(col("documents") >= min_df).drop("documents")
    return out.orderBy(col("count").desc(), "word").limit(max_features) if max_features else out
