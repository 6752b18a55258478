"""Mixing of sources to target weights by entropy balancing, with DataFrame functions alone.

Rates of documents lie between 0 and `most` copies. Among all rates that meet each source's token target, those nearest to
one copy each (in the entropy of a quantity between 0 and `most`) tilt the odds exponentially in the document's size:

    rate / (most - rate) = exp(A * u) / (most - 1),  A = most / (most - 1),  u = lambda_source * size / mean size of the source

The convex dual has one multiplier per source; Newton steps, kept inside a bracket, solve it on a table of
(source, size, documents), which is summed before any shuffle. Rates become copies by one threshold per source on
`hash - fraction`, found by three passes of 4,096 bins each, so that the words taken miss the target by no more than about
one document.

Null texts have size 0, and a null source is a source of its own, last in order. Rows of equal id and size are
rounded alike. A table without words has targets of 0; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallbars.llm.common import ranked, written

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """`target` of each (source, source_size): shares by weight, none above `most` times its size.

    The excess is reshared by raising one level for all that are below their limit; each round sums a row per source.
    """
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    placed = written(ranked(sources, F.col("source").asc_nulls_last()).withColumn("weight", cases.cast("double")).drop("position"), "sources")
    limit, level = F.col("source_size") * float(most), 0.0
    total = placed.agg(F.sum("source_size").alias("n")).first().n or 0
    while True:
        full = limit < F.col("weight") * level
        got = placed.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got.open or (raised := (total - got.used) / got.open) <= level:
            break
        level = raised
    return placed.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def tilted(u: Column, most: int) -> Column:
    """The rate at tilt `u`: 1 at 0, between 0 and `most`."""
    return most / (1.0 + (most - 1.0) * F.exp(-u * (most / (most - 1.0))))


def balance(sizes: DataFrame, targets: DataFrame, most: int = 3, rounds: int = 80, precision: float = 1e-9) -> DataFrame:
    """`multiplier` of each source: Newton's method on the dual, all sources at once.

    `sizes` has (source, size, n). A step that leaves the bracket known so far halves it; without a bracket on that side
    a step at most doubles the multiplier.
    """
    infinite = F.lit(float("inf"))
    # A target at the limit has no finite multiplier: its rates are the limit itself.
    at_limit = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = (targets.withColumn("mean", F.col("source_size") / F.col("documents"))
             .withColumn("multiplier", F.when(F.col("source_size") == 0, 0.0).when(at_limit, infinite).otherwise(0.0))
             .withColumn("low", -infinite).withColumn("high", infinite)
             .withColumn("open", (F.col("source_size") > 0) & ~at_limit))
    state = written(state, "balance")
    for _ in range(rounds):
        if not state.filter("open").limit(1).count():
            break
        u = F.col("multiplier") * F.col("size") / F.col("mean")
        words, rate = F.col("size").cast("double") * F.col("n"), tilted(u, most)
        open_ones = state.filter("open").select(F.col("source").alias("_s"), "multiplier", "mean")
        sums = (sizes.join(open_ones, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s")
                .agg(F.sum(words * rate).alias("taken"),
                     F.sum(words * F.col("size") / F.col("mean") * (most / (most - 1.0)) * rate * (1 - rate / most)).alias("slope")))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        miss = F.col("taken") - F.col("target")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high"))
        reach = F.greatest(F.lit(1.0), F.abs("multiplier"))
        step = F.when(F.col("slope") > 0, -miss / F.col("slope")).otherwise(F.when(miss > 0, -reach).otherwise(reach))
        moved = F.col("multiplier") + F.greatest(-reach, F.least(reach, step))
        inside = (moved > F.col("_low")) & (moved < F.col("_high"))
        bracketed = (F.col("_low") > -infinite) & (F.col("_high") < infinite)
        solved = (F.abs(miss) <= precision * F.greatest(F.col("target"), F.lit(1.0))) | (bracketed & (F.col("_high") - F.col("_low") <= 1e-15 * reach))
        busy = F.col("open") & F.col("taken").isNotNull()
        state = written(
            joined.withColumn("_low", low).withColumn("_high", high)
            .withColumn("_next", F.when(busy & ~solved, F.when(inside | ~bracketed, moved).otherwise((F.col("_low") + F.col("_high")) / 2)).otherwise(F.col("multiplier")))
            .select("source", "source_size", "documents", "weight", "target", "mean", F.col("_next").alias("multiplier"),
                    F.when(busy, F.col("_low")).otherwise(F.col("low")).alias("low"), F.when(busy, F.col("_high")).otherwise(F.col("high")).alias("high"),
                    (busy & ~solved).alias("open")), "balance")
    # Sums of doubles differ in their last digits between runs; ten digits do not, and all after this is exact.
    digits = F.pow(F.lit(10.0), 10 - F.floor(F.log10(F.abs("multiplier"))))
    rounded = F.when((F.col("multiplier") == 0) | (F.abs("multiplier") == infinite), F.col("multiplier")).otherwise(F.round(F.col("multiplier") * digits) / digits)
    return state.select("source", "source_size", "target", "mean", rounded.alias("multiplier"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row."""
    sizes = written(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    table = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "size-table")
    per_source = table.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    solved = written(balance(table, source_targets(per_source, weights, most), most), "solved")

    own = solved.withColumnRenamed("source", "_s")
    u = F.when(F.abs("multiplier") == float("inf"), F.lit(float("inf"))).otherwise(F.col("multiplier") * F.col("size") / F.col("mean"))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit("copies")), 12) / float(1 << 52)
    rated = (sizes.join(own, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), tilted(u, most))))
             .withColumn("whole", F.floor("rate"))
             .withColumn("place", F.least(F.lit((1 << BITS * LEVELS) - 1), F.floor((chance - (F.col("rate") - F.col("whole")) + 1) / 2 * (1 << BITS * LEVELS)))))
    cut = _cuts(rated, solved, most).withColumnRenamed("source", "_s")
    extra = (F.col("place") < F.col("cut")) & (F.col("whole") < most)
    copies = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")
    return (rated.join(cut, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def _cuts(rated: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """`cut` of each source: places below it take one copy more, which brings the words taken nearest to the target.

    Each pass sums sizes by (source, bin), 4,096 bins at most, and goes on inside the bin in which the target is reached.
    """
    state = solved.select("source", F.lit(0).cast("long").alias("cut"), F.lit(None).cast("double").alias("need"), "target")
    base = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("_base"))
    state = written(state.join(base.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                    .select("source", "cut", (F.col("target") - F.col("_base")).alias("need")), "cuts")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = state.select(F.col("source").alias("_s"), F.col("cut").alias("_c"))
        bins = (rated.filter((F.col("whole") < most) & (F.col("size") > 0)).join(inside, F.col("source").eqNullSafe(F.col("_s")))
                .filter(F.shiftright("place", shift + BITS) == F.shiftright("_c", shift + BITS))
                .groupBy(F.col("source").alias("_s"), F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("words")))
        running = Window.partitionBy("_s").orderBy("bin")
        bins = bins.withColumn("to", F.sum("words").over(running)).withColumn("from", F.col("to") - F.col("words"))
        # The first bin whose end reaches the need; where all bins together do not, the end of the range.
        first = (bins.join(state, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s")
                 .agg(F.min(F.when(F.col("to") >= F.col("need"), F.col("bin"))).alias("at"),
                      F.max(F.when(F.col("to") < F.col("need"), F.col("to"))).alias("before"), F.max("bin").alias("last")))
        here = first.select("_s", F.coalesce("at", F.col("last") + 1).alias("at"), F.coalesce("before", F.lit(0)).alias("before"))
        here = here.withColumn("up", F.lit(0))
        if level == LEVELS - 1:  # the last bin is taken or left, whichever is nearer
            found = bins.select(F.col("_s").alias("_t"), F.col("bin").alias("_b"), "words")
            here = (here.join(found, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("at")), "left")
                    .join(state.select(F.col("source").alias("_u"), "need"), F.col("_s").eqNullSafe(F.col("_u")))
                    .withColumn("up", F.when((F.col("need") - F.col("before")) * 2 >= F.col("words"), 1).otherwise(0)).drop("need"))
        state = written(state.join(here, F.col("source").eqNullSafe(F.col("_s")), "left")
                        .select("source", F.coalesce(F.shiftleft(F.col("at") + F.col("up"), shift), F.col("cut")).alias("cut"),
                                (F.col("need") - F.coalesce("before", F.lit(0))).alias("need")), "cuts")
    return state.select("source", "cut")
