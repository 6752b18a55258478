"""Ordered-series layout: every window runs in bounded chunks, never on one task per instrument.

``number_rows`` gives each row its position in its series in two levels: a count per bucket, a running sum over those counts,
and the place inside the bucket. Buckets of a keyed series are calendar units; one order over all rows, and as-of joins, use
ranges of about equal numbers of rows (``dealt``), whatever the calendar looks like.
``lay_out`` copies each row to its own chunk and to the neighbours whose look-back or look-ahead
reaches it, so a row-based window over ``(keys, chunk)`` sees every row it needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallbars.session import shared

ROW, CHUNK, OWN = "_row", "_chunk", "_own"
CHUNK_ROWS = 2048


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join per-bucket values; plain key equality keeps the partitioning of the large side."""
    return df.join(small, list(keys), "left")


def dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows sorted by ``order`` over ranges of about equal size, with the range (``_part``) and the place in it (``_at``).

    Bounds are sampled, so a crowded day, or even instant while its ties differ, is split like any other stretch. The rows are
    checkpointed, so every reader sees the same ranges and a lost executor costs the reading of a file.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return shared(rows).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


BROADCAST_ROWS = 100_000


def attach_small(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join a table of few keys without dealing ``df`` by key: broadcast once its rows are counted, else an ordinary join."""
    small = shared(small)
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, list(keys), "left")


def in_buckets(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], unit: str | None) -> DataFrame:
    """Rows with ``_bucket``, a number or time that ascends along each series: a calendar unit, or a dealt range if ``None``."""
    if unit:
        return df.withColumn("_bucket", F.date_trunc(unit, F.col(order)))
    return dealt(df, [*keys, order, *ties]).withColumnRenamed("_part", "_bucket").drop("_at")


def number_rows(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), unit: str | None = "month",
                out: str = ROW) -> DataFrame:
    """0-based position of each row in its series ordered by ``order`` then ``ties``.

    ``unit`` is the calendar bucket of a keyed series (``None``: dealt ranges); a bucket holds the rows one task sorts, and the
    running sum over buckets reads one row per bucket. Without keys, ranges are dealt and the place in them is the rest.
    """
    keys = list(keys)
    if not keys:
        rows = dealt(df, [order, *ties])
        sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        return attach(rows, F.broadcast(offsets), ["_part"]).withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
    bucketed = in_buckets(df, keys, order, ties, unit)
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    return (
        attach(bucketed, offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bucket", "_before")
    )


def lay_out(numbered: DataFrame, back: int, ahead: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Assign chunks of ``chunk_rows`` rows and replicate halo rows to the chunks that read them."""
    row = F.col(ROW)
    first = F.floor((row - ahead) / chunk_rows)
    last = F.floor((row + back) / chunk_rows)
    home = F.floor(row / chunk_rows)
    return (
        numbered.withColumn(CHUNK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
        .withColumn(OWN, F.col(CHUNK) == home)
    )


def safe_chunk(back: int, ahead: int, shortest: int = 0) -> int:
    """Chunk length that covers the halos and keeps powers of (1 - 1/n) inside double range."""
    rows = CHUNK_ROWS
    if shortest:
        rows = min(rows, int(640 / -math.log(1 - 1 / shortest)) - back - ahead)
    if rows < max(back, ahead, 1):
        rows = max(back, ahead, 1)
    return rows


class Frames:
    """Column builders over the one window specification of a laid-out frame."""

    def __init__(self, keys: Sequence[str], order: str, back: int = 0, ahead: int = 0, chunk_rows: int = CHUNK_ROWS):
        self.keys, self.order, self.back, self.ahead, self.chunk_rows = list(keys), order, back, ahead, chunk_rows
        self.base = Window.partitionBy(*self.keys, CHUNK).orderBy(ROW)

    @staticmethod
    def _col(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    def lag(self, c, k: int = 1) -> Column:
        return F.lag(self._col(c), k).over(self.base)

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(self._col(c), k).over(self.base)

    def frame(self, agg: Callable, c, start: int, end: int, full: bool = True) -> Column:
        """Aggregate over rows start..end; with ``full`` a frame with missing values gives null."""
        c, w = self._col(c), self.base.rowsBetween(start, end)
        value = agg(c).over(w)
        return F.when(F.count(c).over(w) == end - start + 1, value) if full else value

    def roll(self, agg: Callable, c, n: int) -> Column:
        return self.frame(agg, c, -(n - 1), 0)

    def fwd(self, agg: Callable, c, n: int, head_gap: bool = False) -> Column:
        """Rows t+1..t+n; ``head_gap`` also blanks the first n-1 rows of the series (shift-then-roll)."""
        value = self.frame(agg, c, 1, n)
        return F.when(F.col(ROW) >= n - 1, value) if head_gap else value

    def running(self, agg: Callable, c) -> Column:
        return agg(self._col(c)).over(self.base.rowsBetween(Window.unboundedPreceding, 0))


def over_series(df: DataFrame, build: Callable[[DataFrame, Frames], DataFrame], keys: Sequence[str], order: str,
                back: int, ahead: int = 0, ties: Sequence[str] = (), unit: str = "month",
                chunk_rows: int = CHUNK_ROWS, keep_row: bool = False) -> DataFrame:
    """Run ``build(laid_out, frames)`` over a series and return each input row once."""
    chunk_rows = max(chunk_rows, back, ahead)
    frames = Frames(keys, order, back, ahead, chunk_rows)
    laid = lay_out(number_rows(shared(df), keys, order, ties, unit), back, ahead, chunk_rows)
    out = build(laid, frames).filter(F.col(OWN))
    return out.drop(CHUNK, OWN) if keep_row else out.drop(CHUNK, OWN, ROW)


def over_bars(bars: DataFrame, build: Callable[[DataFrame, Frames], DataFrame], back: int, ahead: int = 0,
              **kw) -> DataFrame:
    return over_series(bars, build, ["ticker"], "datetime", back, ahead, **kw)


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, Column], ties: Sequence[str] = (),
                 strict: bool = False, unit: str | None = "month") -> DataFrame:
    """Last non-null value of each column so far (``strict``: before this row), in two levels.

    Inside a bucket by a running window; across buckets by one carried row per bucket. Without keys, or with ``unit`` None,
    buckets are dealt ranges.
    """
    keys = list(keys)
    src = in_buckets(df.select("*", *[c.alias(f"_v_{name}") for name, c in cols.items()]), keys, order, ties, unit if keys else None)
    rank = F.struct(F.col(order), *[F.col(t) for t in ties])
    heads = src.groupBy(*keys, "_bucket").agg(*[
        F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_c_{n}") for n in cols])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*keys, "_bucket", *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}")
                                               for n in cols])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
              .rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    joined = attach(src, carried, [*keys, "_bucket"])
    filled = {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")) for n in cols}
    kept = [c for c in df.columns if c not in cols]
    return joined.select(*kept, *[v.alias(n) for n, v in filled.items()])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str],
              unit: str | None = None, tolerance: str | None = None) -> DataFrame:
    """Latest right row at or before each left row, as a tagged union and a two-level forward fill over dealt ranges."""
    keys = list(keys)
    kept = [c for c in left.columns if c not in keys and c != on]
    ours = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*kept).alias("_left"))
    theirs = right.select(*keys, on, F.lit(0).alias("_side"),
                          F.struct(F.col(on).alias("_at"), *values).alias("_right"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    filled = fill_forward(both, keys, on, {"_hit": F.col("_right")}, ties=["_side"], unit=unit)
    hit = F.col("_hit")
    if tolerance:
        hit = F.when(F.col("_hit._at") >= F.col(on) - F.expr(f"interval {tolerance}"), hit)
    return (filled.filter("_side = 1").select(*keys, on, *[F.col(f"_left.{c}").alias(c) for c in kept],
                                              hit.alias("_hit"))
            .select(*keys, on, *kept, *[F.col(f"_hit.{v}").alias(v) for v in values]))


def value_bucket(c: Column, bits: int) -> Column:
    """Order-preserving bucket of a double: sign and octave, then ``bits`` leading mantissa bits.

    Needs no pass over the data, so every branch of a plan computes the same buckets.
    """
    c = c.cast("double")
    size = F.abs(c)
    octave = F.when(size < F.lit(2.0 ** -900), F.lit(-900)).otherwise(F.floor(F.log2(size)))
    scale = F.lit(float(2 ** bits))
    step = F.least(F.floor(size / F.pow(F.lit(2.0), octave) * scale), scale * 2 - 1).cast("long") - 2 ** bits
    magnitude = (octave.cast("long") + 1000) * (2 ** bits) + F.greatest(step, F.lit(0))
    return F.when(c == 0, F.lit(0)).when(c > 0, magnitude).otherwise(-magnitude).cast("long")


LEVEL_BITS = 10


def bucket_levels(c: Column, bits: int) -> list[Column]:
    """Order-preserving groups of a double's buckets, coarse to fine: a number's sign and octave, then ten mantissa bits a level.

    An octave holds at most 2^10 groups of the next level, and so on, so every window over sums of groups is short.
    """
    fine = value_bucket(c, bits)
    return [F.shiftright(fine, k) for k in (*range(bits, 0, -LEVEL_BITS), 0)]


def prefix_sums(sums: DataFrame, keys: list[str], levels: list[str], totals: Sequence[str], way: Callable[[str], Column]) -> DataFrame:
    """For each finest group, the sums of ``totals`` over all groups before it (``_o_*``) and over the key (``total_*``).

    Sums of groups are summed again level by level up to the octaves; on the way down a group's offset is its parent's plus the
    groups before it under the same parent. A window reads 2^10 rows, or the octaves of a key (some two thousand at most).
    """
    stack = [sums]
    for depth in range(len(levels) - 1, 0, -1):
        stack.append(stack[-1].groupBy(*keys, *levels[:depth]).agg(*[F.sum(f"_b_{n}").alias(f"_b_{n}") for n in totals]))
    known = None
    for depth, groups in enumerate(reversed(stack), 1):
        under = Window.partitionBy(*keys, *levels[:depth - 1])
        before = under.orderBy(way(levels[depth - 1])).rowsBetween(Window.unboundedPreceding, -1)
        placed = groups.select("*", *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
                               *([] if known is not None else [F.sum(f"_b_{n}").over(under).alias(f"total_{n}") for n in totals]))
        if known is not None:
            parents = known.select(*keys, *levels[:depth - 1], *[F.col(f"_o_{n}").alias(f"_p_{n}") for n in totals], *[f"total_{n}" for n in totals])
            placed = attach(placed, parents, [*keys, *levels[:depth - 1]]).withColumns({f"_o_{n}": F.col(f"_o_{n}") + F.col(f"_p_{n}") for n in totals})
        known = placed.select(*keys, *levels[:depth], *[f"_o_{n}" for n in totals], *[f"total_{n}" for n in totals])
    return known


def running_totals(df: DataFrame, keys: Sequence[str], value: str, totals: dict[str, Column], bits: int = 20,
                   descending: bool = False) -> DataFrame:
    """One row per (keys, distinct value) with the totals at that value, cumulatively, and over the key.

    Map-side combined counts first, then running sums over value buckets in levels. All branches read the same exchange of
    per-value totals, so the input is scanned once.
    """
    keys = list(keys)
    groups = bucket_levels(F.col(value), bits)
    levels = [f"_v{i}" for i in range(len(groups))]
    per_value = (df.filter(F.col(value).isNotNull())
                 .groupBy(*keys, value).agg(*[c.alias(n) for n, c in totals.items()])
                 .select("*", *[g.alias(n) for g, n in zip(groups, levels, strict=True)]))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sums = per_value.groupBy(*keys, *levels).agg(*[F.sum(n).alias(f"_b_{n}") for n in totals])
    offsets = prefix_sums(sums, keys, levels, list(totals), way)
    inside = (Window.partitionBy(*keys, *levels).orderBy(way(value))
              .rowsBetween(Window.unboundedPreceding, 0))
    out = attach(per_value, offsets, [*keys, *levels])
    return out.select(*keys, value, *totals, *[f"total_{n}" for n in totals],
                      *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in totals])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per key; result columns ``q0, q1, ...`` in the order of ``qs``."""
    keys = list(keys)
    ranked = running_totals(df, keys, value, {"n": F.count(F.lit(1))})
    aggs = []
    for i, q in enumerate(qs):
        spot = (F.col("total_n") - 1) * F.lit(float(q))
        for name, rank in ((f"_lo{i}", F.floor(spot)), (f"_hi{i}", F.ceil(spot))):
            inside = (F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank)
            aggs.append(F.max(F.when(inside, F.col(value))).alias(name))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_w{i}"))
    found = ranked.groupBy(*keys).agg(*aggs)
    return found.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
        for i in range(len(qs))])
