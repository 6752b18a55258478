"""Recursive (Wilder) smoothing as a distributed affine scan.

e_t = (1 - 1/n) e_{t-1} + x_t / n with e_0 = x_0 composes associatively. Each chunk is summarised by
its decay and its own contribution, the chunk summaries are carried along the series, and each chunk
is replayed from its carry with a running sum. Terms further back than ``_REACH * n`` values are
multiplied by a factor below the smallest double and so vanish in any double arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squallbars.operators.layout import CHUNK, ROW, Frames, attach

_REACH = 760
_MAX_EXPONENT = 650.0


def wilder(df: DataFrame, w: Frames, specs: dict[str, tuple[str, int]], warm: int = 1) -> DataFrame:
    """Add ``out = wilder(col, n)`` for each ``out: (col, n)``; null until n values were seen.

    ``df`` is a laid-out frame. Smoothing in chunk c starts ``w.back - warm`` rows before its own rows,
    where ``warm`` is the look-back of the smoothed columns; summaries cover the rows from one such
    start to the next. Missing values are skipped.
    """
    longest = w.chunk_rows + w.back + w.ahead
    for out, (_, n) in specs.items():
        if n < 2:
            raise ValueError(f"{out}: smoothing length must be at least 2")
        if longest * -math.log(1 - 1 / n) > _MAX_EXPONENT:
            raise ValueError(f"{out}: chunk of {longest} rows is too long for n={n}; use a smaller chunk_rows")
    cols = sorted({c for c, _ in specs.values()})
    keys = w.keys
    lead_in = w.back - warm
    started = (F.col(CHUNK) == 0) | (F.col(ROW) >= F.col(CHUNK) * w.chunk_rows - lead_in)
    fed = df.select("*", *[F.when(started, F.col(c)).alias(f"_x_{c}") for c in cols])
    counted = fed.select("*", *[w.running(F.count, f"_x_{c}").alias(f"_k_{c}") for c in cols])
    in_summary = F.col(ROW) < (F.col(CHUNK) + 1) * w.chunk_rows - lead_in
    aggs = []
    for c in cols:
        aggs += [F.max(F.when(in_summary, F.col(f"_k_{c}"))).alias(f"_m_{c}"),
                 F.max(F.when(in_summary & (F.col(f"_k_{c}") == 1), F.col(f"_x_{c}"))).alias(f"_f_{c}")]
    for out, (c, n) in specs.items():
        aggs.append(F.sum(F.when(in_summary, F.col(f"_x_{c}") / n * _grow(n, F.col(f"_k_{c}")))).alias(f"_s_{out}"))
    summary = counted.groupBy(*keys, CHUNK).agg(*aggs)
    series = Window.partitionBy(*keys).orderBy(CHUNK)
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    carried = summary.select("*", *[F.sum(F.coalesce(f"_m_{c}", F.lit(0))).over(upto).alias(f"_tot_{c}") for c in cols])
    ends = []
    for out, (c, n) in specs.items():
        m, total = F.coalesce(F.col(f"_m_{c}"), F.lit(0)), F.col(f"_tot_{c}")
        own = _decay(n, m) * F.coalesce(F.col(f"_s_{out}"), F.lit(0.0))
        first = F.when((total == m) & (m > 0), F.col(f"_f_{c}") * (1 - 1 / n) * _decay(n, m - 1)).otherwise(0.0)
        ends.append((own + first).alias(f"_b_{out}"))
    carried = carried.select(*keys, CHUNK, *[f"_tot_{c}" for c in cols], *ends)
    for out, (c, n) in specs.items():
        reach = Window.partitionBy(*keys).orderBy(F.col(f"_tot_{c}")).rangeBetween(-_REACH * n, 0)
        terms = F.collect_list(F.struct(F.col(f"_tot_{c}").alias("m"), F.col(f"_b_{out}").alias("b"))).over(reach)
        carried = carried.withColumn(f"_e_{out}", _weigh(terms, n, F.col(f"_tot_{c}")))
    starts = carried.select(*keys, CHUNK,
                            *[F.coalesce(F.lag(f"_tot_{c}").over(series), F.lit(0)).alias(f"_seen_{c}") for c in cols],
                            *[F.coalesce(F.lag(f"_e_{o}").over(series), F.lit(0.0)).alias(f"_from_{o}") for o in specs])
    replay = attach(counted, starts, [*keys, CHUNK])
    outs = []
    for out, (c, n) in specs.items():
        k, seen = F.col(f"_k_{c}"), F.col(f"_seen_{c}")
        weight = F.when((seen == 0) & (k == 1), F.lit(1.0)).otherwise(F.lit(1.0 / n))
        inner = w.running(F.sum, F.col(f"_x_{c}") * weight * _grow(n, k))
        value = _decay(n, k) * (F.col(f"_from_{out}") + F.coalesce(inner, F.lit(0.0)))
        outs.append(F.when(started & (seen + k >= n), value).alias(out))
    done = replay.select(*df.columns, *outs)
    return done


def _weigh(terms, n: int, position):
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["b"] * _decay(n, position - t["m"]))


def _decay(n: int, k):
    return F.pow(F.lit(1 - 1 / n), k.cast("double"))


def _grow(n: int, k):
    return F.pow(F.lit(1 - 1 / n), -k.cast("double"))
