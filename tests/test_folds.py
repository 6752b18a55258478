"""Folds without copies of rows, and positions by dealt ranges: against pandas, on one crowded day, by plan."""

import datetime as dt
import glob
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallbars.operators import folds, learners
from squallbars.operators.layout import asof_join, dealt, fill_forward, number_rows
from squallbars.session import shared_dir

DAY = dt.datetime(2024, 5, 6)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def crowded(spark):
    """Nearly all rows on one day, many of them at one instant; 12 tickers, one of them holding a third."""
    rng = np.random.default_rng(4)
    n = 12_000
    ts = [DAY + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 86_400, n)]
    ts[:4_000] = [DAY + dt.timedelta(hours=9)] * 4_000
    ts[-300:] = [DAY + dt.timedelta(days=int(d)) for d in rng.integers(-200, 200, 300)]
    ticker = ["AAA" if x < 1 / 3 else f"T{int(x * 33) % 11}" for x in rng.random(n)]
    pdf = pd.DataFrame({"datetime": ts, "ticker": ticker, "id": rng.permutation(n), "x": rng.random(n)})
    df = spark.createDataFrame(pdf).repartition(8, "id")
    return pdf, df


def test_ranges_are_even_whatever_the_calendar(spark, crowded):
    pdf, df = crowded
    rows = dealt(df.repartition(8), ["datetime", "ticker", "id"])
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in dealt(df, ["datetime", "ticker", "id"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert sum(sizes) == len(pdf) and len(sizes) >= 4 and max(sizes) <= 2 * len(pdf) / len(sizes)
    assert rows.count() == len(pdf)


def test_positions_on_a_crowded_day(crowded):
    pdf, df = crowded
    got = number_rows(df, [], "datetime", ["ticker", "id"], out="k").toPandas().sort_values("k")
    want = pdf.sort_values(["datetime", "ticker", "id"])
    assert got.k.tolist() == list(range(len(pdf))) and got.id.tolist() == want.id.tolist()
    keyed = number_rows(df, ["ticker"], "datetime", ["id"], unit=None, out="k").toPandas().sort_values("id")
    want = pdf.sort_values(["ticker", "datetime", "id"])
    want = want.assign(k=want.groupby("ticker").cumcount()).sort_values("id")
    assert keyed.k.tolist() == want.k.tolist()


def test_positions_have_no_window_over_rows(crowded):
    """The one window without a key reads a row for each range."""
    text = plan(number_rows(crowded[1], [], "datetime", ["ticker", "id"]))
    assert text.count("Window ") == 1 and "row_number" not in text


def test_asof_and_fill_on_a_crowded_day(spark, crowded):
    pdf, df = crowded
    right = pd.DataFrame({"datetime": [DAY + dt.timedelta(minutes=7 * k) for k in range(-60, 200)], "level": np.arange(260.0)})
    got = asof_join(df, spark.createDataFrame(right), [], "datetime", ["level"]).toPandas().sort_values("id")
    want = pd.merge_asof(pdf.sort_values("datetime"), right, on="datetime").sort_values("id")
    np.testing.assert_allclose(got.level.astype(float), want.level)
    by = pd.concat([right.assign(ticker=t, level=right.level + i) for i, t in enumerate(["AAA", "T3"])]).sort_values("datetime")
    got = asof_join(df, spark.createDataFrame(by), ["ticker"], "datetime", ["level"]).toPandas().sort_values("id")
    want = pd.merge_asof(pdf.sort_values("datetime"), by, on="datetime", by="ticker").sort_values("id")
    np.testing.assert_allclose(got.level.astype(float), want.level)
    holes = df.withColumn("y", F.when(col_mod("id", 50), F.col("x")))
    got = fill_forward(holes, [], "datetime", {"y": F.col("y")}, ["ticker", "id"]).toPandas().sort_values("id")
    want = pdf.assign(y=pdf.x.where(pdf.id % 50 == 0)).sort_values(["datetime", "ticker", "id"])
    np.testing.assert_allclose(got.y.astype(float), want.assign(y=want.y.ffill()).sort_values("id").y)


def col_mod(name, k):
    return F.col(name) % k == 0


def plain_summary(values, bounds):
    out = {}
    for k, (a, b, c) in enumerate(bounds):
        train = [v for v in values if (a is None or v >= a) and v < b]
        val = [v for v in values if v >= b and (c is None or v < c)]
        if train and val:
            out[k] = (len(train), len(val), min(train), max(train), min(val), max(val))
    return out


FOLDS = [[(0, 10, 20), (5, 30, 31), (None, 50, None), (200, 210, 220), (0, 0, 3)], [(None, k, k + 7) for k in range(0, 100, 5)], [(k, k + 30, k + 45) for k in range(-20, 90)]]


@pytest.mark.parametrize("bounds", FOLDS)
def test_summary_against_plain(spark, bounds):
    values = [int(v) for v in np.random.default_rng(len(bounds)).integers(0, 100, 500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    array = F.array(*[F.struct(*[F.lit(x).cast("int").alias(n) for x, n in zip(b, ("train_start", "val_start", "val_end"))]) for b in bounds])
    got = folds.summary(df, "v", array)
    assert {r["fold"]: tuple(r)[1:] for r in got.collect()} == plain_summary(values, bounds)
    rows = folds.validation_rows(df, "v", array).collect()
    assert sorted(map(tuple, rows)) == sorted((v, k) for v in values for k, (_, b, c) in enumerate(bounds) if v >= b and (c is None or v < c))


def test_rows_are_counted_before_folds(spark):
    """Folds meet counts of cells: the copies of the plan stand above the first aggregate, none below."""
    df = spark.range(1000).withColumn("v", F.col("id") % 100)
    text = plan(folds.summary(df, "v", F.array(*[F.struct(F.lit(0).cast("long").alias("train_start"), F.lit(k).cast("long").alias("val_start"), F.lit(k + 9).cast("long").alias("val_end")) for k in range(10, 90, 9)])))
    generate = text.index("Generate")
    assert text.count("Generate") == 1 and "HashAggregate" in text[generate:] and "SortAggregate" not in text


def test_position_folds_against_plain(crowded):
    pdf, df = crowded
    order = pdf.sort_values(["datetime", "ticker", "id"]).datetime.tolist()
    n = len(order)
    rolling = folds.rolling_folds(df, "datetime", 1000, 300, 700, ["ticker", "id"])
    got = {r["fold"]: tuple(r)[1:] for r in rolling.summary("datetime").collect()}
    cut = lambda a, b, c: (b - a, c - b, order[a], order[b - 1], order[b], order[c - 1])
    assert got == {k: cut(k * 700, k * 700 + 1000, k * 700 + 1300) for k in range((n - 1300) // 700 + 1)}
    by_cells = {r["fold"]: (r["n_train"], r["n_val"]) for r in folds.summary(rolling.rows, folds.POSITION, rolling.bounds()).collect()}
    assert by_cells == {k: v[:2] for k, v in got.items()}
    parts = folds.sequential_folds(df, "datetime", 5, ["ticker", "id"])
    size = n // 6
    assert {r["fold"]: tuple(r)[1:] for r in parts.summary("datetime").collect()} == {k: cut(0, n - (5 - k) * size, n - (4 - k) * size) for k in range(5)}
    assert folds.rolling_folds(df, "datetime", n, 1).summary("datetime").count() == 0


def test_walk_forward_writes_rows_once(spark):
    """A fit that only counts: training and validation rows of every fold, and what was stored."""
    df = spark.range(600).withColumn("v", (F.col("id") * 7 % 10).cast("int"))
    bounds = folds.expanding_period_folds(df, "v", 4)
    before = set(glob.glob(f"{shared_dir(spark)}/cells-*"))
    out = learners.walk_forward(df, "v", bounds, lambda train: lambda val: val.withColumns({"n": F.lit(train.count()), "seen": F.lit(train.agg(F.max("v")).first()[0])}))
    stored = spark.read.parquet(*(set(glob.glob(f"{shared_dir(spark)}/cells-*")) - before))
    assert stored.count() == 600 and stored.select("id").distinct().count() == 600
    got = {(r["fold"], r["v"], r["n"], r["seen"]): r["count"] for r in out.groupBy("fold", "v", "n", "seen").count().collect()}
    assert got == {(k, k + 4, 60 * (k + 4), k + 3): 60 for k in range(6)}


def test_two_classes(spark):
    df = spark.createDataFrame([(p, y) for p in range(6) for y in ((0, 1) if p % 2 else (1, 1))], "p int, y int")
    bounds = folds.expanding_period_folds(df, "p", 2)
    assert sorted(r["fold"] for r in folds.two_class_folds(df, "p", bounds, "y").collect()) == [1, 3]
    assert math.isclose(folds.summary(df, "p", bounds).agg(F.sum("n_val")).first()[0], 8)
