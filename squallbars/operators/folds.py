"""Walk-forward splits as data: a small array of fold bounds over an ordered column.

Every fold set is one array value (a scalar subquery). The borders of all folds cut the rows into cells; rows are counted, and
written for learning, once by cell, and a fold is a set of cells. No row is copied for the folds that use it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.operators.layout import number_rows

col = F.col
POSITION = "_pos"


def add_months(ts: Column, months: int) -> Column:
    """Month step that clips to the month's end and keeps the time of day."""
    day = F.date_trunc("day", ts)
    return F.timestamp_micros(F.unix_micros(F.add_months(day, months).cast("timestamp")) + F.unix_micros(ts)
                              - F.unix_micros(day))


def _bounds(start, val_start, val_end) -> Column:
    return F.struct(start.alias("train_start"), val_start.alias("val_start"), val_end.alias("val_end"))


def block_folds(df: DataFrame, ts: str, train: int, val: int, step: int, expanding: bool = True) -> Column:
    """Calendar blocks in months: the first validation starts ``train`` months in, then moves by ``step``.

    Steps are taken from the previous start, so month-end clipping accumulates.
    """
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    count = F.floor(F.months_between("hi", "lo") / step).cast("int") + 2
    first = add_months(col("lo"), train)
    starts = F.aggregate(F.sequence(F.lit(1), count), F.array(first), lambda acc, i: F.concat(
        acc, F.array(add_months(F.element_at(acc, -1), step))))
    bounds = F.transform(F.filter(starts, lambda s: s <= col("hi")), lambda s: _bounds(
        col("lo") if expanding else add_months(s, -train), s, add_months(s, val)))
    return span.select(bounds).scalar()


def even_folds(df: DataFrame, ts: str, n_splits: int, val_days: int, min_train_days: int) -> Column:
    """``n_splits`` validation windows with evenly spaced starts; training is everything before."""
    span = df.agg(F.unix_micros(F.min(ts)).alias("lo"), F.unix_micros(F.max(ts)).alias("hi"))
    day = 86_400_000_000
    first, last = col("lo") + min_train_days * day, col("hi") - val_days * day
    starts = F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda i: (
        first + F.floor((last - first) * i / max(n_splits - 1, 1))).cast("long"))
    bounds = F.transform(starts, lambda s: _bounds(F.timestamp_micros(col("lo")), F.timestamp_micros(s),
                                                   F.timestamp_micros(s + val_days * day)))
    return span.select(bounds).scalar()


def last_period_folds(df: DataFrame, period: str, n_val: int) -> Column:
    """Each of the last ``n_val`` periods validates; all earlier periods train. Too few periods is an error."""
    return _period_folds(df, period, F.when(F.size("p") > n_val, F.size("p") - n_val).otherwise(
        F.raise_error(F.lit("not enough periods for the requested validation folds")).cast("int")))


def expanding_period_folds(df: DataFrame, period: str, min_train: int = 1) -> Column:
    """Every period after the first ``min_train`` validates once; all earlier periods train."""
    return _period_folds(df, period, F.lit(min_train))


def _period_folds(df: DataFrame, period: str, first: Column) -> Column:
    """Folds over a column of periods: from the ``first`` one on each validates, and those before it train."""
    periods = df.agg(F.array_sort(F.collect_set(period)).alias("p")).withColumn("k", first)
    chosen = F.slice("p", col("k") + 1, F.greatest(F.size("p") - col("k"), F.lit(0)))
    nothing = F.lit(None).cast(df.schema[period].dataType)
    return periods.select(F.transform(chosen, lambda v, i: _bounds(nothing, v, F.get("p", col("k") + i + 1)))).scalar()


def _role(value: Column, b: Column) -> Column:
    """Part of a value in a fold; a missing bound is open."""
    train = (b["train_start"].isNull() | (value >= b["train_start"])) & (value < b["val_start"])
    val = (value >= b["val_start"]) & (b["val_end"].isNull() | (value < b["val_end"]))
    return F.when(train, "train").when(val, "val")


def with_cells(df: DataFrame, on: str, bounds: Column) -> DataFrame:
    """Rows with ``cell``, the number of fold borders at or before their value: the rows of a cell share all their folds."""
    ends = F.flatten(F.transform("_bounds", lambda b: F.array(b["train_start"], b["val_start"], b["val_end"])))
    borders = df.sparkSession.range(1).select(bounds.alias("_bounds")).select(
        F.array_sort(F.array_distinct(F.filter(ends, lambda x: x.isNotNull())))).scalar()
    placed = df.filter(col(on).isNotNull()).withColumn("_borders", borders)
    return placed.withColumn("cell", F.size(F.filter("_borders", lambda x: x <= col(on)))).drop("_borders")


def fold_cells(celled: DataFrame, on: str, bounds: Column, **totals: Column) -> DataFrame:
    """(fold, role, cell, n, lo, hi and further totals): a row for each fold and cell it uses.

    Rows are counted once by cell, of which there are at most three for each fold and one more; folds meet those counts.
    """
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("lo"), F.max(on).alias("hi"),
                                       *[c.alias(name) for name, c in totals.items()])
    folds = cells.select("*", F.posexplode(bounds).alias("fold", "_b"))
    return folds.withColumn("role", _role(col("lo"), col("_b"))).filter("role IS NOT NULL").drop("_b")


def summary(df: DataFrame, on: str, bounds: Column) -> DataFrame:
    """Rows and range of both roles per fold; folds missing either role are left out."""
    train, val = col("role") == "train", col("role") == "val"
    out = fold_cells(with_cells(df, on, bounds), on, bounds).groupBy("fold").agg(
        F.coalesce(F.sum(F.when(train, col("n"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(val, col("n"))), F.lit(0)).alias("n_val"),
        F.min(F.when(train, col("lo"))).alias("train_from"), F.max(F.when(train, col("hi"))).alias("train_to"),
        F.min(F.when(val, col("lo"))).alias("val_from"), F.max(F.when(val, col("hi"))).alias("val_to"))
    return out.filter((col("n_train") > 0) & (col("n_val") > 0))


def two_class_folds(df: DataFrame, on: str, bounds: Column, label: str) -> DataFrame:
    """The folds whose validation rows hold both classes, by number."""
    cells = fold_cells(with_cells(df, on, bounds), on, bounds, low=F.min(label), high=F.max(label))
    return cells.filter("role = 'val'").groupBy("fold").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a <> b").select("fold")


def validation_rows(df: DataFrame, on: str, bounds: Column) -> DataFrame:
    """Rows with the ``fold`` they validate (one row for each, where validation windows overlap)."""
    numbered = F.transform("_bounds", lambda b, i: F.struct(i.alias("fold"), _role(col(on), b).alias("role")))
    own = F.transform(F.filter(numbered, lambda x: x["role"] == "val"), lambda x: x["fold"])
    return df.withColumn("_bounds", bounds).withColumn("fold", F.explode(own)).drop("_bounds")


class PositionFolds(NamedTuple):
    """Folds by row position: ``rows`` with ``POSITION``, the number of folds, and their borders (train, val, end) by number."""

    rows: DataFrame
    count: Column
    borders: Callable[[Column], tuple[Column, Column, Column]]

    def bounds(self) -> Column:
        """The folds as an array over ``POSITION``, for few of them."""
        each = self.rows.sparkSession.range(1).select(F.explode(self._numbers()).alias("fold")).select(F.struct("fold", _bounds(*self.borders(col("fold"))).alias("b")).alias("f"))
        return each.agg(F.sort_array(F.collect_list("f")).alias("f")).select(F.transform("f", lambda f: f["b"])).scalar()

    def _numbers(self) -> Column:
        return F.when(self.count > 0, F.sequence(F.lit(0).cast("long"), (self.count - 1).cast("long"))).otherwise(F.array().cast("array<long>"))

    def summary(self, ts: str) -> DataFrame:
        """Rows and range of both roles per fold, from the rows at the borders alone: four of them for each fold."""
        fold = self.rows.sparkSession.range(1).select(F.explode(self._numbers()).alias("fold"))
        train, val, end = self.borders(col("fold"))
        edges = {"train_from": train, "train_to": val - 1, "val_from": val, "val_to": end - 1}
        wanted = fold.select("fold", train.alias("_train"), val.alias("_val"), end.alias("_end"), F.explode(F.array(*[
            F.struct(F.lit(name).alias("edge"), place.cast("long").alias(POSITION)) for name, place in edges.items()])).alias("e")).select("*", "e.*").drop("e")
        return (wanted.join(self.rows.select(POSITION, col(ts).alias("_at")), POSITION).groupBy("fold", (col("_val") - col("_train")).cast("long").alias("n_train"),
                                                                                               (col("_end") - col("_val")).cast("long").alias("n_val"))
                .agg(*[F.max(F.when(col("edge") == name, col("_at"))).alias(name) for name in edges]).filter("n_train > 0 AND n_val > 0"))


def _positions(df: DataFrame, order: str, ties: Sequence[str]) -> tuple[DataFrame, Column]:
    rows = number_rows(df, [], order, ties, out=POSITION)
    return rows, rows.agg(F.count(F.lit(1))).scalar()


def rolling_folds(df: DataFrame, order: str, window: int, horizon: int, step: int = 1, ties: Sequence[str] = ()) -> PositionFolds:
    """Folds by row position: ``window`` training rows, then ``horizon`` test rows, moved by ``step``."""
    rows, n = _positions(df, order, ties)
    return PositionFolds(rows, F.floor((n - window - horizon) / step) + 1, lambda k: (k * step, k * step + window, k * step + window + horizon))


def sequential_folds(df: DataFrame, order: str, k: int, ties: Sequence[str] = ()) -> PositionFolds:
    """k equal test blocks at the end of the ordered rows, each trained on everything before it."""
    rows, n = _positions(df, order, ties)
    size = F.floor(n / (k + 1))
    return PositionFolds(rows, F.lit(k), lambda i: (F.lit(0).cast("long"), n - k * size + i * size, n - k * size + (i + 1) * size))
