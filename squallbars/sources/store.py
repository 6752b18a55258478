"""Merging new rows into stored tables and reading only what is new."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the last by ``order`` (then by the other columns that can be ordered, so that reruns agree).

    A rank limited to 1 is taken in every task before the shuffle, so a key that arrives many times is one row per task.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    rest = [c for c in rows.columns if c not in (*keys, *order) and isinstance(kinds[c], AtomicType)]
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in (*order, *rest)] or [F.lit(0)])
    return rows.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


def without(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key (nulls are values) is not among the new rows."""
    named = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    return stored.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]), "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Stored rows overwritten by new rows with the same key; among new rows the last by ``order`` wins.

    Stored rows are only filtered, never sorted or combined. A table that is kept is a `merge_store.MergeStore`, which reads no
    more of it than the new rows touch.
    """
    newest = latest(new, keys, order)
    return without(stored, newest, keys).unionByName(newest.select(*[c for c in stored.columns if c in newest.columns]), allowMissingColumns=True)


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not stored yet, each key once."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def newer_than_stored(stored: DataFrame, source: DataFrame, keys: Sequence[str], ts: str = "datetime",
                      step: str = "1 hour", default_days: int = 50, now: str | None = None) -> DataFrame:
    """Source rows at or after each key's stored maximum plus one step.

    A key without stored rows reads the last ``default_days`` before ``now`` (default: the newest source row).
    """
    marks = stored.groupBy(*keys).agg(F.max(ts).alias("_mark"))
    at = F.lit(now).cast("timestamp") if now else source.agg(F.max(ts)).scalar()
    start = F.coalesce(F.col("_mark") + F.expr(f"interval {step}"), at - F.expr(f"interval {default_days} days"))
    return source.join(marks, list(keys), "left").filter(F.col(ts) >= start).drop("_mark")


def stitch(old: DataFrame, new: DataFrame, keys: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Old source strictly before the new source's first row per key, then the new source."""
    cut = new.groupBy(*keys).agg(F.min(ts).alias("_cut"))
    before = old.join(cut, list(keys), "left").filter(F.col("_cut").isNull() | (F.col(ts) < F.col("_cut"))).drop("_cut")
    return before.unionByName(new, allowMissingColumns=True)
