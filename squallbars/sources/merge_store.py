"""A stored table laid out in partitions, into which rows are merged without reading or writing the others.

A merge finds the partitions that the new rows touch, reads those alone (partition filters, so other files are not even opened),
keeps their rows whose key is not new, and overwrites them dynamically. Rows of a key stay in one partition because the layout
is made of keys. Overwriting is a rename of each partition after the whole job; a merge that stops midway is simply run again,
since merging the same rows twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from squallbars.session import shared
from squallbars.sources.store import latest, without

NOTHING, BETWEEN = "\x00", "\x01"


def by_ticker_and_month(ticker: str = "ticker", ts: str = "datetime") -> dict[str, Column]:
    return {"_ticker": F.col(ticker), "_month": F.date_format(ts, "yyyy-MM")}


def by_day(ts: str) -> dict[str, Column]:
    return {"_day": F.date_format(ts, "yyyy-MM-dd")}


def by_hash(key: str, parts: int) -> dict[str, Column]:
    return {"_part": F.pmod(F.xxhash64(key), F.lit(parts))}


@dataclass(frozen=True)
class MergeStore:
    """`layout` names partition columns and says how they follow from `keys`; rows have the columns of `schema`."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    layout: Mapping[str, Column]

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], layout: Mapping[str, Column]) -> MergeStore:
        """A new store holding `rows`, whose keys are unique."""
        store = cls(rows.sparkSession, path, rows.schema, tuple(keys), dict(layout))
        store._write(store._placed(rows), "errorifexists")
        return store

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def touched(self, rows: DataFrame) -> list[str]:
        """Partitions that rows belong to; as the file listing, the driver holds one name for each at most."""
        return sorted(r[0] for r in self._placed(rows.select(*self.keys)).select(self._name()).distinct().collect())

    def merged(self, newest: DataFrame, parts: Sequence[str]) -> DataFrame:
        """The partitions `parts` after one row per key, `newest`, has taken the place of what is stored."""
        kept = without(self._stored().filter(self._name().isin(*parts)), newest, self.keys)
        return kept.unionByName(self._placed(newest))

    def merge(self, rows: DataFrame, order: Sequence[str] = ()) -> list[str]:
        """Stored rows overwritten by rows with the same key, among which the last by ``order`` wins; the partitions written."""
        known = [c for c in self.schema.names if c not in rows.columns]
        newest = latest(rows.withColumns({c: F.lit(None) for c in known}), self.keys, order)
        newest = shared(newest.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]))
        parts = self.touched(newest)
        if parts:
            self._write(self.merged(newest, parts), "overwrite")
        return parts

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: F.nullif(c.cast("string"), F.lit("")) for name, c in self.layout.items()})

    def _stored(self) -> DataFrame:
        schema = StructType(list(self.schema))
        for name in self.layout:
            schema = schema.add(name, "string")
        return self.spark.read.schema(schema).parquet(self.path)

    def _name(self) -> Column:
        return F.concat_ws(BETWEEN, *[F.coalesce(name, F.lit(NOTHING)) for name in self.layout])

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Rebalanced by partition, so that small ones are one file and large ones are split."""
        (rows.hint("rebalance", *[F.col(c) for c in self.layout]).write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.layout).parquet(self.path))
