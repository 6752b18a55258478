"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item") and getattr(v, "shape", None) == ():
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v if isinstance(v, (int, bool)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = [tuple(plain(v) for v in row) for row in df.itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
