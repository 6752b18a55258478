"""Connected components of an edge table by alternating large and small stars.

Each round joins every edge with the least neighbour of its end; no neighbour list is gathered. Rounds are written, so
that the lineage stays short and a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallbars.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (src, dst): the least node it can reach. Loops are ignored.

    An error is raised if the last of `rounds` still changed edges.
    """
    now = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds if mark[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large: u > v throughout. Small stars: all smaller neighbours of u, and u, hang on the least of them.
        large = large.distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        if mark[0]:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.withColumn("component", F.col("node")))


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
    return row.n, row.x, row.s


def deal_pairs(rows: DataFrame, group: str, key: str, blocks: str) -> DataFrame:
    """Rows dealt to all pairs of blocks of their group, as `a` <= `b`, with `block` the row's own.

    A group of one block stays one; a larger one is spread over blocks x (blocks + 1) / 2 keys, each of which sees two
    blocks, so that no task holds a whole large group.
    """
    own = rows.withColumn("block", F.pmod(F.xxhash64(key, F.lit("block")), F.col(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    return own.select("*", other.alias("_o")).withColumn("a", F.least("block", "_o")).withColumn("b", F.greatest("block", "_o")).drop("_o", blocks)
