"""Connected components of a distributed edge table.

Alternating large-star and small-star steps (Kiveris et al. 2014): the edge
table never leaves the executors, every step is a pair of map-side combined
minima and equi-joins, and each round is cut in the shared folder. Minima carry
their key as an aggregate of its own: a join then deals out both of its sides
itself, and Spark may split the rows of a frequent key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, plain


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("u").alias("k")).select("k", F.least("k", "m").alias("m"))
    return both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.max("u").alias("k")).select("k", "m")
    met = down.join(least, down.u == least.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    Nodes are of any type that has an order. Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    now = plain(cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, now = mark, plain(cut(_small(_large(now))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
