"""Connected components over a distributed edge list, by alternating large-star and small-star rounds.

Each round is two grouped minima and joins on written tables; no link or component ever reaches the driver, which only
sees a count and a checksum per round. Minima are combined before the shuffle; nodes with very many neighbours are joined
by broadcast (there can be few of them), the rest by an equi-join without a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_by, stored


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    per = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return joined_by(both.where("v > u"), per, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    per = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = joined_by(down, per, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(per.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges has u and v (bigint); gives node and root, the least node that node reaches, for every node with a link."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        starred = stored(_large(now, mark[0]), "cc-large")
        before, now = now, stored(_small(starred, mark[0]), "cc")
        dropped(before)
        dropped(starred)
    root = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(root)
