"""Fair shares of a budget of characters among the sources of a request, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of all sources of a request, and what each source gets at least.
BUDGET, LEAST = 60_000, 2_000


def fair_shares(rows: DataFrame, group: str, order: str, text: str = "text", budget: int = BUDGET, least: int = LEAST) -> DataFrame:
    """rows (group, order, text) with chars, share, truncated, and text cut to its share.

    A source gets an equal part of what those before it left over, and no less than `least`. That is a fold in order with a
    running remainder; only the lengths of a group are folded, texts are joined back to their place.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, F.xxhash64(text)))
    placed = rows.withColumn("_n", place).withColumn("chars", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    lengths = placed.groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_n", "chars"))).alias("xs")).withColumn("m", F.size("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("shares"))

    def step(state, x):
        share = F.greatest(F.lit(least), F.floor((F.lit(budget) - state["used"]) / (F.col("m") - x["_n"] + 1))).cast("long")
        return F.struct((state["used"] + F.least(share, x["chars"])).alias("used"), F.concat(state["shares"], F.array(share)).alias("shares"))

    shares = lengths.select("_g", F.posexplode(F.aggregate("xs", zero, step, lambda s: s["shares"])).alias("_i", "share"))
    both = placed.join(shares, placed[group].eqNullSafe(shares["_g"]) & (placed["_n"] == shares["_i"] + 1))
    cut = F.substring(F.coalesce(text, F.lit("")), F.lit(1), F.col("share").cast("int"))
    return both.withColumn("truncated", F.col("chars") > F.col("share")).withColumn(text, cut).drop("_g", "_i", "_n")
