"""Deduplication with a defined survivor, always by aggregates or windows over explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order. Rows with a null key are one group of that null."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def richest(df: DataFrame, keys: list[str], score: Column, tie: str) -> DataFrame:
    """The row of each key with the largest score, the smallest tie value on equal scores.

    An aggregate with partial results instead of a window: a hot key costs one row a task.
    """
    rows = df.withColumn("_s", F.struct((-score).alias("s"), F.col(tie).alias("t")))
    best = rows.groupBy(*keys).agg(F.min("_s").alias("_best"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return rows.alias("r").join(best.alias("b"), [*on, F.col("r._s") == F.col("b._best")], "left_semi").drop("_s")


def capped_share(df: DataFrame, group: Column, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Rows of the group cut, in a random order that the seed fixes, to int(share) of all rows; all other rows stay.

    The cut is the bound of the hash order found from counts of its ranges, so no task holds the
    whole group: whole ranges stay or go, and only the range at the bound is ranked.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20))
    rows = df.select("*", F.coalesce(group, F.lit(False)).alias("_in"), place.alias("_place"))
    counts = rows.groupBy("_in", F.shiftright("_place", 8).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
    most = int(sum(r["n"] for r in counts) * share)
    left, bound = most, 1 << 12
    for r in sorted((r for r in counts if r["_in"]), key=lambda r: r["range"]):
        if r["n"] > left:
            bound = r["range"]
            break
        left -= r["n"]
    at = F.shiftright("_place", 8)
    inside = rows.where(~F.col("_in") | (at < bound))
    edge = rows.where(F.col("_in") & (at == bound)).withColumn("_n", F.row_number().over(Window.partitionBy("_in").orderBy("_place", key))).where(F.col("_n") <= left)
    return inside.drop("_in", "_place").unionByName(edge.drop("_in", "_place", "_n"))
