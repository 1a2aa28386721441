"""Exact ranks inside groups of any size without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], ident: Column, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """df with `rank`, from 0, in the order of a seeded hash of `ident` within `keys`.

    The hash range is cut into so many parts that the largest group (counted first) has about `most` rows in each; a row's
    rank is its place within its part plus the sizes of the parts before.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    parts = max(1, -(-largest // most))
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), ident))
    rows = rows.withColumn("__part", F.floor((F.shiftright(F.col("__h"), 32) + F.lit(1 << 31)) * parts / F.lit(1 << 32)).cast("int"))
    sizes = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__h", ident)) - 1
    return rows.withColumn("__place", place).join(sizes, [*keys, "__part"]).withColumn("rank", F.col("__place") + F.col("__before")).drop("__h", "__part", "__place", "__before")
