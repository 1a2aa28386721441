"""Top N of every group by simultaneous bisection of an order-preserving code.

A row's place is its 128-bit code (score, then identifier): two longs whose order is the wanted order.  All groups are
bisected at once.  A round puts equally spaced midpoints between each group's lowest and highest code still open, counts
the rows above every midpoint in one pre-aggregated pass, and keeps the interval in which the N-th row lies: rows above it
are chosen, rows below it are dropped, only rows inside go on.  Where all scores of an interval are equal the round bisects
the identifiers instead.  A round narrows an interval `fan`-fold (log2(fan) plain bisection steps), so a few rounds do
whatever a group's size, and no group is ever sorted or held in one task: a hot group is only more counts, and its rows are
spread over `salts` join keys, counted from the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import written

_BITS = 0x7FFFFFFFFFFFFFFF
_SALTED = 250_000


def order_code(score: Column) -> Column:
    """A double as a long of the same order (IEEE bits, the negative ones mirrored); -0.0 counts as 0.0."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_BITS)))


def _midpoint(code: Column, lo: Column, hi: Column, fan: int) -> Column:
    """Which of `fan` equal parts of [lo, hi] holds the code; exact below 2^53, monotone in doubles beyond."""
    span = hi.cast("double") - lo.cast("double")
    wide = F.floor((code.cast("double") - lo.cast("double")) / span * fan)
    code, lo, hi = (x.cast("decimal(20,0)") for x in (code, lo, hi))
    narrow = F.floor((code - lo) * fan / (hi - lo + 1))
    return F.least(F.lit(fan - 1), F.when(span >= float(2**53), wide).otherwise(narrow)).cast("int")


def top_per_group(df: DataFrame, group: str, score: str, ident: str, n: int, salts: int | None = None, fan: int = 512) -> DataFrame:
    """The `n` rows of the highest score of each group: columns `group`, `ident`, `score`.

    Equal scores go by the smaller `ident` (an integer).  A repeated `ident` counts once (of differing repeats the one with
    the highest score, then group).  Rows with a null group, null ident, or null or NaN score take no place; groups of fewer
    than `n` rows come out whole; an empty table gives an empty result.  Other columns of `df` are not looked at.
    """
    if n < 1 or fan < 2 or (salts is not None and salts < 1):
        raise ValueError("n and salts must be at least 1 and fan at least 2")
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(ident).cast("long").alias("i"), value.alias("s"))
    rows = rows.where("g is not null and i is not null and s is not null and not isnan(s)")
    rows = rows.groupBy("i").agg(F.max(F.struct("s", "g")).alias("m")).select("m.g", "i", "m.s")
    # the identifier's code is mirrored (~i), so that a smaller one stands higher
    rows = rows.select("g", "i", "s", order_code(F.col("s")).alias("c"), F.bitwise_not(F.col("i")).alias("d"))
    rows = written(rows.withColumn("b", F.lit(0)), "top-rows")
    ends = [F.count(F.lit(1)).alias("rows"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("d").alias("d0"), F.max("d").alias("d1")]
    # cut: the interval (bucket) of each group that holds its n-th row, and how many of its rows are still wanted
    cut = written(rows.groupBy("g").agg(*ends).withColumn("need", F.lit(n).cast("long")).withColumn("at", F.lit(0)), "top-cut")
    if salts is None:  # so many that the largest group has about `_SALTED` rows for each
        salts = max(1, -(-(cut.agg(F.max("rows")).first()[0] or 0) // _SALTED))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    chosen: list[DataFrame] = []
    while True:
        state = cut.select("g", "at", "need", (F.col("rows") <= F.col("need")).alias("whole"), (F.col("c0") == F.col("c1")).alias("tie"), "c0", "c1", "d0", "d1")
        state = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        code, lo, hi = (F.when(F.col("tie"), F.col(d)).otherwise(F.col(c)) for d, c in (("d", "c"), ("d0", "c0"), ("d1", "c1")))
        met = rows.join(state, ["g", "salt"]).where("b >= at")
        met = met.withColumn("done", F.col("whole") | (F.col("b") > F.col("at"))).withColumn("b", F.when(~F.col("done"), _midpoint(code, lo, hi, fan)))
        met = written(met.select("g", "i", "s", "c", "d", "salt", "b", "need", "done"), "top-round")
        chosen.append(met.where("done").select("g", "i", "s"))
        rows = met.where("not done").drop("done")
        above = Window.partitionBy("g").orderBy(F.desc("b"))  # at most `fan` counts a group
        counts = rows.groupBy("g", "need", "b").agg(*ends).withColumn("upto", F.sum("rows").over(above))
        cut = counts.where("upto >= need and upto - rows < need").withColumn("need", F.col("need") - F.col("upto") + F.col("rows"))
        cut = written(cut.select("g", F.col("b").alias("at"), "need", "rows", "c0", "c1", "d0", "d1"), "top-cut")
        rows = rows.drop("need")
        if cut.isEmpty():
            break
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group), F.col("i").alias(ident), F.col("s").alias(score))
