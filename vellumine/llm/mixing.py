"""Mixing sources to target shares: exact token budgets by subset sums over the histogram of lengths.

A source's budget is its share of the total.  Whole passes over the source come first, as many as the budget and the cap
on repeats allow.  The rest of the budget is met by choosing how many documents of each exact token length to take: a
proportional share of every length, then, for the last few thousand tokens, a bounded-knapsack dynamic program over the
lengths left.  Which documents of a length are taken follows a seeded hash.  Planning sees one row per (source, length).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.ranks import ranked
from vellumine.session import written


def nearest_subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take for the largest sum within `budget` (bounded knapsack over a bit set of sums)."""
    mask, sums, layers = (1 << (budget + 1)) - 1, 1, []
    for n, c in zip(lengths, counts, strict=True):
        layers.append(sums)
        c, k = min(c, budget // n) if n else 0, 1
        while c > 0:
            k = min(k, c)
            sums |= (sums << (n * k)) & mask
            c -= k
            k *= 2
    best, taken = sums.bit_length() - 1, [0] * len(lengths)
    for j in range(len(lengths) - 1, -1, -1):
        n = lengths[j]
        while not layers[j] >> best & 1:  # the fewest of this length that lead back to a sum of the layer before
            best -= n
            taken[j] += 1
    return taken


def choose_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = 16_384) -> np.ndarray:
    """How many documents of each length make up `budget` tokens, never more than it and as near as the lengths allow."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    for j in np.argsort(-lengths, kind="stable"):  # whole lengths until the exact part is in reach
        if left <= exact or lengths[j] == 0:
            break
        more = min(int(counts[j] - taken[j]), max(0, (left - exact // 2) // int(lengths[j])))
        taken[j] += more
        left -= more * int(lengths[j])
    open_ = np.flatnonzero((counts > taken) & (lengths > 0) & (lengths <= left))
    if len(open_):
        taken[open_] += np.array(nearest_subset([int(v) for v in lengths[open_]], [int(v) for v in (counts - taken)[open_]], left), dtype=np.int64)
    return taken


def mixture(df: DataFrame, targets: DataFrame, ident: str, source: str, text: str, size: str, total: int | None = None, seed: int = 7, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selection, plan) of a mixture of `total` tokens (default: all tokens of the listed sources).

    A source that cannot supply its share of the total gives all it has, `max_repeats` times, and the others' shares of what
    comes out grow.  With `keep` the shares hold instead: sources that supply nothing are set aside and the other shares scaled
    to a sum of 1 (`wanted`), and the total is the largest, up to `total`, at which every one of these sources has its share.

    selection: source, `ident`, tokens, repeats (how often the document is used, at most max_repeats).  Equal texts of one
    source are one text: only the smallest id is used.  plan: one row per listed source.  Documents with a null id, text,
    size or source, or of an unlisted source, are not used; a source without documents supplies nothing; a null or negative
    share counts as 0, a null or negative max_repeats as 0.  Repeated target rows of one source count once (the first by
    share).  Empty tables give an empty selection.
    """
    goal = targets.select(F.col("source").alias("s"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("cap"))
    goal = goal.where("s is not null").groupBy("s").agg(F.min(F.struct("share", "cap")).alias("m")).select("s", "m.share", "m.cap")
    docs = df.select(F.col(ident).alias("i"), F.col(source).alias("s"), F.md5(F.col(text)).alias("t"), F.col(size).cast("long").alias("n"))
    docs = docs.where("i is not null and s is not null and n >= 0").join(goal.select("s"), "s", "left_semi").dropDuplicates(["i"])
    docs = written(docs, "mix-documents")
    own = docs.groupBy("s").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("documents"))
    texts = docs.where("t is not null").groupBy("s", "t", "n").agg(F.min("i").alias("i"))
    texts = written(texts.select("s", "i", "n"), "mix-texts")
    counts = texts.groupBy("s", "n").agg(F.count(F.lit(1)).alias("c"))
    every = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_tokens"))
    budget = (F.col("all_tokens") if total is None else F.lit(total)).cast("double")
    sources = goal.join(own, "s", "left").crossJoin(every).fillna(0, ["own", "documents"])  # `every` is one row
    supply = texts.groupBy("s").agg(F.sum("n").alias("supply"))
    sources = sources.join(supply, "s", "left").withColumn("supply", F.coalesce("supply", F.lit(0)) * F.col("cap"))
    sources = sources.withColumn("wanted", F.when(F.col("supply") > 0, F.col("share")).otherwise(0.0) if keep else F.col("share"))
    if keep:  # one row
        scale = sources.agg(F.sum("wanted").alias("scale"), F.min(F.when(F.col("wanted") > 0, F.col("supply") / F.col("wanted"))).alias("reach"))
        sources = sources.crossJoin(scale).withColumn("wanted", F.when(F.col("scale") > 0, F.col("wanted") / F.col("scale")).otherwise(0.0))
        budget = F.least(budget, F.coalesce(F.floor(F.col("reach") * F.col("scale")), F.lit(0)).cast("double"))
    sources = written(sources.select("s", "share", "cap", "own", "documents", "all_tokens", "wanted", F.round(F.col("wanted") * budget).cast("long").alias("budget")), "mix-sources")

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        lengths, c = rows["n"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
        cap, want, one = int(rows["cap"].iloc[0]), int(rows["budget"].iloc[0]), int((lengths * c).sum())
        passes = min(cap, want // one) if one else min(cap, 1)
        part = choose_counts(lengths, c, want - passes * one) if passes < cap and one else np.zeros(len(c), dtype=np.int64)
        return pd.DataFrame({"s": rows["s"], "n": lengths, "passes": passes, "part": part})

    joined = counts.join(sources.select("s", "cap", "budget"), "s")
    takes = written(joined.groupBy("s").applyInPandas(planned, "s string, n long, passes int, part long"), "mix-plan")
    chosen = ranked(texts, ["s", "n"], F.col("i"), seed).join(takes, ["s", "n"])
    chosen = chosen.withColumn("repeats", F.col("passes") + F.when(F.col("rank") < F.col("part"), 1).otherwise(0)).where("repeats > 0")
    return chosen.select(F.col("s").alias(source), F.col("i").alias(ident), F.col("n").alias("tokens"), "repeats"), sources.withColumnRenamed("s", source)


def source_report(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Per listed source: target_share, wanted share, budget, own tokens, reached tokens and share, and `short` if it cannot supply its target share."""
    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"))
    out = plan.join(reached, "source", "left").fillna(0, ["reached_tokens"])
    whole = out.agg(F.sum("reached_tokens").alias("mixture_tokens"))
    out = out.crossJoin(whole)  # one row
    short = F.col("cap") * F.col("own") < F.col("share") * F.col("all_tokens")
    share = F.when(F.col("mixture_tokens") > 0, F.col("reached_tokens") / F.col("mixture_tokens"))
    return out.select("source", F.col("share").alias("target_share"), F.col("wanted").alias("wanted_share"), "budget", F.col("own").alias("own_tokens"), "documents", "reached_tokens", F.round(share, 6).alias("reached_share"), short.alias("short"))
