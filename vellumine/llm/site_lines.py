"""Lines a site puts on the pages of many of its documents.

A page is a string over line identifiers (hashes of normalised lines).  Every line starts a suffix of its page, cut at
`window` lines.  The suffixes of all pages are sorted by (source, identifiers), range-partitioned, so that no source or line
is a task's own: that is the suffix array.  The common prefixes of neighbours are the repeated blocks, of one line or
several, and nothing but them is looked at further.  A block's spread is the number of distinct documents among the suffixes
that begin with it; a block spread over enough documents of its source is deleted wherever it stands.

Every line of such a block starts a suffix of the block, which spans the same documents at least; so the lines to delete are
the lines at which some spread block begins.  For the same reason blocks longer than `window` lines lose nothing: their
windows cover them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import written


def normal_lines(text: Column) -> Column:
    """The lines of a text that have a letter, as array<struct<line_no, t>>: letters and word breaks only."""
    bare = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\n]+", " ")
    lines = F.transform(F.split(bare, "\n", -1), lambda line, i: F.struct((i + 1).alias("line_no"), F.trim(line).alias("t")))
    return F.filter(lines, lambda x: x["t"].rlike("\\p{L}"))


def suffixes(pages: DataFrame, window: int) -> DataFrame:
    """(s, d, k0 ..., line_no, h, w1 ... w`window`) of pages (k0 ..., d, s, t): the identifiers of a line and of those after it (0 past the end).

    h is a second hash of the line itself, so that two lines are one only if 128 bits agree.
    """
    ids = F.transform(normal_lines(F.col("t")), lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["t"]).alias("w"), F.xxhash64(F.lit(1), x["t"], F.lit(2)).alias("h")))
    keys = _keys(pages)
    rows = pages.where("t is not null").select("s", "d", *keys, ids.alias("ids")).select("s", "d", *keys, "ids", F.posexplode("ids").alias("j", "x"))
    ahead = [F.coalesce(F.get("ids", F.col("j") + n)["w"], F.lit(0)).alias(f"w{n + 1}") for n in range(window)]
    return rows.select("s", "d", *keys, "x.line_no", "x.h", *ahead)


def suffix_array(rows: DataFrame, window: int) -> DataFrame:
    """The suffixes that share a prefix with a neighbour in sorted order, with `common`, the longer of the two prefixes' lengths.

    Each task sorts a range and compares neighbours as they stream by; the first and last suffix of a range are compared with
    those of the ranges beside it afterwards (two rows a range).
    """
    names = [f"w{n + 1}" for n in range(window)]
    order = ["s", *names, "d", *_keys(rows), "line_no"]

    def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumprod((a == b) & (a != 0), axis=1).sum(1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None  # held: the last row so far, whose second neighbour is still to come
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            else:
                batch = batch.assign(before=0, edge=-1)
                batch.loc[1:, "edge"] = 0
            ids, site = batch[names].to_numpy(np.int64), pd.factorize(batch["s"])[0]
            shared = lengths(ids[:-1], ids[1:]) * (site[:-1] == site[1:])
            fresh = batch["before"].to_numpy(np.int64, na_value=0).copy()
            fresh[1:] = shared
            batch = batch.assign(before=fresh, edge=batch["edge"].fillna(0).astype(int), part=part)
            after = np.append(shared, 0)
            batch = batch.assign(common=np.maximum(fresh, after))
            held = batch.iloc[[-1]].drop(columns=["common", "part"])
            done = batch.iloc[:-1]
            yield done[(done["common"] > 0) | (done["edge"] != 0)].drop(columns="before")
        if held is not None:
            yield held.assign(common=held["before"], part=part, edge=np.where(held["edge"] == -1, 2, 1)).drop(columns="before")

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(compare, f"{kinds}, edge int, part int, common int")
    ranges = written(ranges, "site-array")
    # edge: -1 the first of a range, 1 the last, 2 both
    beside = Window.orderBy("part", "edge")
    edges = ranges.where("edge != 0").select("part", "edge", "s", F.array(*names).alias("w"))  # two rows a range at most
    match = [F.transform(F.arrays_zip(F.col("w").alias("a"), other("w", 1).over(beside).alias("b")), lambda x: (x["a"] == x["b"]) & (x["a"] != 0)) for other in (F.lag, F.lead)]
    edges = edges.select("part", "edge", *[F.when(other("s", 1).over(beside) == F.col("s"), m).alias(n) for other, m, n in zip((F.lag, F.lead), match, ("m0", "m1"), strict=True)])
    run = [F.coalesce(F.when(F.array_position(m, False) > 0, F.array_position(m, False) - 1).otherwise(F.size(m)), F.lit(0)) for m in ("m0", "m1")]
    edges = edges.select("part", "edge", F.greatest(F.when(F.col("m0").isNull(), 0).otherwise(run[0]), F.when(F.col("m1").isNull(), 0).otherwise(run[1])).cast("int").alias("more"))
    inner, outer = ranges.where("edge = 0"), ranges.where("edge != 0").join(F.broadcast(edges), ["part", "edge"])
    outer = outer.withColumn("common", F.greatest("common", F.coalesce("more", F.lit(0)))).drop("more")
    return inner.unionByName(outer).where("common > 0").drop("edge", "part")


def spread_blocks(array: DataFrame, pages: DataFrame, share: float, least: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(begins, blocks): suffixes with `n`, each length of the blocks they begin with, and the blocks (s, n, b, h, docs) spread enough.

    Enough is at least `share` of the source's documents and at least `least` of them.
    """
    totals = pages.groupBy("s", "d").agg(F.lit(1).alias("one")).groupBy("s").agg(F.count(F.lit(1)).alias("all"))
    ids = F.array(*[F.col(f"w{n + 1}") for n in range(window)])
    keys = _keys(array)
    begins = array.select("s", "d", *keys, "line_no", "h", ids.alias("w"), F.explode(F.sequence(F.lit(1), "common")).alias("n"))
    begins = begins.select("s", "d", *keys, "line_no", "h", "n", F.xxhash64(F.slice("w", F.lit(1), F.col("n"))).alias("b"))
    docs = begins.groupBy("s", "n", "b", "h", "d").agg(F.lit(1).alias("one")).groupBy("s", "n", "b", "h").agg(F.count(F.lit(1)).alias("docs"))
    enough = (F.col("docs") >= least) & (F.col("docs") >= F.col("all") * share - 1e-9)
    return begins, docs.where(F.col("docs") >= least).join(totals, "s").where(enough).drop("all")


def _keys(rows: DataFrame) -> list[str]:
    """The columns k0, k1, ... that hold a page's key."""
    return [c for c in rows.columns if c[0] == "k"]


def _pages(df: DataFrame, keys: list[str], document: str, source: str, text: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], F.col(document).alias("d"), F.col(source).alias("s"), F.col(text).alias("t")).where("d is not null and s is not null")


def _blocks(pages: DataFrame, share: float, least: int, window: int) -> tuple[DataFrame, DataFrame]:
    array = suffix_array(suffixes(pages, window), window)
    begins, blocks = spread_blocks(array, pages, share, least, window)
    return begins, written(blocks, "site-blocks")


def site_lines(df: DataFrame, keys: list[str], document: str, source: str, text: str, share: float = 0.2, least: int = 4, window: int = 8) -> DataFrame:
    """Each line of a site's repeated blocks: `keys` (of the page) and line_no, numbered from 1 after splitting at newlines.

    Pages with a null source or document belong to no site and have no such lines; null and empty texts have no lines but
    their documents count.  Lines without a letter never count.  Repeated rows of a page change nothing.  Empty tables give
    an empty result.
    """
    begins, blocks = _blocks(_pages(df, keys, document, source, text), share, least, window)
    return begins.join(blocks.select("s", "n", "b", "h"), ["s", "n", "b", "h"], "left_semi").select(*[F.col(f"k{j}").alias(k) for j, k in enumerate(keys)], "line_no").distinct()


def site_blocks(df: DataFrame, page: str, document: str, source: str, text: str, share: float = 0.2, least: int = 4, window: int = 8) -> DataFrame:
    """(`source`, lines, documents, places) of the blocks with which some place goes no further: the longest ones that are deleted.

    Nulls, empty texts and repeated rows count as in site_lines; places are distinct (page, line).
    """
    begins, blocks = _blocks(_pages(df, [page], document, source, text), share, least, window)
    at = begins.join(blocks, ["s", "n", "b", "h"]).groupBy("s", "d", "k0", "line_no").agg(F.max(F.struct("n", "b", "h", "docs")).alias("m"))
    out = at.groupBy("s", "m").agg(F.count(F.lit(1)).alias("places"))
    return out.select(F.col("s").alias(source), F.col("m.n").alias("lines"), F.col("m.docs").alias("documents"), "places")


def without_lines(df: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """df with the found lines taken out of `text`; each page once, null texts stay null."""
    gone = found.groupBy(*keys).agg(F.collect_set("line_no").alias("__gone"))
    pages = df.dropDuplicates(keys).join(gone, keys, "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col("__gone"), i + 1))
    return pages.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__gone")
