"""Cutting oversized texts at their strongest natural boundaries.

Every place after which a text may be cut has a strength (paragraph > line > sentence > clause > word).  A sparse table over
these places answers "the strongest one in this range, the rightmost of equals" in constant time; the splitter asks it for
the permissible window of each cut, then steps back by the overlap, again to the best place the overlap reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of boundary, strongest first; a boundary is the end of the match.
_KINDS = (
    regex.compile(r"\n[^\S\n]*\n\s*"),
    regex.compile(r"\n\s*"),
    regex.compile(r"[.!?।॥…]+[\"'”’»)\]]*\s+"),
    regex.compile(r"[;:,–—|]\s+"),
    regex.compile(r"\s+"),
)
_MARK = regex.compile(r"[\p{M}‍️]")


class StrongestCut:
    """Sparse table of range maxima over boundary strengths; ranges are of text positions, at most `reach` long."""

    def __init__(self, text: str, reach: int):
        strength = np.zeros(len(text) + 1, dtype=np.int8)
        for weight, kind in zip(range(len(_KINDS), 0, -1), _KINDS, strict=True):
            ends = np.fromiter((m.end() for m in kind.finditer(text)), dtype=np.int64)
            strength[ends] = np.maximum(strength[ends], weight)
        strength[0] = strength[-1] = 0
        self.at = np.flatnonzero(strength)
        self.levels = [np.arange(len(self.at))]
        self.strength = strength[self.at]
        width = 1
        while 2 * width <= min(len(self.at), reach):
            left, right = self.levels[-1][: -width or None], self.levels[-1][width:]
            n = len(self.at) - 2 * width + 1
            left, right = left[:n], right[:n]
            self.levels.append(np.where(self.strength[left] > self.strength[right], left, right))
            width *= 2

    def query(self, lo: int, hi: int) -> int | None:
        """The strongest boundary in [lo, hi], the rightmost of equals; None if there is none."""
        a, b = np.searchsorted(self.at, lo), np.searchsorted(self.at, hi, side="right")
        if a >= b:
            return None
        k = min(int(b - a).bit_length() - 1, len(self.levels) - 1)
        best = None
        for start in [*range(a, b - (1 << k) + 1, 1 << k), b - (1 << k)]:
            j = int(self.levels[k][start])
            if best is None or (self.strength[j], j) > (self.strength[best], best):
                best = j
        return int(self.at[best])


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text; each piece is at most `limit` code points and starts within the one before."""
    if len(text) <= limit:
        return [(0, len(text))]
    table = StrongestCut(text, limit)
    pieces, start, done = [], 0, 0
    while len(text) - start > limit:
        # a cut lies in the later half of the window, so pieces stay large; else at the last whole character
        lo, hi = max(done + 1, start + limit // 2), start + limit
        end = table.query(lo, hi)
        if end is None:
            end = _whole(text, hi, lo)
        pieces.append((start, end))
        done = end
        if overlap:
            back = table.query(max(end - overlap, start + 1), end - overlap // 2)
            start = end if back is None else back
            if back is None:
                start = table.query(max(end - overlap, start + 1), end - 1) or _whole(text, end - overlap, max(end - overlap - 8, 0), up=True)
        else:
            start = end
    pieces.append((start, len(text)))
    return pieces


def _whole(text: str, at: int, least: int, up: bool = False) -> int:
    """The nearest place that doesn't part a mark from its letter."""
    first = at
    while at > least and at < len(text) and _MARK.match(text[at]):
        at += 1 if up else -1
    return at if at > least or up else first


def split_oversized(df: DataFrame, ident: str, text: str, limit: int = 1800, overlap: int = 300) -> DataFrame:
    """Pieces (`ident`, piece, pieces, start, text) of every row's text, none longer than `limit` code points.

    Consecutive pieces repeat up to `overlap` code points.  A text within the limit is its own only piece, an empty text an
    empty piece; a null text or null `ident` has none.  Repeated rows of one `ident` are cut once.  Texts with no boundary
    in reach are cut between whole characters.  Joining the pieces by `start` gives the text back.
    """
    if limit < 2 or not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    rows = df.select(F.col(ident).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    size = F.length("t")
    kind = rows.schema["i"].dataType.simpleString()
    small = rows.where(size <= limit).select("i", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), "t")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["i"], batch["t"], strict=True):
                spans = cut_points(t, limit, overlap)
                out += [(i, k, len(spans), a, t[a:b]) for k, (a, b) in enumerate(spans, 1)]
            yield pd.DataFrame(out, columns=["i", "piece", "pieces", "start", "t"])

    large = rows.where(size > limit).mapInPandas(cut, f"i {kind}, piece int, pieces int, start int, t string")
    pieces = small.unionByName(large).dropDuplicates(["i", "piece"])
    return pieces.select(F.col("i").alias(ident), "piece", "pieces", "start", F.col("t").alias(text))


def boundary_share(pieces: DataFrame, text: str = "text") -> DataFrame:
    """How many cuts of a result of split_oversized fell on each kind of boundary; a report to tune limits by."""
    ends = pieces.where("piece < pieces").select(F.regexp_extract(F.col(text), r"([.!?।]?\s*)$", 1).alias("e"))
    kind = F.when(F.col("e").rlike("\n\\s*\n"), "paragraph").when(F.col("e").contains("\n"), "line").when(F.col("e").rlike("^[.!?।]"), "sentence").when(F.col("e") != "", "word").otherwise("none")
    return ends.groupBy(kind.alias("boundary")).agg(F.count(F.lit(1)).alias("cuts"))


