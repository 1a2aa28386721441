"""Fuzzy token matching: equality and containment in the JVM, sequence ratio in Arrow batches over distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.session import written

_BLOCK = 50_000  # words of one length that meet a term in one task


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def exact_match(term: Column, token: Column) -> Column:
    """1 if equal, shorter by longer length if one holds the other, else 0; empty words match nothing."""
    a, b = F.length(term), F.length(token)
    held = F.contains(token, term) | F.contains(term, token)
    return F.when((a == 0) | (b == 0), 0.0).when(term == token, 1.0).when(held, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def _words(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).where(F.col(name) != "").distinct()


def _letters(word: Column) -> Column:
    """The characters of a word as marks in 64 bits."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(x), F.lit(64)))))


def matched(term: str, token: str, threshold: float, fuzzy: bool) -> bool:
    """Whether exact_match or, with `fuzzy`, where that is 0 and both have five letters or more, the sequence ratio reaches the threshold."""
    a, b = len(term), len(token)
    if term == token:
        return a > 0
    if min(a, b) < _reach(threshold, fuzzy) * max(a, b) - 1e-9 or not a or not b:
        return False
    if term in token or token in term:
        return min(a, b) / max(a, b) >= max(threshold, 1e-9)
    if not fuzzy or a < 5 or b < 5:
        return False
    one, other = set(term), set(token)
    if 2 * min(a - len(one - other), b - len(other - one)) < (threshold - 1e-9) * (a + b):
        return False
    match = SequenceMatcher(None, term, token)
    return match.quick_ratio() >= threshold - 1e-9 and match.ratio() >= threshold


def _near(pairs: DataFrame, threshold: float, fuzzy: bool) -> DataFrame:
    """The pairs (term, token, ...) that reach the threshold with `score`, or may reach it by their ratio (score 0).

    A ratio is at most 2 x shared characters / all characters: that bound comes before the ratio, so that Python sees near
    pairs only.  With `fuzzy` off, only equality and containment count.
    """
    a, b = F.length("term"), F.length("token")
    rest = [c for c in pairs.columns if c not in ("term_letters", "token_letters")]
    few = F.lit(True)
    if len(rest) < len(pairs.columns):
        # each mark that only one of the words has stands for one of its characters at least: cheaper than counting them, and never below
        one, other = (F.bit_count(F.col(f"{x}_letters").bitwiseAND(F.bitwise_not(f"{y}_letters"))) for x, y in (("term", "token"), ("token", "term")))
        few = 2 * F.least(a - one, b - other) / (a + b) >= threshold - 1e-9
    pairs = pairs.withColumn("score", exact_match(F.col("term"), F.col("token")))
    # characters of one word that the other has at all: no more can match
    shared = F.least(a - F.length(F.call_function("translate", F.col("term"), F.col("token"), F.lit(""))), b - F.length(F.call_function("translate", F.col("token"), F.col("term"), F.lit(""))))
    may = (a >= 5) & (b >= 5) & few & (F.col("score") == 0) & (2 * shared / (a + b) >= threshold - 1e-9)
    sure = F.col("score") >= max(threshold, 1e-9)
    return pairs.where(sure | may if fuzzy else sure).select(*rest, "score")


def _rated(pairs: DataFrame, threshold: float) -> DataFrame:
    """(term, token, score) of the distinct pairs whose ratio reaches the threshold."""
    return pairs.select("term", "token").distinct().withColumn("score", _ratio("term", "token")).where(F.col("score") >= threshold)


def _reach(threshold: float, fuzzy: bool) -> float:
    """The smallest share of the shorter word's length in the longer one's that can reach the threshold.

    Containment needs shorter / longer >= t, and a ratio is at most 2 shorter / (shorter + longer).
    """
    t = max(threshold, 1e-6)
    return t / (2 - t) if fuzzy else t


def term_matches(terms: DataFrame, tokens: DataFrame, threshold: float, fuzzy: bool = True) -> DataFrame:
    """(term, token, score) of distinct terms and tokens (columns term and token) with a score of at least `threshold`.

    For terms that may meet any token: a term meets the tokens of the lengths that can reach the threshold, in blocks of a
    bounded number of words.  Where it is known which tokens a term may meet, pair_matches does less.
    """
    low = _reach(threshold, fuzzy)
    a, b = F.length("term"), F.length("token")
    right = written(_words(tokens, "token").select("token", b.alias("n"), _letters(F.col("token")).alias("token_letters")), "vocabulary")
    parts = max(4, -(-(right.groupBy("n").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0) // _BLOCK))
    reach = F.sequence(F.ceil(a * low - 1e-9).cast("int"), F.floor(a / low + 1e-9).cast("int"))
    left = _words(terms, "term").select("term", _letters(F.col("term")).alias("term_letters"), F.explode(reach).alias("n")).select("term", "term_letters", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # few rows here are much work: their tasks aren't to be put together by size
    left = left.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n", "part")
    right = right.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))
    near = written(_near(right.join(left, ["n", "part"]).drop("n", "part"), threshold, fuzzy), "near-words")
    sure = near.where("score > 0").select("term", "token", "score")
    return sure.unionByName(_rated(near.where("score = 0"), threshold)) if fuzzy else sure


def pair_matches(terms: DataFrame, tokens: DataFrame, key: str, threshold: float, fuzzy: bool = True) -> DataFrame:
    """(`key`, term, token, score) of the terms and tokens of one `key` that reach the threshold.

    Terms (`key`, term) and tokens (`key`, token) meet within their key only; each distinct pair is scored once.
    """
    low = _reach(threshold, fuzzy)
    a, b = F.length("term"), F.length("token")
    left = terms.where("term != ''").select(key, "term").distinct()
    right = tokens.where("token != ''").select(key, "token").distinct()
    met = left.join(right, key).where((F.least(a, b) >= low * F.greatest(a, b) - 1e-9)).select(key, "term", "token")
    near = written(_near(met, threshold, fuzzy), "near-words")
    rated = near.where("score = 0").drop("score").join(_rated(near.where("score = 0"), threshold), ["term", "token"]).select(key, "term", "token", "score")
    return near.where("score > 0").unionByName(rated)


def containing(terms: DataFrame, tokens: DataFrame, least: int = 5) -> DataFrame:
    """(term, token) of tokens that hold a term of `least` letters or more: met by the term's first letters."""
    left = _words(terms, "term").where(F.length("term") >= least).withColumn("g", F.substring("term", 1, least))
    right = _words(tokens, "token").where(F.length("token") >= least)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - least + 1), lambda k: F.substring(F.col("token"), k, F.lit(least))))
    return right.withColumn("g", F.explode(grams)).join(left, "g").where(F.contains("token", "term")).select("term", "token").distinct()
