"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.numbers import plain_numbers
from vellumine.functions.text import evaluation_text, strip


def recall_at_k(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(questions, hits, recall): share of questions one of whose expected pages is among the first k results.

    results: query_id, rank, page_number; expected: query_id, pages (array).  Questions without results miss.
    """
    pages = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(F.col("page_number").cast("int")).alias("found"))
    rows = expected.join(pages, "query_id", "left").withColumn("hit", F.coalesce(F.arrays_overlap("pages", "found"), F.lit(False)).cast("int"))
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.round(F.avg("hit"), 6).alias("recall"))


def numbers_match(expected: Column, answer: Column, tolerance: float = 0.01) -> Column:
    """Whether each expected number has an answer number of its own within the tolerance; null if none is expected."""
    wanted, given = plain_numbers(expected), plain_numbers(answer)
    start = F.struct(given.alias("left"), F.lit(True).alias("ok"))

    def use(s: Column, x: Column) -> Column:
        at = F.array_position(F.transform(s["left"], lambda y: F.abs(y - x) <= tolerance), True).cast("int")
        rest = F.concat(F.slice(s["left"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(s["left"], at + 1, F.size(s["left"])))
        return F.struct(F.when(at > 0, rest).otherwise(s["left"]).alias("left"), (s["ok"] & (at > 0)).alias("ok"))

    return F.when(F.size(wanted) == 0, None).when(F.size(given) == 0, False).otherwise(F.aggregate(wanted, start, use)["ok"])


def text_match(expected: Column, answer: Column) -> Column:
    """Whether the answer holds the expected text, or all its parts between `;` or `|`; null if nothing is expected."""
    e, a = evaluation_text(expected), evaluation_text(answer)
    parts = F.filter(F.transform(F.split(e, "[;|]"), strip), lambda p: p != "")
    return F.when(e == "", None).otherwise(F.contains(a, e) | ((F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(a, p))))


def answer_match(expected: Column, answer: Column) -> Column:
    """Numbers or text match; null if nothing is expected."""
    right = F.coalesce(numbers_match(expected, answer), F.lit(False)) | F.coalesce(text_match(expected, answer), F.lit(False))
    return F.when(F.coalesce(expected, F.lit("")) == "", None).otherwise(right)


def page_match(found: Column, expected: Column) -> Column:
    return F.when(F.size(expected) <= 0, None).otherwise(F.coalesce(F.arrays_overlap(found, expected), F.lit(False)))


def answer_rates(rows: DataFrame) -> DataFrame:
    """(questions, grounded_rate, page_rate, answers, answer_rate, passed) of evaluated questions, one row, rates in percent.

    rows: pages, expected, answer, grounded, found (pages of the context).  Page and grounding rates are of all questions, the
    answer rate of those with an expected answer; a run passes if every page and every answer was found.
    """
    page = F.coalesce(page_match(F.coalesce("found", F.array().cast("array<int>")), F.col("pages")), F.lit(False))
    right, asked = F.coalesce(answer_match(F.col("expected"), F.col("answer")), F.lit(False)), F.coalesce("expected", F.lit("")) != ""
    n, m = F.count(F.lit(1)), F.sum(asked.cast("int"))
    rates = rows.agg(n.alias("questions"), F.sum(F.coalesce("grounded", F.lit(False)).cast("int")).alias("g"), F.sum(page.cast("int")).alias("p"), F.coalesce(m, F.lit(0)).alias("answers"), F.sum((asked & right).cast("int")).alias("a"))

    def share(part: str, whole: str):
        return F.round(F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0), 4)

    rates = rates.select("questions", share("g", "questions").alias("grounded_rate"), share("p", "questions").alias("page_rate"), "answers", share("a", "answers").alias("answer_rate"))
    return rates.withColumn("passed", (F.col("page_rate") == 100) & (F.col("answer_rate") == 100))
