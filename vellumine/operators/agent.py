"""Steps of the question agent: resolving, routing, calculating, validating."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions.numbers import answer_numbers, validator_number
from vellumine.functions.text import any_of, strip
from vellumine.operators import answers
from vellumine.session import written

# What asks for arithmetic, by form, and the form of a flat expression (digits of any script).
ARITHMETIC = (
    r"\b(calculate|compute|solve|evaluate)\b",
    r"\b\p{Nd}+(?:\.\p{Nd}+)?\s*(?:%|percent)\b",
    r"\p{Nd}+(?:\.\p{Nd}+)?\s*[+\-*/^]\s*\p{Nd}+(?:\.\p{Nd}+)?",
    r"\b(?:add|subtract|multiply|divide)\b.*\p{Nd}",
    r"\bdifference between\b.*\p{Nd}.*\p{Nd}",
)
EXPRESSION = r"(?<![A-Za-z0-9_.])-?\p{Nd}+(?:\.\p{Nd}+)?(?:\s*[+\-*/^]\s*-?\p{Nd}+(?:\.\p{Nd}+)?)+(?![A-Za-z0-9_.])"
# What the steps say.
NO_EXPRESSION, NO_VALUE = "No supported arithmetic expression found.", "Unable to evaluate the calculation."
NO_ANSWER, NO_EVIDENCE, NOT_NUMERIC, NOT_GROUNDED = "Missing answer.", "Missing grounding evidence.", "Calculator answer is not numeric.", "Answer grounding validation failed."
INTENT = "general"
COMPARATIVE = ("between", "change", "changed", "increase", "decrease", "growth", "difference", "compared", "comparison")


def route(query: Column, intent: Column | None = None) -> Column:
    """`calculator` or `retrieval`.  Any digits, hyphen, digits count as arithmetic, fiscal years too: that is the tested behaviour."""
    low = F.lower(F.coalesce(query, F.lit("")))
    asked = any_of([low.rlike(p) for p in ARITHMETIC])
    if intent is not None:
        asked = asked | F.coalesce(intent.isin("calculation", "calculator"), F.lit(False))
    return F.when(asked, "calculator").otherwise("retrieval")


def is_comparative(query: Column) -> Column:
    return F.lower(query).rlike("|".join(COMPARATIVE))


def expression(query: Column) -> Column:
    """The first flat arithmetic expression (no parentheses); null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(query, F.lit("")), EXPRESSION, 0), F.lit(""))


_NUMBER = re.compile(r"(-?)\s*([0-9]+(?:\.[0-9]+)?)\s*")
_RANKS = (("*", "/"), ("+", "-"))  # after powers, which go first and from the right


def calculated(text: str | None) -> str | None:
    """The value of a flat expression to ten digits; null if it has none (division by zero, overflow, other digits).

    A sign belongs to the power it stands before: -2^2 is -4, and 2^-2^2 is 2^-4.
    """
    if text is None:
        return None
    signs, values, marks, at = [], [], [], 0
    while at < len(text):
        m = _NUMBER.match(text, at)
        if not m or (m[2].isdigit() and m[2][0] == "0" and m[2].strip("0")):  # no whole number begins with 0
            return None
        signs.append(-1.0 if m[1] else 1.0)
        values.append(m[2])
        at = m.end()
        if at < len(text):
            marks.append(text[at])
            at += 1
            at += len(text[at:]) - len(text[at:].lstrip())
    if len(marks) != len(values) - 1:
        return None
    try:
        numbers = [float(int(v)) if v.isdigit() else float(v) for v in values]
        for k in reversed(range(len(marks))):  # an exponent is what follows, with its sign
            if marks[k] == "^":
                numbers[k] = numbers[k] ** (signs[k + 1] * numbers[k + 1])
                del numbers[k + 1], signs[k + 1], marks[k]
        numbers = [s * n for s, n in zip(signs, numbers, strict=True)]
        for rank in _RANKS:
            k = 0
            while k < len(marks):
                if marks[k] in rank:
                    a, b = numbers[k], numbers[k + 1]
                    numbers[k : k + 2] = [a * b if marks[k] == "*" else a / b if marks[k] == "/" else a + b if marks[k] == "+" else a - b]
                    del marks[k]
                else:
                    k += 1
        return f"{numbers[0]:.10g}"
    except (ArithmeticError, ValueError, TypeError):
        return None


@F.pandas_udf(T.StringType())
def _calculate(texts: pd.Series) -> pd.Series:
    return texts.map(calculated)


def calculator(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with answer and error; only rows with an expression reach Python."""
    e = expression(F.col("query"))
    rows = queries.withColumn("expression", e)
    done = rows.where("expression is not null").withColumn("value", _calculate("expression"))
    some = done.select("query_id", "query", F.coalesce("value", F.lit("")).alias("answer"), F.when(F.col("value").isNull(), NO_VALUE).alias("error"))
    none = rows.where("expression is null").select("query_id", "query", F.lit("").alias("answer"), F.lit(NO_EXPRESSION).alias("error"))
    return some.unionByName(none)


def previous_year(query: Column) -> Column:
    """`FY 2022-23` for a text with `FY 2023-24` (or the bare years); null without."""
    years = F.coalesce(*[F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in (r"(?i)\bFY\s*(\d{4})[-/]\d{2}\b", r"\b(\d{4})[-/]\d{2}\b")]).cast("int")
    return F.when(years.isNotNull(), F.concat(F.lit("FY "), (years - 1).cast("string"), F.lit("-"), F.substring(years.cast("string"), -2, 2)))


def resolve(queries: DataFrame, history: DataFrame) -> DataFrame:
    """queries (query_id, conversation_id, turn, query) with `resolved`: follow-ups made to stand by themselves.

    history: conversation_id, turn, content of the user's turns.  The topic is the last earlier turn about total income or
    expenditure, else the last earlier turn; without one the query stays.
    """
    said = strip(F.coalesce("content", F.lit("")))
    past = history.where(said != "").select("conversation_id", F.col("turn").alias("at"), said.alias("content"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"))
    here = queries.select("conversation_id", F.col("turn").alias("at"), F.lit(None).cast("string").alias("content"), "query_id").where("conversation_id is not null")
    # one pass in turn order: questions stand before what is said at their own turn, so that only earlier turns count
    before = Window.partitionBy("conversation_id").orderBy("at", F.col("content").isNotNull(), "content").rowsBetween(Window.unboundedPreceding, -1)
    about = F.when(F.lower("content").rlike("total income|total expenditure"), F.col("content"))
    known = past.unionByName(here).withColumn("topic", F.coalesce(F.last(about, ignorenulls=True).over(before), F.last("content", ignorenulls=True).over(before)))
    rows = queries.join(known.where("query_id is not null").select("query_id", "topic"), "query_id", "left")
    low, topic = F.lower(strip(F.coalesce("query", F.lit("")))), F.lower(F.coalesce("topic", F.lit("")))
    year = previous_year(F.col("topic"))

    def of(subject: str, text: Column) -> Column:
        return F.when(topic.contains(f"total {subject}"), text)

    back = F.coalesce(*[of(s, F.concat(F.lit(f"What was the total {s} for "), year, F.lit("?"))) for s in ("income", "expenditure")], F.concat("topic", F.lit(" for "), year))
    change = F.coalesce(*[of(s, F.lit(f"What was the change in total {s} between FY 2023-24 and FY 2024-25?")) for s in ("income", "expenditure")])
    whole = F.coalesce(*[of(s, F.lit(f"What was the consolidated total {s} for FY 2024-25?")) for s in ("income", "expenditure")])
    resolved = F.coalesce(
        F.when(year.isNotNull() & low.rlike(r"\b(previous year|prior year|last year)\b"), back),
        F.when(low.rlike("how much did it (increase|decrease)"), change),
        F.when(low.rlike(r"\b(and|also|what about)\b") & low.contains("consolidated"), whole),
        F.col("query"),
    )
    return rows.withColumn("resolved", resolved).drop("topic")


def validated(answered: DataFrame) -> DataFrame:
    """answered (query_id, answer, route, results, grounded, numbers_known, numbers) with `validated` and `errors`.

    grounded: as of answers.grounding with STRICT; numbers_known: whether the results have all the answer's numbers, in the
    form of validator_number.
    """
    a = strip(F.coalesce("answer", F.lit("")))
    known = F.coalesce(F.col("grounded"), F.lit(False)) | (F.coalesce(F.col("numbers_known"), F.lit(False)) & (F.coalesce("numbers", F.lit(0)) > 0))
    error = (
        F.when(a == "", NO_ANSWER)
        .when(F.coalesce("results", F.lit(0)) == 0, NO_EVIDENCE)
        .when((F.col("route") == "calculator") & ~a.rlike(r"^-?\p{Nd}+(\.\p{Nd}+)?$"), NOT_NUMERIC)
        .when((F.col("route") != "calculator") & ~known, NOT_GROUNDED)
    )
    return answered.withColumn("validated", error.isNull()).withColumn("errors", F.when(error.isNotNull(), F.array(error)).otherwise(F.array().cast("array<string>")))


def validate(answered: DataFrame, results: DataFrame, fuzzy: bool = True) -> DataFrame:
    """answered (query_id, answer, route) with `validated` and `errors`, checked against results (query_id, text), several a query."""
    known = answers.grounding(answered.select("query_id", "answer"), results, **answers.STRICT, fuzzy=fuzzy).select("query_id", "grounded")
    missing = answers.missing_numbers(answered, results.select("query_id", F.coalesce("text", F.lit("")).alias("text")), validator_number)
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    base = answered.withColumn("numbers", F.size(answer_numbers("answer"))).join(counts, "query_id", "left").join(known, "query_id", "left")
    base = base.join(missing.withColumn("numbers_known", F.lit(False)), "query_id", "left").withColumn("numbers_known", F.coalesce("numbers_known", F.lit(True)))
    return validated(base)


def run(queries: DataFrame, history: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame] | None = None, fuzzy: bool = True) -> DataFrame:
    """Every question through the agent's steps: query_id, query (resolved), intent, route, results, answer, error, validated, errors, citations.

    queries: query_id, conversation_id, turn, query; history: conversation_id, turn, content.  retrieve: questions (query_id,
    query) to context rows; it runs for every question, as its results are what answers of either route are validated and
    cited by.  Questions with an arithmetic form go to the calculator, the others to generate (see answers.generated).
    """
    return answered(resolve(queries, history).select("query_id", F.col("resolved").alias("query")), retrieve, generate, fuzzy)


def answered(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame] | None = None, fuzzy: bool = True) -> DataFrame:
    """run's steps for questions (query_id, query) that are resolved."""
    asked = written(queries, "agent-queries")
    steps = asked.withColumn("intent", F.lit(INTENT)).withColumn("route", route(F.col("query"), F.col("intent")))
    context = written(retrieve(asked), "agent-context")
    worked = calculator(steps.where("route = 'calculator'")).select("query_id", "answer", "error")
    said = answers.generated(steps.where("route = 'retrieval'"), context, generate, fuzzy)
    said = written(steps.join(worked.unionByName(said), "query_id"), "agent-answers")
    checked = validate(said, context.select("query_id", "text"), fuzzy).select("query_id", "validated", "errors", F.coalesce("results", F.lit(0)).alias("results"))
    shown = said.where("answer != ''").select("query_id", "answer").join(context.drop("answer"), "query_id")
    cited = answers.cited_answers(shown.drop("evidence"))
    return said.join(checked, "query_id").join(cited, "query_id", "left").withColumn("citations", F.coalesce("citations", F.lit("")))


def chat_history(turns: DataFrame) -> DataFrame:
    """(conversation_id, messages): each conversation's messages in order, from (conversation_id, at, request_id, query, answer).

    A request gives a user message and, where it was answered, the assistant's.  Conversations without an id have no memory.
    """
    rows = turns.where("conversation_id is not null")
    said = F.filter(F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")), F.when(F.col("answer").isNotNull(), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))), lambda m: m.isNotNull())
    each = rows.select("conversation_id", F.struct("at", "request_id", said.alias("said")).alias("m"))
    return each.groupBy("conversation_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["said"])).alias("messages"))


def last_turn(turns: DataFrame) -> DataFrame:
    """Each conversation's last request."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("at"), F.desc("request_id"))
    return turns.where("conversation_id is not null").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
