"""Numbers and named things in answers and evidence, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import SPACE, citation_text, col, let, strip, words

# The grammar of a number with its sign and unit, and the names looked for besides capitalised phrases.
NUMBER = f"(?iU)(?<![\\w.])(?:₹{SPACE}*)?\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?(?:{SPACE}*%|(?:{SPACE}*(?:lakhs?|crores?|million|billion)))?"
KNOWN_NAMES = (
    "cash and cash equivalents",
    "bank balance other than cash and cash equivalents",
    "provision for standard assets",
    "total income",
    "total expenditure",
    "total exposure to the top five npa accounts",
)


def number_strings(text: Column | str) -> Column:
    """Numbers as written, with rupee sign and unit."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(NUMBER), F.lit(0))


def bare_number(value: Column) -> Column:
    """A number string without sign, separators, percent and unit; amounts stay strings and are never scaled."""
    plain = F.regexp_replace(value, f"[₹,%]|{SPACE}", "")
    return F.regexp_replace(plain, "(?i)(lakhs?|crores?|million|billion)$", "")


def validator_number(value: Column) -> Column:
    """The validator's form: lower case, unit words removed wherever they stand, blanks at the ends only."""
    return strip(F.regexp_replace(F.translate(F.lower(value), "₹%,", ""), "lakhs|lakh|crores|crore|million|billion", ""))


def answer_numbers(answer: Column | str) -> Column:
    """Number strings of an answer without days (1 to 31) and years (1900 to 2100)."""

    def counts(v: Column) -> Column:
        d = bare_number(v).try_cast("double")
        whole = d == F.floor(d)
        return d.isNotNull() & ~(whole & (d.between(1, 31) | d.between(1900, 2100)))

    return F.transform(F.filter(number_strings(answer), counts), lambda x: F.trim(x))


def plain_numbers(text: Column | str) -> Column:
    """The evaluator's numbers: commas dropped, decimals read as doubles."""
    found = F.regexp_extract_all(F.replace(F.coalesce(col(text), F.lit("")), F.lit(","), F.lit("")), F.lit("\\p{Nd}+\\.\\p{Nd}+|\\p{Nd}+"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


# A run of two to eight capitalised ASCII words.
PHRASE = "\\b[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*){1,7}\\b"


def phrases(answer: Column | str) -> Column:
    """Distinct runs of two to eight capitalised ASCII words."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(answer), F.lit("")), F.lit(PHRASE), F.lit(0)))


def names(answer: Column | str) -> Column:
    """Known names in the answer, then its capitalised phrases, each once, in lower case."""
    known = let(citation_text(answer), lambda t: F.filter(words(*KNOWN_NAMES), lambda n: F.contains(t, n)))
    return F.array_distinct(F.concat(known, F.transform(F.filter(phrases(answer), lambda p: F.length(p) >= 4), citation_text)))


def matched_numbers(numbers: Column, plain: Column | str) -> Column:
    """Numbers whose bare form stands in a text (its citation_text) with separators removed (digits of neighbouring cells may join)."""
    flat = F.regexp_replace(col(plain), f"[₹,%]|{SPACE}", "")
    met = let(flat, lambda t: F.array_distinct(F.filter(numbers, lambda n: (bare_number(n) != "") & F.contains(t, bare_number(n)))))
    return F.when(F.size(numbers) == 0, F.array().cast("array<string>")).otherwise(met)


def matched_names(found: Column, plain: Column | str) -> Column:
    """Names that stand in a text (its citation_text)."""
    met = F.filter(found, lambda n: F.contains(col(plain), n))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(met)


# Names of the months, whole and short.
MONTHS = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"


def is_year(value: Column) -> Column:
    """A year of the last or this century, and nothing else."""
    return F.coalesce(strip(value).rlike("^(?:19|20)\\p{Nd}{2}$"), F.lit(False))


def is_date_like(value: Column) -> Column:
    """A day, a month's name and a year stand together, or the month's name first."""
    low = F.lower(value)
    day_first = f"\\b\\p{{Nd}}{{1,2}}(?:{SPACE}|[/-])+{MONTHS}(?:{SPACE}|[,/-])+\\p{{Nd}}{{4}}\\b"
    month_first = f"\\b{MONTHS}(?:{SPACE}|-)+\\p{{Nd}}{{1,2}}(?:{SPACE}|[,/-])+\\p{{Nd}}{{4}}\\b"
    return F.coalesce(low.rlike(day_first) | low.rlike(month_first), F.lit(False))


def is_numeric_line(line: Column) -> Column:
    """The line has a figure."""
    return F.coalesce(line.rlike("\\p{Nd}"), F.lit(False))
