"""Text functions as Columns: all run inside the JVM.

Patterns spell out what they mean by space and digit, so that every engine reads them alike.  A null text gives null unless
a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The grammar of a token (a number with at most one decimal group, or a word with marks and inner hyphens).
TOKEN = r"\p{N}+(?:[.,]\p{N}+)?|\p{L}[\p{L}\p{M}]*(?:[-’'][\p{L}\p{M}]+)*"
# White space.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACES}]"
# Words that carry no topic, units of money, and words a topic word brings along.
STOPWORDS = (
    "what was were the is are as of in on for to and a an at by from with who which how much many did do does this that these those "
    "year date march 31 2025 2024 fy between happened company companies reported report say said"
).split()
UNITS = ("lakh", "lakhs", "crore", "crores", "million", "billion")
EXPANSIONS = {
    "types": ("kind", "category", "classification"),
    "type": ("kind", "category", "classification"),
    "difference": ("different", "comparison"),
    "differences": ("different", "comparison"),
}
# Words that tell Marathi from Hindi, letters only Marathi has.
MARATHI_HINTS = "आहे आणि मध्ये म्हणून करण्यासाठी यांच्या तसेच होते असलेले महाराष्ट्र आपण त्यामुळे यामुळे करण्यात झालेले असून यांना".split()
HINDI_HINTS = "है और में के की का था थी थे होता होती यह से लिए तथा लेकिन द्वारा करने किया गया गई".split()
MARATHI_LETTERS = "ळऴॲऑ"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column | str) -> Column:
    """Without white space at either end (trim knows blanks only by itself)."""
    return F.btrim(col(text), F.lit(SPACES))


def collapse(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"{SPACE}+", " ")


def tokenize(text: Column | str) -> Column:
    """Lower-case tokens of a text."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0)), F.lower)


def token_count(text: Column | str) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(col(text), F.lit(TOKEN))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def normalize_unicode(text: Column | str) -> Column:
    """Compatibility composition (in Python, only for texts beyond ASCII and Devanagari), zero-width characters dropped; null gives ''."""
    t = F.coalesce(col(text), F.lit(""))
    composed = F.when(t.rlike("[^\\x00-\\x7f\\u0900-\\u097f]"), _nfkc(t)).otherwise(t)
    return F.translate(composed, ZERO_WIDTH, "")


def retrieval_text(text: Column | str) -> Column:
    """The retrieval index's form: lower case, no rupee sign or backtick, single blanks."""
    return strip(collapse(F.translate(F.lower(col(text)), "₹`", "")))


def citation_text(text: Column | str) -> Column:
    """The citation matcher's form: single blanks, lower case."""
    return strip(F.lower(collapse(F.coalesce(col(text), F.lit("")))))


def rerank_text(text: Column | str) -> Column:
    """The reranker's form: lower case, single blanks."""
    return strip(collapse(F.lower(col(text))))


def evaluation_text(text: Column | str) -> Column:
    """The evaluator's form: no currency marks, units in the singular."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    for mark in ("₹", "rs.", "rs "):
        t = F.replace(t, F.lit(mark), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, "\\blakhs\\b", "lakh"), "\\bcrores\\b", "crore")
    return strip(collapse(t))


def normalize_token(token: Column) -> Column:
    """Lower case without trailing digits (`abc12` -> `abc`, `2024` -> empty)."""
    return F.regexp_replace(F.lower(token), "\\p{Nd}+$", "")


def topic_tokens(text: Column | str, without: list[str]) -> Column:
    kept = F.filter(tokenize(text), lambda t: t.rlike("^\\p{L}+$") & (F.length(t) >= 3) & ~F.array_contains(words(*without), t))
    return F.transform(kept, normalize_token)


def query_terms(query: Column | str) -> Column:
    """Distinct topic words of a question in order, then the words they bring along.  Words with marks or hyphens don't count."""
    base = F.array_distinct(topic_tokens(query, STOPWORDS))
    more = [F.when(F.array_contains(base, k), words(*v)).otherwise(F.array().cast("array<string>")) for k, v in EXPANSIONS.items()]
    return F.array_distinct(F.concat(base, *more))


def answer_terms(answer: Column | str) -> Column:
    """Topic words of an answer, repeats kept, units of money left out."""
    return topic_tokens(answer, [*STOPWORDS, *UNITS])


def query_overlap(query: Column | str, text: Column | str, plain: Column | None = None) -> Column:
    """Share of the question's ASCII words (three letters or more) that the text has; 0 for a question without any.

    `plain`: the text's citation_text, where it is at hand.
    """
    q, t = (F.array_distinct(F.regexp_extract_all(c, F.lit("\\b[a-zA-Z]{3,}\\b"), F.lit(0))) for c in (citation_text(query), citation_text(text) if plain is None else plain))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def phrase_overlap(terms: Column, text: Column | str) -> Column:
    """Share of distinct terms that have five letters or more and stand anywhere in the text; 0 without terms."""
    def share(p: Column) -> Column:
        held = F.filter(p["known"], lambda x: (F.length(x) >= 5) & F.contains(p["t"], x))
        return F.when(F.size(p["known"]) == 0, 0.0).otherwise(F.size(held) / F.size(p["known"]))

    return let(F.struct(F.array_distinct(terms).alias("known"), retrieval_text(text).alias("t")), share)


def clean_text(text: Column | str) -> Column:
    """A parsed page's text: composed, runs of blanks as one, at most one blank line."""
    return strip(F.regexp_replace(F.regexp_replace(normalize_unicode(text), "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def clean_scan(text: Column | str) -> Column:
    """A scanned page's text: as clean_text, form feeds dropped, not composed; null gives ''."""
    t = F.replace(F.coalesce(col(text), F.lit("")), F.lit("\x0c"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def without_headers(text: Column | str, headers: list[str]) -> Column:
    """Without the lines that, stripped, are known headers; the text as it is if none are known."""
    if not headers:
        return col(text)
    return F.array_join(F.filter(F.split(col(text), "\n", -1), lambda line: ~F.array_contains(words(*headers), strip(line))), "\n")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_language(text: Column | str) -> Column:
    """eng, hin, mar, mixed or unknown by script and hint words; other Latin languages count as eng."""

    def counted(t: Column) -> Column:
        tokens = F.array_distinct(F.regexp_extract_all(t, F.lit("[\\x{900}-\\x{97F}]+"), F.lit(0)))
        hints = [F.size(F.array_intersect(tokens, words(*known))).alias(code) for code, known in (("mar", MARATHI_HINTS), ("hin", HINDI_HINTS))]
        return F.struct(_count(t, "[\\x{900}-\\x{97F}]").alias("dev"), _count(t, "\\p{IsLatin}").alias("lat"), F.greatest(F.lit(1), _count(t, "\\p{L}")).alias("all"), *hints, t.rlike(f"[{MARATHI_LETTERS}]").alias("own"), (strip(t) == "").alias("blank"))

    def decide(c: Column) -> Column:
        devanagari = F.when(c["mar"] > c["hin"], "mar").when(c["hin"] > c["mar"], "hin").when(c["own"], "mar").otherwise("hin")
        dev, lat = c["dev"] / c["all"], c["lat"] / c["all"]
        shares = F.when((dev < 0.15) & (lat >= 0.5), "eng").when(dev >= 0.5, devanagari).when((c["dev"] > 0) & (c["lat"] > 0), "mixed").otherwise("unknown")
        return F.when(c["blank"], "unknown").otherwise(shares)

    return let(let(normalize_unicode(text), counted), decide)


def text_quality(text: Column | str) -> Column:
    """0 to 1: letters, word density, presence of words, less replacement characters; 0 for an empty text."""

    def counted(t: Column) -> Column:
        return F.struct(F.length(t).alias("chars"), _count(t, "\\p{L}").alias("letters"), _count(t, "[A-Za-z\\x{900}-\\x{97F}]{2,}").alias("found"), _count(t, "[\\x{FFFD}\\x{FFFE}]").alias("bad"))

    def score(c: Column) -> Column:
        density = F.least(F.lit(1.0), c["found"] / F.greatest(F.lit(1.0), c["chars"] / 6))
        total = 0.35 * c["letters"] / c["chars"] + 0.35 * density + F.when(c["found"] > 0, 0.30).otherwise(0.0) - 0.70 * c["bad"] / c["chars"]
        return F.when(c["chars"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), total))

    return let(let(clean_scan(text), counted), score)


def should_scan(text: Column | str, images: Column, min_chars: int = 80, image_chars: int = 900, min_score: float = 0.42) -> Column:
    """Whether a page needs optical recognition: little text, or images with a poor text."""
    t = strip(collapse(F.coalesce(col(text), F.lit(""))))
    poor = (F.length(t) < image_chars) | (text_quality(t) < min_score)
    return (F.length(t) < min_chars) | ((F.coalesce(images, F.lit(0)) > 0) & poor)


def choose_text(raw: Column | str, scanned: Column | str) -> Column:
    """struct(text, method, score) of the better of a page's native and scanned texts; a scan must be better by 0.06."""
    r, s = col(raw), col(scanned)
    rn, sn = (F.length(strip(F.coalesce(x, F.lit("")))) for x in (r, s))

    def pick(q: Column) -> Column:
        def picked(text: Column, method: str, score: Column) -> Column:
            return F.struct(text.alias("text"), F.lit(method).alias("method"), score.alias("score"))

        both, native = picked(s, "native+scan", q["s"]), picked(r, "native", q["r"])
        choice = F.when(F.coalesce(r, F.lit("")) == "", picked(s, "scan", q["s"])).when(F.coalesce(s, F.lit("")) == "", native)
        return choice.when(q["s"] >= q["r"] + 0.06, both).when((rn < 80) & (sn > rn), both).otherwise(native)

    return let(F.struct(text_quality(r).alias("r"), text_quality(s).alias("s")), pick)


def corruption_ratio(text: Column | str) -> Column:
    """Suspicious tokens by tokens, at most 1: digits among letters, runs of marks, control characters, stray single characters."""
    tokens = F.filter(F.split(F.coalesce(col(text), F.lit("")), f"{SPACE}+"), lambda t: t != "")

    def weight(t: Column) -> Column:
        among = F.when(t.rlike("[A-Za-z]\\p{Nd}[A-Za-z]|\\p{Nd}[A-Za-z]\\p{Nd}"), 1.0).otherwise(0.0)
        marks = F.when(t.rlike("[|_=~^]{2,}"), 1.0).otherwise(0.0)
        control = F.when(t.rlike("[\\x00-\\x1f\\x7f]"), 0.5).otherwise(0.0)
        single = F.when((F.length(t) == 1) & ~t.rlike("^[aAiI\\p{Nd}]$"), 0.5).otherwise(0.0)
        return among + marks + control + single

    # one look at every token; the few that have something are weighed
    suspect = "[A-Za-z]\\p{Nd}|\\p{Nd}[A-Za-z]|[|_=~^]{2}|[\\x00-\\x1f\\x7f]|^.$"

    def share(found: Column) -> Column:
        bad = F.aggregate(F.filter(found, lambda t: t.rlike(suspect)), F.lit(0.0), lambda s, t: s + weight(t))
        return F.when(F.size(found) == 0, 0.0).otherwise(F.least(F.lit(1.0), bad / F.size(found)))

    return let(tokens, share)


def token_disagreement(a: Column | str, b: Column | str) -> Column:
    """1 - Jaccard of the lower-case token sets (two characters or more), to 3 places; 0 if either is empty."""

    def tokens(c: Column | str) -> Column:
        found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z0-9\\x{80}-\\x{FFFF}]+"), F.lit(0))
        return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 1), F.lower))

    def apart(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.round(1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 3))

    return let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), apart)


def should_denoise(text: Column | str, scanned: Column | str, confidence: Column, used: Column, min_chars: int = 80, worst: float = 55.0, corrupt: float = 0.08, apart: float = 0.45) -> Column:
    """struct(needs, ratio, disagreement): whether a page's text should be restored; short texts never."""
    t, s = strip(F.coalesce(col(text), F.lit(""))), F.coalesce(col(scanned), F.lit(""))
    low = F.coalesce((confidence >= 0) & (confidence < worst), F.lit(False))

    def gate(m: Column) -> Column:
        doubt = F.coalesce(used & (m["split"] >= apart) & (confidence < worst + 10), F.lit(False))
        return F.struct(((m["ratio"] >= corrupt) | low | doubt).alias("needs"), m["ratio"].alias("ratio"), m["split"].alias("disagreement"))

    short = F.struct(F.lit(False).alias("needs"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("disagreement"))
    measures = F.struct(corruption_ratio(t).alias("ratio"), token_disagreement(t, s).alias("split"))
    return F.when(F.length(t) >= min_chars, let(measures, gate)).otherwise(short)


def digit_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("(?<![A-Za-z])\\d+(?:[.,:/-]\\d+)*(?![A-Za-z])"), F.lit(0))


def valid_restoration(source: Column | str, candidate: Column | str, alternate: Column | str) -> Column:
    """Whether a restored text may replace its source: like length and lines, no new numbers, no chatter."""
    s, c = (strip(F.coalesce(col(x), F.lit(""))) for x in (source, candidate))
    fits = (F.length(c) >= F.greatest(F.lit(20), F.floor(F.length(s) * 0.45))) & (F.length(c) <= F.floor(F.length(s) * 1.8))
    known = F.size(F.array_except(digit_tokens(c), F.array_union(digit_tokens(s), digit_tokens(alternate)))) == 0
    sl, cl = (F.size(F.filter(F.split(x, "\\R"), lambda line: strip(line) != "")) for x in (s, c))
    whole = (sl < 4) | (cl >= F.greatest(F.lit(2), F.floor(sl * 0.5)))
    chatter = F.lower(c).rlike("^(here is|here's|sure,|the corrected text)")
    return (s != "") & (c != "") & fits & known & whole & ~chatter


def sanitize_filename(name: Column | str) -> Column:
    """A safe name ending in .pdf, at most 180 characters; null or empty gives document.pdf."""
    base = strip(F.element_at(F.split(F.replace(F.coalesce(col(name), F.lit("")), F.lit("\\"), F.lit("/")), "/", -1), -1))
    safe = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._()\\- ]+", "_"), " +", " ")
    safe = F.when(safe == "", "document.pdf").otherwise(safe)
    return F.substring(F.when(F.lower(safe).endswith(".pdf"), safe).otherwise(F.concat(safe, F.lit(".pdf"))), 1, 180)


def upload_error(content: Column, most: int = 25 * 1024 * 1024) -> Column:
    """Why an uploaded file's bytes are not taken; null if they are."""
    size = F.coalesce(F.length(content), F.lit(0))
    return F.when(size == 0, "empty").when(size > most, "too large").when(F.hex(F.substring(content, 1, 5)) != "255044462D", "not a PDF")


def display_filename(name: Column | str) -> Column:
    """A stored name as shown: without its hash prefix, blanks for underscores."""
    return F.replace(F.regexp_replace(col(name), "^[0-9a-fA-F]{24,64}[_-]", ""), F.lit("_"), F.lit(" "))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
