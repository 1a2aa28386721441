"""Citations of an answer and the check that it is grounded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.fuzzy import pair_matches
from vellumine.functions.numbers import KNOWN_NAMES, answer_numbers, bare_number, matched_names, matched_numbers, names, number_strings
from vellumine.functions.text import SPACE, answer_terms, citation_text, collapse, let, normalize_token, phrase_overlap, query_overlap, query_terms, retrieval_text, strip, tokenize
from vellumine.operators.chunking import sentences
from vellumine.session import written

# Table rows whose figures follow on lines of their own, and rows that end a search for figures.
ROW_NAMES = ("total income", "total expenditure", *(n for n in KNOWN_NAMES if n not in ("total income", "total expenditure")))
ROW_ENDS = ("total expenditure", "profit / (loss) before tax from continuing operations, exceptional items and share of profit of equity accounted investees and income tax")
STRICT = {"threshold": 0.82, "least": 0.40}  # fixed values: grounding without a question
REFUSAL = "I could not find sufficiently relevant information in the document to answer this question."


def support(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, id, query, answer, text) with numbers and names the text confirms, `exact`, and support_score.

    The score is 1000 for each number, 100 for each name, 500 if there is any, and a thousandth of the query overlap.
    """
    rows = pairs.withColumn("wanted_numbers", answer_numbers("answer")).withColumn("wanted_names", names("answer"))
    rows = rows.withColumn("__plain", citation_text("text"))  # read by all three below
    rows = rows.withColumn("numbers", matched_numbers(F.col("wanted_numbers"), "__plain")).withColumn("named", matched_names(F.col("wanted_names"), "__plain"))
    n = F.size("numbers") + F.size("named")
    score = F.size("numbers") * 1000.0 + F.size("named") * 100.0 + F.when(n > 0, 500.0).otherwise(0.0) + 0.001 * query_overlap("query", "text", F.col("__plain"))
    return rows.withColumn("exact", n > 0).withColumn("support_score", F.round(score, 9)).drop("__plain")


def _text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\R"), strip), lambda x: x != "")


def with_evidence(rows: DataFrame, most: int = 1000) -> DataFrame:
    """rows (wanted_numbers, wanted_names, text) with `evidence`, what of the text is shown for the answer.

    The table row and its figures; else the lines around names; else the lines with numbers; else the text.  Worked out column
    by column, so that nothing is computed twice.
    """
    known = F.array(*[F.lit(x) for x in ROW_NAMES])
    rows = rows.withColumn("lines", _text_lines(F.col("text"))).withColumn("plain", F.transform("lines", lambda x: citation_text(x))).withColumn("bare", F.transform("wanted_numbers", lambda x: bare_number(x)))
    rows = rows.withColumn("row_names", F.array_intersect("wanted_names", known))
    # the longest name that some line holds, and its first line
    longest = F.transform(F.array_sort(F.transform("row_names", lambda e, i: F.struct((-F.size(F.split(e, " "))).alias("k"), i.alias("i"), e.alias("e")))), lambda x: x["e"])
    first = F.transform(longest, lambda e: F.array_position(F.transform("plain", lambda x: F.contains(x, e)), True))
    rows = rows.withColumn("at", F.get(F.filter(first, lambda k: k > 0), F.lit(0)).cast("int"))
    rows = rows.withColumn("label", F.try_element_at("lines", F.col("at"))).withColumn("entity", F.get(F.filter("row_names", lambda e: F.contains(citation_text("label"), e)), F.lit(0)))
    rows = rows.withColumn("after", F.slice("lines", F.col("at") + 1, F.size("lines")))
    rows = rows.withColumn("stop", F.array_position(F.transform("after", lambda x: citation_text(x).isin(*ROW_ENDS)), True).cast("int"))
    before = F.when(F.col("stop") > 0, F.slice("after", F.lit(1), F.col("stop") - 1)).otherwise(F.col("after"))
    figures = F.slice(F.filter(before, lambda x: x.rlike("^\\(?\\p{Nd}[\\p{Nd},]*(?:\\.\\p{Nd}+)?\\)?$") | (x == "-")), F.lit(1), F.lit(4))
    close = F.filter(F.slice("after", F.lit(1), F.lit(7)), lambda x: F.array_contains("bare", bare_number(x)))
    rows = rows.withColumn("figures", figures).withColumn("close", close)
    whole_row = F.col("entity").isin("total income", "total expenditure") & (F.size("figures") >= 4)
    parts = F.concat(F.array("label"), F.when(whole_row, F.col("figures")).otherwise(F.col("close")))
    table = F.when(F.col("at").isNotNull() & F.col("entity").isNotNull(), F.array_join(parts, " | "))
    rows = rows.withColumn("table", table).withColumn("holds", F.transform("plain", lambda x: F.exists("wanted_names", lambda e: F.contains(x, e))))

    def held(i: Column) -> Column:
        return F.coalesce(F.get("holds", i), F.lit(False))

    around = F.array_join(F.array_distinct(F.filter("lines", lambda _, i: held(i) | held(i + 1) | held(i - 1))), " | ")

    def has_number(x: Column) -> Column:
        return F.exists("bare", lambda b: (b != "") & F.contains(F.regexp_replace(x, f"[₹,%]|{SPACE}", ""), b))

    numbered = F.array_join(F.array_distinct(F.filter("lines", lambda x, i: has_number(F.get("plain", i)))), " | ")
    whole = strip(collapse(F.coalesce("text", F.lit(""))))
    shown = F.coalesce(F.nullif("table", F.lit("")), F.nullif(around, F.lit("")), F.nullif(numbered, F.lit("")), whole)
    return rows.withColumn("evidence", F.substring(shown, 1, most)).drop("lines", "plain", "bare", "row_names", "at", "label", "entity", "after", "stop", "figures", "close", "table", "holds")


def citations(pairs: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, citation_id, id, page_number, section, evidence, support_score): a greedy cover of the answer's numbers and names.

    pairs: query_id, id, query, answer, text, document_id, page_number, section.  Results go by support, ties by id.  A result
    of an already cited place only adds what it covers; one that confirms nothing new is passed over; the cover ends when
    everything is confirmed or `most` are cited.  The fold sees one query's results (a bounded list), inside the JVM.
    """
    exact = written(support(pairs).where("exact"), "support")
    place = F.concat_ws("\u0001", F.coalesce("document_id", F.lit("")), F.coalesce(F.col("page_number").cast("string"), F.lit("")), citation_text("section"))
    covers = F.array_distinct(F.concat(F.transform("numbers", lambda x: F.concat(F.lit("n"), x)), F.transform("named", lambda x: F.concat(F.lit("e"), x))))
    wants = F.array_distinct(F.concat(F.transform("wanted_numbers", lambda x: F.concat(F.lit("n"), x)), F.transform("wanted_names", lambda x: F.concat(F.lit("e"), x))))
    item = F.struct((-F.col("support_score")).alias("order"), F.col("id").alias("id"), place.alias("place"), covers.alias("covers"))
    folded = exact.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(wants).alias("wants"))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("cited"), texts.alias("places"), texts.alias("covered"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        again, news = F.array_contains(s["places"], x["place"]), F.size(F.array_except(x["covers"], s["covered"])) > 0
        take = ~again & (news | (F.size(s["cited"]) == 0))
        cited = F.when(take, F.concat(s["cited"], F.array(x["id"]))).otherwise(s["cited"])
        places = F.when(take, F.concat(s["places"], F.array(x["place"]))).otherwise(s["places"])
        covered = F.when(take | again, F.array_union(s["covered"], x["covers"])).otherwise(s["covered"])
        full = take & ((F.size(F.array_except(F.col("wants"), covered)) == 0) | (F.size(cited) >= most))
        return F.when(s["done"], s).otherwise(F.struct(cited.alias("cited"), places.alias("places"), covered.alias("covered"), full.alias("done")))

    chosen = folded.select("query_id", F.posexplode(F.aggregate("items", start, step)["cited"]).alias("n", "id"))
    out = chosen.join(exact, ["query_id", "id"])
    return with_evidence(out).select("query_id", F.format_string("C%d", F.col("n") + 1).alias("citation_id"), "id", "document_id", "page_number", F.coalesce("section", F.lit("")).alias("section"), "evidence", "support_score")


def citation_errors(cited: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, citation_id, errors) of the citations with an unknown or missing chunk, no page, or no evidence."""
    known = results.select("query_id", "id").distinct().withColumn("known", F.lit(True))
    rows = cited.join(known, ["query_id", "id"], "left")
    errors = F.filter(F.array(F.when(F.coalesce("id", F.lit("")) == "", "missing chunk_id").when(F.col("known").isNull(), "chunk_id not found in retrieved results"), F.when(F.col("page_number").isNull(), "missing page number"), F.when(strip(F.coalesce("evidence", F.lit(""))) == "", "missing evidence")), lambda e: e.isNotNull())
    return rows.select("query_id", "citation_id", errors.alias("errors")).where("size(errors) > 0")


def format_citations(cited: DataFrame) -> DataFrame:
    """(query_id, citations): `[C1] Page p, section — evidence` lines."""
    where = F.concat(F.lit("Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.when(F.col("section") != "", F.concat(F.lit(", "), F.col("section"))).otherwise(""))
    line = F.concat(F.lit("["), F.col("citation_id"), F.lit("] "), where, F.lit(" — "), F.col("evidence"))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("citations"))


def _windows(text: Column, most: int, size: int = 45) -> Column:
    """A text's sentences; overlapping runs of `size` words of one that is a single sentence longer than `most`."""
    def runs(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(size // 2)), lambda k: F.array_join(F.slice(words, k + 1, F.lit(size)), " "))

    return let(F.split(text, "(?<=[.!?])\\s+"), lambda parts: F.when((F.size(parts) == 1) & (F.length(text) > most), let(F.split(text, " "), runs)).otherwise(parts))


def generic_citations(pairs: DataFrame, most: int = 3, longest: int = 320, fuzzy: bool = True) -> DataFrame:
    """(query_id, n, id, source, page_number, section, score, evidence): the results that speak of the question's and answer's topic.

    pairs: query_id, id, query, answer, text, document_id, source, page_number, section, rank (the order of a query's results).
    Of a place only the first result counts.  The score weighs the shares of topic words that a result's text and section
    match (0.82), and its generic_relevance_score, lexical_norm, rerank_norm and rrf_score where pairs have them.  Evidence is
    the sentence that matches most of them (0.65).  Results with too few of the question's words, or without such a sentence,
    are left out; ties go by rank.
    """
    place = Window.partitionBy("query_id", F.coalesce("document_id", F.lit("")), "page_number", "section").orderBy("rank", "id")
    rows = pairs.withColumn("section", strip(F.coalesce("section", F.lit("")))).withColumn("k", F.row_number().over(place)).where("k = 1").drop("k")
    rows = rows.withColumn("text", strip(collapse(F.coalesce("text", F.lit(""))))).where("text != ''")
    rows = written(rows.withColumn("q", query_terms(F.coalesce("query", F.lit("")))).withColumn("a", F.array_distinct(answer_terms(F.coalesce("answer", F.lit(""))))).drop("query", "answer"), "generic")
    terms = [rows.select("query_id", F.lit(c).alias("kind"), F.explode(c).alias("term")) for c in ("q", "a")]
    terms = terms[0].unionByName(terms[1]).distinct()

    def tokens_of(part: Column) -> Column:
        return F.array_distinct(F.transform(tokenize(part), normalize_token))

    # terms meet the tokens of their own query's results; its few matches then go to the results
    known = rows.select("query_id", F.explode(tokens_of(F.concat_ws(" \n ", "text", "section"))).alias("token"))
    matched = terms.join(pair_matches(terms, known, "query_id", 0.65, fuzzy), ["query_id", "term"]).groupBy("query_id").agg(F.collect_list(F.struct("kind", "term", "token", "score")).alias("matched"))
    rows = rows.join(matched, "query_id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<struct<kind:string,term:string,token:string,score:double>>")))

    def shares(part: Column, least: float) -> Column:
        """struct(q, a): shares of the question's and the answer's words that the part matches."""

        def share(tokens: Column, c: str) -> Column:
            met = F.filter("matched", lambda m: (m["kind"] == c) & (m["score"] >= least) & F.array_contains(tokens, m["token"]))
            return F.when(F.size(c) > 0, F.size(F.array_distinct(F.transform(met, lambda m: m["term"]))) / F.size(c)).otherwise(0.0)

        return let(tokens_of(part), lambda tokens: F.struct(share(tokens, "q").alias("q"), share(tokens, "a").alias("a")))

    rows = rows.withColumn("in_text", shares(F.col("text"), 0.82)).withColumn("in_section", shares(F.col("section"), 0.82))

    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if c in pairs.columns else F.lit(0.0)

    for c in ("q", "a"):
        rows = rows.withColumn(f"{c}_section", F.col("in_section")[c]).withColumn(f"{c}_phrase", phrase_overlap(F.col(c), "text")).withColumn(f"{c}_support", F.greatest(F.col("in_text")[c], f"{c}_section", f"{c}_phrase"))
    score = 0.42 * F.col("q_support") + 0.28 * F.col("a_support") + 0.10 * F.col("q_phrase") + 0.08 * F.col("a_phrase") + 0.04 * F.col("q_section") + 0.02 * F.col("a_section")
    score = score + 0.03 * given("generic_relevance_score") + 0.015 * given("lexical_norm") + 0.01 * given("rerank_norm") + 0.005 * F.least(given("rrf_score") * 100, F.lit(1.0))
    rows = rows.where("(size(q) > 0 or size(a) > 0) and (size(q) = 0 or q_support >= 0.45)").withColumn("score", F.round(score, 9)).where("score > 0")
    sentence = rows.select("*", F.posexplode(_windows(F.col("text"), longest)).alias("k", "evidence")).drop("text")
    sentence = sentence.withColumn("phrase", phrase_overlap(F.col("q"), "evidence")).withColumn("in_part", shares(F.col("evidence"), 0.65)).drop("matched")
    sentence = sentence.withColumn("concept", F.greatest(F.col("in_part")["q"], "phrase")).where("size(q) = 0 or concept >= 0.35")
    value = F.round(0.60 * F.col("concept") + 0.30 * F.col("in_part")["a"] + 0.10 * F.col("phrase"), 9)
    best = sentence.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc(value), "k"))).where("r = 1")
    order = [F.desc("score"), *[F.desc(given(c)) for c in ("generic_relevance_score", "lexical_norm", "rerank_norm", "rrf_score")], F.asc("rank"), F.asc("id")]
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= most)
    cut = F.concat(F.regexp_replace(F.substring("evidence", 1, longest), " [^ ]*$", ""), F.lit("..."))
    return best.select("query_id", "n", "id", "source", "page_number", "section", "score", F.when(F.length("evidence") > longest, cut).otherwise(F.col("evidence")).alias("evidence"))


def format_generic_citations(cited: DataFrame) -> DataFrame:
    """(query_id, citations): `[C1] source | Page p | Section: s` lines, each with its evidence below."""
    source, page = F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown")), F.coalesce(F.col("page_number").cast("string"), F.lit("Unknown"))
    section = F.when(F.col("section").isin("", "Unknown"), "").otherwise(F.concat(F.lit(" | Section: "), F.col("section")))
    line = F.concat(F.format_string("[C%d] ", "n"), source, F.lit(" | Page "), page, section, F.lit("\n    Evidence: "), F.col("evidence"))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("citations"))


def cited_answers(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, citations): the structured citations where there are any and all are valid, else the generic ones.

    pairs: as for generic_citations.  Answers for which neither finds evidence have no row.
    """
    cited = written(citations(pairs, most), "cited")
    invalid = citation_errors(cited, pairs).select("query_id").distinct()
    valid = cited.join(invalid, "query_id", "left_anti")
    rest = pairs.join(valid.select("query_id").distinct(), "query_id", "left_anti")
    return format_citations(valid).unionByName(format_generic_citations(generic_citations(rest, most)))


def missing_numbers(answers: DataFrame, contexts: DataFrame, normal: Callable[[Column], Column] = bare_number) -> DataFrame:
    """(query_id) of the answers with a number that is none of their contexts' numbers, both in the form `normal` gives them."""
    numbers = contexts.select("query_id", F.explode(F.transform(number_strings("text"), normal)).alias("b")).distinct()
    wanted = answers.select("query_id", F.explode(F.array_distinct(F.transform(answer_numbers("answer"), normal))).alias("b"))
    return wanted.join(numbers, ["query_id", "b"], "left_anti").select("query_id").distinct()


def grounding(answers: DataFrame, contexts: DataFrame, threshold: float = 0.65, least: float = 0.25, fuzzy: bool = True) -> DataFrame:
    """(query_id, numbers_known, term_support, grounded) of answers (query_id, answer) in contexts (query_id, text), several a query.

    Grounded: every number of the answer is one of the contexts' numbers, and at least `least` of its distinct topic words
    match a context token with `threshold`.  Answers that are blank or without context are not grounded.  The defaults hold
    where the question is known; without it STRICT does.
    """
    rows = answers.where(strip(F.coalesce("answer", F.lit(""))) != "")
    text = contexts.select("query_id", retrieval_text(F.coalesce("text", F.lit(""))).alias("text")).where("text != ''")
    missing = missing_numbers(rows, text).withColumn("missing", F.lit(True))
    terms = rows.select("query_id", F.explode(F.array_distinct(answer_terms("answer"))).alias("term")).where("term != ''")
    tokens = text.select("query_id", F.explode(F.array_distinct(F.transform(tokenize("text"), normalize_token))).alias("token")).distinct()
    hits = pair_matches(terms, tokens, "query_id", threshold, fuzzy).select("query_id", "term").distinct()
    share = terms.withColumn("one", F.lit(1)).join(hits.withColumn("hit", F.lit(1)), ["query_id", "term"], "left").groupBy("query_id").agg((F.count("hit") / F.count("one")).alias("term_support"))
    out = rows.select("query_id").join(text.select("query_id").distinct().withColumn("context", F.lit(True)), "query_id", "left")
    out = out.join(missing, "query_id", "left").join(share, "query_id", "left")
    known, support_ = F.col("missing").isNull(), F.coalesce("term_support", F.lit(1.0))
    ok = F.coalesce(F.col("context"), F.lit(False)) & known & (support_ >= least)
    return out.select("query_id", known.alias("numbers_known"), F.round(support_, 6).alias("term_support"), ok.alias("grounded"))


def generated(queries: DataFrame, context: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None, fuzzy: bool = True) -> DataFrame:
    """(query_id, answer, error) of queries (query_id, query) over their context rows, as of context_filter; the refusal where an answer does not hold.

    generate: context rows to (query_id, answer), an extractive sentence unless given.  Refused are queries without context or
    without any evidence in it, and answers that are blank, decline, or are not grounded in the context.
    """
    scores = [F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in ("evidence", "lexical_score", "evidence_rescue_score") if c in context.columns]
    speaks = reduce(lambda a, b: a | b, scores, F.coalesce(F.col("exact"), F.lit(False))) | (F.coalesce(F.col("relevance"), F.lit(0.0)) >= 0.18)
    some = written(context.groupBy("query_id").agg(F.bool_or(speaks).alias("speaks")), "context-evidence")
    spoken = context.join(some.where("speaks"), "query_id", "left_semi")
    said = (generate or extractive_answer)(spoken).select("query_id", strip(F.regexp_replace(strip(F.coalesce("answer", F.lit(""))), f"(?i)^FINAL ANSWER:{SPACE}*", "")).alias("answer"))
    said = written(said, "generated")
    declined = (F.col("answer") == "") | (F.col("answer") == REFUSAL) | F.contains(retrieval_text("answer"), F.lit("does not provide enough information"))
    sound = grounding(said.where(~declined), spoken.select("query_id", "text"), fuzzy=fuzzy).where("grounded").select("query_id")
    kept = said.where(~declined).join(sound, "query_id", "left_semi")
    out = queries.select("query_id").join(some, "query_id", "left").join(kept, "query_id", "left")
    error = F.when(F.col("speaks").isNull(), "Missing retrieval evidence.").when(F.col("answer").isNull(), "Generation refused due to insufficient grounding.")
    return out.select("query_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), error.alias("error"))


def asked(queries: DataFrame, context: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None, fuzzy: bool = True) -> DataFrame:
    """(query_id, answer) of every query, followed by its citations; the refusal alone where there is no answer."""
    said = written(generated(queries, context, generate, fuzzy), "asked")
    held = said.where(F.col("answer") != REFUSAL).select("query_id", "answer").join(context.drop("answer"), "query_id")
    cited = cited_answers(held.drop("evidence"))
    text = F.concat_ws("\n\n", "answer", F.nullif("citations", F.lit("")))
    return said.join(cited, "query_id", "left").select("query_id", text.alias("answer"))


def extractive_answer(pairs: DataFrame) -> DataFrame:
    """(query_id, answer): the sentence that covers most of the query's terms; the refusal where none covers any.

    The offline stand-in for a language model.  pairs: query_id, id, query, text.
    """
    def scored(terms: Column) -> Column:
        """(score, -k, sentence) of each sentence; a text's terms are worked out once, not for each of its sentences."""
        n = F.size(terms)

        def score(sentence: Column) -> Column:
            has = F.transform(tokenize(F.translate(F.lower(sentence), "₹`", "")), normalize_token)  # the tokens of its retrieval_text, whose blanks no token holds
            return F.when(n > 0, F.size(F.array_intersect(terms, has)) / n).otherwise(0.0)

        return F.transform(sentences(F.coalesce(F.col("text"), F.lit(""))), lambda x, k: F.struct(score(x).alias("score"), (-k).alias("k"), x.alias("sentence")))

    # inline: what is below a Generate is worked out once, whatever is then asked of it
    best = F.array_max(let(query_terms("query"), scored))
    rows = pairs.select("query_id", "id", F.inline(F.array(best))).where("sentence is not null")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("n = 1")
    return best.select("query_id", F.when(F.col("score") > 0, F.col("sentence")).otherwise(REFUSAL).alias("answer"), F.round("score", 6).alias("score"))
