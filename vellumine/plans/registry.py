"""Named queries over a data folder: one for each operator or step of the lifecycle.

Scores are rounded so that sums in another order compare equal.  Searches ask with every request, those of vectors and
`bm25_topk`, `text_vectors`, `hybrid_by_document` and `retrieval_recall` with the ids divisible by 20, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import numbers as N
from vellumine.functions import text as X
from vellumine.operators import agent, answers, chunking, evaluation, pages, plugins, retrieval, state
from vellumine.session import shared_folder, written
from vellumine.sources.files import index_rows
from vellumine.sources.tables import once, table
from vellumine.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _pages(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "pages"), "page_id")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "chunks"), "chunk_id")


def _requests(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "chat_requests"), "request_id")


def _responses(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "chat_responses"), "request_id")


def _answered(s: SparkSession, d: str) -> DataFrame:
    return _responses(s, d).select("request_id", "answer").join(_requests(s, d).select("request_id", "query"), "request_id")


def _asked(s: SparkSession, d: str) -> DataFrame:
    return _requests(s, d).select(F.col("request_id").alias("query_id"), "query", "document_id")


def _some_asked(s: SparkSession, d: str) -> DataFrame:
    return _asked(s, d).where("query_id % 20 = 0")


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select(F.col("chunk_id").alias("id"), "document_id", "source", "page_number", "section", "text")


def _joined(c: Column) -> Column:
    return F.array_join(c, " ")


# ---- text functions


@query
def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce(X.token_count("text"), F.lit(0)).alias("tokens"))


@query
def token_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.explode(X.tokenize("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))


@query
def normalized_forms(s: SparkSession, d: str) -> DataFrame:
    forms = {"retrieval": X.retrieval_text("answer"), "citation": X.citation_text("answer"), "rerank": X.rerank_text("answer"), "evaluation": X.evaluation_text("answer")}
    return _responses(s, d).where("answer is not null").select("request_id", *[v.alias(k) for k, v in forms.items()])


@query
def normalized_tokens(s: SparkSession, d: str) -> DataFrame:
    bare = F.filter(F.transform(X.tokenize("text"), X.normalize_token), lambda t: t != "")
    return _chunks(s, d).select("chunk_id", F.size(bare).alias("tokens"), F.size(F.array_distinct(bare)).alias("distinct_tokens"))


@query
def query_terms(s: SparkSession, d: str) -> DataFrame:
    return _requests(s, d).select("request_id", _joined(X.query_terms("query")).alias("terms"))


@query
def answer_terms(s: SparkSession, d: str) -> DataFrame:
    return _responses(s, d).where("answer is not null").select("request_id", _joined(X.answer_terms("answer")).alias("terms"))


@query
def query_overlap(s: SparkSession, d: str) -> DataFrame:
    return _answered(s, d).where("answer is not null").select("request_id", F.round(X.query_overlap("query", "answer"), 6).alias("overlap"))


@query
def phrase_overlap(s: SparkSession, d: str) -> DataFrame:
    return _answered(s, d).where("answer is not null").select("request_id", F.round(X.phrase_overlap(X.query_terms("query"), "answer"), 6).alias("overlap"))


@query
def token_disagreement(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", X.token_disagreement("text", "ocr_text").alias("disagreement"))


@query
def text_quality(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", F.round(X.text_quality("text"), 6).alias("quality"))


@query
def corruption_ratio(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", F.round(X.corruption_ratio("text"), 6).alias("ratio"))


@query
def detect_language(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", X.detect_language("text").alias("detected"))


@query
def should_scan(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", X.should_scan("raw_text", F.col("image_count")).alias("scan"))


@query
def choose_text(s: SparkSession, d: str) -> DataFrame:
    rows = _pages(s, d).withColumn("choice", X.choose_text("raw_text", "ocr_text"))
    return rows.select("page_id", "choice.method", F.round("choice.score", 6).alias("score"))


@query
def should_denoise(s: SparkSession, d: str) -> DataFrame:
    rows = _pages(s, d).withColumn("gate", X.should_denoise("text", "ocr_text", F.col("ocr_confidence"), F.col("ocr_used")))
    return rows.select("page_id", "gate.needs", F.round("gate.ratio", 6).alias("ratio"), "gate.disagreement")


@query
def valid_restoration(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", X.valid_restoration("raw_text", "text", "ocr_text").alias("valid"))


@query
def clean_scan(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).where("text is not null").select("page_id", F.md5(X.clean_scan("text")).alias("digest"))


@query
def clean_text(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).where("text is not null").select("page_id", F.md5(X.clean_text("text")).alias("digest"))


@query
def number_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of pages by what their figures are."""
    rows = chunking.page_lines(_pages(s, d)).where(N.is_numeric_line(F.col("line")))
    return rows.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("numeric"), F.sum(N.is_year(F.col("line")).cast("int")).alias("years"), F.sum(N.is_date_like(F.col("line")).cast("int")).alias("dates"))


@query
def clean_unicode(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", F.length(X.clean_text("text")).alias("characters"))


@query
def without_headers(s: SparkSession, d: str) -> DataFrame:
    known = ["For and on behalf of the Board", "This page is left blank on purpose."]
    return _pages(s, d).where("text is not null").select("page_id", F.md5(X.without_headers("text", known)).alias("digest"))


@query
def sanitize_filename(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_status").select("filename", X.sanitize_filename("filename").alias("safe")).distinct()


@query
def content_hash(s: SparkSession, d: str) -> DataFrame:
    hashed = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))


@query
def number_strings(s: SparkSession, d: str) -> DataFrame:
    return _responses(s, d).where("answer is not null").select("request_id", F.array_join(F.transform(N.number_strings("answer"), lambda x: F.trim(x)), "|").alias("numbers"))


@query
def answer_numbers(s: SparkSession, d: str) -> DataFrame:
    return _responses(s, d).where("answer is not null").select("request_id", F.array_join(F.transform(N.answer_numbers("answer"), N.bare_number), "|").alias("numbers"))


@query
def answer_names(s: SparkSession, d: str) -> DataFrame:
    return _responses(s, d).where("answer is not null").select("request_id", F.array_join(N.names("answer"), "|").alias("names"))


# ---- pages, sections, chunks


@query
def page_lines(s: SparkSession, d: str) -> DataFrame:
    lines = chunking.page_lines(_pages(s, d))
    return lines.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("line") != "").cast("int")).alias("filled"))


@query
def heading_lines(s: SparkSession, d: str) -> DataFrame:
    return chunking.page_lines(_pages(s, d)).where(chunking.is_heading(F.col("line"))).select("document_id", "page_number", "line_no", "line")


@query
def sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.sections(_pages(s, d)).select("document_id", "page_number", "section_index", "section", F.length("text").alias("characters"))


@query
def chunk_rows(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(_pages(s, d)).select("chunk_id", "document_id", "page_number", "section", "section_index", "chunk_index", F.length("text").alias("characters"))


@query
def chunk_statistics(s: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return _chunks(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("average"))


@query
def sentence_windows(s: SparkSession, d: str) -> DataFrame:
    parts = chunking.sentences(F.coalesce(F.col("text"), F.lit("")))
    return _chunks(s, d).select("chunk_id", F.size(parts).alias("parts"))


@query
def denoised_pages(s: SparkSession, d: str) -> DataFrame:
    """The gate of every page, and the text it ends with where no restorer is at hand."""
    return pages.denoised_pages(_pages(s, d)).select("page_id", "denoised", F.round("ratio", 6).alias("ratio"), "disagreement", "error", F.md5("text").alias("digest"))


@query
def parsed_pages(s: SparkSession, d: str) -> DataFrame:
    """Page rows made from the native and scanned texts, as far as their counts tell."""
    rows = pages.parsed_pages(_pages(s, d), ["For and on behalf of the Board", "This page is left blank on purpose."])
    return rows.select("document_id", "page_number", "language", "extraction_method", "ocr_used", "text_length", "raw_text_length", "denoised")


@query
def page_summary(s: SparkSession, d: str) -> DataFrame:
    return pages.page_summary(_pages(s, d))


@query
def extracted(s: SparkSession, d: str) -> DataFrame:
    return pages.extracted_pages(_pages(s, d)).select("page_id", "method", "used", "detected", "characters")


# ---- retrieval and ranking


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), v.select(F.col("vec_id").alias("id"), "embedding", "label")


@query
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.vector_topk(*_vectors(s, d))
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query
def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.vector_topk(*_vectors(s, d), k=5, same="label")
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _bm25(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = [F.coalesce(F.col(c), F.lit("Unknown" if c != "text" else "")) for c in ("section", "source", "text")]
    return retrieval.bm25_index(_corpus(s, d).select("id", F.concat_ws(" ", *named).alias("text")))


@query
def bm25_words(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d)[1].select("token", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.bm25_topk(_some_asked(s, d), *_bm25(s, d))
    return out.select("query_id", "id", F.round("bm25_score", 4).alias("score"), "rank")


def _ranked_vectors(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(*_vectors(s, d)).select("query_id", "id", "rank")


@query
def rank_fusion(s: SparkSession, d: str) -> DataFrame:
    """Vector ranks fused with the ranks of a second, label-filtered search."""
    other = retrieval.vector_topk(*_vectors(s, d), same="label").select("query_id", "id", "rank")
    out = retrieval.reciprocal_rank_fusion(_ranked_vectors(s, d), other)
    return out.select("query_id", "id", F.round("rrf_score", 9).alias("score"), "vector_rank", "bm25_rank", "rank")


@query
def merged_records(s: SparkSession, d: str) -> DataFrame:
    first = retrieval.vector_topk(*_vectors(s, d)).withColumnRenamed("rank", "vector_rank")
    second = retrieval.vector_topk(*_vectors(s, d), k=5, same="label").withColumnRenamed("rank", "bm25_rank")
    out = retrieval.merge_records(first, second)
    return out.select("query_id", "id", F.round("distance", 6).alias("distance"), "vector_rank", "bm25_rank")


@query
def evidence_rescue(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.evidence_rescue(q, _corpus(s, d)))
    return out.select("query_id", "id", F.round("evidence_rescue_score", 4).alias("score"), "rank")


@query
def hybrid_light(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.hybrid(q, _corpus(s, d)))
    return out.select("query_id", "id", F.round("evidence_rescue_score", 4).alias("rescue"), F.round("bm25_score", 4).alias("bm25"), "rank")


@query
def evidence_rescue_exact(s: SparkSession, d: str) -> DataFrame:
    """Evidence rescue by equal and contained words only."""
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.evidence_rescue(q, _corpus(s, d), fuzzy=False))
    return out.select("query_id", "id", F.round("evidence_rescue_score", 4).alias("score"), F.array_join("matches", "; ").alias("matches"), "rank")


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """search_rows with the stand-in encoder's vectors."""
    return retrieval.search_rows(_corpus(s, d), embedding=plugins.hashed_embedding(F.col("text")))


def _text_vectors(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Nearest chunks of every asked question by the stand-in encoder."""
    asked = asked.select("query_id", plugins.hashed_embedding(F.col("query")).alias("embedding"))
    return retrieval.vector_topk(asked, index)


@query
def text_vectors(s: SparkSession, d: str) -> DataFrame:
    index = _corpus(s, d).select("id", plugins.hashed_embedding(F.col("text")).alias("embedding"))
    return _text_vectors(_some_asked(s, d), index).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _shown(out: DataFrame) -> DataFrame:
    return out.select("query_id", "id", F.round("evidence_rescue_score", 4).alias("rescue"), F.round("rrf_score", 9).alias("rrf"), "vector_rank", "bm25_rank", F.array_join("matches", "; ").alias("matches"), "rank")


@query
def hybrid_fused(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the stand-in encoder fused with BM25, and evidence rescue."""
    rows = _embedded(s, d)
    return _shown(retrieval.once_each(_asked(s, d), lambda q: retrieval.hybrid(q, rows, _text_vectors(q, rows))))


@query
def hybrid_full(s: SparkSession, d: str) -> DataFrame:
    """As hybrid_fused, with rescue by equal and contained words only (which SQL can check)."""
    rows = _embedded(s, d)
    return _shown(retrieval.once_each(_asked(s, d), lambda q: retrieval.hybrid(q, rows, _text_vectors(q, rows), fuzzy=False)))


@query
def hybrid_by_document(s: SparkSession, d: str) -> DataFrame:
    """Questions asked of one document: its chunks only, by its own word statistics."""
    asked = _some_asked(s, d).where("document_id is not null")
    out = retrieval.hybrid(asked, _corpus(s, d), fuzzy=False, by="document_id")
    return out.select("query_id", "id", F.round("evidence_rescue_score", 4).alias("rescue"), F.round("bm25_score", 4).alias("bm25"), "rank")


@query
def dedupe_results(s: SparkSession, d: str) -> DataFrame:
    """The stored sources of every answer, each result once."""
    rows = _responses(s, d).select(F.col("request_id").alias("query_id"), F.posexplode("sources").alias("rank", "x")).select("query_id", "rank", F.col("x.chunk_id").alias("id"), "x.document_id", "x.source", "x.page_number", "x.section", F.lit("").alias("text"))
    return retrieval.deduplicate(rows).select("query_id", "rank", "id")


@query
def reranker_order(s: SparkSession, d: str) -> DataFrame:
    """The stored sources of every answer in the reranker's order, by its phrases alone, and the text it is shown."""
    rows = _evidence(s, d).withColumn("rerank_score", F.lit(0.0))
    shown = retrieval.reranker_text(F.col("section"), F.col("source"), F.col("page_number"), F.col("text"))
    out = retrieval.rerank_documents(rows.withColumn("shown", F.md5(shown)))
    return out.select("query_id", "id", F.round("combined_score", 6).alias("score"), "shown", "rank")


def _candidates(s: SparkSession, d: str, asked: DataFrame, fuzzy: bool = True) -> DataFrame:
    found = retrieval.hybrid(asked, _corpus(s, d), fuzzy=fuzzy).drop("rank")
    return plugins.bm25_scores(found.join(asked.select("query_id", "query"), "query_id").join(_corpus(s, d), "id"))


@query
def reranked(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.rerank(_candidates(s, d, q)))
    return out.select("query_id", "id", F.round("final_score", 4).alias("score"), "exact", "rank")


@query
def reranked_exact(s: SparkSession, d: str) -> DataFrame:
    """As reranked, with equal and contained words only (which SQL can check)."""
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.rerank(_candidates(s, d, q, fuzzy=False), fuzzy=False))
    return out.select("query_id", "id", F.round("final_score", 4).alias("score"), "exact", "rank")


def _context(s: SparkSession, d: str, asked: DataFrame, fuzzy: bool = True) -> DataFrame:
    return retrieval.retrieve_evidence(asked, _corpus(s, d), plugins.bm25_scores, fuzzy=fuzzy)


@query
def context_rows_exact(s: SparkSession, d: str) -> DataFrame:
    """As context_rows, with equal and contained words only (which SQL can check)."""
    out = retrieval.once_each(_asked(s, d), lambda q: _context(s, d, q, fuzzy=False))
    return out.select("query_id", "id", F.round("relevance", 6).alias("relevance"), "rank")


@query
def context_rows(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.once_each(_asked(s, d), lambda q: _context(s, d, q))
    return out.select("query_id", "id", F.round("relevance", 4).alias("relevance"), "rank")


@query
def context_text(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.context_text(_context(s, d, q)))
    return out.select("query_id", F.length("context").alias("characters"), "sources")


@query
def serialized_sources(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.once_each(_asked(s, d), lambda q: retrieval.serialized_sources(_context(s, d, q)))
    return out.select("query_id", "citation_id", "chunk_id", "document_id", "page_number", "section", "exact")


@query
def lexical_scores(s: SparkSession, d: str) -> DataFrame:
    rows = _responses(s, d).select("request_id", F.explode("sources").alias("x")).join(_requests(s, d).select("request_id", "query"), "request_id")
    rows = rows.select("request_id", "query", "x.chunk_id").distinct().join(_chunks(s, d).select("chunk_id", "section", "text"), "chunk_id")
    score = retrieval.lexical_score(F.col("query"), F.col("section"), F.col("text"))
    rows = rows.select(F.col("request_id").alias("query_id"), "chunk_id", score.alias("score"))
    return rows.select("query_id", "chunk_id", "score", F.round(retrieval.minmax("score"), 6).alias("norm"))


# ---- answers and the agent


def _evidence(s: SparkSession, d: str) -> DataFrame:
    rows = _responses(s, d).where("answer is not null").select("request_id", "answer", F.posexplode("sources").alias("n", "x")).groupBy("request_id", "answer", "x.chunk_id").agg(F.min("n").alias("rank"))
    rows = rows.join(_requests(s, d).select("request_id", "query"), "request_id").join(_chunks(s, d).select("chunk_id", "document_id", "source", "page_number", "section", "text"), "chunk_id")
    return rows.withColumnsRenamed({"request_id": "query_id", "chunk_id": "id"})


@query
def answer_support(s: SparkSession, d: str) -> DataFrame:
    out = answers.support(_evidence(s, d))
    return out.select("query_id", "id", F.size("numbers").alias("numbers"), F.size("named").alias("names"), F.round("support_score", 6).alias("score"))


@query
def built_citations(s: SparkSession, d: str) -> DataFrame:
    return answers.citations(_evidence(s, d)).select("query_id", "citation_id", "id", "page_number", "section", F.length("evidence").alias("characters"), F.round("support_score", 6).alias("score"))


@query
def citation_errors(s: SparkSession, d: str) -> DataFrame:
    """The stored citations checked against the stored chunks."""
    cited = once(table(s, d, "citations"), "cite_id").select(F.col("cite_id").alias("query_id"), "citation_id", F.col("chunk_id").alias("id"), "page_number", "evidence")
    known = _chunks(s, d).select(F.col("chunk_id").alias("id")).join(cited.select("query_id", "id"), "id")
    return answers.citation_errors(cited, known).select(F.col("query_id").alias("cite_id"), F.array_join("errors", "; ").alias("errors"))


@query
def formatted_citations(s: SparkSession, d: str) -> DataFrame:
    out = answers.cited_answers(_evidence(s, d))
    return out.select("query_id", F.length("citations").alias("characters"))


@query
def generic_citations(s: SparkSession, d: str) -> DataFrame:
    """The three generic citations of every answer, whether or not it has structured ones."""
    out = answers.generic_citations(_evidence(s, d))
    return out.select("query_id", "n", "id", "page_number", "section", F.length("evidence").alias("characters"), F.round("score", 6).alias("score"))


@query
def grounded_answers(s: SparkSession, d: str) -> DataFrame:
    rows = _evidence(s, d)
    return answers.grounding(rows.select("query_id", "answer").distinct(), rows.select("query_id", "text"))


@query
def extractive_answers(s: SparkSession, d: str) -> DataFrame:
    return retrieval.once_each(_asked(s, d), lambda q: answers.extractive_answer(_context(s, d, q)))


@query
def generated_answers(s: SparkSession, d: str) -> DataFrame:
    """Every asked question's answer, or the refusal and why."""
    return retrieval.once_each(_asked(s, d), lambda q: answers.generated(q, _context(s, d, q)))


@query
def asked_questions(s: SparkSession, d: str) -> DataFrame:
    """Every asked question's answer with its citations."""
    return retrieval.once_each(_asked(s, d), lambda q: answers.asked(q, _context(s, d, q)))


@query
def agent_run(s: SparkSession, d: str) -> DataFrame:
    """Every asked question through all steps of the agent."""
    turns = _turns(s, d)
    past = turns.select("conversation_id", F.col("request_id").alias("turn"), F.col("query").alias("content"))
    asked = _requests(s, d).select(F.col("request_id").alias("query_id"), "conversation_id", F.col("request_id").alias("turn"), "query")
    asked = written(agent.resolve(asked, past).select("query_id", F.col("resolved").alias("query")), "resolved")
    out = retrieval.once_each(asked, lambda q: agent.answered(q, lambda x: _context(s, d, x)))
    return out.select("query_id", "query", "intent", "route", "results", "answer", "error", "validated", F.array_join("errors", "; ").alias("errors"), F.length("citations").alias("cited"))


@query
def routes(s: SparkSession, d: str) -> DataFrame:
    return _requests(s, d).select("request_id", agent.route(F.col("query")).alias("route"), F.coalesce(agent.is_comparative(F.col("query")), F.lit(False)).alias("comparative"))


@query
def calculations(s: SparkSession, d: str) -> DataFrame:
    return agent.calculator(_requests(s, d).select(F.col("request_id").alias("query_id"), "query")).select("query_id", "answer", "error")


def _turns(s: SparkSession, d: str) -> DataFrame:
    asked = _requests(s, d).where("conversation_id is not null").select("request_id", "conversation_id", F.col("requested_at").alias("at"), "query")
    return asked.join(_responses(s, d).select("request_id", "answer"), "request_id", "left")


@query
def resolved_queries(s: SparkSession, d: str) -> DataFrame:
    turns = _turns(s, d).withColumn("turn", F.col("request_id"))
    past = turns.select("conversation_id", "turn", F.col("query").alias("content"))
    out = agent.resolve(turns.select(F.col("request_id").alias("query_id"), "conversation_id", "turn", "query"), past)
    return out.select("query_id", "resolved")


@query
def chat_history(s: SparkSession, d: str) -> DataFrame:
    out = agent.chat_history(_turns(s, d))
    return out.select("conversation_id", F.size("messages").alias("messages"), F.element_at("messages", 1)["content"].alias("first"))


@query
def validated_answers(s: SparkSession, d: str) -> DataFrame:
    answered = _answered(s, d).select(F.col("request_id").alias("query_id"), "answer", agent.route(F.col("query")).alias("route"))
    return agent.validate(answered, _evidence(s, d).select("query_id", "text")).select("query_id", "validated", F.array_join("errors", "; ").alias("errors"))


@query
def validated_answers_exact(s: SparkSession, d: str) -> DataFrame:
    """As validated_answers, with equal and contained words only (which SQL can check)."""
    answered = _answered(s, d).select(F.col("request_id").alias("query_id"), "answer", agent.route(F.col("query")).alias("route"))
    return agent.validate(answered, _evidence(s, d).select("query_id", "text"), fuzzy=False).select("query_id", "validated", F.array_join("errors", "; ").alias("errors"))


@query
def grounded_answers_exact(s: SparkSession, d: str) -> DataFrame:
    rows = _evidence(s, d)
    return answers.grounding(rows.select("query_id", "answer").distinct(), rows.select("query_id", "text"), fuzzy=False)


# ---- ingestion state


@query
def latest_status(s: SparkSession, d: str) -> DataFrame:
    return state.latest_status(table(s, d, "document_status")).select("document_id", "status", "page_count", "chunk_count")


@query
def document_listing(s: SparkSession, d: str) -> DataFrame:
    return state.listing(table(s, d, "document_status"), table(s, d, "pages"), table(s, d, "chunks"))


@query
def first_by_hash(s: SparkSession, d: str) -> DataFrame:
    status = table(s, d, "document_status")
    return state.find_by_hash(status, status.select("sha256"))


@query
def incremental_index(s: SparkSession, d: str) -> DataFrame:
    """Chunks no answer has cited yet, as rows to index."""
    cited = table(s, d, "citations").select("chunk_id")
    return index_rows(state.not_indexed(table(s, d, "chunks"), cited)).select("chunk_id", "source", "section", "page_number", "language")


@query
def deleted_documents(s: SparkSession, d: str) -> DataFrame:
    gone = state.latest_status(table(s, d, "document_status")).where("status = 'failed'")
    return state.without_documents(_chunks(s, d), gone).select("chunk_id", "document_id")


_NOW = "timestamp'2026-01-01 00:00:00'"


@query
def upload_outcomes(s: SparkSession, d: str) -> DataFrame:
    """The texts of `documents` uploaded as files: what is refused, known already, or begins."""
    files = table(s, d, "documents").select(F.col("doc_id").alias("upload_id"), F.concat_ws(" ", "source", "section").alias("filename"), F.encode(F.concat(F.when(F.col("text") != "", F.lit("%PDF-")).otherwise(F.lit("")), "text"), "utf-8").alias("content"))
    out = state.uploaded(state.latest_status(table(s, d, "document_status")), files)
    return out.select("upload_id", "filename", "sha256", "size_bytes", "status", "duplicate", "error")


@query
def status_updates(s: SparkSession, d: str) -> DataFrame:
    """The latest statuses after every document with pages has been counted anew."""
    counted = _pages(s, d).groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("page_count")).select("document_id", F.lit("ready").alias("status"), "page_count", F.lit(None).cast("int").alias("chunk_count"), F.lit(None).cast("string").alias("error"))
    out = state.updated(state.latest_status(table(s, d, "document_status")), counted, F.expr(_NOW))
    return out.select("document_id", "filename", "status", "page_count", "chunk_count", "error")


@query
def retry_outcomes(s: SparkSession, d: str) -> DataFrame:
    """What retrying every document would give, with the files of the documents that have chunks."""
    status = state.latest_status(table(s, d, "document_status"))
    stored = status.join(_chunks(s, d).select("document_id").distinct(), "document_id", "left_semi")
    return state.retried(status, _pages(s, d).select("document_id").unionByName(status.select("document_id")), stored, F.expr(_NOW))[1]


@query
def language_histogram(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("pages"))


@query
def scan_summary(s: SparkSession, d: str) -> DataFrame:
    confidence = F.coalesce(F.avg(F.when(F.col("ocr_confidence") >= 0, F.col("ocr_confidence"))), F.lit(-1.0))
    flags = [F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("ocr_used", "denoised")]
    return _pages(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), *flags, F.round(confidence, 4).alias("confidence"))


@query
def rate_limit_log(s: SparkSession, d: str) -> DataFrame:
    return state.rate_limit(_requests(s, d), "client", "requested_at", "request_id", limit=3, window=3600.0)


@query
def rate_limit_bound(s: SparkSession, d: str) -> DataFrame:
    return state.rate_limit_bound(_requests(s, d), "client", "requested_at", 3600).select("request_id", "recent")


# ---- evaluation


def _expected(s: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    """The pages that the stored answers of the asked questions were taken from."""
    rows = _responses(s, d).select(F.col("request_id").alias("query_id"), F.explode("sources").alias("x")).where("x.page_number is not null").join(asked.select("query_id"), "query_id")
    return rows.groupBy("query_id").agg(F.collect_set("x.page_number").alias("pages"))


def _paged(s: SparkSession, d: str, found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "rank").join(_corpus(s, d).select("id", "page_number"), "id")


@query
def retrieval_recall(s: SparkSession, d: str) -> DataFrame:
    """Recall of BM25 at 10: asked questions one of whose answer's pages is among those of the first ten chunks."""
    asked = _some_asked(s, d)
    return evaluation.recall_at_k(_paged(s, d, retrieval.bm25_topk(asked, *_bm25(s, d))), _expected(s, d, asked), 10)


@query
def retrieval_comparison(s: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of vectors, BM25 and their fusion with rescue."""
    asked, rows = _asked(s, d), _embedded(s, d)
    names = ["vector", "bm25", "hybrid"]

    def lists(q: DataFrame) -> DataFrame:
        vectors = _text_vectors(q, rows)
        ranked = written(retrieval.bm25_topk(q, *retrieval.bm25_index(rows)), "bm25-list")
        three = zip(names, (vectors, ranked, retrieval.hybrid(q, rows, vectors, fuzzy=False, ranked=ranked)), strict=True)
        parts = [found.select("query_id", "id", "rank").where("rank <= 10").withColumn("method", F.lit(name)) for name, found in three]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    found, expected = written(retrieval.once_each(asked, lists), "lists"), written(_expected(s, d, asked), "expected")
    parts = [evaluation.recall_at_k(_paged(s, d, found.where(F.col("method") == name)), expected, 10).withColumn("method", F.lit(name)) for name in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("method", "questions", "hits", "recall")


@query
def answer_rates(s: SparkSession, d: str) -> DataFrame:
    """Rates over the asked questions: grounded answers, expected pages in the context, answers that match the stored ones."""
    asked = _asked(s, d)

    def answered(q: DataFrame) -> DataFrame:
        context = _context(s, d, q)
        said = answers.generated(q, context).select("query_id", "answer")
        known = answers.grounding(said, context.select("query_id", "text"), **answers.STRICT).select("query_id", "grounded")
        found = context.groupBy("query_id").agg(F.collect_set(F.col("page_number").cast("int")).alias("found"))
        return said.join(known, "query_id", "left").join(found, "query_id", "left")

    expected = _expected(s, d, asked).join(_responses(s, d).select(F.col("request_id").alias("query_id"), F.col("answer").alias("expected")), "query_id", "left")
    return evaluation.answer_rates(expected.join(retrieval.once_each(asked, answered), "query_id"))


@query
def numbers_match(s: SparkSession, d: str) -> DataFrame:
    return _answered(s, d).select("request_id", evaluation.numbers_match(F.col("query"), F.col("answer")).cast("string").alias("match"))


@query
def answer_match(s: SparkSession, d: str) -> DataFrame:
    return _answered(s, d).where("query is not null").select("request_id", evaluation.text_match(F.col("query"), F.col("answer")).alias("text"), evaluation.answer_match(F.col("query"), F.col("answer")).alias("match"))


@query
def page_match(s: SparkSession, d: str) -> DataFrame:
    """Whether an answer's sources lie on a page that was scanned."""
    scanned = _pages(s, d).where("ocr_used").groupBy("document_id").agg(F.collect_set("page_number").alias("pages"))
    rows = _responses(s, d).select("request_id", "document_id", F.array_distinct(F.transform("sources", lambda x: x["page_number"])).alias("found"))
    return rows.join(scanned, "document_id").select("request_id", evaluation.page_match(F.col("found"), F.col("pages")).alias("match"))


# ---- streaming


@query
def stream_event_windows(s: SparkSession, d: str) -> DataFrame:
    out = flows.drained(flows.event_windows(flows.table_stream(s, d, "events"), "1 day", "365 days"), "complete")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    out = flows.drained(flows.sessions(flows.table_stream(s, d, "events"), "6 hours", "365 days"), "complete")
    return out.withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def stream_rate_limit(s: SparkSession, d: str) -> DataFrame:
    calls = flows.distinct_calls(flows.table_stream(s, d, "chat_requests").select("client", "request_id", F.col("requested_at").cast("timestamp").alias("requested_at")), "request_id", "requested_at", "3650 days")
    calls = calls.select(F.coalesce("client", F.lit("unknown")).alias("client"), F.col("request_id").alias("ident"), F.col("requested_at").cast("double").alias("at"), F.col("requested_at").alias("ts"))
    return flows.drained(flows.limited(calls, 3, 3600.0))


@query
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    root = f"{shared_folder(s)}/ingest-{uuid.uuid4().hex}"
    return flows.ingest(flows.table_stream(s, d, "pages"))(f"{root}/chunks", f"{root}/log").select("chunk_id", "document_id", "section", F.length("text").alias("characters"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid retrieval, reranking, context selection and the extractive answer of every asked question."""
    return extractive_answers(spark, folder)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
