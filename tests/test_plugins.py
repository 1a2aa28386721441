from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from vellumine.operators import agent, answers, pages, plugins, retrieval, state

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import this file
TEXT = "The total income of the company was 500.25 lakh in the year under review and the board approved it."


class Fixed:
    name = "fixed"

    def __init__(self, reply=""):
        self.reply = reply

    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def score(self, queries, texts):
        return [float(len(t)) for t in texts]

    def generate(self, queries, contexts):
        return [self.reply for _ in queries]

    def restore(self, text, alternate):
        if self.reply == "raise":
            raise ValueError("no model")
        return self.reply or text

    def read(self, content):
        if not content:
            raise ValueError("no pages")
        for n, part in enumerate(content.decode().split("|"), 1):
            yield {"page_number": n, "raw_text": part, "image_count": 0}


def test_encoder_and_reranker(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    got = {r.id: list(r.embedding) for r in plugins.encoded(rows, "text", Fixed(), "q: ").collect()}
    assert got == {1: [6.0, 1.0], 2: [3.0, 1.0]}
    pairs = spark.createDataFrame([(1, "a", "q", "s", "src", 3, "text")], "query_id int, id string, query string, section string, source string, page_number int, text string")
    shown = "Section: s\nSource: src\nPage: 3\nContent: text"
    assert plugins.rerank_scores(Fixed())(pairs).first().rerank_score == len(shown)


def test_read_pages_and_parse_them(spark):
    docs = spark.createDataFrame([("d", "a.pdf", bytearray(b"one  two|three")), ("e", "b.pdf", bytearray(b""))], "document_id string, filename string, content binary")
    read = plugins.read_pages(docs, Fixed())
    assert {(r.document_id, r.page_number, r.error) for r in read.collect()} == {("d", 1, None), ("d", 2, None), ("e", None, "no pages")}
    assert {(r.page_number, r.text, r.extraction_method) for r in pages.parsed_pages(read).collect()} == {(1, "one two", "native"), (2, "three", "native")}


def test_restoring_keeps_the_text_unless_the_candidate_is_safe(spark):
    bad = "tot4l inc0me of th3 comp4ny wa5 appr0ved by th3 b04rd a5 5tat3d in th3 r3p0rt of th3 y34r 2024"
    rows = spark.createDataFrame([("p", bad, "", 20.0, True)], "page_id string, text string, ocr_text string, ocr_confidence double, ocr_used boolean")
    good = "total income of the company was approved by the board as stated in the report of the year 2024"
    got = {k: pages.denoised_pages(rows, r).first() for k, r in (("none", None), ("good", Fixed(good)), ("numbers", Fixed(good + " 777")), ("raise", Fixed("raise")))}
    assert (got["good"].text, got["good"].denoised, got["good"].model) == (good, True, "fixed")
    assert not got["none"].denoised and got["none"].error and got["none"].text == bad
    assert not got["numbers"].denoised and got["numbers"].text == bad and "safety" in got["numbers"].error
    assert not got["raise"].denoised and got["raise"].error == "no model"


def context(spark, evidence=0.9):
    return spark.createDataFrame([(1, "c1", "What was the total income?", TEXT, "d", "s", 1, "General", evidence, evidence >= 0.65, evidence, 1)], "query_id int, id string, query string, text string, document_id string, source string, page_number int, section string, evidence double, exact boolean, relevance double, rank int")


def test_answers_that_do_not_hold_are_refused(spark):
    asked = spark.createDataFrame([(1, "What was the total income?"), (2, "Nothing")], "query_id int, query string")

    def said(reply, rows):
        by = plugins.answers_by(Fixed(reply), retrieval.context_text)
        return {r.query_id: (r.answer, r.error) for r in answers.generated(asked, rows, by).collect()}

    refused = (answers.REFUSAL, "Generation refused due to insufficient grounding.")
    good = "The total income of the company was 500.25 lakh"
    assert said(f"FINAL ANSWER: {good}", context(spark)) == {1: (good, None), 2: (answers.REFUSAL, "Missing retrieval evidence.")}
    assert said("", context(spark))[1] == refused
    assert said("The document does not provide enough information.", context(spark))[1] == refused
    assert said("The total income was 999.99 lakh", context(spark))[1] == refused
    assert said(good, context(spark, 0.0))[1] == refused


def test_agent_run(spark):
    asked = spark.createDataFrame([(1, "k", 2, "And what about the previous year?"), (2, None, 1, "What is 2 + 3?")], "query_id int, conversation_id string, turn int, query string")
    past = spark.createDataFrame([("k", 1, "What was the total income in FY 2023-24?")], "conversation_id string, turn int, content string")
    rows = {r.query_id: r for r in agent.run(asked, past, lambda q: context(spark).drop("query", "query_id").crossJoin(q)).collect()}
    assert rows[1].query == "What was the total income for FY 2022-23?" and rows[1].route == "calculator"  # the tested behaviour for fiscal years
    assert (rows[2].answer, rows[2].validated, rows[2].error) == ("5", True, None)


def test_status_transitions(spark):
    status = spark.createDataFrame([("a", "a.pdf", "a_a.pdf", "h", 3, "failed", 1, 2, "x", "t0", "t0"), ("b", "b.pdf", "", None, 3, "ready", 1, 2, None, "t0", "t0")], ", ".join(f"{c} {'int' if c.endswith('count') else 'bigint' if c == 'size_bytes' else 'string'}" for c in state.STATUS))
    now = F.expr("timestamp'2026-01-01 00:00:00'")
    changes = spark.createDataFrame([("a", "ready", None, 9, None), ("z", "failed", None, None, "bad")], "document_id string, status string, page_count int, chunk_count int, error string")
    rows = {r.document_id: r for r in state.updated(status, changes, now).collect()}
    assert (rows["a"].status, rows["a"].page_count, rows["a"].chunk_count, rows["a"].error, rows["a"].created_at) == ("ready", 1, 9, None, "t0")
    assert (rows["z"].status, rows["z"].filename, rows["z"].page_count, rows["z"].error) == ("failed", "", 0, "bad")
    assert rows["b"].updated_at == "t0" and len(rows) == 3
    again, outcomes = state.retried(status, spark.createDataFrame([("a",), ("b",), ("q",)], "document_id string"), status, now)
    assert {(r.document_id, r.outcome) for r in outcomes.collect()} == {("a", "processing"), ("b", "not failed"), ("q", "not found")}
    assert {r.document_id: r.status for r in again.collect()} == {"a": "processing", "b": "ready"}


def test_uploads(spark):
    status = spark.createDataFrame([], ", ".join(f"{c} {'int' if c.endswith('count') else 'bigint' if c == 'size_bytes' else 'string'}" for c in state.STATUS))
    files = spark.createDataFrame([(1, "a/b c.pdf", bytearray(b"%PDF-1")), (2, "x", bytearray(b"%PDF-1")), (3, "y.pdf", bytearray(b"zip")), (4, "", bytearray(b"%PDF-2")), (5, "n.pdf", None)], "upload_id int, filename string, content binary")
    rows = {r.upload_id: r for r in state.uploaded(status, files).collect()}
    assert (rows[1].duplicate, rows[2].duplicate, rows[1].document_id == rows[2].document_id) == (False, True, True)
    assert rows[1].storage_filename == f"{rows[1].document_id}_b c.pdf"
    assert [rows[k].error for k in (3, 4, 5)] == ["not a PDF", "no filename", "empty"]
