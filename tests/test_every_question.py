"""Queries that ask of all texts do so with every question of the table, whatever its id."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellumine.operators import retrieval
from vellumine.plans import oracles, registry

LEASE, INCOME = "what were the lease obligations", "what was the total income of the boiler plant"
REQUESTS = [(1, LEASE), (7, INCOME), (20, LEASE), (21, None), (23, LEASE)]
CHUNKS = [
    ("a", "d1", 3, "Leases", "The lease obligations were 40 lakh. They fell."),
    ("b", "d1", 4, "Income", "The total income of the boiler plant was 75 lakh. It rose."),
    ("c", "d2", 5, "Notes", "Nothing else is known of the cooling tower."),
]
FOUND = {1, 7, 20, 23}  # the blank question finds nothing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("every"))
    times = "timestamp'2025-01-01 00:00:00'"
    requests = spark.createDataFrame(REQUESTS, "request_id long, query string")
    requests.selectExpr("*", "'d1' as document_id", "cast(null as string) as conversation_id", "'x' as client", f"{times} as requested_at").coalesce(1).write.parquet(f"{d}/chat_requests.parquet")
    spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, page_number int, section string, text string").selectExpr("*", "'s' as source").coalesce(1).write.parquet(f"{d}/chunks.parquet")
    sources = "array<struct<chunk_id:string,document_id:string,source:string,page_number:int,section:string>>"
    said = [(i, "40 lakh", [("a", "d1", "s", 3, "Leases")]) for i, q in REQUESTS if q]
    spark.createDataFrame(said, f"request_id long, answer string, sources {sources}").selectExpr("*", "'d1' as document_id").coalesce(1).write.parquet(f"{d}/chat_responses.parquet")
    return d


def asked(spark, folder, name):
    rows = registry.queries()[name](spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(tuple(v for c, v in sorted(r.asDict().items()) if c != "query_id"))
    assert sorted(by.get(1, []), key=str) == sorted(by.get(20, []), key=str) == sorted(by.get(23, []), key=str)  # equal texts, equal rows
    return set(by)


@pytest.mark.parametrize("name", ["evidence_rescue_exact", "evidence_rescue", "hybrid_light", "hybrid_full", "hybrid_fused", "reranked_exact", "reranked", "context_rows_exact", "context_rows", "context_text", "serialized_sources", "extractive_answers"])
def test_every_question_is_asked(spark, folder, name):
    assert asked(spark, folder, name) == FOUND


@pytest.mark.parametrize("name", ["generated_answers", "asked_questions", "agent_run"])
def test_every_question_is_answered(spark, folder, name):
    assert asked(spark, folder, name) == FOUND | {21}


@pytest.mark.parametrize("name", ["answer_rates", "retrieval_comparison"])
def test_every_question_is_rated(spark, folder, name):
    assert {r["questions"] for r in registry.queries()[name](spark, folder).collect()} == {4}


@pytest.mark.parametrize("name", ["evidence_rescue_exact", "hybrid_full", "reranked_exact", "context_rows_exact", "retrieval_comparison"])
def test_sql_asks_every_question(name):
    assert "request_id %" not in oracles.sql()[name]


def test_blank_and_equal_questions_are_asked_once(spark):
    asked = spark.createDataFrame(REQUESTS, "query_id long, query string")
    seen = []

    def find(questions):
        seen.extend(r.query for r in questions.collect())
        return questions.selectExpr("query_id", "coalesce(query, 'none') as said")

    rows = retrieval.once_each(asked, find).collect()
    assert sorted(seen, key=str) == sorted({q for _, q in REQUESTS}, key=str)
    assert sorted(map(tuple, rows)) == [(i, q or "none") for i, q in REQUESTS]


def test_shares_are_shown_by_their_binary_value(spark):
    values = sorted({k / n for n in (3, 7, 8, 16, 40, 200) for k in range(n + 1)})
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", retrieval._two_digits(F.col("v")).alias("shown")).collect()
    assert {r.v: r.shown for r in got} == {v: f"{v:.2f}" for v in values}


def test_five_of_eight_terms(spark):
    asked = spark.createDataFrame([(1, "alpha bravo charlie delta echo foxtrot golf hotel")], "query_id long, query string")
    chunks = spark.createDataFrame([("a", "alpha bravo charlie delta echo", "Notes")], "id string, text string, section string")
    assert retrieval.evidence_rescue(asked, chunks, fuzzy=False).first()["matches"][0] == "term_overlap:0.62"
