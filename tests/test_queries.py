from __future__ import annotations

import os
import subprocess
import sys

import pytest

from vellumine.plans import oracles, registry


def test_every_oracle_has_its_query():
    assert set(oracles.sql()) <= set(registry.queries())


def test_core_imports_nothing_of_the_training_data_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{root}/vellumine"):
        if not folder.startswith(f"{root}/vellumine/llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "vellumine.llm" not in open(f"{folder}/{f}").read(), f


def test_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)


QUICK = ["tokenize_counts", "normalized_forms", "query_terms", "query_overlap", "text_quality", "detect_language", "should_denoise", "number_strings", "heading_lines", "vector_topk", "bm25_topk", "rank_fusion", "lexical_scores", "document_listing", "retrieval_recall", "stream_event_windows", "sections", "chunk_rows", "answer_support", "evidence_rescue_exact", "hybrid_full", "hybrid_by_document", "grounded_answers_exact", "validated_answers_exact", "calculations", "resolved_queries", "rate_limit_log", "stream_rate_limit", "upload_outcomes", "retry_outcomes", "denoised_pages", "retrieval_comparison", "answer_names", "numbers_match", "reranked_exact", "context_rows_exact", "extracted", "parsed_pages"]


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    want = con.execute(oracles.sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]

    def plain(v):
        return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = sorted([tuple(plain(r[k]) for k in order) for r in want.fetchall()], key=str)
    got = registry.queries()[name](spark, data)
    assert sorted(got.columns) == columns
    assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str) == rows


def test_streamed_chunks_equal_batched_ones(spark, data):
    stream, batch = (registry.queries()[n](spark, data).select("chunk_id", "characters").collect() for n in ("stream_ingest", "chunk_rows"))
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch))


def test_flagship(spark, data):
    rows = registry.flagship(spark, data)
    assert rows.columns == ["query_id", "answer", "score"] and rows.count() > 0


@pytest.mark.parametrize("name", ["hybrid_full", "retrieval_comparison"])
def test_fused_lists_read_the_texts_once(spark, data, name, monkeypatch):
    reads = []

    def corpus(s, d, corpus=registry._corpus):
        reads.append(name)
        return corpus(s, d)

    monkeypatch.setattr(registry, "_corpus", corpus)
    monkeypatch.setattr(registry, "_paged", lambda s, d, found: found.withColumn("page_number", registry.F.lit(1)))
    registry.queries()[name](spark, data)
    assert len(reads) == 1
