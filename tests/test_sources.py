from __future__ import annotations

import json

import pytest

from vellumine.operators.pages import extracted_pages
from vellumine.sources import files
from vellumine.streaming import flows

CHUNK = {"chunk_id": "d_p1_s1_c1", "document_id": "d", "source": None, "page_number": None, "section": "", "section_index": 1, "chunk_index": 1, "text": "body"}


def test_json_chunks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([CHUNK, CHUNK | {"chunk_id": "x"}]))
    rows = files.read_chunks(spark, str(tmp_path / "d.json"))
    assert rows.count() == 2 and set(rows.columns) >= set(CHUNK)
    assert files.read_chunks(spark, str(tmp_path / "missing.json")).count() == 0
    row = files.index_rows(rows).first()
    assert (row.page_number, row.source, row.section, row.ocr_used) == (0, "Unknown", "Unknown", False)


def test_index_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", "text")], "chunk_id string, document_id string, text string")
    assert files.rebuild(rows, str(tmp_path / "index")) == 1
    files.append(rows, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2
    files.write_chunks(rows, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).where("document_id = 'd'").count() == 1


def test_raw_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.txt").write_bytes(b"no")
    row = files.raw_documents(spark, str(tmp_path)).collect()
    assert [(r.filename, r.length) for r in row] == [("a.pdf", 8)]


def test_questions_by_other_names(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "q", "answer": "a", "expected_pages": [1, 2]}]))
    row = files.questions(spark, str(tmp_path / "q.json")).first()
    assert (row.question, row.expected_answer, row.expected_pages, row.expected_sections) == ("q", "a", [1, 2], [])


def test_page_extraction(spark):
    rows = [("p1", None, "Scanned text of a page that is long enough to be used as it stands here. " * 2, 1, 90.0), ("p2", "Native text. " * 20, "", 0, None), ("p3", None, None, 0, None), ("p4", "ab", "Better scanned text here", 0, 50.0)]
    got = {r.page_id: (r.method, r.used) for r in extracted_pages(spark.createDataFrame(rows, "page_id string, raw_text string, ocr_text string, image_count int, ocr_confidence double")).collect()}
    assert got == {"p1": ("scan", True), "p2": ("native", False), "p3": ("none", False), "p4": ("native+scan", True)}


def test_streamed_limiter(spark, tmp_path):
    spark.createDataFrame([("a", n, float(n)) for n in range(4)] + [("b", 9, 0.0), ("a", 10, 100.0)], "client string, ident long, at double").coalesce(1).write.parquet(str(tmp_path / "calls.parquet"))
    calls = flows.table_stream(spark, str(tmp_path), "calls")
    got = {r.ident: r.allowed for r in flows.drained(flows.limited(calls, 2, 60.0)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 9: True, 10: True}


def test_a_batch_run_again_keeps_its_rows(spark, data, tmp_path):
    import glob
    import os

    from vellumine.streaming import flows

    run = flows.ingest(flows.table_stream(spark, data, "pages"))
    table, log = str(tmp_path / "chunks"), str(tmp_path / "log")
    first = sorted(r.chunk_id for r in run(table, log).collect())
    # the batch has written, but its commit is lost: it runs again
    for f in glob.glob(f"{log}/commits/*") + glob.glob(f"{log}/commits/.*.crc"):
        os.remove(f)
    assert sorted(r.chunk_id for r in run(table, log).collect()) == first and len(first) > 0


def test_a_cluster_needs_a_shared_folder():
    import types

    from vellumine import session

    conf = types.SimpleNamespace(get=lambda *a: None)
    fake = types.SimpleNamespace(sparkContext=types.SimpleNamespace(applicationId="x-cluster", master="spark://host:7077", getConf=lambda: conf), conf=conf)
    with pytest.raises(RuntimeError):
        session.shared_folder(fake)


def test_one_documents_chunks(spark, tmp_path):
    from vellumine.sources.files import read_chunks, read_document_chunks, write_chunks

    rows = spark.createDataFrame([("a_p1_s1_c1", "a", "x"), ("b_p1_s1_c1", "b", "y")], "chunk_id string, document_id string, text string")
    write_chunks(rows, str(tmp_path / "t"))
    assert [r.text for r in read_document_chunks(spark, str(tmp_path / "t"), "b").collect()] == ["y"]
    assert read_document_chunks(spark, str(tmp_path / "none"), "b").count() == 0
    assert read_chunks(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        read_chunks(spark, str(tmp_path / "none.json"), must_exist=True)
