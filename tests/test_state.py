from __future__ import annotations

from collections import deque
from datetime import datetime, timedelta

import numpy as np

from vellumine.operators import state as S

STATUS = "document_id string, filename string, storage_filename string, sha256 string, status string, page_count int, chunk_count int, created_at string, updated_at string"


def test_limiter_denies_the_third(spark):
    t = datetime(2026, 1, 1)
    calls = spark.createDataFrame([(n, "a", t + timedelta(seconds=n)) for n in range(3)], "i long, client string, at timestamp")
    assert [r.allowed for r in S.rate_limit(calls, "client", "at", "i", 2).orderBy("i").collect()] == [True, True, False]


def test_limiter_against_a_log(spark):
    rng = np.random.default_rng(1)
    rows = [(n, ["a", "b", None, ""][int(rng.integers(4))], datetime(2026, 1, 1) + timedelta(seconds=int(s))) for n, s in enumerate(np.sort(rng.integers(0, 600, 300)))]
    log, want = {}, {}
    for n, c, at in rows:
        q = log.setdefault(c or "unknown", deque())
        while q and q[0] <= at - timedelta(seconds=60):
            q.popleft()
        want[n] = len(q) < 3
        if want[n]:
            q.append(at)
    got = S.rate_limit(spark.createDataFrame(rows, "i long, client string, at timestamp"), "client", "at", "i", 3)
    assert {r.i: r.allowed for r in got.collect()} == want


def test_latest_status_over_two_notations(spark):
    rows = [("d", "a.pdf", None, "H", "processing", 0, 0, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z"), ("d", "a.pdf", None, "H", "ready", 2, 3, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00.5+00:00"), (None, "x", None, None, "ready", 1, 1, None, None)]
    history = spark.createDataFrame(rows, STATUS)
    assert [(r.document_id, r.status) for r in S.latest_status(history).collect()] == [("d", "ready")]
    assert [tuple(r) for r in S.find_by_hash(history, history.select("sha256")).collect()] == [("H", "d")]


def test_listing_counts_what_the_status_lacks(spark):
    history = spark.createDataFrame([("d", "", "s.pdf", None, "", 0, 0, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z")], STATUS)
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2)], "document_id string, page_number int")
    chunks = spark.createDataFrame([("d", "c1")], "document_id string, chunk_id string")
    assert tuple(S.listing(history, pages, chunks).first()) == ("d", "s.pdf", "ready", 2, 1)


def test_incremental_and_delete(spark):
    chunks = spark.createDataFrame([("d", "c1"), ("d", "c1"), ("e", "c2"), (None, "c3")], "document_id string, chunk_id string")
    assert {r.chunk_id for r in S.not_indexed(chunks, chunks.where("chunk_id = 'c2'")).collect()} == {"c1", "c3"}
    assert sorted(r.chunk_id for r in S.without_documents(chunks, chunks.where("chunk_id = 'c1'")).collect()) == ["c2", "c3"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], STATUS)
    assert S.latest_status(empty).count() == 0
    assert S.rate_limit(spark.createDataFrame([], "i long, client string, at timestamp"), "client", "at", "i").count() == 0
