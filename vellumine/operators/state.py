"""Document status, listings, incremental indexing, and the request limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import sanitize_filename, upload_error

def latest_status(history: DataFrame) -> DataFrame:
    """The latest row of each document by updated_at (two notations of UTC), then status; a null document_id has none."""
    when = F.regexp_replace("updated_at", "(Z|\\+00:00)$", "").cast("timestamp")
    order = Window.partitionBy("document_id").orderBy(F.desc_nulls_last(when), F.desc("status"))
    return history.where("document_id is not null").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def find_by_hash(status: DataFrame, hashes: DataFrame) -> DataFrame:
    """(sha256, document_id): the earliest document of each asked hash; null and empty hashes find nothing."""
    known = status.where("sha256 is not null and sha256 != ''")
    first = known.join(hashes.select("sha256").distinct(), "sha256").groupBy("sha256").agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("document_id"))
    return first


STATUS = ("document_id", "filename", "storage_filename", "sha256", "size_bytes", "status", "page_count", "chunk_count", "error", "created_at", "updated_at")


def _fresh(rows: DataFrame, now: Column) -> DataFrame:
    """Status rows of documents that begin (document_id, filename, storage_filename, sha256, size_bytes)."""
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return rows.select(
        "document_id", "filename", F.coalesce("storage_filename", F.lit("")).alias("storage_filename"), "sha256", F.coalesce(F.col("size_bytes").cast("bigint"), F.lit(0)).alias("size_bytes"),
        F.lit("processing").alias("status"), F.lit(0).alias("page_count"), F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("error"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def created(status: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """The status table after uploads (document_id, filename, storage_filename, sha256, size_bytes): a known id begins anew."""
    kept = status.join(uploads.select("document_id"), "document_id", "left_anti").select(*STATUS)
    return kept.unionByName(_fresh(uploads.dropDuplicates(["document_id"]), now))


def updated(status: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The status table after changes (document_id, status, page_count, chunk_count, error), one a document.

    A null count keeps the old one; the error is replaced in any case; an unknown id gets a row of its own.
    """
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    new = changes.select("document_id", *[F.col(c).alias(f"new_{c}") for c in ("status", "page_count", "chunk_count", "error")], F.lit(True).alias("changed"))
    rows = status.select(*STATUS).join(new, "document_id", "full")
    met = F.coalesce("changed", F.lit(False))
    values = {
        "status": F.when(met, F.col("new_status")).otherwise(F.col("status")),
        "error": F.when(met, F.col("new_error")).otherwise(F.col("error")),
        "updated_at": F.when(met, stamp).otherwise(F.col("updated_at")),
        "created_at": F.coalesce("created_at", stamp),
        **{c: F.coalesce(F.when(met, F.col(f"new_{c}")), F.col(c), F.lit(0)).cast("int") for c in ("page_count", "chunk_count")},
        **{c: F.when(F.col("created_at").isNull(), F.coalesce(c, F.lit(""))).otherwise(F.col(c)) for c in ("filename", "storage_filename")},
        "size_bytes": F.when(F.col("created_at").isNull(), F.coalesce("size_bytes", F.lit(0))).otherwise(F.col("size_bytes")),
    }
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in STATUS])


def retried(status: DataFrame, asked: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(the status table, outcomes): failed documents whose file (stored: storage_filename) is still there begin anew.

    outcomes: document_id, outcome of every asked id: processing, not found, not failed, or file missing.
    """
    files = stored.select("storage_filename").where("storage_filename != ''").distinct().withColumn("there", F.lit(True))
    known = asked.select("document_id").distinct().join(status, "document_id", "left").join(files, "storage_filename", "left")
    outcome = F.when(F.col("status").isNull(), "not found").when(F.col("status") != "failed", "not failed").when(F.col("there").isNull(), "file missing").otherwise("processing")
    known = known.withColumn("outcome", outcome)
    again = known.where("outcome = 'processing'").withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), "storage_filename"))
    return created(status, again, now), known.select("document_id", "outcome")


def uploaded(status: DataFrame, files: DataFrame, most: int = 25 * 1024 * 1024) -> DataFrame:
    """(upload_id, document_id, filename, sha256, size_bytes, storage_filename, status, duplicate, error) of uploads (upload_id, filename, content).

    A file that is refused has an error and no document.  One whose bytes are known already gives the known document; of
    equal files in one batch the first by upload_id is the document.  A new document's id is made from its upload and hash.
    """
    rows = files.select("upload_id", "filename", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"), F.when(F.coalesce("filename", F.lit("")) == "", "no filename").otherwise(upload_error(F.col("content"), most)).alias("error"))
    rows = rows.withColumn("filename", sanitize_filename("filename"))
    known = find_by_hash(status, rows.where("error is null")).withColumnRenamed("document_id", "known")
    known = known.join(status.select(F.col("document_id").alias("known"), F.col("status").alias("known_status")), "known")
    first = rows.where("error is null").groupBy("sha256").agg(F.min("upload_id").alias("first"))
    rows = rows.join(known, "sha256", "left").join(first, "sha256", "left")
    own = F.md5(F.concat_ws(":", F.col("first").cast("string"), "sha256"))
    ok, again = F.col("error").isNull(), F.col("known").isNotNull() | (F.col("upload_id") != F.col("first"))
    ident = F.when(ok, F.coalesce("known", own))
    return rows.select("upload_id", ident.alias("document_id"), "filename", "sha256", "size_bytes", F.when(ok & ~again, F.concat_ws("_", ident, "filename")).alias("storage_filename"), F.when(ok, F.coalesce("known_status", F.lit("processing"))).alias("status"), (ok & again).alias("duplicate"), "error")


def listing(status: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per latest document: filename, status, page and chunk counts, counted where the status has none (or 0)."""
    counted_pages = pages.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages"))
    counted_chunks = chunks.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    rows = latest_status(status).join(counted_pages, "document_id", "left").join(counted_chunks, "document_id", "left")
    chunk_count = F.coalesce(F.nullif("chunk_count", F.lit(0)), F.col("chunks").cast("int"), F.lit(0))
    return rows.select(
        "document_id",
        F.coalesce(F.nullif("filename", F.lit("")), "storage_filename").alias("filename"),
        F.coalesce(F.nullif("status", F.lit("")), F.when(F.coalesce("chunks", F.lit(0)) > 0, "ready").otherwise("processing")).alias("status"),
        F.coalesce(F.nullif("page_count", F.lit(0)), F.col("pages").cast("int"), F.lit(0)).alias("page_count"),
        chunk_count.alias("chunk_count"),
    )


def not_indexed(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose id the index doesn't have yet, each once."""
    return chunks.dropDuplicates(["chunk_id"]).join(index.select("chunk_id"), "chunk_id", "left_anti")


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of documents that are not to be deleted; rows without a document stay."""
    return rows.join(gone.select("document_id").where("document_id is not null").distinct(), "document_id", "left_anti")


def document_of_file(filename: str = "filename"):
    """The document id a stored file's name begins with (32 hex digits before `_`), else its stem."""
    stem = F.regexp_replace(filename, "\\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, "^([a-f0-9]{32})(?:_|$)", 1), F.lit("")), stem)


def admitted(held: deque[float], at: float, most: int, window: float) -> bool:
    """Whether a call at `at` is admitted beside the admitted ones in `held`, which is brought up to date."""
    while held and held[0] <= at - window:
        held.popleft()
    if at != at or len(held) >= most:
        return False
    held.append(at)
    return True


def rate_limit(calls: DataFrame, client: str, at: str, ident: str, limit: int = 60, window: float = 60.0) -> DataFrame:
    """(`ident`, allowed): a sliding log per client; a call is admitted if fewer than `limit` admitted ones lie in (at - window, at].

    Denied calls don't count, so the log is sequential, but no longer than a client's calls follow each other within the
    window: after a longer pause the log is empty.  Such runs of calls are found with a range-sorted pass and spread over the
    tasks, so that one busy client isn't one task.  Clients without a name share "unknown"; calls without a time are denied.
    """
    who = F.coalesce(F.nullif(F.col(client).cast("string"), F.lit("")), F.lit("unknown"))
    rows = calls.select(who.alias("c"), F.col(at).cast("timestamp").cast("double").alias("s"), F.col(ident).alias("i"))
    kind, most = rows.schema["i"].dataType.simpleString(), max(1, limit)
    # a bin of one window that follows an empty bin begins a run; bins are counted before anything is sorted
    bins = rows.where("s is not null").select("c", F.floor(F.col("s") / window).alias("bin")).distinct()
    order = Window.partitionBy("c").orderBy("bin")
    bins = bins.withColumn("new", F.coalesce(F.col("bin") - F.lag("bin").over(order) > 1, F.lit(True)).cast("int"))
    bins = bins.select("c", "bin", F.sum("new").over(order).alias("run"))
    placed = rows.withColumn("bin", F.floor(F.col("s") / window)).join(bins, ["c", "bin"], "left")

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[float] = deque()
        current = None
        for batch in batches:
            out = []
            for c, run, s in zip(batch["c"], batch["run"], batch["s"], strict=True):
                if (c, run) != current:
                    current, held = (c, run), deque()
                out.append(admitted(held, s, most, window))
            yield pd.DataFrame({"i": batch["i"], "allowed": out})

    ordered = placed.withColumn("run", F.coalesce("run", F.lit(0))).repartition("c", "run").sortWithinPartitions("c", "run", "s", "i").select("c", "run", "s", "i")
    return ordered.mapInPandas(admit, f"i {kind}, allowed boolean").withColumnRenamed("i", ident)


def rate_limit_bound(calls: DataFrame, client: str, at: str, window: int = 60) -> DataFrame:
    """calls with `recent`, all calls of the client in the window up to each: an upper bound of what the limiter counts."""
    seconds = F.col(at).cast("timestamp").cast("long")
    return calls.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy(client).orderBy(seconds).rangeBetween(-window + 1, 0)))


