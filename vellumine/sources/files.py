"""Files in and out: JSON chunk files, raw documents, question sets, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.schema import CHUNK
from vellumine.session import written


def read_chunks(spark: SparkSession, path: str, must_exist: bool = False) -> DataFrame:
    """Chunk rows of JSON-array files; a missing path gives an empty table of the schema, or an error if it must exist (as for building an index)."""
    try:
        return spark.read.schema(CHUNK).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if must_exist:
            raise FileNotFoundError(path) from e
        return spark.createDataFrame([], CHUNK)


def read_document_chunks(spark: SparkSession, path: str, document: str) -> DataFrame:
    """The chunks of one document of a table written by write_chunks: only its partition is read; none for an unknown document."""
    try:
        return spark.read.parquet(path).where(F.col("document_id") == document)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], CHUNK)
        raise


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows as a table partitioned by document (for many documents, bucket instead)."""
    chunks.write.mode("overwrite").partitionBy("document_id").parquet(path)


def raw_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, filename, length, modified, sha256, content) of raw files; unread columns cost nothing."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("filename"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSON file under their usual names."""
    rows = spark.read.json(path, multiLine=True)
    have = set(rows.columns)

    def first(*names: str):
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))

    lists = [F.array().cast(f"array<{t}>").alias(n) if n not in have else F.col(n).cast(f"array<{t}>").alias(n) for n, t in (("expected_pages", "int"), ("expected_sections", "string"))]
    return rows.select(first("question", "query").alias("question"), first("expected_answer", "answer", "expected").alias("expected_answer"), *lists)


def rebuild(chunks: DataFrame, path: str) -> int:
    """Writes the index table anew and returns its rows, which must be as many as the chunks."""
    fixed = written(index_rows(chunks), "rebuild")
    fixed.write.mode("overwrite").parquet(path)
    stored, given = chunks.sparkSession.read.parquet(path).count(), fixed.count()
    if stored != given:
        raise ValueError(f"index has {stored} rows, not {given}")
    return stored


def append(chunks: DataFrame, path: str) -> None:
    index_rows(chunks).write.mode("append").parquet(path)


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as index rows: nulls coerced as the index boundary has it (page and indexes 0, source and section named unknown)."""
    have = set(chunks.columns)
    zero = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("page_number", "section_index", "chunk_index") if c in have]
    named = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c) for c, d in (("source", "Unknown"), ("section", "Unknown"), ("language", "unknown"), ("extraction_method", "unknown")) if c in have]
    used = [F.coalesce("ocr_used", F.lit(False)).alias("ocr_used")] if "ocr_used" in have else []
    return chunks.select("chunk_id", "document_id", *zero, *named, *used, F.coalesce("text", F.lit("")).alias("text"))
