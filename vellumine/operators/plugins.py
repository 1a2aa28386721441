"""What an outside model or reader must offer, how a table is run through one, and plain stand-ins that need none.

A plug-in works on batches of texts in Python workers; it is shipped to them, and should load its model on first use there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import let, tokenize
from vellumine.operators.retrieval import reranker_text

# What an encoder's texts begin with.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


class Encoder(Protocol):
    """Texts to vectors of one length."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """A score for each pair of question and text, higher for a better match."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    """An answer to each question from its context."""

    def generate(self, queries: list[str], contexts: list[str]) -> list[str]: ...


class Restorer(Protocol):
    """A restored text for each page's text and its other reading; raises or returns "" where it can't."""

    name: str

    def restore(self, text: str, alternate: str) -> str: ...


class PageReader(Protocol):
    """The pages of a document's bytes: dicts with page_number, raw_text, image_count, and ocr_text, ocr_confidence where scanned."""

    def read(self, content: bytes) -> Iterator[dict]: ...


def encoded(df: DataFrame, text: str, encoder: Encoder, prefix: str = PASSAGE_PREFIX) -> DataFrame:
    """df with `embedding`, the encoder's vectors of a text column; a null text is encoded as empty."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encoder.encode([prefix + (t or "") for t in texts])])

    return df.withColumn("embedding", run(F.col(text)))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The stand-in for an encoder: counts of a text's tokens by a hash of each, at length 1; null for a text without tokens."""
    # the buckets as one text: a bucket's own text is looked for in it, as a call for each token and bucket would cost far more
    marks = F.array_join(F.transform(tokenize(text), lambda t: F.concat(F.lit(","), (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim).cast("string"), F.lit(","))), "")

    def counted(found: Column) -> Column:
        each = F.array(*[F.lit(f",{b},") for b in range(dim)])
        return F.transform(each, lambda m: ((F.length(found) - F.length(F.replace(found, m, F.lit("")))) / F.length(m)).cast("double"))

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(length > 0, let(length, lambda n: F.transform(counts, lambda x: x / n)))

    return let(let(marks, counted), scaled)


def rerank_scores(reranker: Reranker) -> Callable[[DataFrame], DataFrame]:
    """What retrieve_evidence takes as `score`: the reranker's scores of pairs, shown as reranker_text."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in reranker.score(list(queries), list(texts))])

    def score(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rerank_score", run(F.col("query"), reranker_text(F.col("section"), F.col("source"), F.col("page_number"), F.col("text"))))

    return score


def bm25_scores(pairs: DataFrame) -> DataFrame:
    """The stand-in for a reranker: the BM25 score, 0 where there is none."""
    return pairs.withColumn("rerank_score", F.coalesce("bm25_score", F.lit(0.0)))


def answers_by(generator: Generator, context: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """What answers.generated takes as `generate`: the generator's answer to each question from the text `context` makes of its rows."""

    @F.pandas_udf("string")
    def run(queries: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series(list(generator.generate(list(queries), list(contexts))))

    def generate(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy("query_id").agg(F.first("query").alias("query"))
        return context(rows).join(asked, "query_id").select("query_id", run("query", "context").alias("answer"))

    return generate


def read_pages(documents: DataFrame, reader: PageReader) -> DataFrame:
    """(document_id, source, page_number, raw_text, image_count, ocr_text, ocr_confidence, error) of documents (document_id, filename, content).

    A document that can't be read is one row with an error and no page.
    """
    columns = ["document_id", "source", "page_number", "raw_text", "image_count", "ocr_text", "ocr_confidence", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, name, content in zip(batch["document_id"], batch["filename"], batch["content"], strict=True):
                try:
                    out += [(d, name, p["page_number"], p.get("raw_text"), p.get("image_count", 0), p.get("ocr_text"), p.get("ocr_confidence"), None) for p in reader.read(bytes(content))]
                except Exception as e:  # noqa: BLE001  the plug-in's own errors are data here
                    out.append((d, name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=columns).astype({"page_number": "Int32", "image_count": "Int32", "ocr_confidence": "float64"})

    schema = "document_id string, source string, page_number int, raw_text string, image_count int, ocr_text string, ocr_confidence double, error string"
    return documents.select("document_id", "filename", "content").mapInPandas(run, schema)


def restored(texts: DataFrame, restorer: Restorer, most: int) -> DataFrame:
    """texts (chosen, alternate) with `candidate` and `candidate_error`, the restorer's reading of up to `most` characters of each (its own limit)."""

    @F.pandas_udf("candidate string, candidate_error string")
    def run(text: pd.Series, alternate: pd.Series) -> pd.DataFrame:
        out = []
        for t, a in zip(text, alternate, strict=True):
            try:
                got = restorer.restore(t[:most], (a or "")[:most]).strip()
                out.append((got, None if got else "restored text is empty"))
            except Exception as e:  # noqa: BLE001
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["candidate", "candidate_error"])

    return texts.withColumn("__r", run("chosen", "alternate")).select("*", "__r.*").drop("__r")
