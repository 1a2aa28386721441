"""From a document's pages as read to their final texts and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import choose_text, clean_text, corruption_ratio, detect_language, should_denoise, should_scan, strip, valid_restoration, without_headers
from vellumine.operators import plugins

# The shortest text that is restored, and how much of a text a restorer is shown.
RESTORE_LEAST, RESTORE_MOST = 80, 12_000


def extracted_pages(pages: DataFrame) -> DataFrame:
    """pages (raw_text, ocr_text, image_count, ocr_confidence) with method, used, chosen text, denoise gate, language, lengths.

    A scan is adopted only where the page needs one and the better text differs from the native one.
    """
    raw, scan = F.coalesce("raw_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    rows = pages.withColumn("needs_scan", should_scan("raw_text", F.col("image_count"))).withColumn("choice", choose_text("raw_text", "ocr_text"))
    used = F.col("needs_scan") & (scan != "") & (F.coalesce(F.col("choice.text"), F.lit("")) != raw)
    method = F.when(used & (raw == ""), "scan").when(used, "native+scan").when(raw != "", "native").otherwise("none")
    rows = rows.withColumn("used", used).withColumn("method", method).withColumn("chosen", F.when(used, F.col("choice.text")).otherwise(raw))
    gate = should_denoise("chosen", "ocr_text", F.col("ocr_confidence"), F.col("used"))
    return rows.withColumn("gate", gate).withColumn("detected", detect_language("chosen")).withColumn("characters", F.length("chosen")).drop("choice")


def denoised_pages(pages: DataFrame, restorer: plugins.Restorer | None = None, text: str = "text") -> DataFrame:
    """pages (`text`, ocr_text, ocr_confidence, ocr_used) with the text they end with and denoised, ratio, disagreement, model, error.

    A page that the gate lets through is restored if there is a restorer and its candidate passes the safety check; else the
    text stays, with the reason.  An empty text is replaced by its other reading first.
    """
    primary, other = (strip(F.coalesce(F.col(c), F.lit(""))) for c in (text, "ocr_text"))
    rows = pages.withColumn("chosen", F.when(primary != "", primary).otherwise(other)).withColumn("alternate", other)
    rows = rows.withColumn("gate", should_denoise("chosen", "alternate", F.col("ocr_confidence"), F.col("ocr_used")))
    short = F.length("chosen") < RESTORE_LEAST
    rows = rows.withColumn("ratio", F.when(short, corruption_ratio("chosen")).otherwise(F.col("gate.ratio"))).withColumn("disagreement", F.col("gate.disagreement"))
    kept = [c for c in pages.columns if c not in (text, "denoised", "ratio", "disagreement", "model", "error")]

    def out(rows: DataFrame, chosen, denoised, model, error) -> DataFrame:
        return rows.select(*kept, chosen.alias(text), denoised.alias("denoised"), "ratio", "disagreement", model.cast("string").alias("model"), error.cast("string").alias("error"))

    none = F.lit(None)
    if restorer is None:
        return out(rows, F.col("chosen"), F.lit(False), none, F.when(F.col("gate.needs"), "no restorer is configured"))
    calm = out(rows.where("not gate.needs"), F.col("chosen"), F.lit(False), none, none)
    tried = plugins.restored(rows.where("gate.needs"), restorer, RESTORE_MOST)
    seen = F.substring("chosen", 1, RESTORE_MOST)
    ok = F.col("candidate_error").isNull() & valid_restoration(seen, "candidate", "alternate")
    error = F.when(~ok, F.coalesce("candidate_error", F.lit("candidate failed the safety check")))
    return calm.unionByName(out(tried, F.when(ok, F.col("candidate")).otherwise(seen), ok, F.lit(restorer.name), error))


def parsed_pages(pages: DataFrame, headers: list[str] | None = None, restorer: plugins.Restorer | None = None) -> DataFrame:
    """Page rows of pages as read (document_id, source, page_number, raw_text, image_count, ocr_text, ocr_confidence): texts cleaned, chosen, restored, known headers taken out.

    The read pages may come from plugins.read_pages or from a table; pages without a number are left out.
    """
    read = pages.where("page_number is not null").withColumn("raw_text", clean_text("raw_text")).withColumn("ocr_text", clean_text("ocr_text"))
    rows = extracted_pages(read).withColumn("ocr_used", F.col("used")).withColumn("text", F.col("chosen"))
    rows = denoised_pages(rows.select("document_id", "source", "page_number", "text", "raw_text", "ocr_text", "image_count", "ocr_confidence", "ocr_used", F.col("method").alias("extraction_method")), restorer)
    rows = rows.withColumn("text", without_headers("text", headers or []))
    return rows.select(
        "document_id", "source", "page_number", "text", "raw_text", "ocr_text", detect_language("text").alias("language"), "extraction_method", "ocr_used", "image_count",
        F.length("text").alias("text_length"), F.length("raw_text").alias("raw_text_length"), "ocr_confidence", "denoised",
        F.col("model").alias("denoising_model"), F.col("error").alias("denoising_error"), F.col("ratio").alias("denoising_corruption_ratio"), F.col("disagreement").alias("denoising_disagreement"),
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """One row per document of an ingestion run: pages, scanned and restored ones, mean confidence, characters, languages."""
    confidence = F.coalesce(F.avg(F.when(F.col("ocr_confidence") >= 0, F.col("ocr_confidence"))), F.lit(-1.0))
    flags = [F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("ocr_used", "denoised")]
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), *flags, F.round(confidence, 4).alias("confidence"), F.sum(F.length("text")).alias("characters"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
