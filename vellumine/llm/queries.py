"""Queries of the training-data operators over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import token_count
from vellumine.llm import language, merkle, pair_defects, scan_noise
from vellumine.llm.boundary_split import split_oversized
from vellumine.llm.mixing import mixture, source_report
from vellumine.llm.packing import pack
from vellumine.llm.site_lines import site_blocks, site_lines, without_lines
from vellumine.llm.template_residue import parts, residue
from vellumine.llm.top_per_group import top_per_group
from vellumine.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be cut."""
    return split_oversized(table(spark, folder, "chunks"), "chunk_id", "text").where("pieces > 1").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's text in pieces within the limit."""
    return split_oversized(table(spark, folder, "chunks"), "chunk_id", "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three best citations of every document."""
    return top_per_group(table(spark, folder, "citations"), "document_id", "support_score", "cite_id", 3).select("document_id", "cite_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of `pages.text` that stand in many documents of their source."""
    return site_lines(table(spark, folder, "pages"), ["document_id", "page_number"], "document_id", "source", "text")


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated blocks of each site, by their lines: how many there are, the widest spread, and where they stand."""
    blocks = site_blocks(table(spark, folder, "pages"), "page_id", "document_id", "source", "text")
    return blocks.groupBy("source", "lines").agg(F.count(F.lit(1)).alias("blocks"), F.max("documents").alias("documents"), F.sum("places").alias("places"))


def p3_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page without its site's lines."""
    pages, keys = table(spark, folder, "pages").select("document_id", "page_number", "source", "text"), ["document_id", "page_number"]
    return without_lines(pages, keys, "text", site_lines(pages, keys, "document_id", "source", "text"))


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    pages, chunks = table(spark, folder, "pages"), table(spark, folder, "chunks")
    ocr, raw = (scan_noise.texts_of(pages, "page_id", f"pages.{c}", c, "document_id", "page_number", False) for c in ("ocr_text", "raw_text"))
    return ocr.unionByName(raw).unionByName(scan_noise.texts_of(chunks, "chunk_id", "chunks.text", "text", "document_id", "page_number", True))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of noise in the texts of pages and chunks."""
    found, _, _ = scan_noise.find_noise(_scans(spark, folder))
    return found.select(F.col("r").alias("record_id"), F.col("f").alias("field"), "noise")


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of pages and chunks in continuous paragraphs."""
    texts = _scans(spark, folder)
    _, fixes, titles = scan_noise.find_noise(texts)
    return scan_noise.repaired(texts, fixes, titles).select(F.col("r").alias("record_id"), F.col("f").alias("field"), F.col("t").alias("text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Answered requests whose answer is of no use, with the defect."""
    model = language.train(table(spark, folder, "chunks"), "chunk_id", "text", "language")
    return pair_defects.defects(table(spark, folder, "chat_requests"), table(spark, folder, "chat_responses"), "request_id", "query", "answer", model)


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    """(record_table, record_id, given, language, confidence, stretches) of every chunk and page, by one model.

    Pages carry what their sites stamp on them, which chunks don't, so a stretch of a page takes more words.
    """
    tables = {n: table(spark, folder, n).select(F.col(i).alias("record_id"), "text", "language") for n, i in (("chunks", "chunk_id"), ("pages", "page_id"))}
    model = language.train(tables["chunks"].unionByName(tables["pages"]), "record_id", "text", "language")
    out = []
    for name, rows, rules in (("chunks", tables["chunks"], language.Rules()), ("pages", tables["pages"], language.Rules(6, 4))):
        given = rows.dropDuplicates(["record_id"]).select("record_id", language.label_code(F.col("language")).alias("given"))
        out.append(language.identify(rows, "record_id", "text", model, rules).join(given, "record_id").withColumn("record_table", F.lit(name)))
    return out[0].unionByName(out[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks without the right language code, with it, and pages of several languages, with each."""
    rows = _languages(spark, folder)
    right = rows.where("record_table = 'chunks' and (given is null or given != language)").select("record_id", "language")
    several = rows.where("record_table = 'pages'").select("record_id", F.array_distinct("stretches.language").alias("languages")).where("size(languages) > 1")
    return right.unionByName(several.select("record_id", F.explode("languages").alias("language")))


def p6_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language, confidence and stretches of every chunk and page."""
    return _languages(spark, folder).select("record_table", "record_id", "language", F.round("confidence", 6).alias("confidence"), "stretches")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the same text and documents of the same file hash, whatever the form they are written in."""
    texts = merkle.text_nodes(table(spark, folder, "chunks").select("chunk_id", "text"), "text")
    chunks = merkle.collapse(texts, "chunk_id", F.col("__h"), F.col("__c"))
    code = merkle.hex_code(F.col("sha256"))
    files = merkle.collapse(table(spark, folder, "document_status"), "document_id", F.md5(code), code)
    pairs = [merkle.copies_of(d, i).withColumn("record_table", F.lit(n)) for d, i, n in ((chunks, "chunk_id", "chunks"), (files, "document_id", "document_status"))]
    return pairs[0].unionByName(pairs[1]).select("record_table", "kept_id", "copy_id")


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each text of `chunks`, with the number of copies."""
    texts = merkle.text_nodes(table(spark, folder, "chunks").select("chunk_id", "text"), "text")
    chunks = merkle.collapse(texts, "chunk_id", F.col("__h"), F.col("__c"))
    return chunks.where("chunk_id = kept_id").select("chunk_id", "copies")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "text", token_count("text").alias("tokens"))


def _profiles(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = table(spark, folder, "pack_profiles").where("profile is not null and capacity_tokens > 0").collect()  # a fixed table of settings
    return {r.profile: r.capacity_tokens for r in rows}


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that fit no container whole, by profile."""
    packed = pack(_tokens(spark, folder), "doc_id", "tokens", _profiles(spark, folder))
    return packed.where("pieces > 1").select("profile", "doc_id").distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Fill of the containers of each profile."""
    packed = pack(_tokens(spark, folder), "doc_id", "tokens", _profiles(spark, folder))
    each = packed.groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("filled"))
    total = each.groupBy("profile", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"))
    return total.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))


def _mix(spark: SparkSession, folder: str, keep: bool = False) -> DataFrame:
    return source_report(*mixture(_tokens(spark, folder), table(spark, folder, "mix_targets"), "doc_id", "source", "text", "tokens", keep=keep))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot supply their share of the mixture."""
    return _mix(spark, folder).where("short").select("source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, folder).select("source", "target_share", "reached_share", "reached_tokens")


def p9_kept_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each source in the largest mixture that keeps the shares of all sources that supply anything."""
    return _mix(spark, folder, keep=True).select("source", F.round("wanted_share", 6).alias("wanted_share"), "reached_share", "reached_tokens", "budget")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are residue in place of content."""
    return residue(table(spark, folder, "documents"), "doc_id", "text")


def p10_ways(spark: SparkSession, folder: str) -> DataFrame:
    """How the residue was found: documents by way."""
    return parts(table(spark, folder, "documents"), "doc_id", "text").groupBy("how").agg(F.count(F.lit(1)).alias("documents"))


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with content of their own."""
    docs = table(spark, folder, "documents")
    return docs.join(residue(docs, "doc_id", "text"), "doc_id", "left_anti").select("doc_id", "source", "lang", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
