"""Pages to lines, sections and chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import SPACE, collapse, detect_language, let, strip

# Cells of a table's head, which are no headings.
TABLE_LABELS = ("particulars", "standalone", "consolidated", "fy 2024-25", "fy 2023-24", "march 31, 2025", "march 31, 2024", "march 31 2025", "march 31 2024")


def one_line(text: Column) -> Column:
    return strip(collapse(text))


def is_table_label(line: Column) -> Column:
    low = F.lower(line)
    return low.isin(*TABLE_LABELS) | low.rlike(f"^fy{SPACE}+\\p{{Nd}}{{4}}[-–]\\p{{Nd}}{{2}}$|^march{SPACE}+31,?{SPACE}+\\p{{Nd}}{{4}}$")


def is_heading(line: Column) -> Column:
    """A numbered title, a lettered title, or a line in capitals of up to ten words; table labels are none."""
    title = strip(F.regexp_extract(line, f"^\\p{{Nd}}+[.)]?{SPACE}+(.+)$", 1))
    numbered = line.rlike(f"^\\p{{Nd}}+[.)]?{SPACE}+.+$")
    wrong = (F.length(title) < 3) | is_table_label(title) | title.rlike("^[\\p{Nd},.\\-()₹`]+$")
    capitals = line.rlike("[\\p{Lu}\\p{Lt}]") & ~line.rlike("\\p{Ll}") & (F.size(F.split(line, " ")) <= 10) & (F.length(line) >= 4)
    other = line.rlike(f"^[A-Z]\\.{SPACE}+[A-Za-z]") | capitals
    return (line != "") & ~is_table_label(line) & F.when(numbered, ~wrong).otherwise(other)


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, page_number, line_no, line) of every line, white space collapsed; blank lines stay, empty."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), one_line)
    return pages.select("document_id", "page_number", F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def headings(lines: DataFrame) -> DataFrame:
    """lines with `heading` (null for body lines) and `taken` (the line is the second half of a two-line heading).

    A line of digits only followed at once by a capitalised line of up to twelve words is one heading of two lines.
    """
    page = Window.partitionBy("document_id", "page_number").orderBy("line_no")
    after = F.lead("line").over(page)
    pair = F.col("line").rlike("^\\p{Nd}+$") & after.rlike("^[A-Z]") & ~is_table_label(after) & (F.size(F.split(after, " ")) <= 12)
    rows = lines.withColumn("pair", F.coalesce(pair, F.lit(False))).withColumn("next", after)
    rows = rows.withColumn("taken", F.coalesce(F.lag("pair").over(page), F.lit(False)))
    heading = F.when(F.col("taken"), None).when(F.col("pair"), F.concat_ws(" ", "line", "next")).when(is_heading(F.col("line")), F.col("line"))
    return rows.withColumn("heading", heading).drop("pair", "next")


def sections(pages: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, page_number, section_index, section, text): body lines under their heading, from "General" on each page.

    A heading without a body disappears.  Numbers count sections with a body, from 1.
    """
    rows = headings(page_lines(pages, text))
    page = Window.partitionBy("document_id", "page_number").orderBy("line_no")
    rows = rows.withColumn("part", F.sum(F.col("heading").isNotNull().cast("int")).over(page))
    rows = rows.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0)), F.lit("General")))
    body = rows.where("heading is null and not taken and line != ''")
    out = body.groupBy("document_id", "page_number", "part", "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    number = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("part"))
    return out.select("document_id", "page_number", number.alias("section_index"), "section", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def pack_paragraphs(paragraphs: list[str], limit: int, overlap: int) -> list[str]:
    """Paragraphs packed greedily to `limit` characters; trailing paragraphs within `overlap` open the next chunk.

    A paragraph over the limit is cut every `limit` characters without overlap, and nothing is carried over it.  Carried
    paragraphs count a line end each, so a chunk that opens with some may pass the limit, as the reference semantics have it.

    Worked out over the running lengths of the paragraphs (each with its line end), so that a chunk is a range of them: the
    last one that fits and the first one carried are found by bisection.
    """
    ends = list(accumulate((len(p) + 1 for p in paragraphs), initial=0))  # ends[k]: length of the first k paragraphs
    oversized = [k for k, p in enumerate(paragraphs) if len(p) > limit]
    out: list[str] = []
    first = 0
    for stop in [*oversized, len(paragraphs)]:
        fresh, carried = first, first  # paragraphs from `fresh` on are in no chunk yet; those from `carried` open the next one
        while fresh < stop:
            # one new paragraph comes in any case; but in a range's first chunk its last line end doesn't count
            reach = ends[carried] + limit + (fresh == first)
            last = max(fresh + 1, min(stop, bisect_right(ends, reach) - 1))
            out.append("\n".join(paragraphs[carried:last]))
            carried = max(carried, bisect_left(ends, ends[last] - overlap, 0, last + 1)) if last < stop else last
            fresh = last
        if stop < len(paragraphs):
            p = paragraphs[stop]
            out += [s for k in range(0, len(p), limit) if (s := p[k : k + limit].strip())]
        first = stop + 1
    return out


def chunks(pages: DataFrame, text: str = "text", limit: int = 1800, overlap: int = 300) -> DataFrame:
    """Chunk rows of pages: chunk_id `{document}_p{page}_s{section}_c{chunk}`, page attributes inherited.

    Pages without text have no chunks; a page redelivered counts once.
    """
    rows = pages.dropDuplicates(["document_id", "page_number"])
    parts = sections(rows, text)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, p, s, name, t in batch[["document_id", "page_number", "section_index", "section", "text"]].itertuples(index=False):
                out += [(d, p, s, name, k, c) for k, c in enumerate(pack_paragraphs(t.split("\n"), limit, overlap), 1)]
            yield pd.DataFrame(out, columns=["document_id", "page_number", "section_index", "section", "chunk_index", "text"])

    number = rows.schema["page_number"].dataType.simpleString()
    packed = parts.mapInPandas(pack, f"document_id string, page_number {number}, section_index int, section string, chunk_index int, text string")
    ident = F.format_string("%s_p%s_s%s_c%s", "document_id", F.col("page_number").cast("string"), F.col("section_index").cast("string"), F.col("chunk_index").cast("string"))
    kept = [c for c in ("source", "language", "extraction_method", "ocr_used", "denoised", "ocr_confidence", "denoising_model") if c in rows.columns]
    page = rows.select("document_id", "page_number", *kept, F.col(text).alias("page_text"))
    out = packed.withColumn("chunk_id", ident).join(page, ["document_id", "page_number"])
    if "language" in kept:
        out = out.withColumn("language", F.coalesce(F.nullif(F.col("language"), F.lit("")), detect_language("page_text")))
    return out.drop("page_text")


def sentences(text: Column, most: int = 320, window: int = 45) -> Column:
    """Sentences of a text; a single sentence longer than `most` gives overlapping windows of words instead."""
    step = max(1, window // 2)

    def windows(flat: Column) -> Column:
        return let(F.split(flat, " "), lambda tokens: F.transform(F.sequence(F.lit(1), F.size(tokens), F.lit(step)), lambda k: F.array_join(F.slice(tokens, k, window), " ")))

    def cut(flat: Column) -> Column:
        parts = let(F.split(flat, f"(?<=[.!?]){SPACE}+"), lambda x: F.when((F.size(x) == 1) & (F.length(flat) > most), windows(flat)).otherwise(x))
        return F.when(flat == "", F.array().cast("array<string>")).otherwise(parts)

    return let(one_line(text), cut)
