from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import chunking as C

HEADINGS = {"FY 2024-25": False, "FY 2023-24": False, "1. FINANCIAL RESULTS": True, "6 Provisions and Contingencies": True, "BOARD'S REPORT": True, "CONSOLIDATED": False, "STANDALONE": False, "PARTICULARS": False, "2. OPERATIONS OF THE COMPANY": True, "2024 was good": True, "A. Lease terms": True, "12 345.6": False, "": False}


def test_headings(spark):
    df = spark.createDataFrame([(h,) for h in HEADINGS], "line string")
    assert {r[0]: r[1] for r in df.select("line", C.is_heading(F.col("line"))).collect()} == HEADINGS


def pages(spark, *texts):
    return spark.createDataFrame([("d", n, t) for n, t in enumerate(texts, 1)], "document_id string, page_number int, text string")


def test_sections(spark):
    rows = C.sections(pages(spark, "intro\n1. TITLE\nbody one\nbody two\nEMPTY HEADING\n7\nTwo Line Heading\nlast", None, "")).orderBy("page_number", "section_index").collect()
    assert [(r.section, r.text) for r in rows] == [("General", "intro"), ("1. TITLE", "body one\nbody two"), ("7 Two Line Heading", "last")]


def test_blank_line_parts_a_two_line_heading(spark):
    rows = C.sections(pages(spark, "7\n\nTwo Line Heading")).collect()
    assert [(r.section, r.text) for r in rows] == [("General", "7\nTwo Line Heading")]


def test_packing():
    assert C.pack_paragraphs([], 10, 3) == []
    assert C.pack_paragraphs(["a" * 25], 10, 3) == ["a" * 10, "a" * 10, "a" * 5]
    assert C.pack_paragraphs(["aaaa", "bb", "cccccccc"], 10, 3) == ["aaaa\nbb", "bb\ncccccccc"]
    assert C.pack_paragraphs(["aaaa", "bbb", "cccccccc"], 10, 3) == ["aaaa\nbbb", "cccccccc"]


def test_chunk_ids(spark):
    rows = C.chunks(pages(spark, "A. Part one\n" + "x" * 1801 + "\nshort").withColumn("language", F.lit(None).cast("string"))).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["d_p1_s1_c1", "d_p1_s1_c2", "d_p1_s1_c3"]
    assert {r.language for r in rows} == {"eng"}


def test_sentences(spark):
    df = spark.createDataFrame([("One. Two! Three?",), ("w " * 200,), ("",)], "t string")
    got = [r[0] for r in df.select(C.sentences(F.col("t"))).collect()]
    assert got[0] == ["One.", "Two!", "Three?"]
    assert len(got[1]) == 10 and got[1][0] == " ".join(["w"] * 45)
    assert got[2] == []
