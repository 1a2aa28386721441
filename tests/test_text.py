from __future__ import annotations

import pytest
import regex
from pyspark.sql import functions as F

from vellumine.functions import numbers as N
from vellumine.functions import text as X

TEXTS = ["Net 31,455.43 in FY 2024-25", "क्या राम self-employed है?", "", "abc12 ₹5 lakhs", None]


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [r[0] for r in df.select(column).collect()]


def test_tokens(spark):
    got = values(spark, X.tokenize("t"), *TEXTS)
    want = [None if t is None else [x.lower() for x in regex.findall(X.TOKEN, t)] for t in TEXTS]
    assert got == want
    assert got[0][1:3] == ["31,455", "43"]
    assert values(spark, X.token_count("t"), *TEXTS) == [None if w is None else len(w) for w in want]


def test_terms_drop_marked_and_hyphenated_words(spark):
    assert values(spark, X.query_terms("t"), "क्या self-employed types of income, types?")[0] == ["types", "income", "kind", "category", "classification"]
    assert values(spark, X.answer_terms("t"), "income lakh income")[0] == ["income", "income"]


def test_normal_forms(spark):
    t = "  ₹5  Lakhs`\tRs. 7\n"
    assert values(spark, X.retrieval_text("t"), t) == ["5 lakhs rs. 7"]
    assert values(spark, X.citation_text("t"), t, None) == ["₹5 lakhs` rs. 7", ""]
    assert values(spark, X.rerank_text("t"), t) == ["₹5 lakhs` rs. 7"]
    assert values(spark, X.evaluation_text("t"), t) == ["5 lakh` 7"]
    assert values(spark, X.normalize_token(F.col("t")), "Abc12", "2024") == ["abc", ""]


def test_unicode(spark):
    assert values(spark, X.normalize_unicode("t"), "ﬁ​ne", None, "ok") == ["fine", "", "ok"]


def test_language(spark):
    got = values(spark, X.detect_language("t"), "An English text", "यह राशि है और था", "आहे आणि मध्ये", "12 34", "", None, "abcdefghij राम")
    assert got == ["eng", "hin", "mar", "unknown", "unknown", "unknown", "mixed"]


def test_corruption_and_denoise(spark):
    assert values(spark, X.corruption_ratio("t"), "Bacte8ia Mes0tomAs", "clean words here", "", None) == [1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("Clean text that is short.", None, 92.0, True), ("x" * 30 + " Bacte8ia Mes0tomAs str|_ " + "y" * 60, None, 41.0, True)], "t string, o string, c double, u boolean")
    gate = df.select(X.should_denoise("t", "o", F.col("c"), F.col("u"))["needs"]).collect()
    assert [g[0] for g in gate] == [False, True]


def test_restoration(spark):
    df = spark.createDataFrame([("Amount 123.45 was reported.", "Amount 124.45 was reported."), ("Amount 123.45 was reported.", "Amount 123.45 was reported!")], "s string, c string")
    assert [r[0] for r in df.select(X.valid_restoration("s", "c", F.lit(None))).collect()] == [False, True]


@pytest.mark.parametrize(("name", "safe"), [("..\\secret/../../annual report?.pdf", "annual report_.pdf"), (None, "document.pdf"), ("", "document.pdf"), ("a.PDF", "a.PDF"), ("x" * 300, "x" * 180)])
def test_filenames(spark, name, safe):
    assert values(spark, X.sanitize_filename("t"), name) == [safe]


def test_upload(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.7\nvalid"),), (bytearray(b"not a pdf"),), (bytearray(b""),), (bytearray(b"%PDF-1.7" + b"0" * 200),)], "c binary")
    assert [r[0] for r in df.select(X.upload_error(F.col("c"), 100)).collect()] == [None, "not a PDF", "empty", "too large"]


def test_numbers(spark):
    t = "On March 31, 2025 it was ₹37,569.16 lakhs (up 12.5%), SP/3861/95"
    assert values(spark, F.transform(N.number_strings("t"), lambda x: F.trim(x)), t)[0] == ["31,", "2025", "₹37,569.16 lakhs", "12.5%", "3861", "95"]
    assert values(spark, N.answer_numbers("t"), t)[0] == ["₹37,569.16 lakhs", "12.5%", "3861", "95"]
    assert values(spark, N.bare_number(F.col("t")), "₹37,569.16 lakhs") == ["37569.16"]
    assert values(spark, N.names("t"), "Total income of Alpha Holdings rose")[0] == ["total income", "alpha holdings"]


def test_quality_bounds(spark):
    got = values(spark, X.text_quality("t"), "A good text of words", "����", "", None)
    assert got[0] > 0.8 and got[1:] == [0.0, 0.0, 0.0]


def test_strip_takes_every_space_at_the_ends_without_a_pattern(spark):
    cases = [None, "", "a", " \t\n", *[f"{c}a{c}b{c}{c}" for c in X.SPACES], "　 x\r\n", "​z ", "नम \n"]
    rows = spark.createDataFrame([(c,) for c in cases], "x string")
    want = F.regexp_replace("x", f"^{X.SPACE}+|{X.SPACE}+$", "")
    assert all(r[0] == r[1] for r in rows.select(X.strip("x"), want).collect())
    assert "regexp" not in str(X.strip("x"))
