from __future__ import annotations

import pytest

from vellumine.operators import agent, answers
from vellumine.operators import evaluation as E

COLUMNS = "query_id long, id string, query string, answer string, text string, document_id string, page_number int, section string"
D = "benchmark_document"


def case(answer, *chunks, query="?"):
    return [(1, f"{D}_p{p}_s{s}_c{c}", query, answer, text, D, p, name) for p, s, c, name, text in chunks]


CASES = [
    ("Total Income was ₹31,455.43 lakhs and ₹37,569.16 lakhs.", [(5, 2, 1, "FINANCIAL RESULTS", "Total Income\n31,455.43\n37,569.16\n1,000.00\n2,000.00")], 1, 5, "31,455.43"),
    ("Bank balance of 52.63 lakhs.", [(151, 4, 1, "CASH", "Bank balance other\n52.63\nmore")], 1, 151, "52.63"),
    ("Alpha Holdings and Beta Industries are partners.", [(101, 1, 1, "PARTNERS", "Joint partners are Alpha Holdings and Beta Industries.")], 1, 101, "Alpha Holdings"),
    ("Nothing matches.", [(3, 1, 1, "X", "An unrelated chunk")], 0, None, None),
]


@pytest.mark.parametrize(("answer", "chunks", "count", "page", "evidence"), CASES)
def test_citations(spark, answer, chunks, count, page, evidence):
    got = answers.citations(spark.createDataFrame(case(answer, *chunks), COLUMNS)).collect()
    assert len(got) == count
    if count:
        assert (got[0].citation_id, got[0].page_number) == ("C1", page) and evidence in got[0].evidence


def test_cover_prefers_support_and_skips_what_adds_nothing(spark):
    rows = case("Figures 1,819.57 and 52.63", (151, 3, 1, "A", "52.63"), (151, 4, 1, "B", "1,819.57 and 52.63"), (152, 1, 1, "C", "52.63"))
    got = answers.citations(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [r.id for r in got] == [f"{D}_p151_s4_c1"]


def test_same_place_only_adds_coverage(spark):
    rows = case("Figures 1,819.57 and 52.63 and 77.10", (151, 3, 1, "A", "52.63 and 1,819.57"), (151, 3, 2, "A", "77.10"), (152, 1, 1, "C", "77.10"))
    got = answers.citations(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [r.id for r in got] == [f"{D}_p151_s3_c1"]


def test_citation_errors(spark):
    cited = spark.createDataFrame([(1, "C1", "x", 1, "e"), (1, "C2", "y", None, " ")], "query_id long, citation_id string, id string, page_number int, evidence string")
    got = answers.citation_errors(cited, spark.createDataFrame([(1, "x")], "query_id long, id string")).collect()
    assert [(r.citation_id, r.errors) for r in got] == [("C2", ["chunk_id not found in retrieved results", "missing page number", "missing evidence"])]


GENERIC = "query_id long, id string, query string, answer string, text string, document_id string, source string, page_number int, section string, rank int"


def test_generic_citations_where_none_are_structured(spark):
    ask, said = "What types of laminar equipment exist?", "Laminar flow cabinets exist."
    long = "Rain fell. Laminar equipment exists of several types " + "and " * 90 + "more."
    rows = [
        (1, "a", ask, said, "Rain fell. The laminar equipment of all types exists as cabinets. It is cleaned.", "d", "s.pdf", 4, "Tools", 1),
        (1, "b", ask, said, "Laminar equipment types exist.", "d", "s.pdf", 4, "Tools", 2),  # the same place
        (1, "c", ask, said, "Nothing of it here.", "d", "s.pdf", 5, "Other", 3),
        (1, "e", ask, said, long, "d", None, None, "Unknown", 4),
        (2, "f", "What was the income?", "Income was 31,455.43 lakhs.", "Income was 31,455.43", "d", "s.pdf", 7, "Sums", 1),
        (3, "g", "What was the income?", "Income was 31,455.43 lakhs.", "Income was 31,455.43 lakhs.", "d", "s.pdf", None, "Sums", 1),  # no page: not valid
        (4, "h", "zebra?", "quagga", "An unrelated chunk", "d", "s.pdf", 1, "X", 1),
    ]
    pairs = spark.createDataFrame(rows, GENERIC)
    got = {r.query_id: r.citations for r in answers.cited_answers(pairs).collect()}
    assert set(got) == {1, 2, 3}
    first = got[1].split("\n")
    assert first[:2] == ["[C1] s.pdf | Page 4 | Section: Tools", "    Evidence: The laminar equipment of all types exists as cabinets."]
    assert first[2] == "[C2] Unknown | Page Unknown" and first[3].endswith("and...") and len(first) == 4
    assert got[2].startswith("[C1] Page 7, Sums — ")
    assert got[3] == "[C1] s.pdf | Page Unknown | Section: Sums\n    Evidence: Income was 31,455.43 lakhs."


def test_generic_scores(spark):
    row = (1, "a", "laminar types", "cabinets hold", "Laminar cabinets of types.", "d", "s", 1, "Laminar", 1)
    got = answers.generic_citations(spark.createDataFrame([row], GENERIC)).first()
    # query terms: laminar, types, kind, category, classification; answer terms: cabinets, hold
    assert got is None
    row = (1, "a", "laminar cabinets", "cabinets hold", *row[4:])
    got = answers.generic_citations(spark.createDataFrame([row], GENERIC)).first()
    assert got.score == pytest.approx(0.42 + 0.28 * 0.5 + 0.10 + 0.08 * 0.5 + 0.04 * 0.5, abs=1e-9)


def test_grounding(spark):
    a = spark.createDataFrame([(1, "Income was 31,455.43"), (2, "Income was 99.99"), (3, "zebra quagga"), (4, " ")], "query_id long, answer string")
    t = spark.createDataFrame([(n, "total income was 31,455.43 lakh") for n in (1, 2, 3, 4)], "query_id long, text string")
    assert {r.query_id: r.grounded for r in answers.grounding(a, t).collect()} == {1: True, 2: False, 3: False}


ROUTES = {"calculate 12 + 8": "calculator", "What does the document say about safety?": "retrieval", "What was the change in total income between FY 2023-24 and FY 2024-25?": "calculator", "What does the document say about laminar flow equipment?": "retrieval", None: "retrieval"}


def test_routes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(q,) for q in ROUTES], "q string")
    assert {r[0]: r[1] for r in df.select("q", agent.route(F.col("q"))).collect()} == ROUTES


@pytest.mark.parametrize(("query", "answer"), [("calculate 12 + 8", "20"), ("compute 10 + 5 * 2", "20"), ("2 ^ 3 ^ 2", "512"), ("-2 ^ 2 + 0", "-4"), ("1 - -3", "4"), ("10 / 4", "2.5")])
def test_calculator(spark, query, answer):
    got = agent.calculator(spark.createDataFrame([(1, query)], "query_id long, query string")).first()
    assert (got.answer, got.error) == (answer, None)


@pytest.mark.parametrize("query", ["calculate 10 / 0", "nothing here", "9 ^ 9 ^ 9 ^ 9"])
def test_calculator_errors(spark, query):
    got = agent.calculator(spark.createDataFrame([(1, query)], "query_id long, query string")).first()
    assert got.answer == "" and got.error


def test_resolving(spark):
    q = spark.createDataFrame([(1, "c", 3, "And the previous year?"), (2, "c", 1, "first"), (3, "c", 9, "How much did it increase?"), (4, None, 1, "alone")], "query_id long, conversation_id string, turn long, query string")
    h = spark.createDataFrame([("c", 2, "What was the total income in FY 2023-24?"), ("c", 2, " ")], "conversation_id string, turn long, content string")
    got = {r.query_id: r.resolved for r in agent.resolve(q, h).collect()}
    assert got == {1: "What was the total income for FY 2022-23?", 2: "first", 3: "What was the change in total income between FY 2023-24 and FY 2024-25?", 4: "alone"}


def test_evaluation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("5 and 5", "5"), ("5 and 5", "5, 5.005"), ("rose; fell", "it fell and rose"), ("", "x"), (None, "x")], "e string, a string")
    assert [tuple(r) for r in df.select(E.numbers_match(F.col("e"), F.col("a")), E.text_match(F.col("e"), F.col("a")), E.answer_match(F.col("e"), F.col("a"))).collect()] == [(False, False, False), (True, False, True), (None, True, True), (None, None, None), (None, None, None)]
    found = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 1)], "query_id long, rank int, page_number int")
    want = spark.createDataFrame([(1, [8]), (2, [5]), (3, [1])], "query_id long, pages array<int>")
    assert tuple(E.recall_at_k(found, want, 10).first()) == (3, 1, 0.333333)


def test_extractive_answer_hands_on_no_sentences(spark):
    """A text gives one row, its best sentence: its question's terms are worked out once, not for each sentence."""
    long = " ".join(f"w{i}" for i in range(100)) + " profit growth"
    rows = [(1, "a", "profit growth", "Profit fell. The growth of profit. Growth, profit."), (1, "b", "profit growth", "Profit growth."), (2, "c", "profit growth", None), (3, "d", None, "A b. C d."), (4, "e", "profit growth", long)]
    out = answers.extractive_answer(spark.createDataFrame(rows, "query_id long, id string, query string, text string"))
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.query_id: (r.answer, r.score) for r in out.collect()}
    assert got == {1: ("The growth of profit.", 1.0), 3: (answers.REFUSAL, 0.0), 4: (" ".join(long.split()[66:]), 1.0)}
