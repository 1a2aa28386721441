from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellumine.llm import language as L
from vellumine.llm import pair_defects as P
from vellumine.llm import scan_noise as S
from vellumine.llm.template_residue import residue

SENTENCES = {
    "eng": ["The board approved the plan for the next year.", "No claim was found at the new plant.", "The lease was shown within other income.", "These totals were checked against the vouchers."],
    "fra": ["Le conseil a approuvé le plan pour la nouvelle année.", "Aucune dette n'a été relevée dans le site.", "Les échantillons ont été conservés puis comptés.", "La société a constitué une provision pour ce litige."],
    "deu": ["Der Vorstand hat den Plan für das neue Jahr gebilligt.", "Es wurde keine Haftung in dem Werk festgestellt.", "Die Proben wurden gelagert und erneut gezählt.", "Die Firma hat eine Rückstellung für den Streit gebildet."],
    "spa": ["El consejo aprobó el plan para el nuevo año.", "No se encontró ninguna deuda en la planta.", "Las muestras se guardaron y se contaron de nuevo.", "La empresa constituyó una provisión para el litigio."],
    "hin": ["निदेशक मंडल ने बैठक में योजना को मंजूरी दी और टिप्पणी दर्ज की।", "प्रयोगशाला में नमूनों की जांच की गई और परिणाम दिए गए हैं।", "यह राशि पिछले वर्ष से अधिक है और बाकी दावे खुले हैं।"],
    "mar": ["संचालक मंडळाने बैठकीत योजनेला मान्यता दिली आणि नोंद केली.", "प्रयोगशाळेत नमुने तपासण्यात आले आणि निकाल दिले आहेत.", "ही रक्कम मागील वर्षापेक्षा जास्त आहे आणि दावे खुले आहेत."],
}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for n in range(600):
        code = rng.choice(list(SENTENCES))
        rows.append((f"r{n}", " ".join(rng.sample(SENTENCES[code], 2)), code if rng.random() > 0.08 else rng.choice(list(SENTENCES)), code))
    return spark.createDataFrame(rows, "id string, text string, label string, truth string")


@pytest.fixture(scope="module")
def model(labelled):
    return L.train(labelled, "id", "text", "label", 400)


def test_held_out_accuracy_despite_wrong_labels(labelled, model):
    got = L.identify(labelled, "id", "text", model).join(labelled.select("id", "truth"), "id")
    assert got.where("language = truth").count() >= 0.98 * labelled.count()


def test_stretches_and_unknown(spark, model):
    a, b = SENTENCES["eng"][0], SENTENCES["fra"][0]
    rows = [("m", f"{a} {b} {a}"), ("n", "12 34"), ("e", ""), ("z", None), (None, a), ("m", f"{a} {b} {a}"), ("c", a.upper()), ("names", "Ilmarine Minerals Limited")]
    got = {r.id: r for r in L.identify(spark.createDataFrame(rows, "id string, t string"), "id", "t", model).collect()}
    assert set(got) == {"m", "n", "e", "z", "c", "names"}
    assert got["m"].language == "mixed" and [s.language for s in got["m"].stretches] == ["eng", "fra", "eng"]
    assert [got[k].language for k in "nez"] == ["unknown"] * 3 and got["c"].language == "eng"
    assert all(0 <= r.confidence <= 1 for r in got.values())


def test_label_notations(spark):
    df = spark.createDataFrame([("ENG",), (" en-GB",), ("Hi",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(L.label_code(F.col("t"))).collect()] == ["eng", "eng", "hin", "", None]


def test_training_on_nothing(spark):
    model = L.train(spark.createDataFrame([], "id string, text string, label string"), "id", "text", "label")
    assert L.identify(spark.createDataFrame([], "id string, t string"), "id", "t", model).count() == 0


def test_pair_defects(spark, model):
    full = [f"The board approved the plan of {n} lakh for the plant at Ivelle and closed the file." for n in range(30)]
    cases = {
        1: ("What was approved?", None, "empty"),
        2: ("What was approved?", " \n", "empty"),
        3: ("What was approved?", "FINAL ANSWER:", "empty"),
        4: ("What was approved?", "N/A", "empty"),
        5: ("What was approved at Ivelle?", "what was approved at ivelle", "copied_question"),
        6: ("What was approved at Ivelle?", "Q: What was approved at Ivelle?\nA: What was approved at Ivelle?", "copied_question"),
        7: ("What was approved?", "I am unable to answer this from the file.", "refusal"),
        8: ("What was approved?", "The auditor declined to comment on the plan of 5 lakh and left.", None),
        9: ("What was approved?", "The board approved the plan of 7 lakh for the pl", "truncated"),
        10: ("What was approved?", "NIL", None),
        11: ("What was approved?", "₹5,000.00 lakh", None),
        12: ("What was approved by the board?", SENTENCES["deu"][0], "other_language"),
        13: ("Answer in German: what was approved by the board?", SENTENCES["deu"][0], None),
        14: ("Answer in German: what was approved by the board?", SENTENCES["eng"][0], "other_language"),
        15: (None, "The board met.", None),
    }
    rows = [(k, q, a) for k, (q, a, _) in cases.items()] + [(100 + n, "What was approved?", t) for n, t in enumerate(full)]
    asked = spark.createDataFrame([(k, q, 1) for k, q, _ in rows] + [(999, "never answered", 1)], "request_id long, query string, n int")
    given = spark.createDataFrame([(k, a, "q") for k, _, a in rows] + [(1, None, "q"), (None, "x", "q")], "request_id long, answer string, query string")
    got = {r.request_id: r.defect for r in P.defects(asked, given, "request_id", "query", "answer", model).collect()}
    assert got == {k: d for k, (_, _, d) in cases.items() if d}
    assert P.defects(asked.limit(0), given.limit(0), "request_id", "query", "answer", model).count() == 0


def scans(spark, rows):
    return S.texts_of(spark.createDataFrame(rows, "r string, d string, p int, t string"), "r", "pages.ocr_text", "t", "d", "p", False)


WORDS = "the laboratory approved contract samples against committee remarks limited company settled depreciation machinery".split()


def noisy(spark):
    rng = random.Random(1)
    rows = [(f"c{n}", f"d{n}", 1, " ".join(rng.choice(WORDS) for _ in range(40))) for n in range(40)]
    rows += [
        ("misread1", "m1", 1, "the contr@ct was settled"),
        ("misread2", "m2", 1, "the cornmittee approved"),
        ("misread3", "m3", 1, "the labora~tory approved"),
        ("code", "m4", 1, "the ledger B2B-204 and form 16A"),
        ("cut", "b1", 1, "the labora-\ntory approved"),
        ("cut2", "b2", 2, "the labora­\n– 2 –\ntory approved"),
        ("number", "n1", 7, "the samples\n- 7 -"),
        ("edge", "n2", 3, "3\nthe samples"),
        ("figure", "n3", 3, "the\n3\nsamples and more"),
        ("title1", "t1", 1, "Alpha & Sons – Annual Report 2020-21\nthe samples"),
        ("title2", "t1", 2, "ALPHA & SONS – ANNUAL REPORT 2020-21\nthe samples"),
        ("title3", "t2", 1, "Beta Limited – Annual Report 2011-12\nthe contract"),
        ("null", "x", 1, None),
        ("blank", "x", 2, " \n"),
        (None, "x", 3, "the contr@ct"),
    ]
    return scans(spark, rows + rows[-12:-10])


def test_scan_noise(spark):
    texts = noisy(spark)
    found, fixes, titles = S.find_noise(texts)
    got = defaultdict(set)
    for r in found.collect():
        got[r.r].add(r.noise)
    assert dict(got) == {"misread1": {"misread"}, "misread2": {"misread"}, "misread3": {"misread"}, "cut": {"broken_word"}, "cut2": {"broken_word", "page_furniture"}, "number": {"page_furniture"}, "edge": {"page_furniture"}, "title1": {"page_furniture"}, "title2": {"page_furniture"}, "title3": {"page_furniture"}}
    text = {r.r: r.t for r in S.repaired(texts, fixes, titles).collect()}
    assert text["misread1"] == "the contract was settled" and text["misread2"] == "the committee approved" and text["misread3"] == "the laboratory approved"
    assert text["cut"] == "the laboratory approved" and text["cut2"] == "the laboratory approved" and text["number"] == "the samples" and text["title1"] == "the samples"
    assert text["code"] == "the ledger B2B-204 and form 16A"


def test_frequent_misreads_are_corrected(spark):
    words = spark.createDataFrame([("limited", 200_000), ("limitcd", 10_000), ("houses", 4_000), ("hovses", 3_000)], "w string, n long")
    assert {r.w: r.v for r in S.corrections(words).collect()} == {"limitcd": "limited"}


def test_letters_of_another_script_are_misreads(spark):
    words = [("दौरान", 50), ("दौlान", 3), ("प्रशिक्षण", 40), ("प्रशिकlषण", 2), ("limited", 60), ("limitеd", 2), ("पिछlे", 2), ("अनजlना", 4), ("état", 9), ("थी", 80), ("थीi", 7), ("थी|", 3)]
    fixes = S.corrections(spark.createDataFrame(words, "w string, n long"))
    assert {r.w: r.v for r in fixes.collect()} == {"दौlान": "दौरान", "प्रशिकlषण": "प्रशिक्षण", "limitеd": "limited", "थीi": "थी", "थी|": "थी"}
    page = scans(spark, [(f"c{n}", f"d{n}", 1, "बैठक के दौरान") for n in range(5)] + [("m", "d9", 1, "बैठक के दौlान")])
    found, fixes, titles = S.find_noise(page)
    assert [(r.r, r.noise) for r in found.collect()] == [("m", "misread")]
    assert {r.r: r.t for r in S.repaired(page, fixes, titles).collect()}["m"] == "बैठक के दौरान"


def test_anagram_values(spark):
    df = spark.createDataFrame([("listen", "silent", "rn", "m")], "a string, b string, c string, d string")
    r = df.select(S.anagram_value(F.col("a")), S.anagram_value(F.col("b")), S.anagram_value(F.col("c")) == S.anagram_value(F.col("d"))).first()
    assert r[0] == r[1] and not r[2]


def test_scan_noise_of_nothing(spark):
    found, fixes, titles = S.find_noise(scans(spark, [(None, None, None, None)]).limit(0))
    assert found.count() == 0 and fixes.count() == 0 and titles.count() == 0


def test_residue(spark):
    names = ["Ivelle", "Nuvela", "Orruk", "Quessa", "Rothava"]
    clean = [f"The board met at {n} and adopted ₹{k},500.00 lakh for the plant.\nSamples from {n} were kept at {k} degrees and counted again." for k, n in enumerate(names * 4, 1)]
    cases = {
        101: ("Samples from {{ place }} were kept at 4 degrees and counted again.", True),
        102: ("Samples from ________ were kept at 4 degrees and counted again.", True),
        103: ("The board met at Ivelle and adopted ₹[object Object] lakh for the plant.", True),
        104: ("Letters are made from a form in which fields such as {{client_name}} are filled before dispatch.", False),
        105: ("The clerk writes TBD in the draft ledger, but each such mark was replaced.", False),
        106: ("Please enable JavaScript to view this document.", True),
        107: ("If the page asks you to enable JavaScript, the council advises staff to use the printed copy.", False),
        108: ("Error 503: Service unavailable", True),
        109: ("Error 503 was seen 12 times at Kelmora during the move, and the service was stable again.", False),
        110: ("Lorem ipsum dolor sit amet.", True),
        111: ("The layout was tried out with lorem ipsum text, and the final figures were set.", False),
        112: ("asdf asdf qwer qwer asdf.", True),
        113: ("", False),
        114: (None, False),
        115: ("The board met at Ivelle.\nYour content goes here.", True),
    }
    rows = [(k, t, "x") for k, t in enumerate(clean)] + [(k, t, "x") for k, (t, _) in cases.items()] + [(108, cases[108][0], "x"), (None, cases[108][0], "x")]
    got = {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, t string, s string"), "doc_id", "t").collect()}
    assert got == {k for k, (_, bad) in cases.items() if bad}
    assert residue(spark.createDataFrame([], "doc_id long, t string"), "doc_id", "t").count() == 0


def test_residue_lines_are_learned_from_other_records(spark):
    clean = "The board met at Ivelle and closed the file."
    rows = [(n, f"{clean}\nError 503: Service unavailable\nKindly knock once more at desk {n}.") for n in range(4)]
    rows += [(10, f"{clean}\nKindly knock once more at desk 10."), (11, clean), (12, f"{clean}\nSamples were counted again."), (13, clean)]
    got = {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", "t").collect()}
    assert got == {0, 1, 2, 3, 10}


def test_residue_says_how_it_was_found(spark):
    from vellumine.llm.template_residue import parts

    clean = [f"The board met at {n} and adopted the plan.\nSamples were counted at {n} again." for n in ("Ivelle", "Nuvela", "Orruk")]
    rows = list(enumerate(clean))
    rows += [(10, "The board met at {{place}} and adopted the plan.")]
    # a page template without any line of the fixed lists, and one of its lines in a report
    rows += [(20 + k, f"Home > Files\nThe upstairs server closed session {k} early.\nHelp | Terms") for k in range(3)] + [(30, f"{clean[0]}\nThe upstairs server closed session 9 early.")]
    rows += [(40, "Type the summary of sales here."), (41, "Type the summary of stock here."), (50, "Error 503: Service unavailable")]
    # long pages and lines are templates too
    rows += [(60 + k, "\n".join(["The request to the server failed and the session was closed " * 6 + "."] * 30) + f"\nRetry {k}.") for k in range(2)]
    got = {r.i: r.how for r in parts(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert got == {10: "slot", 20: "page", 21: "page", 22: "page", 30: "page", 40: "line", 41: "line", 50: "single", 60: "page", 61: "page"}


def test_a_slot_needs_both_sides_in_one_record(spark):
    from vellumine.llm.template_residue import residue

    # the words before the place stand in one clean record, those after it in another: no template has both
    rows = [(1, "Fields such as {{name}} are filled by hand."), (2, "Fields such as rice were sown."), (3, "All forms are filled by hand."), (4, "Fields such as wheat were sown.")]
    assert residue(spark.createDataFrame(rows, "i long, t string"), "i", "t").count() == 0
    rows += [(5, "Fields such as dates are filled by hand."), (6, "Fields such as sums are filled by hand.")]
    assert {r.i for r in residue(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()} == {1}


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_neighbours_over_range_borders(spark, ranges):
    from vellumine.llm.pair_defects import neighbours

    rng = random.Random(ranges)
    forms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    tails = [(k, 3, "t", "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))) for k in range(60)]
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = neighbours(spark.createDataFrame([(f,) for f in forms], "m string"), spark.createDataFrame(tails, "i int, n int, tail string, m string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])
    assert len(rows) == 60
    for r in rows:
        assert r.below == max((f for f in forms if f <= r.m), default=None) and r.above == min((f for f in forms if f >= r.m), default=None)


def test_truncation_comes_from_the_neighbours(spark):
    from vellumine.llm.pair_defects import broken_off

    whole = ["The board at Ivelle approved the plan for the plant.", "The samples from Orruk were counted twice by staff."]
    cut = [(10, "The board at Nuvela approved the pl"), (11, "It rained. The samples from Quessa were counted twi"), (12, "Something else entirely was being said about")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(whole)] + cut, "i int, a string")
    assert {r.i for r in broken_off(df).collect()} == {10, 11}  # the third has no neighbour of its form


def test_the_sample_is_cut_before_it_leaves_the_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("i"))
    kept = L.hash_sample(rows, "i", 500, 20_000).count()
    assert 500 <= kept <= 900 and L.hash_sample(rows.limit(300), "i", 500, 300).count() == 300


def test_found_queries_against_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    import os

    from vellumine.llm import oracles, queries

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    for name, sql in oracles.sql().items():
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        order = [[c[0] for c in want.description].index(c) for c in columns]
        rows = sorted(tuple(str(r[k]) for k in order) for r in want.fetchall())
        assert sorted(tuple(str(r[c]) for c in columns) for r in queries.queries()[name](spark, data).collect()) == rows, name
