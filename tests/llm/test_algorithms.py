from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.llm import boundary_split as B
from vellumine.llm import merkle as M
from vellumine.llm import mixing, packing, ranks
from vellumine.llm.site_lines import site_lines, suffix_array, suffixes, without_lines
from vellumine.llm.top_per_group import order_code, top_per_group


def joined(text, spans):
    out = ""
    for a, b in spans:
        out = out[:a] + text[a:b]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,;।का", max_size=400), st.integers(10, 60), st.integers(0, 4))
def test_pieces_keep_the_text_and_the_limit(text, limit, overlap):
    spans = B.cut_points(text, limit, overlap)
    assert joined(text, spans) == text
    assert all(b - a <= limit for a, b in spans)
    assert all(a2 <= b1 and b2 > b1 for (_, b1), (a2, b2) in zip(spans, spans[1:], strict=False))


def test_range_maximum_against_brute_force():
    rng = random.Random(1)
    text = "".join(rng.choice("ab .\n,") for _ in range(3000))
    table = B.StrongestCut(text, 500)
    for _ in range(300):
        lo = rng.randrange(len(text))
        hi = min(len(text) - 1, lo + rng.randrange(500))
        inside = [(s, p) for p, s in zip(table.at, table.strength, strict=True) if lo <= p <= hi]
        assert table.query(lo, hi) == (max(inside)[1] if inside else None)


def test_split_rows(spark):
    long = "One sentence here. " * 300
    rows = [("a", long, 1), ("a", long, 1), ("b", "short", 2), ("c", "", 3), ("d", None, 4), (None, "x", 5), ("e", "x" * 50_000, 6)]
    got = B.split_oversized(spark.createDataFrame(rows, "id string, text string, piece int"), "id", "text").collect()
    by = defaultdict(dict)
    for r in got:
        by[r.id][r.piece] = r
    assert set(by) == {"a", "b", "c", "e"} and all(len(r.text) <= 1800 for r in got)
    for k, text in (("a", long), ("b", "short"), ("c", ""), ("e", "x" * 50_000)):
        whole = ""
        for n in range(1, len(by[k]) + 1):
            whole = whole[: by[k][n].start] + by[k][n].text
        assert whole == text and by[k][1].pieces == len(by[k])
    assert all(r.text.endswith(". ") for r in got if r.id == "a" and r.piece < r.pieces)
    with pytest.raises(ValueError):
        B.cut_points and B.split_oversized(spark.range(0), "id", "id", 10, 5)


def brute_top(rows, n):
    best, by = {}, defaultdict(list)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[i] = max(best.get(i, (s, g)), (s, g))
    for i, (s, g) in best.items():
        by[g].append((-s, i))
    return {(g, i) for g, v in by.items() for _, i in sorted(v)[:n]}


@pytest.mark.parametrize(("n", "fan"), [(3, 512), (1, 2), (5, 4)])
def test_top_per_group(spark, n, fan):
    rng = random.Random(n)
    scores = [0.0, -0.0, 1.0, 1.0, 2.5, -7.0, float("inf"), float("-inf"), 1e-300, float("nan"), None]
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([rng.randrange(-500, 500), rng.randrange(-(2**63), 2**63)]), rng.choice([*scores, rng.random()])) for _ in range(800)]
    rows += rows[:50] + [("a", None, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, i long, s double, need string")
    got = {(r.g, r.i) for r in top_per_group(df, "g", "s", "i", n, 4, fan).collect()}
    assert got == brute_top(rows, n)


def test_top_ties_and_empty(spark):
    ties = spark.createDataFrame([("g", i, 1.0) for i in range(1000)], "g string, i long, s double")
    assert sorted(r.i for r in top_per_group(ties, "g", "s", "i", 7, 3, 8).collect()) == list(range(7))
    assert top_per_group(ties.limit(0), "g", "s", "i", 3).count() == 0


def test_order_code(spark):
    values = [float("-inf"), -2.5, -1e-300, 0.0, 1e-300, 1.0, 1.0000000000000002, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "s double").select("s", order_code(F.col("s")).alias("c"))
    codes = [r.c for r in df.orderBy("s").collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)


def pages(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, source string, text string")


def test_site_lines(spark):
    rows = [(f"d{k}", 1, "s", f"Body {'abcdefghij'[k]} word\nFollow us, reader {k}!\n12\nAll rights: RESERVED") for k in range(8)]
    rows += [(f"d{k}", 2, "s", f"unlike {'klmnopqrst'[k]} text") for k in range(8)] + [("d0", 3, "s", "follow   us reader\n\nother"), ("e0", 1, "t", "Follow us, reader"), ("f", 1, None, "Follow us, reader"), ("d1", 9, "s", None), ("d1", 8, "s", "")]
    df = pages(spark, rows + rows[:3])
    keys = ["document_id", "page_number"]
    found = site_lines(df, keys, "document_id", "source", "text")
    got = {tuple(r) for r in found.collect()}
    assert got == {(f"d{k}", 1, n) for k in range(8) for n in (2, 4)} | {("d0", 3, 1)}
    cleaned = {(r.document_id, r.page_number): r.text for r in without_lines(df, keys, "text", found).collect()}
    assert cleaned["d0", 1] == "Body a word\n12" and cleaned["d0", 3] == "\nother" and cleaned["d1", 9] is None and len(cleaned) == len({(r[0], r[1]) for r in rows})
    assert site_lines(df.limit(0), keys, "document_id", "source", "text").count() == 0


def test_site_lines_come_from_the_suffix_array(spark, monkeypatch):
    keys = ["document_id", "page_number"]
    rows = [(f"d{k}", 1, "s", f"own {'abcdefghij'[k]}\nLegal notice\nAll rights kept\nmore {'klmnopqrst'[k]}") for k in range(10)]
    df = pages(spark, rows)
    found = {(r.document_id, r.line_no) for r in site_lines(df, keys, "document_id", "source", "text").collect()}
    assert found == {(f"d{k}", n) for k in range(10) for n in (2, 3)}
    from vellumine.llm.site_lines import site_blocks

    blocks = {(r.lines, r.documents, r.places) for r in site_blocks(df, "document_id", "document_id", "source", "text").collect()}
    assert blocks == {(2, 10, 10), (1, 10, 10)}  # the block of two lines, and its second line where the block goes no further
    # without neighbours in sorted order nothing repeats
    monkeypatch.setattr("vellumine.llm.site_lines.suffix_array", lambda rows, window: rows.withColumn("common", F.lit(0)).limit(0))
    assert site_lines(df, keys, "document_id", "source", "text").count() == 0


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_suffix_array_over_range_borders(spark, parts):
    # however the suffixes are cut into ranges, the common prefixes are those of one sorted list
    rng = random.Random(parts)
    lines = [[rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(30)]
    df = spark.createDataFrame([(f"d{k:02}", "st"[k % 2], f"d{k:02}", "\n".join(t)) for k, t in enumerate(lines)], "k0 string, s string, d string, t string")
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r.d, r.line_no, r.common) for r in suffix_array(suffixes(df, 4), 4).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])
    every = [("st"[k % 2], tuple(t[n : n + 4]), f"d{k:02}", n + 1) for k, t in enumerate(lines) for n in range(len(t))]

    def shared(a, b):
        return next((n for n, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1]))) if a[0] == b[0] else 0

    best = [(x[2], x[3], max(shared(x, y) for y in every if y is not x)) for x in every]
    assert got == sorted(x for x in best if x[2])


def test_site_lines_need_both_thresholds(spark):
    rows = [(f"d{k}", 1, "s", "same line" if k < 3 else f"x{'abcdefghijklmnopqrstuvwxyz'[k]} y") for k in range(10)]
    rows += [(f"b{k}", 1, "big", "same line" if k < 5 else f"w {'abcdefghijklmnopqrstuvwxyz'[k]}") for k in range(26)]
    found = site_lines(pages(spark, rows), ["document_id"], "document_id", "source", "text")
    assert found.count() == 0


def test_long_repeated_blocks(spark):
    block = "\n".join("line " + "abcdefghijklmnopqrst"[k] for k in range(20))
    found = site_lines(pages(spark, [(f"d{k}", 1, "s", block) for k in range(5)]), ["document_id"], "document_id", "source", "text", window=3)
    assert found.count() == 100


def test_merkle_texts(spark):
    same = ["Total: 1,234.50 paid", "TOTAL 1,234.50 – paid!", "to​tal\n1,234.50 paid", "“Total: 1,234.50 paid”"]
    fields = ["Unit: Ivelle; Year: 2020-21", "year: 2020-21 | UNIT: Ivelle"]
    others = ["Total: 1,2345.0 paid", "Unit: 2020-21; Year: Ivelle", "", None, "Straße", "STRASSE"]
    rows = [(f"{n:02d}", t) for n, t in enumerate([*same, *fields, *others])] + [("00", same[0])]
    df = M.text_nodes(spark.createDataFrame(rows, "i string, t string"), "t")
    got = {r.i: (r.kept_id, r.copies) for r in M.collapse(df, "i", F.col("__h"), F.col("__c")).collect()}
    assert got == {"00": ("00", 4), "01": ("00", 4), "02": ("00", 4), "03": ("00", 4), "04": ("04", 2), "05": ("04", 2), "06": ("06", 1), "07": ("07", 1), "08": ("08", 1), "10": ("10", 2), "11": ("10", 2)}
    assert M.collapse(df.limit(0), "i", F.col("__h"), F.col("__c")).count() == 0


def test_merkle_nested_records(spark):
    df = spark.sql("select 1 as i, struct('A' as x, array('p', 'q') as y, map('k', 'V ') as z) as r union all select 2, struct('a', array('p', 'q'), map('k', 'v')) union all select 3, struct('a', array('q', 'p'), map('k', 'v')) union all select 4, null")
    h, c = M.node(F.col("r"), df.schema["r"].dataType)
    got = {r.i: r.kept_id for r in M.collapse(df, "i", h, c).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_hash_collision_is_told_apart(spark):
    df = spark.createDataFrame([(1, "h", "a"), (2, "h", "b"), (3, "h", "a")], "i long, h string, c string")
    got = {r.i: (r.kept_id, r.copies) for r in M.collapse(df, "i", F.col("h"), F.col("c")).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1)}


def test_hash_notations(spark):
    df = spark.createDataFrame([(" AB:cd-12\t",), ("sha256: abcd12",), ("",), (None,), ("--",)], "t string")
    assert [r[0] for r in df.select(M.hex_code(F.col("t"))).collect()] == ["abcd12", "abcd12", None, None, None]


def test_ranks_are_exact(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    by = defaultdict(list)
    for r in ranks.ranked(df, ["k"], F.col("id"), 5, 8).collect():
        by[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_uses_every_item_once_within_capacity(histogram):
    used = Counter()
    for pattern, repeats in packing.plan(histogram, 50):
        assert sum(n * k for n, k in pattern.items()) <= 50 and repeats > 0
        for n, k in pattern.items():
            used[n] += k * repeats
    assert used == Counter(histogram)


def test_pack_rows(spark):
    rng = np.random.default_rng(2)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(1, 300, 2000))}
    rows = [*sizes.items(), (5000, 0), (5001, None), (None, 3), (5002, 1000), (0, sizes[0]), (5003, -1)]
    got = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "id long, n long, rank int"), "id", "n", {"x": 128, "y": 400}).collect()
    for profile, capacity in (("x", 128), ("y", 400)):
        rows = [r for r in got if r.profile == profile]
        fill, whole = Counter(), Counter()
        for r in rows:
            fill[r.container] += r.n
            whole[r.id] += r.n
        assert max(fill.values()) <= capacity
        assert whole == Counter(sizes | {5000: 0, 5002: 1000})
        assert {r.id for r in rows if r.pieces > 1} == {i for i, n in (sizes | {5002: 1000}).items() if n > capacity}
        assert sum(fill.values()) / (len(fill) * capacity) > 0.97
    assert packing.pack(spark.createDataFrame([], "id long, n long"), "id", "n", {"x": 5}).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 6)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_subset_sums_are_the_nearest(items, budget):
    lengths, counts = [n for n, _ in items], [c for _, c in items]
    taken = mixing.nearest_subset(lengths, counts, budget)
    reach = {0}
    for n, c in items:
        reach = {s + n * k for s in reach for k in range(c + 1)}
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(s for s in reach if s <= budget)


def test_mixture(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", "c", None][int(rng.integers(4))], f"t{i}", int(rng.integers(1, 90))) for i in range(900)] + [(9000, "b", "t-copy", 50), (9001, "b", "t-copy", 50), (9002, "a", None, 4), (None, "a", "z", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 1), ("none", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    selection, plan = mixing.mixture(df, targets, "doc_id", "source", "text", "tokens")
    report = {r.source: r for r in mixing.source_report(selection, plan).collect()}
    own = Counter()
    for _, s, _, n in rows[:-1]:
        own[s] += n
    total = own["a"] + own["b"] + own["c"]
    assert {s for s, r in report.items() if r.short} == {s for s, share, cap in (("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 1), ("none", 0.1, 5)) if cap * own[s] < share * total}
    for s in ("a", "b", "c"):
        assert 0 <= report[s].budget - report[s].reached_tokens <= 2
    chosen = selection.collect()
    cap = {"a": 1, "b": 3, "c": 1}
    assert all(1 <= r.repeats <= cap[r.source] for r in chosen) and 9001 not in {r.doc_id for r in chosen}
    again = mixing.mixture(df, targets, "doc_id", "source", "text", "tokens")[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen))
    empty = mixing.mixture(df.limit(0), targets, "doc_id", "source", "text", "tokens")
    assert empty[0].count() == 0 and mixing.source_report(*empty).count() == 4


def test_the_solver_places_most_items():
    rng = random.Random(3)
    histogram = Counter(min(900, int(rng.lognormvariate(5, 0.7)) + 3) for _ in range(8000))
    runs, left = packing.solved(dict(histogram), 2048)
    assert left.sum() <= 0.2 * sum(histogram.values())
    containers = sum(r for _, r in [*runs, *packing.greedy(left, 2048)])
    assert sum(n * c for n, c in histogram.items()) / (containers * 2048) > 0.98


def test_kept_shares(spark):
    docs = [(k, s, f"{s}{k}", n) for k, (s, n) in enumerate([("a", 7)] * 30 + [("b", 5)] * 8 + [("b", 3)] * 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.source_report(*mixing.mixture(df, targets, "doc_id", "source", "text", "tokens", keep=True)).collect()}
    # b can give 2 x 55 = 110 tokens, which is 0.625 of the largest mixture: 176 tokens
    assert (rows["a"].wanted_share, rows["b"].wanted_share, rows["none"].wanted_share) == (0.3 / 0.8, 0.5 / 0.8, 0.0)
    assert rows["b"].reached_tokens == 110 and 66 - 7 < rows["a"].reached_tokens <= 66 and rows["none"].reached_tokens == 0


def test_lists_with_invisible_characters_are_lists(spark):
    rows = [("a", "Unit: Aba | Opening balance: 1.5"), ("b", "\ufeffOpening balance: 1.5 | Unit: ABA"), ("c", "Unit: Aba | Opening balance: 2.5"), ("d", "x" * 200 + ": 1; y: 2"), ("e", "Y: 2; " + "X" * 200 + ": 1")]
    df = M.text_nodes(spark.createDataFrame(rows, "id string, t string"), "t")
    kept = {r.id: r.kept_id for r in M.collapse(df, "id", F.col("__h"), F.col("__c")).collect()}
    assert kept == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}
