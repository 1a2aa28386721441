"""Blocks of questions against all rows: scores that are sums over shared words, of which no task passes on more than the k best.

A pass over the rows for each block; what a pass hands on is k rows a question and task, however many rows share a word with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.functions.fuzzy import matched
from vellumine.session import written

_ASKED, _ROWS = 512, 4096  # questions and rows that meet at once in a worker
_SLACK = 1e-9  # scores are rounded to nine digits

# (word, place, value) of a side's words, sorted by word
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def blocks(asked: DataFrame, block: int, name: str) -> Iterator[list[Row]]:
    """The rows of `asked` (query_id, ...) in blocks of about `block`, one at a time on the driver."""
    count = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int"))
    numbered = written(numbered.groupBy("block").agg(F.collect_list(F.struct(*asked.columns)).alias("asked")), name)
    for n in range(count):
        row = numbered.where(F.col("block") == n).first()
        if row is not None:
            yield row["asked"]


def side(words: np.ndarray, places: np.ndarray, values: np.ndarray) -> Side:
    order = np.argsort(words, kind="stable")
    return words[order], places[order], values[order]


def products(left: Side, right: Side, words: int, shape: tuple[int, int], kind: type = np.float64) -> np.ndarray:
    """Sums over the words of left times right values, for all pairs of places; each word stands once at a place.

    Words that stand at many places of both sides meet as a matrix product, the others pair by pair.
    """
    out = np.zeros(shape, dtype=kind)
    ends = [np.searchsorted(s[0], np.arange(words + 1)) for s in (left, right)]
    counts = [np.diff(e) for e in ends]
    often = counts[0] * counts[1] > shape[0] * shape[1] // 100
    if often.any():
        column = np.cumsum(often) - 1
        dense = []
        for (w, place, value), size in ((left, shape[0]), (right, shape[1])):
            m = np.zeros((size, int(often.sum())), dtype=kind)
            at = often[w]
            m[place[at], column[w[at]]] = value[at]
            dense.append(m)
        out += dense[0] @ dense[1].T
    for t in np.flatnonzero((counts[0] > 0) & (counts[1] > 0) & ~often):
        (a, b), (c, d) = (ends[0][t], ends[0][t + 1]), (ends[1][t], ends[1][t + 1])
        if b - a == 1:
            out[left[1][a], right[1][c:d]] += left[2][a] * right[2][c:d]
        else:
            out[np.ix_(left[1][a:b], right[1][c:d])] += np.outer(left[2][a:b], right[2][c:d])
    return out


class Best:
    """The k best rows of each question so far, by score, then id; `cut` is the score that another row must reach."""

    def __init__(self, size: int, k: int):
        self.k, self.size, self.cut, self.parts, self.held = k, size, np.full(size, -np.inf), [], 0
        self.most = 2 * size * k

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, more: dict[str, np.ndarray]) -> None:
        if not len(q):
            return
        self.parts.append(pd.DataFrame({"q": q, "score": np.round(score, 9), "id": ids} | more))
        self.held += len(q)
        if self.held > self.most:
            self.rows()
            self.most = max(2 * self.held, 2 * self.size * self.k)

    def rows(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        rows = pd.concat(self.parts, ignore_index=True).sort_values(["q", "score", "id"], ascending=[True, False, True])
        place = rows.groupby("q").cumcount()
        rows, last = rows[place < self.k], rows[place == self.k - 1]
        self.cut[last["q"].to_numpy()] = last["score"].to_numpy() - _SLACK
        self.parts, self.held = [rows], len(rows)
        return rows


def reached(scores: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that are among the k best of their line, with all ties, and reach the line's cut; -inf never is."""
    cut = np.maximum(cut, np.finfo(np.float64).min)
    lines = np.flatnonzero(cut == np.finfo(np.float64).min)  # nothing to hold against yet
    if len(lines) and scores.shape[1] > k:
        cut = cut.copy()
        cut[lines] = np.maximum(cut[lines], np.partition(scores[lines], scores.shape[1] - k, axis=1)[:, -k] - _SLACK)
    return np.nonzero(scores >= cut[:, None])


def known_words(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number in `known`) of the words of a list column, those that are known."""
    row, number = pc.list_parent_indices(words).to_numpy(zero_copy_only=False), pc.index_in(pc.list_flatten(words), value_set=known)
    at = pc.is_valid(number).to_numpy(zero_copy_only=False)
    return row[at].astype(np.int64), number.filter(pc.is_valid(number)).to_numpy(zero_copy_only=False).astype(np.int64)


def block_topk(rows: DataFrame, ids: list, k: int, meet: Callable, query_id: T.DataType, more: str = "") -> DataFrame:
    """(query_id, id, score, and `more`): the k best of each task's rows for a block's questions `ids`.

    meet(batch, best): adds what a batch of rows (at most 4,096 of them) has to the Best.
    """
    schema = T._parse_datatype_string(f"query_id {query_id.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double{more}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                meet(batch.slice(start, _ROWS), best)
        out = best.rows()
        if out is not None:
            names = pd.Series(ids)
            out = out.assign(query_id=names.take(out["q"]).to_numpy())
            kinds = to_arrow_schema(schema)
            for start in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pandas(out.iloc[start : start + 10_000], schema=kinds, preserve_index=False)

    return rows.mapInArrow(run, schema)


def asked_parts(words: np.ndarray, places: np.ndarray, values: np.ndarray, size: int) -> list[tuple[int, int, Side]]:
    """(first, behind, side) of the questions in runs of at most 512; places count from each run's first."""
    out = []
    for first in range(0, size, _ASKED):
        at = (places >= first) & (places < first + _ASKED)
        out.append((first, min(size, first + _ASKED), side(words[at], places[at] - first, values[at])))
    return out


def sums(known: list[str], parts: list[tuple[int, int, Side]]) -> Callable:
    """What block_topk takes for sums of a question's values times f gain / (f + norm), f being how often a row (id, t, gain, norm) has the word."""
    value_set = pa.array(known, pa.string())

    def meet(batch: pa.RecordBatch, best: Best) -> None:
        size, names = batch.num_rows, batch.column("id").to_numpy(zero_copy_only=False)
        gain, norm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gain", "norm"))
        row, word = known_words(batch.column("t"), value_set)
        codes, f = np.unique(word * size + row, return_counts=True)
        word, row = codes // size, codes % size
        right = (word, row, f * gain[row] / (f + norm[row]))
        for first, behind, left in parts:
            shape = (behind - first, size)
            scores = products(left, right, len(known), shape)
            if (left[2] <= 0).any():  # a score doesn't tell whether a word is shared
                one = [(w, p, np.ones(len(v), dtype=np.float32)) for w, p, v in (left, right)]
                met = products(one[0], one[1], len(known), shape, np.float32) > 0
            else:
                met = scores > 0
            scores[~met] = -np.inf
            q, at = reached(scores, best.cut[first:behind], best.k)
            best.add(q + first, scores[q, at], names[at], {})

    return meet


def shares(known: list[str], pairs: dict[str, tuple[np.ndarray, np.ndarray]], terms: int, parts: list[tuple[int, int, Side]], n: np.ndarray, least: np.ndarray) -> Callable:
    """What block_topk takes for evidence rescue: counts of a question's terms that a row (id, doc, section) meets.

    pairs: (word, term) numbers, sorted by word, that match (near) or of which the word holds the term (held); n: terms of each question; least: of
    which it must meet as many in text or section, or have in the text.
    """
    value_set = pa.array(known, pa.string())
    ends = {name: np.searchsorted(w, np.arange(len(known) + 1)) for name, (w, _) in pairs.items()}

    def met(row: np.ndarray, word: np.ndarray, kind: str, size: int) -> Side:
        """(term, row, 1) of the terms that a row's words meet, each once."""
        first, count = ends[kind][word], ends[kind][word + 1] - ends[kind][word]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        codes = np.unique(pairs[kind][1][at] * size + np.repeat(row, count))
        return codes // size, codes % size, np.ones(len(codes), dtype=np.float32)

    def meet(batch: pa.RecordBatch, best: Best) -> None:
        size, names = batch.num_rows, batch.column("id").to_numpy(zero_copy_only=False)
        doc, section = (known_words(batch.column(c), value_set) for c in ("doc", "section"))
        rights = [met(*doc, "near", size), met(*section, "near", size), met(*doc, "held", size)]
        for first, behind, left in parts:
            d, s, p = (products(left, right, terms, (behind - first, size), np.float32) for right in rights)
            q, at = np.nonzero(np.maximum(np.maximum(d, s), p) >= least[first:behind, None])
            d, s, p = (x[q, at].astype(np.float64) / n[q + first] for x in (d, s, p))
            score = np.round(np.maximum(np.maximum(d, s), p) * 100 + s * 20 + p * 15, 9)
            good = score >= best.cut[q + first]
            best.add((q + first)[good], score[good], names[at[good]], {"doc_overlap": d[good], "section_overlap": s[good], "phrase_overlap": p[good]})

    return meet


def met_pairs(schema: T.StructType, fuzzy: bool, threshold: float) -> Callable:
    """What mapInArrow takes for rows (id, doc, section, asked): overlaps and lexical score of a chunk with each of its questions (query_id, terms, topics).

    A pair of words is scored once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        near: dict[str, set[str]] = {}
        seen: dict[str, set[str]] = {}
        for batch in batches:
            out = []
            for chunk, doc, section, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "doc", "section", "asked")), strict=True):
                words, titles = set(doc), set(section)
                both, text, held = words | titles, "\n".join(doc), {}
                for a in {x for q in asked for x in q["terms"]}:
                    known, new = near.setdefault(a, set()), both - seen.setdefault(a, set())
                    known.update(b for b in new if matched(a, b, threshold, fuzzy))
                    seen[a] |= new
                    held[a] = (not known.isdisjoint(words), not known.isdisjoint(titles), len(a) >= 5 and a in text)
                for q in asked:
                    met = [held[a] for a in q["terms"]]
                    overlap = [sum(x) / len(met) for x in zip(*met, strict=True)] or [0.0, 0.0, 0.0]
                    out.append((q["query_id"], chunk, *overlap, sum(3.0 if x in titles else 1.0 if x in words else 0.0 for x in q["topics"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return run
