"""Language of documents and of the stretches of mixed documents.

Model: the mean of hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows (`sample` rows; everything else sees all rows).  Labels may be wrong: after a first fit,
training sentences whose label the model confidently contradicts are left out and the model is fitted again.  A temperature
fitted on held-out sentences calibrates the confidence; sentences under the confidence `floor`, or without enough ordinary
words (names don't count), decide nothing.  As the model is linear after averaging, a word's contribution is one vector,
kept per worker, and a sentence is a sum over words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes in use and other notations of them.
CODES = ("eng", "hin", "mar", "fra", "deu", "spa")
NOTATIONS = {"en": "eng", "hi": "hin", "mr": "mar", "fr": "fra", "fre": "fra", "de": "deu", "ger": "deu", "es": "spa"}

# A word has no digit at its sides (codes aren't words) and no more than 40 letters.
WORD = regex.compile(r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}]{1,40}(?:['’][\p{L}\p{M}]{1,40})*(?![\p{L}\p{M}\p{N}])")
# A sentence ends at its mark before white space; a blank line also parts sentences.
_END = regex.compile(r"(?<=[.!?।॥][\"'”’»)\]]*)\s+|\n[^\S\n]*\n\s*")
_KEPT_WORDS = 200_000


def label_code(label: Column) -> Column:
    """A label in the project's notation: case, edges, region suffix and two-letter codes set aside."""
    bare = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    notations = F.create_map(*[F.lit(x) for kv in NOTATIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(notations, bare), bare)


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()]


def ordinary(words: list[str]) -> int:
    """Words that aren't names: not capitalised, unless nearly all are (titles and texts in capitals)."""
    low = sum(1 for w in words if len(w) > 1 and not w[0].isupper())
    return low if low * 5 > len(words) or len(words) < 10 else sum(1 for w in words if len(w) > 1)


def speaking(words: list[str]) -> list[str]:
    """Words that tell a language: without the names inside a sentence that has ordinary words enough."""
    low = sum(1 for w in words if len(w) > 1 and not w[0].isupper())
    return words if low < 3 else [w for k, w in enumerate(words) if not k or not w[0].isupper()]


@dataclass
class Model:
    """Embeddings E (buckets x dim), softmax W (dim x codes), bias b; `temperature` and `floor` for the decision."""

    E: np.ndarray
    W: np.ndarray
    b: np.ndarray
    temperature: float = 1.0
    floor: float = 0.97
    sample: tuple[list[str], list[str]] = field(default=((), ()), repr=False)
    words: dict[str, tuple[int, np.ndarray, int]] = field(default_factory=dict, repr=False)
    table: list[np.ndarray] = field(default_factory=list, repr=False)
    sizes: list[int] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"E": self.E, "W": self.W, "b": self.b, "temperature": self.temperature, "floor": self.floor}

    def __setstate__(self, state):
        self.__init__(**state)

    def word(self, w: str) -> int:
        """The word's place in `table` (its summed logits) and `sizes` (its number of subwords)."""
        at = self.words.get(w)
        if at is None:
            if len(self.table) > _KEPT_WORDS:
                self.words, self.table, self.sizes = {}, [], []
            ids = subwords(w, len(self.E))
            at = self.words[w] = len(self.table)
            self.table.append(self.E[ids].sum(0) @ self.W)
            self.sizes.append(len(ids))
        return at

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, number of words, number of ordinary words) of each text."""
        ids, owner, words, plain = [], [], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        if len(self.table) > _KEPT_WORDS // 2:
            self.words, self.table, self.sizes = {}, [], []
        for j, t in enumerate(texts):
            found = WORD.findall(t)
            words[j] = len(found)
            plain[j] = ordinary(found)
            found = speaking(found)
            ids += [self.word(w.lower()) for w in found]
            owner += [j] * len(found)
        n = len(texts)
        if not ids:
            return np.full((n, len(self.b)), 1 / len(self.b)), words, plain
        rows, where = np.asarray(self.table)[ids], np.asarray(owner)
        size = np.bincount(where, np.asarray(self.sizes)[ids], n)
        logit = np.stack([np.bincount(where, rows[:, k], n) for k in range(rows.shape[1])], 1)
        logit = (logit / np.maximum(size, 1)[:, None] + self.b) / self.temperature
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), words, plain


def subwords(word: str, buckets: int) -> np.ndarray:
    """Hashed character 2- to 4-grams of <word>, and the word itself."""
    s = f"<{word}>"
    grams = [s] + [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)]
    return np.fromiter((zlib.crc32(g.encode()) % buckets for g in grams), dtype=np.int64)


def fit(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, floor: float = 0.97, seed: int = 11, batch: int = 32, start: Model | None = None) -> Model:
    """A model from labelled sentences by stochastic gradient descent in small batches; every tenth sentence is held out to fit the temperature.

    `start`: a model to go on from, in half as many passes.
    """
    rng, known = np.random.default_rng(seed), {}
    kept = [(ids, CODES.index(y)) for t, y in zip(texts, labels, strict=True) if y in CODES and len(ids := _features(t, buckets, known))]
    if start is None:
        E, W, b = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32), np.zeros((dim, len(CODES)), dtype=np.float32), np.zeros(len(CODES), dtype=np.float32)
    else:
        E, W, b = start.E.copy(), start.W.copy(), start.b.copy()
    flat = np.concatenate([ids for ids, _ in kept]) if kept else np.zeros(0, dtype=np.int64)
    sizes, ys = np.array([len(ids) for ids, _ in kept], dtype=np.int64), np.array([y for _, y in kept], dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    held = np.arange(0, len(kept), 10) if len(kept) >= 100 else np.zeros(0, dtype=np.int64)

    def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of the sentences, and where each begins."""
        at = np.cumsum(sizes[rows]) - sizes[rows]
        return flat[np.arange(sizes[rows].sum()) + np.repeat(firsts[rows] - at, sizes[rows])], at

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def run(rows: np.ndarray, epochs: int) -> None:
        steps, done = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            order = rng.permutation(rows)
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                ids, at = gathered(part)
                n = sizes[part][:, None]
                h = np.add.reduceat(E[ids], at) / n
                g = softmax(h @ W + b)
                g[np.arange(len(part)), ys[part]] -= 1
                step = np.float32(rate * (1 - done / steps))
                done += len(part)
                # a sentence moves each of its subwords alike; repeats of a subword within the batch add up
                move = np.repeat((step * 8 * (g @ W.T) / n).astype(np.float32), sizes[part], axis=0)
                by = np.argsort(ids.astype(np.uint16) if buckets <= 1 << 16 else ids, kind="stable")  # short integers sort by radix
                ids = ids[by]
                new = np.flatnonzero(np.diff(ids, prepend=-1))
                E[ids[new]] -= np.add.reduceat(move[by], new)
                W[:] -= step * (h.T @ g)
                b[:] -= np.float32(0.1) * step * g.sum(0)

    def probabilities(rows: np.ndarray, t: float = 1.0) -> np.ndarray:
        out = [np.zeros((0, len(CODES)))]
        for k in range(0, len(rows), 1024):
            ids, at = gathered(rows[k : k + 1024])
            out.append(softmax((np.add.reduceat(E[ids], at) / sizes[rows[k : k + 1024]][:, None] @ W + b) / t))
        return np.concatenate(out)

    train_ = np.setdiff1d(np.arange(len(kept)), held)
    if len(train_):
        run(train_, 1 if start else 2)
        p = probabilities(train_)
        run(train_[~((p.argmax(1) != ys[train_]) & (p.max(1) > 0.7))], max(1, epochs // 2) if start else epochs)
    temperature = 1.0
    if len(held):
        p = probabilities(held)
        sound = held[~((p.argmax(1) != ys[held]) & (p.max(1) > 0.9))]
        held = sound if len(sound) else held
        loss = {t: -np.log(np.maximum(probabilities(held, t)[np.arange(len(held)), ys[held]], 1e-9)).mean() for t in (0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0)}
        temperature = min(loss, key=loss.get)
    return Model(E, W, b, temperature, floor)


def _features(text: str, buckets: int, known: dict[str, np.ndarray]) -> np.ndarray:
    """The subwords of a text's words; `known` holds those of the words met so far."""
    words = [w.lower() for w in speaking(WORD.findall(text))]
    for w in words:
        if w not in known:
            known[w] = subwords(w, buckets)
    return np.concatenate([known[w] for w in words]) if words else np.zeros(0, dtype=np.int64)


def hash_sample(rows: DataFrame, ident: str, sample: int, total: int) -> DataFrame:
    """The rows of about 1.2 x `sample` idents out of `total`, with `h`, a hash of the ident: only these leave their tasks."""
    share = min(1.0, (1.2 * sample + 50) / max(1, total))
    rows = rows.withColumn("h", F.xxhash64(F.col(ident).cast("string")))
    return rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))


def train(df: DataFrame, ident: str, text: str, language: str, sample: int = 4000, each: int = 6) -> Model:
    """A model from at most `sample` labelled rows of df, chosen by a hash of `ident`, and `each` sentences of a row, from all over its text."""
    rows = df.select(F.col(ident).alias("i"), F.col(text).alias("t"), label_code(F.col(language)).alias("y")).where(F.col("y").isin(*CODES))
    total = rows.select("y").count()
    rows = hash_sample(rows, "i", sample, total).where(F.col("t").rlike("\\p{L}")).select("h", "t", "y")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, t, y in zip(batch["h"], batch["t"], batch["y"], strict=True):
                parts = sentences(t)
                out += [(h, k, s, y) for k, s in enumerate(parts[:: -(-len(parts) // each)])] if parts else []
            yield pd.DataFrame(out, columns=["h", "k", "s", "y"])

    found = rows.mapInPandas(cut, "h long, k int, s string, y string").toPandas()  # at most 1.2 x sample x each sentences
    found = found.sort_values(["h", "k", "s", "y"]).drop_duplicates(["h", "k"])
    found = found[found["h"].isin(found["h"].drop_duplicates().iloc[:sample])]
    texts, labels = list(found["s"]), list(found["y"])
    model = fit(texts, labels)
    model.sample = (texts, labels)
    return model


def widened(model: Model, texts: list[str], labels: list[str]) -> Model:
    """A model that goes on from `model`, fitted on its own sample and more labelled texts, of another kind say."""
    return fit([*model.sample[0], *texts], [*model.sample[1], *labels], start=model)


@dataclass(frozen=True)
class Rules:
    """When a sentence speaks for its language: at least `words` words, `plain` of them ordinary ones."""

    words: int = 4
    plain: int = 3


def stretches(model: Model, texts: list[str | None], rules: Rules = Rules()) -> list[list[tuple[int, int, str, float]]]:
    """For each text its stretches (start, end, language, confidence) of one language, in order.

    Sentences that decide nothing join the stretch before (or after, at the start).  A text without words has none.
    """
    spans, flat, owner = [], [], []
    for j, t in enumerate(texts):
        for s, a, b in _located(t or ""):
            spans.append((a, b))
            flat.append(s)
            owner.append(j)
    p, words, plain = model.scores(flat)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    held: dict[int, tuple[int, int]] = {}
    for k, j in enumerate(owner):
        a, b = spans[k]
        best = int(p[k].argmax())
        sure = p[k, best] >= model.floor and words[k] >= rules.words and plain[k] >= rules.plain
        rows = out[j]
        if sure:
            if rows and rows[-1][2] == CODES[best]:
                a0, _, code, c = rows[-1]
                n = b - a0
                rows[-1] = (a0, b, code, c + (p[k, best] - c) * (b - a) / max(1, n))
            else:
                rows.append((min(a, held.pop(j, (a, b))[0]), b, CODES[best], float(p[k, best])))
        elif rows:
            rows[-1] = (rows[-1][0], b, *rows[-1][2:])
        else:
            held.setdefault(j, (a, b))
    return out


def _located(text: str) -> Iterator[tuple[str, int, int]]:
    at = 0
    for m in _END.finditer(text):
        if m.start() > at and not text[at : m.start()].isspace():
            yield text[at : m.start()], at, m.start()
        at = m.end()
    if at < len(text) and not text[at:].isspace():
        yield text[at:], at, len(text)


def whole(model: Model, text: str | None, parts: list[tuple[int, int, str, float]]) -> tuple[str, float]:
    """(code, confidence) of a text from its stretches: one language, `mixed`, or `unknown` if it has no words."""
    codes = {x[2] for x in parts}
    if len(codes) > 1:
        return "mixed", min(max(x[3] for x in parts if x[2] == c) for c in codes)
    if codes:
        return codes.pop(), max(x[3] for x in parts)
    found = WORD.findall(text or "")
    if not any(len(w) > 2 and not (w.isupper() and len(w) < 4) for w in found):  # no words, or abbreviations beside figures
        return "unknown", 1.0
    p, _, plain = model.scores([text])
    if not plain[0] and len(found) < 4:  # a name tells no language
        return "unknown", 1.0 - float(p[0].max())
    return CODES[int(p[0].argmax())], float(p[0].max())


def identify(df: DataFrame, ident: str, text: str, model: Model, rules: Rules = Rules()) -> DataFrame:
    """`ident`, language, confidence, and stretches (start, end, language, confidence) of every row's text.

    Null, blank and wordless texts are `unknown` with no stretches.  Rows with a null `ident` do not come out; repeated rows
    of an `ident` come out once.  An empty table gives an empty result.
    """
    rows = df.select(F.col(ident).alias("i"), F.col(text).alias("t")).where("i is not null")
    kind = rows.schema["i"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets x dim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["t"]]
            parts = stretches(shared.value, texts, rules)
            done = [whole(shared.value, t, p) for t, p in zip(texts, parts, strict=True)]
            keys = ("start", "end", "language", "confidence")
            yield pd.DataFrame({"i": batch["i"], "language": [d[0] for d in done], "confidence": [d[1] for d in done], "stretches": [[dict(zip(keys, x, strict=True)) for x in p] for p in parts]})

    schema = f"i {kind}, language string, confidence double, stretches array<struct<start:int,end:int,language:string,confidence:double>>"
    return rows.mapInPandas(run, schema).dropDuplicates(["i"]).withColumnRenamed("i", ident)
