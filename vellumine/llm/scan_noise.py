"""Noise of scanned and typeset pages: cut words, misread characters, page furniture; and the repaired text.

Misread words: every word has an anagram value, the sum of its characters' hashes, so that one confusion (a letter taken for
a mark, a digit or a letter of another script, a stray mark, rn for m) shifts it by a known difference.  Words with marks,
digits or letters of another script among their letters, and rare words, are joined by value plus difference with frequent
words; a hit is confirmed letter by letter, and of several the most frequent wins.  Cut words: the halves joined must not be
rarer than the halves with a hyphen.  Furniture: lines of a document's running title, whose kinds are learned from lines that
recur on pages of one document, and lines that say the page's number, at the page's edges or with the word or signs of a page
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.merkle import INVISIBLE
from vellumine.session import written

# Words of page numbers, marks that scanning leaves in words, and letters it takes for others.
PAGE_WORDS = "page|seite|página|pagina|पृष्ठ|पान|p\\.|s\\."
MARKS = "~^=¬¦|_@+�§¤#*<>{}\\[\\]"
CONFUSED = (("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("l", "i"), ("i", "l"), ("ii", "u"), ("u", "ii"), ("nn", "m"), ("ri", "n"), ("n", "ri"), ("tl", "d"), ("f", "t"), ("t", "f"), ("o", "e"), ("e", "o"), ("b", "h"), ("h", "b"), ("g", "q"), ("q", "g"), ("in", "m"), ("m", "in"))

_NUMBER = f"(?iU)^(?:[-–—\\[(|]\\s*)?((?:{PAGE_WORDS})\\s*)?(\\p{{Nd}}{{1,4}})(?:\\s*(?:/|of|von|de|sur|पैकी|में से|\\()\\s*\\p{{Nd}}{{1,4}}\\)?)?(?:\\s*[-–—\\])|])?$"
_BARE = "^\\p{Nd}{1,4}$"
_CUT = "([\\p{L}\\p{M}]+)([-‐­])[^\\S\\n]*\\n\\s*([\\p{L}\\p{M}]+)"
_SEPARATED = " [–—|·-] "
_ENDED = "[.!?।॥;:,]$"
_SPLIT = "[ \\t\\n\\r\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000/.,;:!?()\"“”„'’‘«»–—…%₹•।॥&]+"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, "\\s+", " "))), lambda line: line != "")


def is_page_number(line: Column, page: Column) -> Column:
    """The line says this page's number (any number where the page's is not known)."""
    number = F.regexp_extract(line, _NUMBER, 2)
    return F.coalesce((number != "") & (page.isNull() | (F.try_to_number(number, F.lit("9999")) == page)), F.lit(False))


def number_lines(lines: Column, page: Column, anywhere: Column) -> Column:
    """The page-number lines among the lines of a page: bare numbers count at its edges (beside titles) only."""
    n = F.size(lines)

    def title(i: Column) -> Column:
        line = F.get(lines, i)
        return line.rlike(_SEPARATED) & ~line.rlike(_ENDED)

    def edge(i: Column) -> Column:
        return (i == 0) | (i == n - 1) | ((i == 1) & title(F.lit(0))) | ((i == n - 2) & title(n - 1))

    return F.filter(lines, lambda line, i: is_page_number(line, page) & (anywhere | ~line.rlike(_BARE) | edge(i)))


def title_kind(line: Column) -> Column:
    """What a title line says after its last dash, without figures and codes."""
    bare = F.regexp_replace(F.lower(line), "\\s+[·|]\\s+\\S+$", "")
    return F.regexp_replace(F.regexp_extract(bare, "^.* [–—|-] (.+)$", 1), "\\p{Nd}+", "0")


def is_titleish(line: Column) -> Column:
    """A separated line that neither ends a sentence nor goes on from one, nor is a list of `label: value` fields."""
    return line.rlike(_SEPARATED) & ~line.rlike(_ENDED) & ~line.rlike("[-‐­]$|^\\p{Ll}|\\p{L}\\s*:.*[|;].*\\p{L}\\s*:")


def title_lines(marked: DataFrame, documents: int = 2, edge: float = 0.8) -> DataFrame:
    """(d, line) of the lines (lower case) that are a document's running title.

    A titleish line is one if it stands on two or more pages of its document, or if its kind does so somewhere, or stands at
    the edge of pages nearly always and in at least `documents` documents.
    """
    lines = marked.where("d is not null").select("d", "p", F.explode("led").alias("x")).select("d", "p", "x.line", "x.edge").where(F.col("line").rlike("[–—·-]"))
    lines = lines.groupBy("d", "p", "line").agg(F.max("edge").alias("edge")).groupBy("d", "line").agg(F.count(F.lit(1)).alias("pages"), F.sum("edge").alias("edges"), F.count("edge").alias("seen"))
    lines = written(lines.withColumn("kind", title_kind(F.col("line"))), "scan-titles")
    kinds = lines.where(F.col("kind").rlike("\\p{L}{3}|[\u0900-\u0D7F]{3}")).groupBy("kind").agg(F.count_distinct("d").alias("docs"), F.max("pages").alias("pages"), F.sum("edges").alias("edges"), F.sum("seen").alias("seen"))
    kinds = kinds.where((F.col("docs") >= documents) & ((F.col("pages") > 1) | (F.col("seen") > 0)) & (F.coalesce("edges", F.lit(0)) >= edge * F.coalesce("seen", F.lit(0)))).select("kind")
    return lines.where("pages > 1 and coalesce(edges, 0) > 0").select("d", "line").unionByName(lines.join(kinds, "kind").select("d", "line")).distinct()


def words_of(text: Column) -> Column:
    """Distinct lower-case words with their noise: cut words joined, three characters or more (two where a letter bears a sign), with a letter."""
    flat = F.regexp_replace(text, "[-‐­][ \\t\\r]*\\n\\s*|" + INVISIBLE, "")
    words = F.array_distinct(F.split(F.lower(flat), _SPLIT))
    return F.filter(words, lambda w: ((F.length(w) >= 3) & w.rlike("\\p{L}")) | w.rlike("^\\p{L}\\p{M}$"))


def anagram_value(word: Column) -> Column:
    """A sum over characters: equal for anagrams, and shifted by a fixed difference by a confusion."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + F.pmod(F.xxhash64(c), F.lit(1 << 40)))


def _one(c: str | Column) -> Column:
    return anagram_value(F.lit(c) if isinstance(c, str) else c)


def _turns(old: str, new: str) -> Column:
    """Each place of `old` in the word w turned into `new`: array of (v, value)."""
    w, n, shift = F.col("w"), len(old), _one(new) - _one(old)

    def turn(k: Column) -> Column:
        return F.struct(F.concat(F.substring(w, F.lit(1), k - 1), F.lit(new), F.substring(w, k + n, F.length(w))).alias("v"), (F.col("value") + shift).alias("value"))

    return F.transform(F.filter(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(w, k, F.lit(n)) == old), turn)


def _foreign(text: Column, word: Column) -> Column:
    """The text has a letter of another script than most of the word's letters are of (Latin or Devanagari)."""
    latin, deva = (F.length(F.regexp_replace(word, f"\\P{{Is{x}}}", "")) for x in ("Latin", "Devanagari"))
    other = [text.rlike(f"[\\p{{L}}&&[^\\p{{Is{x}}}\\p{{IsCommon}}]]") for x in ("Latin", "Devanagari")]
    return F.when(latin > deva, other[0]).when(deva > latin, other[1]).otherwise(False)


def corrections(words: DataFrame, ratio: int = 15, least: int = 10) -> DataFrame:
    """(w, v): a misread word and the frequent word it is, from (w, n), the words and the number of texts with each."""
    foreign = _foreign(F.col("w"), F.col("w"))
    odd_word = F.col("w").rlike(f"[{MARKS}]") | F.col("w").rlike("\\p{L}\\p{M}*\\p{Nd}|\\p{Nd}\\p{L}") | foreign
    pure = F.col("w").rlike("^[\\p{L}\\p{M}-]+$") & ~foreign
    letters = F.length(F.regexp_replace("w", "[^\\p{L}\\p{M}]", ""))
    known = words.where(pure & (F.col("n") >= 2))
    # no variant of a known word has more letters than the longest one (one more where a letter became two)
    longest = known.agg(F.max(F.length("w"))).first()[0] or 0
    known = known.select(F.col("w").alias("v"), F.col("n").alias("vn"), anagram_value(F.col("w")).alias("value"))
    # odd words: marks, digits or letters of another script in one place taken for a letter, or strayed in
    odd = written(words.where(odd_word & letters.between(2, longest) & (letters * 2 >= F.length("w"))), "scan-odd").withColumn("value", anagram_value(F.col("w")))

    def spot(k: Column) -> Column:
        c = F.substring(F.col("w"), k, F.lit(1))
        return c.rlike(f"[{MARKS}\\p{{Nd}}]") | _foreign(c, F.col("w"))

    spots = F.filter(F.sequence(F.lit(1), F.length("w")), spot)
    odd = odd.withColumn("spots", spots).withColumn("from", F.array_min("spots")).withColumn("to", F.array_max("spots"))
    odd = odd.where("size(spots) > 0 and to - from + 1 = size(spots)")
    odd = odd.select("w", "n", "value", F.substring("w", F.lit(1), F.col("from") - 1).alias("left"), F.substring("w", F.col("from"), F.col("to") - F.col("from") + 1).alias("bad"), F.substring("w", F.col("to") + 1, F.length("w")).alias("right"))
    # without its mark, and without one of its letters (or none), the odd and the frequent word have the same value
    odd = odd.withColumn("value", F.col("value") - _one(F.col("bad")))
    letters_of = F.array_distinct(F.concat(F.filter(F.split("v", ""), lambda c: c != ""), F.array(F.lit(""))))
    dropped = known.select("v", "vn", "value", F.explode(letters_of).alias("c"))
    dropped = dropped.select("v", "vn", (F.col("value") - F.when(F.col("c") == "", 0).otherwise(_one(F.col("c")))).alias("value"), F.length("c").alias("more"))
    size = F.length("left") + F.length("right") + F.col("more")
    swapped = odd.join(dropped, "value").where(F.col("v").startswith(F.col("left")) & F.col("v").endswith(F.col("right")) & (F.length("v") == size)).select("w", "n", "v", "vn").where("vn >= n")
    # rare words: letters taken for letters
    rare = written(words.where(pure & F.length("w").between(5, longest + 1)), "scan-rare").withColumn("value", anagram_value(F.col("w")))
    turned = rare.select("w", "n", F.explode(F.concat(*[_turns(a, b) for a, b in CONFUSED])).alias("e")).select("w", "n", "e.value", "e.v")
    turned = turned.join(known, ["value", "v"]).where(f"vn >= {ratio} * n and vn >= {least}").select("w", "n", "v", "vn")
    met = swapped.unionByName(turned)
    return met.groupBy("w").agg(F.max(F.struct("vn", "v")).alias("m")).select("w", F.col("m.v").alias("v"))


def texts_of(df: DataFrame, record: str, field: str, text: str, document: str, page: str, part: bool) -> DataFrame:
    """(r, f, d, p, t, part): one row per record with a text; `part` if the text is a part of a page, not a page."""
    rows = df.select(F.col(record).alias("r"), F.lit(field).alias("f"), F.col(document).alias("d"), F.col(page).cast("int").alias("p"), F.col(text).alias("t"), F.lit(part).alias("part"))
    return rows.where("r is not null").where(F.col("t").rlike("\\S"))


def _small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast only what was counted and found small; else the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def marks(texts: DataFrame) -> DataFrame:
    """(r, f, d, p, words, numbered, led, cuts): all that is read from the texts, in one pass over them.

    led: the titleish lines (lower case), and whether a page has them at its edge (null in parts of pages).  cuts: halves of
    words at line ends; furniture lines between the halves are passed over.
    """
    rows = texts.withColumn("lines", _lines(F.col("t")))
    n = F.size("lines")
    edge = F.when(~F.col("part"), 1)
    led = F.filter(F.transform("lines", lambda x, k: F.when(is_titleish(x), F.struct(F.lower(x).alias("line"), (edge * F.when((k == 0) | (k == n - 1), 1).otherwise(0)).alias("edge")))), lambda x: x.isNotNull())
    prose = F.array_join(F.filter("lines", lambda x: ~is_page_number(x, F.col("p")) & ~(is_titleish(x) & x.rlike(" [–—·-] "))), "\n")
    halves = F.arrays_zip(*[F.regexp_extract_all("prose", F.lit(_CUT), F.lit(g)).alias(name) for g, name in ((1, "a"), (2, "mark"), (3, "b"))])
    rows = rows.withColumn("prose", F.when(F.col("t").rlike("[\\p{L}\\p{M}][-‐­][ \\t\\r]*\\n"), prose))
    return rows.select("r", "f", "d", "p", words_of(F.col("t")).alias("words"), (F.size(number_lines(F.col("lines"), F.col("p"), F.col("part"))) > 0).alias("numbered"), led.alias("led"), halves.alias("cuts"))


def find_noise(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, corrections, titles) of rows of texts_of.

    found: (r, f, noise) with noise broken_word, misread or page_furniture, once each.  Null and blank texts have none;
    repeated records count once in it; a text without a page number takes any number line as furniture, one without a
    document has no running title.  Empty tables give empty results.
    """
    marked = written(marks(texts), "scan-marks")
    titles = written(title_lines(marked), "scan-title-lines")
    led = marked.select("r", "f", "d", F.explode("led").alias("x")).select("r", "f", "d", "x.line").join(_small(titles), ["d", "line"], "left_semi")
    furniture = marked.where("numbered").select("r", "f").unionByName(led.select("r", "f")).distinct().withColumn("noise", F.lit("page_furniture"))
    words = written(marked.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "scan-words")
    fixes = written(corrections(words), "scan-corrections")
    wrong = marked.select("r", "f", F.explode("words").alias("w")).join(_small(fixes.select("w")), "w", "left_semi")
    misread = wrong.select("r", "f").distinct().withColumn("noise", F.lit("misread"))
    cuts = marked.select("r", "f", F.explode("cuts").alias("x"))
    cuts = cuts.select("r", "f", F.lower(F.concat("x.a", "x.b")).alias("joined"), F.lower(F.concat_ws("-", "x.a", "x.b")).alias("kept"), F.col("x.mark").alias("mark"))
    hyphened = words.where(F.col("w").rlike("^[\\p{L}\\p{M}]+-[\\p{L}\\p{M}]+$")).select(F.col("w").alias("kept"), F.col("n").alias("with"))
    cuts = cuts.join(hyphened, "kept", "left")
    sure = cuts.where("with is null or mark != '-'").select("r", "f")
    unsure = cuts.where("with is not null and mark = '-'").join(words.select(F.col("w").alias("joined"), F.col("n").alias("without")), "joined", "left").where("coalesce(without, 0) >= with").select("r", "f")
    broken = sure.unionByName(unsure).distinct().withColumn("noise", F.lit("broken_word"))
    return furniture.unionByName(misread).unionByName(broken), fixes, titles


def repaired(texts: DataFrame, fixes: DataFrame, titles: DataFrame) -> DataFrame:
    """(r, f, t) with furniture taken out, cut words joined, misread words corrected and lines joined to paragraphs."""
    rows = texts.dropDuplicates(["r", "f"]).withColumn("lines", _lines(F.col("t")))
    rows = rows.withColumn("numbers", number_lines(F.col("lines"), F.col("p"), F.col("part")))
    own = titles.groupBy("d").agg(F.collect_set("line").alias("titles"))  # the few titles of one document
    words = rows.select("r", "f", F.explode(words_of(F.col("t"))).alias("w")).join(_small(fixes), "w")
    words = words.groupBy("r", "f").agg(F.map_from_entries(F.collect_set(F.struct("w", "v"))).alias("fixes"))
    rows = rows.join(own, "d", "left").join(words, ["r", "f"], "left").select("r", "f", "t", "numbers", "titles", "fixes")
    word, cut, space = regex.compile(r"[^\s\p{Z}/.,;:!?()\"“”„'’‘«»–—…%₹•।॥&]+"), regex.compile(r"(?<=[\p{L}\p{M}])[-‐­][^\S\n]*\n\s*(?=[\p{L}\p{M}])"), regex.compile(r"[^\S\n]+")

    def like(old: str, new: str) -> str:
        return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, numbers, titles_, fixes_ in zip(batch["t"], batch["numbers"], batch["titles"], batch["fixes"], strict=True):
                numbers, titles_, fixes_ = set(numbers if numbers is not None else ()), set(titles_ if titles_ is not None else ()), dict(fixes_ or {})
                lines = [space.sub(" ", x).strip() for x in t.split("\n")]
                kept = "\n".join(x for x in lines if x not in numbers and x.lower() not in titles_)
                joined = cut.sub("", kept)
                joined = word.sub(lambda m: like(m[0], fixes_[m[0].lower()]) if m[0].lower() in fixes_ else m[0], joined)
                # a line that doesn't end a sentence goes on in the next, unless that one starts a heading or a list
                out.append(regex.sub(r"(?<![.!?।:;])\n(?=[\p{Ll}\p{Lo}₹(])", " ", joined).strip())
            yield pd.DataFrame({"r": batch["r"], "f": batch["f"], "t": out})

    return rows.mapInPandas(fix, "r string, f string, t string")
