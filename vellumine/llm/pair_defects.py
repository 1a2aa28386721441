"""Defective question-answer pairs: empty, copied, refused, truncated, or in another language.

Shortened answers are found by sorting alone: the last sentence of every answer that has no end mark is sorted among all
complete sentences (figures and names masked, so that sentences of one form meet), over ranges of the whole order, and
compared with the nearest complete sentence on either side.  A sentence that is a prefix of its neighbour, or shares a long
prefix with it, breaks off.  Answers cut by a length limit pile up at one length: at such a spike a shorter common prefix is
enough.  Copies, refusals and languages follow by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm import language
from vellumine.llm.merkle import INVISIBLE
from vellumine.session import written

# Words that announce an answer or stand for none.
LABELS = "you asked|your question( was| is)?|the question( was| is)?|query|prompt|vous avez demandé|votre question|sie fragten|ihre frage|usted preguntó|su pregunta|आपने पूछा|तुम्ही विचारले|final answer|answer|question|response|output|assistant|réponse|question|antwort|frage|respuesta|pregunta|उत्तर|प्रश्न|a|q"
NOTHING = "none|null|nan|n ?a|undefined|empty|no response|blank|todo|tbd"
# How an answer declines, by language.  A speaker or the sources must be the one that fails: papers report
# of others that they declined or could not.
REFUSALS = {
    "eng": r"\b(i|we|i am|i'm|as an assistant)\b[^.!?]{0,50}\b(unable|not able|cannot|can ?not|can't|could not|couldn't|do not know|don't know|did not find|didn't find|must decline|have to decline|decline to|won't|will not be able|not something i can)\b"
    r"|\bnot something (i|we) can\b|\boutside what (i|we)\b|\bno answer (could|can) be\b|\b(lets?|allows?|enables?|for) me (to )?(reply|answer|say|respond)"
    r"|\b(documents?|sources?|passages?|pages?|context|text|excerpts?|information)\b[^.!?]{0,40}\b(do|does|did) not (contain|provide|mention|include|state|say|have)\b[^.!?]*|\bno answer can be given\b|\b(my apologies|i apologi[sz]e|i'm sorry|i am sorry)\b"
    r"|\bnot (enough|sufficient) (information|details?|context)\b[^.!?]{0,60}\b(answer|reply|respond)|\b(cannot|can't|could not) be answered\b|\bdeclines? to answer\b",
    "fra": r"\bje (ne |n['’])[^.!?]{0,60}\b(pas|aucun|rien)\b|\bne (me|nous) permet(tent)? pas de répondre\b|\b(désolée?|je regrette)\b|\bimpossible de répondre\b",
    "deu": r"\b(kann|darf|konnte|fand|finde|weiß) ich\b[^.!?]{0,80}\b(nicht|keine?n?)\b|\bich (kann|darf|konnte|weiß)\b[^.!?]{0,80}\b(nicht|keine?n?)\b|\b(tut mir leid|leider kann)\b|\bnicht beantwort(en|et)\b",
    "spa": r"\bno (puedo|podemos|encontré|encontramos|sé|me es posible|dispongo)\b|\b(lo siento|lo lamento)\b|\bno se puede responder\b|\bno permiten responder\b",
    "hin": r"असमर्थ|क्षमा करें|उत्तर नहीं दिया जा सकता|पर्याप्त जानकारी नहीं|जानकारी नहीं मिली|मुझे नहीं पता",
    "mar": r"क्षमस्व|माफ करा|उत्तर देता येत नाही|उत्तर देऊ शकत नाही|मदत करू शकत नाही|माहिती सापडली नाही|मला माहीत नाही",
}
# Names of the languages.
NAMES = {
    "eng": "english|englisch|anglais|inglés|ingles|अंग्रेज़ी|अंग्रेजी|इंग्रजी|इंग्रजीत",
    "hin": "hindi|हिंदी|हिन्दी",
    "mar": "marathi|मराठी|मराठीत",
    "fra": "french|französisch|français|francés|फ्रेंच|फ़्रेंच",
    "deu": "german|deutsch|allemand|alemán|जर्मन",
    "spa": "spanish|spanisch|espagnol|español|स्पेनिश|स्पॅनिश",
}
_ASKS = r"(?iU)\b(in|into|auf|ins|en|al|reply|answer|respond|write|translate[d]?|antworte|réponds|responde)\s+(?:\p{L}+\s+){0,2}?"
_END = r"[.!?।॥][\"'”’»)\]]*$"


def bare(text: Column) -> Column:
    """Letters and digits in lower case, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, INVISIBLE, "")), "[^\\p{L}\\p{M}\\p{N}]+", " "))


def asked_language(query: Column) -> Column:
    """The code of the language a question asks for; null if it asks for none."""
    forms = [F.when(query.rlike(f"{_ASKS}({names})\\b") | query.rlike(f"(?U)({names})\\s*(में|मध्ये|भाषेत)|मराठीत(?!\\p{{L}})" if code in ("mar",) else f"(?U)({names})\\s*(में|मध्ये|भाषेत)"), F.lit(code)) for code, names in NAMES.items()]
    return F.coalesce(*forms)


def is_empty(answer: Column) -> Column:
    return answer.isNull() | bare(answer).rlike(f"^(({LABELS}|{NOTHING})( |$))*$")


def is_copy(query: Column, answer: Column) -> Column:
    """The answer, labels aside, is the question once or more often, or a large part of it."""
    a, q = F.regexp_replace(bare(answer), f"^(({LABELS}) )+", ""), bare(query)
    rest = F.trim(F.replace(a, q, F.lit("")))
    whole = (q != "") & (F.instr(a, q) > 0) & rest.rlike(f"^(({LABELS})( |$))*$")
    part = (F.instr(q, a) > 0) & (F.length(a) >= 15) & (F.length(a) >= 0.6 * F.length(q))
    return F.coalesce(whole | part, F.lit(False))


def is_refusal(answer: Column) -> Column:
    """A sentence of the answer declines, and the rest reports nothing (no figures, not long)."""
    flat = F.lower(F.replace(answer, F.lit("’"), F.lit("'")))
    cue = "(?U)" + "|".join(REFUSALS.values())
    rest = F.filter(F.split(flat, "(?<=[.!?।])\\s+"), lambda s: ~s.rlike(cue))
    return flat.rlike(cue) & (F.length(F.array_join(rest, " ")) <= 120) & ~F.array_join(rest, " ").rlike("\\p{Nd}")


def masked(sentence: Column) -> Column:
    """A sentence's form: figures as 0, runs of capitalised words as N."""
    figures = F.regexp_replace(sentence, "\\p{Nd}[\\p{Nd}.,/:-]*", "0")
    return F.regexp_replace(figures, "\\p{Lu}[\\p{L}\\p{M}\\p{N}'’-]*(?:\\s+(?:&\\s+)?\\p{Lu}[\\p{L}\\p{M}\\p{N}'’-]*)*", "N")


def _views(sentence: Column) -> Column:
    """The sentence, and what follows its first clause (answers often open with a phrase of their own)."""
    after = F.regexp_extract(sentence, "^.{3,60}?[,:–] +(.{8,})$", 1)
    return F.filter(F.array(sentence, after), lambda s: s != "")


def shared_length(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts; 0 if either is null."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.coalesce(F.when(first > 0, first - 1).otherwise(F.least(F.length(a), F.length(b))), F.lit(0)).cast("int")


def neighbours(forms: DataFrame, tails: DataFrame) -> DataFrame:
    """tails (i, n, tail, m) with `below` and `above`, the nearest forms (m) in sorted order, equal ones included.

    Both are sorted together, range-partitioned (equal tails part by i), so that no opening is a task's own.  A range without
    a form beside a tail takes the last form of the ranges before, the first of those after.
    """
    both = forms.select("m", *[F.lit(None).cast(tails.schema[c].dataType).alias(c) for c in ("i", "n", "tail")]).unionByName(tails.select("m", "i", "n", "tail"))
    both = written(both.repartitionByRange("m", "i").withColumn("part", F.spark_partition_id()), "pair-sorted")
    form = F.when(F.col("i").isNull(), F.col("m"))
    ends = both.groupBy("part").agg(F.min(form).alias("low"), F.max(form).alias("high"))
    order = Window.orderBy("part")  # one row a range
    ends = ends.select("part", F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    down = Window.partitionBy("part").orderBy(F.desc("m"), F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("part").orderBy("m", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("above", F.last(form, ignorenulls=True).over(down)).withColumn("below", F.last(form, ignorenulls=True).over(up)).where("i is not null")
    met = met.join(F.broadcast(ends), "part").select("i", "n", "tail", "m", F.coalesce("above", "after").alias("above"), F.coalesce("below", "before").alias("below"))
    return met.withColumn("above", F.when(F.col("below") == F.col("m"), F.col("m")).otherwise(F.col("above")))  # an equal form may lie in the range before


def broken_off(answers: DataFrame, spike: int = 10) -> DataFrame:
    """(i, how) of the answers (i, a) whose last sentence breaks off: `shortened` (a prefix of a neighbour), `parted` (follows one, then parts)."""
    text = F.regexp_replace("a", "(^\\s+)|([\\s\\p{Ps}\\p{Pi}\"'„…]+$)|(\\.{2,}\\s*$)", "")
    parts = F.filter(F.split(text, "(?<=[.!?।])\\s+|\\n\\s*"), lambda s: F.trim(s) != "")
    rows = answers.select("i", "a", F.length("a").alias("n"), parts.alias("parts")).where(F.size("parts") > 0)
    rows = rows.withColumn("tail", F.element_at("parts", -1)).withColumn("open", ~F.col("tail").rlike(_END) & ~F.col("tail").rlike("[)\\]]$"))
    rows = written(rows, "pair-sentences")
    complete = rows.select(F.explode(F.filter("parts", lambda s: s.rlike(_END))).alias("s")).select(F.explode(_views(F.col("s"))).alias("s"))
    complete = complete.select(F.regexp_replace(masked(F.col("s")), "[.!?।॥\"'”’»)\\]]+$", "").alias("m")).distinct()
    # a tail is a sentence if it has an ordinary word, or follows a whole sentence; figures, names and codes are answers of their own
    before = F.get("parts", F.size("parts") - 2)
    begun = F.coalesce(before.rlike(_END) & F.col("tail").rlike("[\\p{Ll}\\u0900-\\u0D7F]") & F.col("a").contains(F.concat(before, F.lit(" "), F.col("tail"))), F.lit(False))
    tails = rows.where("open").select("i", "n", "tail", begun.alias("begun"), F.explode(_views(F.col("tail"))).alias("s")).withColumn("m", F.rtrim(masked(F.col("s"))))
    tails = tails.where(F.col("begun") | F.col("m").rlike("\\p{Ll}{2}|[\\u0900-\\u0D7F]{2}")).drop("begun")
    lengths = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("open").cast("int")).alias("opens"))
    near = F.sum("rows").over(Window.partitionBy(F.floor(F.col("n") / 20)))
    spikes = lengths.withColumn("near", near).where(f"opens >= {spike} and opens >= 0.9 * rows and rows >= 0.5 * near").select("n", F.lit(True).alias("spike"))
    met = neighbours(complete, tails).join(spikes, "n", "left")
    enough = F.when(F.col("spike"), 4).otherwise(8)
    shared = F.greatest(shared_length(F.col("m"), F.col("above")), shared_length(F.col("m"), F.col("below")))
    shortened = F.col("above").startswith(F.col("m")) & (F.length("above") > F.length("m"))
    equal = (F.col("above") == F.col("m")) | (F.col("below") == F.col("m"))
    met = met.select("i", "tail", F.coalesce(equal, F.lit(False)).alias("equal"), F.coalesce(shortened, F.lit(False)).alias("shortened"), (shared >= enough).alias("parted"))
    # of a sentence that only lacks its mark the last word is a word seen elsewhere; of one cut in a name it isn't
    last = F.lower(F.regexp_extract("tail", "([\\p{L}\\p{M}]+)[^\\p{L}\\p{M}]*$", 1))
    seen = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.array_join(F.filter("parts", lambda s: s.rlike(_END)), " ")), F.lit("(?<![\\p{L}\\p{N}/])[\\p{L}\\p{M}]+(?![\\p{N}/])"), F.lit(0)))).alias("w")).distinct().withColumn("known", F.lit(True))
    whole = met.where("equal").withColumn("w", last).join(seen, "w", "left").groupBy("i").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
    cut = met.groupBy("i").agg(F.bool_or("shortened").alias("shortened"), F.bool_or("parted").alias("parted")).join(whole, "i", "left")
    cut = cut.where("(shortened or parted) and not coalesce(known, false)")
    return cut.select("i", F.when(F.col("shortened"), "shortened").otherwise("parted").alias("how"))


def defects(requests: DataFrame, responses: DataFrame, ident: str, query: str, answer: str, model: language.Model, sample: int = 4000) -> DataFrame:
    """(`ident`, defect) of every defective answered pair; one defect each, in the order of the module's first line.

    Requests without a response row don't come out; a response without its request is judged without a question.  Repeated
    rows of an `ident` count once.  A null answer is empty.  A null or wordless question has no language, so its answer has
    none to keep to.  Empty tables give an empty result.
    """
    asked = requests.select(F.col(ident).alias("i"), F.col(query).alias("q")).where("i is not null").groupBy("i").agg(F.max("q").alias("q"))
    given = responses.select(F.col(ident).alias("i"), F.col(answer).alias("a")).where("i is not null").groupBy("i").agg(F.max("a").alias("a"))
    pairs = given.join(asked, "i", "left")
    q, a = F.coalesce("q", F.lit("")), F.col("a")
    rule = F.when(is_empty(a), "empty").when(is_copy(q, a), "copied_question").when(is_refusal(a), "refusal")
    pairs = written(pairs.withColumn("rule", rule).withColumn("wanted", asked_language(q)), "pairs")
    ruled = pairs.where("rule is not null").select("i", F.col("rule").alias("defect"))
    rest = pairs.where("rule is null")
    cut = written(broken_off(rest.select("i", "a")).select("i"), "pairs-cut")
    spoken = language.identify(rest, "i", "a", model, language.Rules(3, 2)).select("i", F.aggregate("stretches", F.create_map(F.lit(""), F.lit(0)), lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s["language"]), F.create_map(s["language"], F.coalesce(F.try_element_at(m, s["language"]), F.lit(0)) + s["end"] - s["start"]))).alias("by"))
    main = F.array_max(F.transform(F.map_entries("by"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("code"))))["code"]
    spoken = written(spoken.select("i", main.alias("main")).where("main != ''"), "pairs-spoken")
    # questions that ask for a language have said which.  The others are read by a model that has also seen questions, a
    # bounded sample labelled by their answers' languages: most answers keep to the question's
    plain = rest.where("wanted is null and q is not null").select("i", "q")
    seen = language.hash_sample(plain, "i", sample, spoken.count()).join(spoken, "i").select("h", "q", "main").toPandas()  # about `sample` questions
    seen = seen.sort_values(["h", "q"]).iloc[:sample]
    asker = language.widened(model, list(seen["q"]), list(seen["main"]))
    own = language.identify(plain, "i", "q", asker, language.Rules(2, 1)).where("confidence >= 0.6 and language not in ('unknown', 'mixed')").select("i", F.col("language").alias("own"))
    met = rest.select("i", "wanted").join(own, "i", "left").join(spoken, "i").withColumn("want", F.coalesce("wanted", "own"))
    other = met.where("want is not null and main != want").select("i")
    found = ruled.unionByName(cut.withColumn("defect", F.lit("truncated"))).unionByName(other.join(cut, "i", "left_anti").withColumn("defect", F.lit("other_language")))
    return found.withColumnRenamed("i", ident)
