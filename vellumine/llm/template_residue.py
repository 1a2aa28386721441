"""Template residue, filler, error pages and script notices in place of content.

A record is a line of a document (a sentence, or a line of its own); records are aligned in two ways.

Slots.  Records of one template agree in the words around a place and differ in what stands there.  Where the two words
before and the two words after a place come together in records without a suspect, with values that vary, the place is a
slot; a variable name, default or blank that another record retains in it is residue.  A bracket or a name that always stands
in its sentence (a text that speaks of templates) is aligned with nothing and stays.

Templates that repeat.  Documents that agree but for their figures and codes are of one page template; records that agree
so, or in their opening words and their last one, are of one line template, as are all lines of filler words.  A page
template is an error page if every sentence of it speaks of a fault, and its fault lines are then residue wherever they
stand; a line template that repeats is residue if its records read as an error, a notice or filler.  A line that repeats over
records found so far and hardly elsewhere is one as well.  Only such lines as read so and repeat nowhere go by the fixed
lists alone; `parts` tells how each document was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.session import written

# How unfilled slots look (wrapped names, defaults of languages and sheets, blanks).
SUSPECT = (
    r"(?=[{$\[<«@%_#(?.xXNuTFn₹])(?:\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|\$?\{[^{}\n]+\}|\[\[[^\[\]\n]+\]\]|\[[^\[\]\n]+\]|<<[^<>\n]+>>|<[^<>\n]+>|«[^«»\n]+»"
    r"|@@[^@\n]+@@|%\p{L}[\p{L}\p{M}_. ]*%|__[\p{L}\p{N}][^_\n]*(?:_[^_\n]+)*__|#(?:REF!|N/A|NAME\?|VALUE!|DIV/0!|NULL!|NUM!)|\(\p{Ll}[^()\p{Nd}\n]{2,}\)"
    r"|\b(?:NaN|undefined|null|None|TBD|TBA|TBC|TODO|FIXME|N/A)\b|\bX{3,}\b|(?:₹ ?)?\bx{2,}(?:[,.]x{2,})+|\?{2,}|_{3,}|\.{4,}|₹(?=\s+\p{L}))"
)
# Fixed values (figures are 0 here): lines of error pages, of script, cookie and sign-in notices, and of filler; each is a sentence's opening.
FAULTS = (
    r"http(/0)?( status| error)?( code)?:? 0\b.*|(error|erreur|fehler|त्रुटि|त्रुटी)\s*:?\s*0\s*([:–-].*)?[.।]?$",
    r"(fatal|panic|uncaught( exception)?|unhandled exception|(\w+)?(error|exception))\s*:\s?.*",
    r"traceback\b.*|nullreference\b.*|stack trace\b.*|at [\w$]+(\.[\w$<>]+)+ ?\(.*",
    r"\(?0\)?\s*[-–:]?\s*(page |file )?not found.*|(page|file|document)( \S+)? (was )?not found\b.*|(seite|datei|dokument)( \S+)? nicht gefunden.*|(la )?(page|ressource) (demandée )?(est )?introuvable.*|(no se encontró|no se ha encontrado) la página.*",
    r"हे पान सापडले नाही.*|(पृष्ठ|पेज|पान)( \S+)? (नहीं मिला|सापडले नाही).*",
    r"(the )?(item|page|file|document|resource)( \S+)? (is not on this server|could not be (found|loaded|opened|shown|displayed)).*|document preview failed.*|(the )?(report|page|document|content) (cannot|could not|can't) be (shown|displayed|loaded).*",
    r"(this )?(service|server|site|page) (is )?(down\b|unavailable|temporarily).*|the upstream (host|server) .*|(bad gateway|gateway time-?out|internal server error|service unavailable)\b.*|too many requests\b.*",
    r"(oops|uh-oh)\b.*|something (broke|went wrong)\b.*|access (denied|refused|forbidden)[.!]?$|forbidden[.!]?$|you (do not|don't) have (the right|permission|access)\b.*|your session (has )?(ended|expired)\b.*",
)
NOTICES = (
    r"(please )?(enable|activate|allow|turn on|switch on) (java ?script|cookies|scripts?|scripting)\b.*|java ?script (is|must be|needs to be|has to be) (switched off|disabled|off|required|enabled|on|needed)\b.*",
    r"you (must|need to|have to) (enable|allow|accept|activate|turn on) (java ?script|cookies|scripts?)\b.*|(this|the) (viewer|page|site|reader|reading room|application) (needs|requires) (java ?script|scripts?|cookies)\b.*",
    r"scripts? (must|need to|have to) be (on|enabled|allowed)\b.*|noscript\b.*|your browser (does not|doesn't) support\b.*|(loading|please wait)(…|\.\.\.).*|(if nothing appears|check that scripts)\b.*|checking (that|if) you are (not a robot|human)\b.*",
    r"bitte aktivieren sie (java ?script|cookies)\b.*|(bitte )?(java ?script|cookies) (aktivieren|muss aktiviert).*|veuillez (activer|autoriser) (java ?script|les cookies)\b.*|(por favor,? )?(active|habilite|active usted|debe activar) (java ?script|las cookies)\b.*",
    r"(please )?(sign|log) in (again )?(to|before)\b.*|(bitte melden sie sich an|veuillez vous connecter|inicie sesión)\b.*",
)
ASKED = r"(जावास्क्रिप्ट|कुकीज़|कुकीज|कुकी) (चालू|सुरू|सक्षम|स्वीकार) कर.{0,20}$"
FILLERS = (
    r"(sample|dummy|placeholder|filler|example) (text|content|paragraph|heading|copy)\b.*|this is (a )?(dummy|sample|placeholder)\b.*|your (heading|content|text|title|copy|message) (goes )?here\b.*|replace this (paragraph|text|section|sentence|line)\b.*|(insert|add|enter|type|write|put) [^.]+ here[.!]?$|(content|text|details|more) (is )?(coming soon|to follow|to come)\b.*",
    r"texte (à remplacer|de remplissage|d'exemple|factice)\b.*|(insérez|saisissez|entrez) (votre )?texte\b.*|texto de (relleno|ejemplo|prueba|muestra)\b.*|(escriba|inserte) (su |el )?texto\b.*|(hier steht|dies ist|das ist) (ein )?(blindtext|platzhalter|beispieltext|mustertext)\b.*|(blindtext|platzhaltertext)[.!]?$|hier (ihren )?text (einfügen|eingeben)\b.*",
    r"येथे (आपला )?मजकूर.*|यहां (अपना )?(पाठ|टेक्स्ट).*|यहाँ (अपना )?(पाठ|टेक्स्ट).*|(नमुना|नमूना) (मजकूर|पाठ).*",
)
# Words of the pseudo-Latin that stands for text, whole or cut.
LATIN = (
    "ad adipiscing aliqua aliquam aliquip amet ante arcu at augue aute bibendum commodo condimentum congue consec consectetuer consectetur consequat cras culpa curabitur cursus dapibus deserunt diam dictum do dolor dolore donec duis ea efficitur egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu euismod ex excepteur exercitation facilisis fames faucibus felis feugiat fringilla fugiat fusce gravida habitant hac hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris maximus metus mi minim molestie mollis mollit montes morbi mus nam nascetur natoque nec neque netus nibh nisi nisl non nostrud nulla nullam nunc occaecat odio orci ornare pariatur pellentesque penatibus pharetra phasellus placerat porta porttitor posuere praesent pretium primis proident proin pulvinar purus quam quis quisque reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt suscipit suspendisse tellus tempor tempus tetur tincidunt tortor tristique turpis ullamco ultrices ultricies urna ut varius vehicula vel velit venenatis veniam vestibulum vitae vivamus viverra volutpat vulputate"
).split()
# Words one of which every sentence of an error page carries.
FAULT_WORDS = r"(?U)\b(error|failed|failure|not found|unavailable|denied|refused|forbidden|enable|javascript|scripts?|cookies?|sign in|log in|session|robot|requests?|server|retry|reload|loading|try again|browser|erreur|introuvable|fehler|gefunden|aktivieren|activer|página|active)\b|त्रुटि|त्रुटी|जावास्क्रिप्ट|नहीं मिला|सापडले नाही"

# The mark that a suspect is replaced by; the form of filler words.
_SLOT, _FILLER = "∎", "∎filler"


def figures_out(text: Column) -> Column:
    """Figures and codes as 0."""
    return F.regexp_replace(text, "\\p{Lu}{0,3}/?\\p{Nd}+(?:[.,/:-]\\p{Nd}+)*", "0")


def names_out(text: Column) -> Column:
    """Runs of capitalised words as N."""
    return F.regexp_replace(text, "\\p{Lu}[\\p{L}\\p{M}'’-]*(?: (?:& )?\\p{Lu}[\\p{L}\\p{M}'’-]*)*", "N")


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[.!?।])\\s+|\\s*\\n\\s*"), lambda x: F.trim(x)), lambda s: s != "")


def records(docs: DataFrame) -> DataFrame:
    """(i, k, s): the lines of the documents (i, t) in order, suspects as ∎ and figures as 0; each text is read once."""
    shown = F.when(F.col("t").rlike(SUSPECT), F.regexp_replace("t", SUSPECT, _SLOT)).otherwise(F.col("t"))
    return docs.select("i", F.posexplode(_sentences(figures_out(shown))).alias("k", "s"))


def _places(forms: DataFrame) -> DataFrame:
    """(s, l, r): each word with a suspect in the forms (s), and the two words on either side, names as N."""
    words = F.split(F.concat(F.lit("^ ^ "), names_out(F.col("s")), F.lit(" $ $")), "\\s+")
    at = F.filter(F.sequence(F.lit(3), F.size("w") - 2), lambda k: F.contains(F.element_at("w", k), F.lit(_SLOT)))
    rows = forms.select("s", words.alias("w")).select("s", "w", F.explode(at).alias("k"))
    side = [F.concat_ws(" ", F.element_at("w", F.col("k") + a), F.element_at("w", F.col("k") + b)) for a, b in ((-2, -1), (1, 2))]
    rows = rows.select("s", side[0].alias("l"), side[1].alias("r"))
    return rows.where(f"not contains(l, '{_SLOT}') and not contains(r, '{_SLOT}') and not (l = '^ ^' and r = '$ $')")


def slots(places: DataFrame, forms: DataFrame, width: int = 6) -> DataFrame:
    """(l, r) of the places that are slots: in the forms (s) without suspects the same two words stand before and after values that vary.

    A value is up to `width` words, in one form; values vary if one is a figure or a name (which stand for many), or if there
    are two.  Words before a place lead to the forms; only there are values looked at.
    """
    words = F.split(F.concat(F.lit("^ ^ "), F.col("m"), F.lit(" $ $")), "\\s+")
    clean = forms.where(~F.contains("s", F.lit(_SLOT))).select(names_out(F.col("s")).alias("m")).distinct().select(words.alias("w"))
    pair = F.transform(F.sequence(F.lit(3), F.size("w") - 2), lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.element_at("w", k - 2), F.element_at("w", k - 1)).alias("l")))
    met = clean.select("w", F.explode(pair).alias("x")).select("w", "x.k", "x.l").join(places.select("l").distinct(), "l", "left_semi")
    wide = F.transform(F.sequence(F.lit(1), F.least(F.lit(width), F.size("w") - F.col("k") - 1)), lambda n: F.struct(F.array_join(F.slice("w", F.col("k"), n), " ").alias("v"), F.concat_ws(" ", F.element_at("w", F.col("k") + n), F.element_at("w", F.col("k") + n + 1)).alias("r")))
    met = met.select("l", F.explode(wide).alias("x")).select("l", "x.r", "x.v").join(places.select("l", "r").distinct(), ["l", "r"], "left_semi").distinct()
    varied = met.groupBy("l", "r").agg(F.count(F.lit(1)).alias("values"), F.bool_or(F.col("v").rlike("0|(^|\\W)N(\\W|$)")).alias("many"))
    return varied.where("values > 1 or many").select("l", "r")


def slot_residue(forms: DataFrame) -> DataFrame:
    """(s) of the forms that retain a suspect in a slot of their template."""
    places = written(_places(forms.where(F.contains("s", F.lit(_SLOT)))), "residue-places")
    return places.join(slots(places, forms), ["l", "r"], "left_semi").select("s").distinct()


def _is_filler(sentence: Column) -> Column:
    """A line of words (lower case) that say nothing: one or two words over and over, or words of the pseudo-Latin."""
    latin = F.array(*[F.lit(w) for w in LATIN])
    words = F.split(F.trim(F.regexp_replace(sentence, "[^\\p{L}\\p{M}]+", " ")), " ")
    n, forms = F.size(words), F.array_distinct(words)
    few = F.size(forms) <= F.when(n >= 5, 2).otherwise(1)
    return ~sentence.rlike("\\p{Nd}") & (n >= 3) & (few | (F.size(F.array_except(forms, latin)) <= 0.4 * F.size(forms)))


def _plain(s: Column) -> Column:
    return F.lower(F.replace(s, F.lit("’"), F.lit("'")))


def template(s: Column) -> Column:
    """The line template of a record: its first three words and its last one, in lower case."""
    words = F.split(_plain(s), " ")
    return F.xxhash64(F.slice(words, F.lit(1), F.lit(3)), F.element_at(words, -1))


def read_forms(lines: DataFrame) -> DataFrame:
    """(s, kind, fault) of the distinct forms of lines: `line` for an error or a notice by the lists, `filler`, and whether a fault word stands in it."""
    opening = "(?U)^[\\s•*#>|–-]*(?:" + "|".join(f"(?:{p})" for p in (*FAULTS, *NOTICES, *FILLERS)) + ")$"
    plain = _plain(F.col("s"))
    kind = F.when(plain.rlike(opening) | plain.rlike(ASKED), "line").when(_is_filler(plain), "filler")
    return lines.select("s").distinct().select("s", kind.alias("kind"), F.lower("s").rlike(FAULT_WORDS).alias("fault"))


def line_templates(lines: DataFrame, forms: DataFrame, documents: int = 2) -> DataFrame:
    """(s) of the forms that the lists know whose template repeats over documents.

    Forms of one template agree in template(), whether the lists know them or not; all lines of filler words are of one.
    """
    read = forms.where("kind is not null").select("s", "kind", F.when(F.col("kind") == "filler", 0).otherwise(template(F.col("s"))).alias("template"))
    read = written(read, "residue-read")
    alike = forms.select("s", template(F.col("s")).alias("template")).join(read.where("kind = 'line'").select("template").distinct(), "template", "left_semi")
    alike = written(alike.unionByName(read.where("kind = 'filler'").select("s", "template")).distinct(), "residue-alike")
    held = lines.select("i", "s").join(alike, "s").select("i", "template").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("held"))
    return read.join(held.where(F.col("held") >= documents), "template", "left_semi").select("s")


def page_templates(lines: DataFrame, forms: DataFrame, documents: int = 2) -> DataFrame:
    """(i, s) of the fault lines of the documents whose page template repeats over `documents` of them and speaks of a fault in every sentence.

    The template of a page is all its lines (of any number and length) but for figures, in order; lines without an end mark,
    as of a site's frame, need not speak of a fault, but one line must.  Repeated rows of a document count once: a page's
    number of lines is its last line's, and its sums are divided by the number of rows a line has.
    """
    faults = forms.where("fault").select("s", F.lit(1).alias("fault"))
    held = written(lines.join(faults, "s", "left_semi").select("i").distinct(), "residue-held")
    marked = lines.join(held, "i", "left_semi").join(faults, "s", "left")
    ended = F.col("s").rlike("[.!?।]$")
    hashes = [F.shiftright(F.xxhash64(*c), 32) for c in (("k", "s"), ("s", "k"))]
    pages = marked.groupBy("i").agg(F.min(F.when(ended, F.coalesce("fault", F.lit(0)))).alias("each"), (F.max("k") + 1).alias("n"), F.count(F.lit(1)).alias("rows"), *[F.sum(h).alias(c) for h, c in zip(hashes, "ab", strict=True)])
    pages = written(pages.where("coalesce(each, 1) = 1").selectExpr("i", "n", "a div (rows div n) as a", "b div (rows div n) as b"), "residue-pages")
    repeated = pages.groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= documents)
    return lines.join(pages.join(repeated, ["n", "a", "b"], "left_semi"), "i", "left_semi").join(faults, "s", "left_semi").select("i", "s")


def recurring_lines(lines: DataFrame, found: DataFrame, documents: int = 3, share: float = 0.8) -> DataFrame:
    """(s) of the forms that at least `documents` of the documents found (i) have, these being at least `share` of all that have it, but not all."""
    worded = F.col("s").rlike("\\p{Ll}{3}|[\\p{Lo}\\p{M}]{3}")
    bad = lines.where(worded).join(found, "i", "left_semi").select("i", "s").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("bad"))
    bad = written(bad.where(F.col("bad") >= documents), "residue-recurring")
    n = lines.select("i", "s").join(bad.select("s"), "s", "left_semi").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return bad.join(n, "s").where((F.col("bad") >= share * F.col("n")) & (F.col("bad") < F.col("n"))).select("s")


def parts(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(`ident`, how) of the documents that are residue: `slot`, `page`, `line` (template), `learned`, or `single` (a line that repeats nowhere).

    A document comes out with the first of these that it is found by.  Nulls, blanks and repeats as in residue.
    """
    docs = df.select(F.col(ident).alias("i"), F.col(text).alias("t")).where("i is not null").where(F.col("t").rlike("[\\p{L}\\p{N}_]"))
    lines = written(records(docs), "residue-lines")
    forms = written(read_forms(lines), "residue-forms")
    ways = {"slot": slot_residue(forms), "page": page_templates(lines, forms).select("s"), "line": line_templates(lines, forms), "single": forms.where("kind is not null").select("s")}
    known = None
    for rank, way in enumerate(("slot", "page", "line", "learned", "single")):
        if way in ways:
            more = ways[way].select("s", F.lit(rank).alias("rank"))
            known = more if known is None else known.unionByName(more)
    known = written(known.groupBy("s").agg(F.min("rank").alias("rank")), "residue-known")
    found = written(lines.join(known, "s").groupBy("i").agg(F.min("rank").alias("rank")), "residue-found")
    learned = lines.join(recurring_lines(lines, found.select("i")), "s", "left_semi").select("i", F.lit(3).alias("rank"))
    found = found.unionByName(learned).groupBy("i").agg(F.min("rank").alias("rank"))
    return found.select(F.col("i").alias(ident), F.element_at(F.array(*[F.lit(w) for w in ("slot", "page", "line", "learned", "single")]), F.col("rank") + 1).alias("how"))


def residue(df: DataFrame, ident: str, text: str) -> DataFrame:
    """`ident` of the documents that are, in whole or in part, residue.

    Null, blank and empty texts are no case; a null `ident` does not come out; repeated rows of an `ident` come out once.
    An empty table gives an empty result.
    """
    return parts(df, ident, text).select(ident)
