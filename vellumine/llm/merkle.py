"""Collapsing records that differ only in form: Merkle digests of nested records, bottom up.

Leaves are normalised (invisible characters, letter case, white space and punctuation set aside; signs between two digits
are content) and hashed.  An ordered node hashes its children's digests in order, an unordered node (struct, map, list of
`label: value` fields) sorts them first.  Records are grouped by root digest, and every member is then compared with the
group's kept record in full: the canonical text, which spells out the normalised tree, must be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.session import written

# Characters that show nothing.
INVISIBLE = "[\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\uFE00-\\uFE0F\\uFEFF]+"
# White space and marks go; a mark stays only with a digit right before and right after it.
_LOOSE = "[\\s\\p{Z}\\u0085]+|\\p{P}(?:(?!\\p{Nd})|(?<!\\p{Nd}\\p{P}))"
_FIELD = "(?s)^[\\s\\p{Z}\\p{P}]*\\p{L}[^:]*:.*[^\\s\\p{Z}\\p{P}].*$"


def visible(text: Column) -> Column:
    """A text without invisible characters: what every later step reads, the parting into fields too."""
    return F.regexp_replace(text, INVISIBLE, "")


def _leaf(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _LOOSE, "")


def normal_leaf(text: Column) -> Column:
    """A text without what only formats it: invisible characters, case, loose punctuation, all white space."""
    return _leaf(visible(text))


def _digest(canonical: Column) -> Column:
    return F.md5(canonical)


def _field_parts(text: Column) -> Column:
    return F.filter(F.split(text, "[|;]"), lambda part: part.rlike("[\\p{L}\\p{N}]"))


def _fields(text: Column) -> Column:
    """The sorted (h, c) of the fields of a visible text that is a list of `label: value` fields; null for any other text."""
    parts = _field_parts(text)
    is_list = text.contains(":") & text.rlike("[|;]") & (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_FIELD))

    def field(part: Column) -> Column:
        at = F.instr(part, ":")
        label, value = _leaf(F.substring(part, F.lit(1), at - 1)), _leaf(F.substring(part, at + 1, F.length(part)))
        return F.struct(_digest(F.concat(_digest(label), _digest(value))).alias("h"), F.concat(label, F.lit("\u0001"), value).alias("c"))

    return F.when(is_list, F.array_sort(F.transform(parts, field)))


def _list_node(fields: Column) -> tuple[Column, Column]:
    node = _digest(F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: x["h"]), "")))
    return node, F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: x["c"]), "\u0002"))


def text_node(text: Column) -> tuple[Column, Column]:
    """(digest, canonical text) of a string: a leaf, or an unordered node if it is a list of `label: value` fields."""
    fields, leaf = _fields(visible(text)), normal_leaf(text)
    h, c = _list_node(fields)
    return F.coalesce(h, _digest(leaf)), F.coalesce(c, leaf)


def text_nodes(df: DataFrame, text: str, digest: str = "__h", canonical: str = "__c") -> DataFrame:
    """df with the digest and canonical text of a text column; every text is normalised once."""
    nodes = df.withColumn("__text", visible(F.col(text))).withColumn("__fields", _fields(F.col("__text")))
    nodes = nodes.withColumn("__leaf", F.when(F.col("__fields").isNull(), _leaf(F.col("__text"))))
    h, c = _list_node(F.col("__fields"))
    return nodes.withColumn(canonical, F.coalesce(c, F.col("__leaf"))).withColumn(digest, F.coalesce(h, _digest(F.col("__leaf")))).drop("__text", "__fields", "__leaf")


def node(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(digest, canonical text) of a value of any nesting; null has a digest of its own.

    Structs and maps are unordered nodes of (name, child); arrays are ordered nodes.
    """

    def pair(v: Column, k: T.DataType) -> Column:
        h, c = node(v, k)
        return F.struct(h.alias("h"), c.alias("c"))

    def closed(items: Column, mark: str) -> tuple[Column, Column]:
        hashes = F.array_join(F.transform(items, lambda x: x["h"]), "")
        texts = F.array_join(F.transform(items, lambda x: x["c"]), "\u0002")
        return _digest(F.concat(F.lit(mark), hashes)), F.concat(F.lit(mark), texts, F.lit("\u0003"))

    def named(name: Column, child: Column) -> Column:
        return F.struct(_digest(F.concat(_digest(name), child["h"])).alias("h"), F.concat(name, F.lit("\u0001"), child["c"]).alias("c"))

    if isinstance(kind, T.StringType):
        h, c = text_node(value)
    elif isinstance(kind, T.StructType):
        h, c = closed(F.array_sort(F.array(*[named(F.lit(f.name), pair(value[f.name], f.dataType)) for f in kind.fields])), "{")
    elif isinstance(kind, T.ArrayType):
        h, c = closed(F.transform(value, lambda x: pair(x, kind.elementType)), "[")
    elif isinstance(kind, T.MapType):
        h, c = closed(F.array_sort(F.transform(F.map_entries(value), lambda e: named(normal_leaf(e["key"].cast("string")), pair(e["value"], kind.valueType)))), "{")
    else:
        leaf = value.cast("string")
        h, c = _digest(leaf), leaf
    return F.coalesce(h, F.lit("null")), F.coalesce(c, F.lit("\u0000"))


def hex_code(text: Column) -> Column:
    """A hash code in one notation (lower-case digits only); null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(text, "(?i)^[\\s\\p{Z}]*(sha-?256|0x)\\s*[:=-]?", "")), "[^\\p{L}\\p{N}]+", ""), F.lit(""))


def collapse(df: DataFrame, ident: str, digest: Column, canonical: Column) -> DataFrame:
    """One row per record: `ident`, `kept_id` (the smallest id of its group) and `copies` (records in the group, itself included).

    Each id counts once (of repeats with differing content the one of the smallest digest).  Rows with a null id or a null
    canonical text belong to no group and do not come out.  Records of an equal digest whose canonical texts differ, which
    only a hash collision could bring, are told apart by the full comparison.  An empty table gives an empty result.
    """
    rows = df.select(F.col(ident).alias("i"), digest.alias("h"), canonical.alias("c")).where("i is not null and c is not null")
    rows = written(rows, "merkle-leaves")
    # only ids and digests move first; both counts combine before the shuffle, so a hot group is one row per task
    keys = rows.groupBy("i").agg(F.min("h").alias("h"))
    groups = keys.groupBy("h").agg(F.min("i").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    single = groups.where("copies = 1").select(F.col("kept_id").alias("i"), "kept_id", "copies")
    members = written(keys.join(groups.where("copies > 1").select("h"), "h"), "merkle-members")
    # full comparison: the groups again, by the whole canonical text
    texts = rows.join(members, ["i", "h"], "left_semi").dropDuplicates(["i"])
    whole = texts.groupBy("h", "c").agg(F.min("i").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    whole = written(whole.withColumn("forms", F.count(F.lit(1)).over(Window.partitionBy("h"))), "merkle-groups")
    equal = members.join(whole.where("forms = 1").drop("c", "forms"), "h").select("i", "kept_id", "copies")
    clash = texts.join(whole.where("forms > 1").drop("forms"), ["h", "c"]).select("i", "kept_id", "copies")
    return single.unionByName(equal).unionByName(clash).withColumnRenamed("i", ident)


def copies_of(collapsed: DataFrame, ident: str) -> DataFrame:
    """(kept_id, copy_id) of every record that is not the kept one of its group."""
    return collapsed.where(F.col(ident) != F.col("kept_id")).select("kept_id", F.col(ident).alias("copy_id"))
