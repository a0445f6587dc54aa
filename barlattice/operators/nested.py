"""JSON documents of any depth: their nodes in document order, searches for a symbol's record, and two-sided differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.sources.panel import kept

# Exchange prefixes that a symbol may carry or not.
PREFIXES = ["sh", "sz", "bj"]
#: Deeper documents end the query with an error.
DEEPEST = 200
ONLY_LEFT, ONLY_RIGHT, DIFFERENT, UNREADABLE = "ONLY_LEFT", "ONLY_RIGHT", "DIFFERENT", "UNREADABLE"


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean or null of a VARIANT."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null").when(value.isNotNull(), "number")
    )


def nodes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, path, place, key, under, kind and text of every value in every document.

    ``place`` holds the positions from the root down, so that its order is the document's; ``path`` names keys and
    positions (``/a/0/b``, with ``~1`` for a slash and ``~0`` for a tilde in a key). ``key`` is the value's own in its
    object, and null in an array; ``under`` is there the key of the array, or of the array around that. ``text`` is a string's content, and JSON otherwise. Each level of all documents is one step;
    documents do not meet. One that is no JSON has no nodes.
    """
    if doc in ("path", "place", "key", "under", "kind", "text", "m", "t", "at", "c"):
        raise ValueError(f"the documents' key needs another name than {doc}")
    root = docs.select(doc, F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("under"), F.col(text).alias("text"), F.try_parse_json(text).alias("v"))
    level = kept(root.where("v IS NOT NULL").select(doc, "path", "place", "key", "under", kind_of(F.col("v")).alias("kind"), F.when(F.schema_of_variant("v") == "STRING", F.expr("variant_get(v, '$', 'string')")).otherwise(F.col("text")).alias("text")))
    out = level
    for _ in range(DEEPEST):
        names, texts = F.map_keys("m"), F.map_values("m")
        objects = level.where("kind = 'object'").select(doc, "path", "place", F.from_json("text", "map<string,string>").alias("m"), F.from_json("text", "map<string,variant>").alias("t"))
        objects = objects.select(doc, "path", "place", F.posexplode(F.arrays_zip(names.alias("k"), texts.alias("x"), F.map_values("t").alias("t"))).alias("at", "c"))
        objects = objects.select(doc, F.concat("path", F.lit("/"), F.replace(F.replace(F.col("c.k"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("path"), F.concat("place", F.array("at")).alias("place"), F.col("c.k").alias("key"), F.col("c.k").alias("under"), F.col("c.x").alias("text"), F.col("c.t").alias("t"))
        arrays = level.where("kind = 'array'").select(doc, "path", "place", "under", F.from_json("text", "array<string>").alias("m"), F.from_json("text", "array<variant>").alias("t"))
        arrays = arrays.select(doc, "path", "place", "under", F.posexplode(F.arrays_zip(F.col("m").alias("x"), F.col("t").alias("t"))).alias("at", "c"))
        arrays = arrays.select(doc, F.concat("path", F.lit("/"), F.col("at").cast("string")).alias("path"), F.concat("place", F.array("at")).alias("place"), F.lit(None).cast("string").alias("key"), "under", F.col("c.x").alias("text"), F.col("c.t").alias("t"))
        level = objects.unionByName(arrays)
        level = kept(level.select(doc, "path", "place", "key", "under", F.coalesce(kind_of(F.col("t")), F.lit("null")).alias("kind"), "text"))
        out = out.unionByName(level)
        if level.where("kind IN ('object', 'array')").isEmpty():
            return out
    raise ValueError(f"a document is deeper than {DEEPEST}")


def bare(symbol: Column) -> tuple[Column, Column]:
    """(exchange prefix or empty, the rest) of a symbol, without regard to case and outer blanks."""
    s = F.lower(F.trim(symbol))
    prefix = F.when(s.rlike("^(" + "|".join(PREFIXES) + ")"), F.substring(s, 1, 2)).otherwise("")
    return prefix, F.when(prefix == "", s).otherwise(F.substring(s, 3, 1 << 20))


def records(found: DataFrame, doc: str, inherit: bool) -> DataFrame:
    """doc, place, text, name and how of the objects that stand for a symbol: by ``symbol`` (else ``code``), or by their key.

    With ``inherit`` objects in an array take the key of the array; without, they have none.
    """
    fields = F.json_object_keys("text")
    chosen = F.when(F.array_contains(fields, "symbol"), F.get_json_object("text", "$.symbol")).otherwise(F.get_json_object("text", "$.code"))
    objects = found.where("kind = 'object'")
    key = F.col("under") if inherit else F.col("key")
    objects = objects.select(doc, "place", "text", F.explode(F.array_compact(F.array(F.when(chosen.isNotNull(), F.struct(chosen.alias("name"), F.lit("FIELD").alias("how"))), F.when(key.isNotNull(), F.struct(key.alias("name"), F.lit("KEY").alias("how")))))).alias("r"))
    return objects.select(doc, "place", "text", "r.name", "r.how")


def search(docs: DataFrame, doc: str, text: str, asked: DataFrame, symbol: str, last: bool = False) -> DataFrame:
    """doc, symbol, record of each asked (doc, symbol): the first record of the symbol in document order, at any depth.

    Symbols are the same if they are equal, or if one has an exchange prefix and the other none. With ``last`` the last
    record counts, those under a record too, and records in an array answer to the array's key. Symbols without a record
    are left out.
    """
    own = "__document"
    found = records(nodes(docs.select(F.col(doc).alias(own), text), own, text), own, last)
    prefix, rest = bare(F.col("name"))
    found = found.select(F.col(own).alias("__doc"), "place", F.col("text").alias("record"), prefix.alias("__p"), rest.alias("__rest"))
    prefix, rest = bare(F.col(symbol))
    want = asked.select(doc, symbol).distinct().select("*", prefix.alias("__q"), rest.alias("__want"))
    hit = want.join(found, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__want") == F.col("__rest"))).where("__p = __q OR __p = '' OR __q = ''")
    best = F.max_by("record", "place") if last else F.min_by("record", "place")
    return hit.groupBy(doc, symbol).agg(best.alias("record"))


def differences(left: DataFrame, right: DataFrame, doc: str, text: str, advisory: list[str], common: list[str]) -> DataFrame:
    """doc, path, status, left_value, right_value of the values in which two sides of a document differ.

    Paths on one side only are found, whichever side it is; a null is a value, and not the same as nothing. What is below
    an ``advisory`` path never differs; what is below a ``common`` path differs only if both sides have it. Numbers
    are equal by value. A document that one side lacks, or that is no JSON there, is one row with an empty path.
    """

    def side(docs: DataFrame, mark: str) -> DataFrame:
        x = nodes(docs.select(F.col(doc).alias("__document"), text), "__document", text)
        value = F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise(F.concat("kind", F.lit(":"), F.when(F.col("kind") == "number", F.coalesce(F.col("text").try_cast("double").cast("string"), F.col("text"))).otherwise(F.coalesce("text", F.lit("")))))
        return x.select(F.col("__document").alias(f"__{mark}"), F.col("path").alias(f"__{mark}_path"), value.alias(f"{mark}_value"))

    a, b = side(left, "left"), side(right, "right")
    x = a.join(b, F.col("__left").eqNullSafe(F.col("__right")) & (F.col("__left_path") == F.col("__right_path")), "full")
    x = x.select(F.coalesce("__left", "__right").alias(doc), F.coalesce("__left_path", "__right_path").alias("path"), "left_value", "right_value")

    def below(paths: list[str]) -> Column:
        out = F.lit(False)
        for p in paths:
            out = out | (F.col("path") == p) | F.col("path").startswith(f"{p}/")
        return out

    one_side = F.col("left_value").isNull() | F.col("right_value").isNull()
    x = x.where(~F.col("left_value").eqNullSafe(F.col("right_value")) & ~below(advisory) & ~(below(common) & one_side))
    lone = left.select(F.col(doc).alias("__id"), F.try_parse_json(text).isNotNull().alias("l")).join(right.select(F.col(doc).alias("__other"), F.try_parse_json(text).isNotNull().alias("r")), F.col("__id").eqNullSafe(F.col("__other")), "full")
    lone = lone.where("l IS NULL OR r IS NULL OR NOT l OR NOT r")
    lone = lone.select(F.coalesce("__id", "__other").alias("__lone"), F.when(F.col("r").isNull(), ONLY_LEFT).when(F.col("l").isNull(), ONLY_RIGHT).otherwise(UNREADABLE).alias("status"))
    x = x.join(lone.select("__lone"), F.col(doc).eqNullSafe(F.col("__lone")), "left_anti")
    status = F.when(F.col("right_value").isNull(), ONLY_LEFT).when(F.col("left_value").isNull(), ONLY_RIGHT).otherwise(DIFFERENT)
    whole = lone.select(F.col("__lone").alias(doc), F.lit("").alias("path"), "status", F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"))
    return x.select(doc, "path", status.alias("status"), "left_value", "right_value").unionByName(whole)
