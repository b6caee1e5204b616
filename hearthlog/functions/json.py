"""Column functions over JSON text that keep the order of its members, which VARIANT values do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string of a JSON text, with its escapes.
_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MEMBERS = "array<struct<key:string,json:string,kind:string>>"


def _kind(value: Column) -> Column:
    """The kind of a VARIANT value: OBJECT, ARRAY, STRING, or another scalar's type; null for JSON's null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def members(json: Column, kind: Column | str) -> Column:
    """(key, json, kind) of what an object or array holds, in order; keys of an array are null, strings are decoded. Other kinds hold nothing."""
    entry = lambda key, text, value: F.struct(key.alias("key"), text.alias("json"), _kind(value).alias("kind"))
    fields, typed = F.map_entries(F.from_json(json, "map<string,string>")), F.map_values(F.from_json(json, "map<string,variant>"))
    items, of_types = F.from_json(json, "array<string>"), F.from_json(json, "array<variant>")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    held = F.when(kind == "OBJECT", F.zip_with(fields, typed, lambda f, v: entry(f["key"], f["value"], v)))
    held = held.when(kind == "ARRAY", F.zip_with(items, of_types, lambda t, v: entry(F.lit(None).cast("string"), t, v)))
    return F.coalesce(held, F.array().cast(_MEMBERS))


def member(held: Column, key: str) -> Column:
    """The member of that key, or null."""
    return F.get(F.filter(held, lambda m: m["key"] == key), F.lit(0))


def depth(json: Column) -> Column:
    """How deep objects and arrays are nested: zero for a scalar."""
    brackets = F.regexp_replace(F.regexp_replace(json, _STRING, ""), r"[^\[\]{}]++", "")
    step = lambda at, c: F.when(c.isin("[", "{"), at["now"] + 1).when(c.isin("]", "}"), at["now"] - 1).otherwise(at["now"])
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, lambda at, c: F.struct(step(at, c).alias("now"), F.greatest(at["most"], step(at, c)).alias("most")), lambda at: at["most"])


def strings_within(json: Column, kind: Column, keys: tuple[str, ...]) -> Column:
    """The strings that stand under one of the keys at any depth of a JSON text, in the order of the text.

    One level of nesting after the other is opened, within the row: what was found carries its path, by which it is sorted in the end.
    A text without objects, a null and a broken text have none.
    """
    found, opened = "array<struct<path:array<int>,text:string>>", "array<struct<path:array<int>,json:string,kind:string>>"

    def descend(at: Column, _: Column) -> Column:
        below = F.flatten(F.transform(at["open"], lambda o: F.transform(members(o["json"], o["kind"]), lambda m, i: F.struct(F.array_append(o["path"], i).alias("path"), m["key"].alias("key"), m["json"].alias("json"), m["kind"].alias("kind")))))
        strings = F.transform(F.filter(below, lambda b: (b["kind"] == "STRING") & b["key"].isin(*keys)), lambda b: F.struct(b["path"].alias("path"), b["json"].alias("text")))
        deeper = F.transform(F.filter(below, lambda b: b["kind"].isin("OBJECT", "ARRAY")), lambda b: F.struct(b["path"].alias("path"), b["json"].alias("json"), b["kind"].alias("kind")))
        return F.struct(F.concat(at["found"], strings).cast(found).alias("found"), deeper.cast(opened).alias("open"))

    start = F.struct(F.array().cast(found).alias("found"), F.array(F.struct(F.array().cast("array<int>").alias("path"), json.alias("json"), kind.alias("kind"))).cast(opened).alias("open"))
    levels = F.coalesce(depth(json), F.lit(0))
    return F.aggregate(F.slice(F.sequence(F.lit(0), levels), F.lit(2), levels), start, descend, lambda at: F.transform(F.array_sort(at["found"]), lambda s: s["text"]))
