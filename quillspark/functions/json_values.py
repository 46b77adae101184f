"""Changes of JSON values held as text: merge, set, insert and delete by path.

A value is taken apart to the JSON texts of its members and put together again
with object keys in order, so numbers, strings, nulls and nested values keep
their kind and equal values have equal texts.  Where keys repeat, the last one
counts; a text that is no JSON reads as null.  All of it is expressions: nothing
leaves the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import let

_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"


def _starts(json: Column, bracket: str) -> Column:
    return F.coalesce(F.ltrim(json).startswith(bracket), F.lit(False))


def canonical(json: Column) -> Column:
    """The value without idle white space, object keys in order."""
    return F.to_json(F.try_parse_json(json))


def members(json: Column) -> Column:
    """map<string, string>: the members of an object as JSON texts, else null."""
    found = F.transform_values(F.from_json(json, _OBJECT), lambda _, v: F.to_json(v))

    def once(m: Column) -> Column:
        keys, entries = F.map_keys(m), F.map_entries(m)
        last = lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), m).otherwise(F.map_from_entries(F.filter(entries, last)))

    return F.when(_starts(json, "{"), let(found, once))


def items(json: Column) -> Column:
    """array<string>: the items of an array as JSON texts, else null."""
    return F.when(_starts(json, "["), F.transform(F.from_json(json, _ARRAY), lambda v: F.to_json(v)))


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.struct(text.alias("s")))  # {"s":...}
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def object_text(entries: Column) -> Column:
    """An object from array<struct<key, value>> of JSON texts, keys in order."""
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _of_map(m: Column) -> Column:
    return object_text(F.map_entries(m))


def array_text(found: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(found, ","), F.lit("]"))


def _put(m: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(m, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def merge(left: Column, right: Column) -> Column:
    """Concatenation of two values.  Of objects the right one's members win, one
    level deep, nulls among them; arrays are joined; a value beside an array
    becomes an item of it, and of two other values an array is made.  Null if
    either is null or no JSON."""

    def joined(both: Column) -> Column:
        a, b = both["a"], both["b"]
        one = lambda x: F.coalesce(items(x), F.array(canonical(x)))
        objects = let(F.struct(members(a).alias("a"), members(b).alias("b")), lambda m: _of_map(F.map_concat(F.map_filter(m["a"], lambda k, _: ~F.map_contains_key(m["b"], k)), m["b"])))
        known = F.coalesce(members(a).isNotNull() | canonical(a).isNotNull(), F.lit(False)) & F.coalesce(members(b).isNotNull() | canonical(b).isNotNull(), F.lit(False))
        return F.when(known & _starts(a, "{") & _starts(b, "{"), objects).when(known, array_text(F.concat(one(a), one(b))))

    return let(F.struct(left.alias("a"), right.alias("b")), joined)


def _at(path_item: str, n: Column) -> Column:
    """Place in an array from 0, negative ones from its end; null if it is no number."""
    try:
        k = int(path_item)
    except ValueError:
        return F.lit(None).cast("int")
    return F.lit(k) if k >= 0 else n + k


def _change(json: Column, path: Sequence[str], leaf) -> Column:
    """``json`` with ``leaf(kind, container, step)`` in place of the container at
    the end of the path; unchanged where the path leads nowhere."""
    step, rest = path[0], path[1:]

    def at_object(m: Column) -> Column:
        if not rest:
            return leaf("object", m, step)
        return F.when(F.map_contains_key(m, step), _of_map(_put(m, step, _change(F.element_at(m, step), rest, leaf)))).otherwise(_of_map(m))

    def at_array(a: Column) -> Column:
        k = _at(step, F.size(a))
        if not rest:
            return leaf("array", a, step)
        inside = F.coalesce((k >= 0) & (k < F.size(a)), F.lit(False))
        return array_text(F.when(inside, F.transform(a, lambda x, i: F.when(i == k, _change(x, rest, leaf)).otherwise(x))).otherwise(a))

    def change(j: Column) -> Column:
        return F.when(_starts(j, "{"), let(members(j), at_object)).when(_starts(j, "["), let(items(j), at_array)).otherwise(canonical(j))

    return let(json, change)


def set_path(json: Column, path: Sequence[str], value: Column, create: bool = True) -> Column:
    """The value at ``path`` (keys and places) replaced by the JSON ``value``.  A last
    step that is missing is added if ``create`` says so, in arrays at the end, or
    at the front where a negative place lies before it; other missing steps leave
    all unchanged."""

    def leaf(kind: str, c: Column, step: str) -> Column:
        if kind == "object":
            put = _of_map(_put(c, step, value))
            return put if create else F.when(F.map_contains_key(c, step), put).otherwise(_of_map(c))
        k = _at(step, F.size(c))
        inside = (k >= 0) & (k < F.size(c))
        put = F.when(inside, F.transform(c, lambda x, i: F.when(i == k, value).otherwise(x)))
        if create:
            put = put.when(k < 0, F.concat(F.array(value), c)).when(k >= F.size(c), F.concat(c, F.array(value)))
        return array_text(put.otherwise(c))

    return F.when(value.isNotNull(), _change(json, path, leaf))


def insert_path(json: Column, path: Sequence[str], value: Column, after: bool = False) -> Column:
    """The JSON ``value`` inserted at ``path``: as a member that is not there yet, or
    before (``after``: behind) the item of an array."""

    def leaf(kind: str, c: Column, step: str) -> Column:
        if kind == "object":
            return F.when(F.map_contains_key(c, step), _of_map(c)).otherwise(_of_map(_put(c, step, value)))
        k = _at(step, F.size(c))
        place = F.least(F.greatest(k + int(after), F.lit(0)), F.size(c))
        put = F.concat(F.slice(c, F.lit(1), place), F.array(value), F.slice(c, place + 1, F.size(c)))
        return array_text(F.when(k.isNotNull(), put).otherwise(c))

    return F.when(value.isNotNull(), _change(json, path, leaf))


def delete_path(json: Column, path: Sequence[str]) -> Column:
    """``json`` without the member or item at ``path``."""

    def leaf(kind: str, c: Column, step: str) -> Column:
        if kind == "object":
            return _of_map(F.map_filter(c, lambda k, _: k != step))
        k = _at(step, F.size(c))
        return array_text(F.when(k.isNotNull(), F.filter(c, lambda _, i: i != k)).otherwise(c))

    return _change(json, path, leaf)


def merged(df: DataFrame, keys: Sequence[str], by: Sequence[str], json: str) -> DataFrame:
    """(keys, json): the objects of each key merged in the order ``by``.

    Of each member the last value is taken by a partial aggregate, so what is
    gathered for a key is one entry for each member, however many rows it has.
    Rows whose value is null or no object say nothing; a key without any other has
    an empty object.
    """
    rows = df.select(*keys, *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], members(F.col(json)).alias("_m"))
    each = rows.select(*keys, *[f"_by{i}" for i in range(len(by))], F.explode_outer("_m").alias("_key", "_value"))
    last = each.groupBy(*keys, "_key").agg(F.max(F.struct(*[f"_by{i}" for i in range(len(by))], "_value")).getField("_value").alias("_value"))
    entry = F.when(F.col("_key").isNotNull(), F.struct(F.col("_key").alias("key"), F.col("_value").alias("value")))
    return last.groupBy(*keys).agg(object_text(F.collect_list(entry)).alias(json))
