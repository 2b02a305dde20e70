"""Strict reading of JSON objects and UTC timestamps given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON string without backtracking, so that its length needs no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# Fixed value: form of an RFC 3339 UTC timestamp.
UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def bad_constant(text: Column) -> Column:
    """NaN or Infinity outside strings."""
    return F.regexp_replace(text, STRING, '""').rlike("NaN|Infinity")


def repeated_key(text: Column) -> Column:
    """A key that occurs twice in one object, at any depth.

    The scan reads keys and braces in order and keeps the numbers of the open
    objects; a key counts with the number of its object and its escapes undone.
    """
    marks = F.regexp_extract_all(text, F.lit(rf"({STRING}(\s*:)?|[{{}}])"), 1)
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("made"), F.array().cast("array<string>").alias("keys"))

    def step(s: Column, t: Column) -> Column:
        name = F.regexp_replace(t, r"\s*:$", "")
        plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"k":'), name, F.lit("}")), "$.k"), name)
        key = F.concat_ws(":", F.try_element_at(s["open"], F.lit(-1)).cast("string"), plain)
        opened = F.when(t == "{", F.array_append(s["open"], s["made"])).when(t == "}", F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        return F.struct(opened.alias("open"), (s["made"] + (t == "{").cast("int")).alias("made"), F.when(t.endswith(":"), F.array_append(s["keys"], key)).otherwise(s["keys"]).alias("keys"))

    return F.aggregate(marks, start, step, lambda s: F.size(s["keys"]) != F.size(F.array_distinct(s["keys"])))


def _one_value(text: Column) -> Column:
    """One JSON value and nothing behind it: as an array's only element, since the parser leaves what follows a value unread."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()


def json_fault(text: Column) -> Column:
    """Why ``text`` is not a strict JSON object: ``missing``, ``bad_constant``, ``not_object``, ``duplicate_key`` or ``malformed``; null if it is one."""
    return (F.when(text.isNull(), "missing").when(bad_constant(text), "bad_constant").when(~F.ltrim(text).startswith("{"), "not_object")
            .when(repeated_key(text), "duplicate_key").when(~_one_value(text), "malformed"))


def utc_stamp(text: Column) -> Column:
    """The instant of an RFC 3339 text that ends in Z; null for all other texts and for dates that do not exist."""
    return F.when(text.rlike(UTC), F.try_to_timestamp(text))
