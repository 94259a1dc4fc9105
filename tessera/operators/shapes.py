"""The shape of JSON objects in a text column: keys, kinds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON value as text (strings with their quotes)."""
    v = F.trim(value)
    first = F.substring(v, 1, 1)
    return (
        F.when(v.isNull() | (v == "null"), "null").when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(v.isin("true", "false"), "boolean").when(v.try_cast("double").isNotNull(), "number").otherwise("string")
    )


def key_histogram(rows: DataFrame, column: str) -> DataFrame:
    """(key, n): how many objects have each key, most frequent first, then by key; what is no object has none."""
    keys = rows.select(F.explode(F.json_object_keys(column)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def json_shape(rows: DataFrame, column: str, width: int = 160) -> DataFrame:
    """(key, kind, n, sample): the kinds of value of each key, and the least of them as a sample, blanks collapsed, at most ``width`` characters.

    Values are read as a map of texts, so numbers and nested values keep their JSON form.
    """
    parsed = F.from_json(column, "map<string,string>")
    each = rows.select(F.explode(parsed).alias("key", "value"))
    sample = F.substring(F.regexp_replace("value", r"\s+", " "), 1, width)
    return each.groupBy("key", value_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"), F.min(sample).alias("sample"))


def number_map(m: Column) -> Column:
    """Only the entries that are numbers, as doubles, in key order."""
    cast = F.transform_values(m, lambda k, v: v.try_cast("double"))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(cast, lambda k, v: v.isNotNull()))))


def largest_by_key(a: Column, b: Column) -> Column:
    """Both maps; of a key that both have the larger value."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))
