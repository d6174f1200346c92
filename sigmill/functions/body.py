"""The open part of a log row, as JSON text or, parsed once at ingest, as a variant.

Operators ask for parts of it by path and need not know which it is. A variant
is read without parsing the text again, and Parquet stores it as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_variant(df: DataFrame, c: str = "body") -> bool:
    return dict(df.dtypes).get(c) == "variant"


def parsed(logs: DataFrame, c: str = "body") -> DataFrame:
    """`logs` with its body as a variant; what is no JSON becomes null."""
    return logs if is_variant(logs, c) else logs.withColumn(c, F.try_parse_json(c))


def part(variant: bool, path: str, c: str = "body") -> Column:
    """What stands at a path, as text: JSON for objects and arrays."""
    return F.try_variant_get(c, path, "string") if variant else F.get_json_object(c, path)


def keys(variant: bool, path: str, c: str = "body") -> Column:
    """The keys of the object at a path; null if there is none."""
    return F.map_keys(F.try_variant_get(c, path, "map<string,variant>")) if variant else F.json_object_keys(F.get_json_object(c, path))


def texts(variant: bool, path: str, c: str = "body") -> Column:
    """The object at a path as a map of texts; null if there is none."""
    return F.transform_values(F.try_variant_get(c, path, "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "string")) if variant else F.from_json(F.get_json_object(c, path), "map<string,string>")


def elements(variant: bool, path: str, c: str = "body") -> Column:
    """The elements of the array at a path: variants, or JSON texts; null if there is none."""
    return F.try_variant_get(c, path, "array<variant>") if variant else F.from_json(F.get_json_object(c, path), "array<string>")


def is_object(variant: bool, c: str) -> Column:
    return F.startswith(F.schema_of_variant(c), F.lit("OBJECT")) if variant else F.startswith(F.ltrim(c), F.lit("{"))
