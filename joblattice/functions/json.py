"""Fields of JSON that nobody promised a schema for, read from VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what some boards put before a JSON body so that no script tag can read it.
GUARD = r"^\s*(?:while\s*\(\s*1\s*\)\s*;|for\s*\(\s*;\s*;\s*\)\s*;|\)\]\}'?,?)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, VOID (JSON's null) or the name of a scalar type; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def parsed(text: Column) -> Column:
    """A JSON text as a variant, without its guard; null if it isn't JSON."""
    return F.try_parse_json(F.trim(F.regexp_replace(text, GUARD, "")))


def as_object(v: Column) -> Column:
    """An object's fields as a map; null for anything else.  Looks at one level only, unlike :func:`kind`."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    """An array's elements; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def scalar(v: Column) -> Column:
    """A scalar's trimmed text; '' for everything else."""
    plain = as_object(v).isNull() & as_array(v).isNull() & ~F.is_variant_null(v)
    return F.coalesce(F.when(plain, F.trim(F.try_variant_get(v, "$", "string"))), F.lit(""))


def record(v: Column) -> Column:
    """An object as a map of its fields; anything else as an empty one."""
    return F.coalesce(as_object(v), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def elements(v: Column) -> Column:
    """The elements of an array; anything else has none."""
    return F.coalesce(as_array(v), F.array().cast("array<variant>"))


def records(v: Column) -> Column:
    """The objects and arrays among an array's elements."""
    return F.filter(elements(v), lambda x: as_object(x).isNotNull() | as_array(x).isNotNull())


def text(v: Column) -> Column:
    """Any value as trimmed text: null and missing as '', objects and arrays as JSON."""
    return F.coalesce(F.when(kind(v).isin("OBJECT", "ARRAY"), F.to_json(v)).when(kind(v) != "VOID", F.trim(F.try_variant_get(v, "$", "string"))), F.lit(""))


def number(v: Column) -> Column:
    """A finite number, of a number or of its text; null for anything else.

    A blank text, a truth value and JSON's null are not numbers that anyone measured, so they are null too.
    """
    plain = F.when(kind(v) == "STRING", F.when(F.trim(F.try_variant_get(v, "$", "string")).rlike(NUMBER), F.expr("1"))).when(~kind(v).isin("OBJECT", "ARRAY", "BOOLEAN", "VOID"), F.lit(1))
    value = F.when(plain == 1, F.trim(F.try_variant_get(v, "$", "string")).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)
