"""JSON values as variants: how lists, numbers and booleans read as text, as numbers and as missing.

Text follows the spelling of Python, in which the answers' consumers were
written: `True`, `None`, `1e+22`, and lists in lists as `['a', 1]`; objects are
JSON.  A number without a fraction that was written with a point keeps it
(`1.0`) up to 18 digits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import missing, values
from .missing import strip
from .values import let

_ITEMS = "array<variant>"
#: Lists in lists are spelled out so many levels deep, deeper ones are JSON.
DEPTH = 2


def _bound(rule: Callable) -> Callable:
    """The rule with its first argument bound once."""

    @functools.wraps(rule)
    def run(v: Column, *args) -> Column:
        return let(v, lambda x: rule(x, *args))

    return run


def holds_variants(df: DataFrame, column: str) -> bool:
    """Whether the column is a variant, or a map of variants."""
    kind = df.schema[column].dataType
    return isinstance(kind.valueType if isinstance(kind, T.MapType) else kind, T.VariantType)


def of_map(bag: Column) -> Column:
    """A map of text as a map of variants; null stays null in it."""
    return F.transform_values(bag, lambda k, v: v.cast("variant"))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_null(v: Column) -> Column:
    """No value, or the JSON null."""
    return v.isNull() | F.is_variant_null(v)


def items(v: Column) -> Column:
    """The items of a list, null for anything else."""
    return F.when(is_list(v), F.try_variant_get(v, "$", _ITEMS))


def string(v: Column) -> Column:
    """A string, null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


@_bound
def _float_text(x: Column) -> Column:
    """A double in its shortest spelling, with an exponent below 1e-4 and from 1e16."""
    short = x.cast("string")
    size = F.abs(x)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(short, r"E(-?)(\d+)$", 2)
    sign = F.when(F.regexp_extract(short, r"E(-?)(\d+)$", 1) == "-", "-").otherwise("+")
    science = F.concat(F.regexp_replace(short, r"(\.0)?E.*$", ""), F.lit("e"), sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    return F.when(short.contains("E"), F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(science)).otherwise(short)


@_bound
def scalar(v: Column) -> Column:
    """A value that is no list as text; null is `None`."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    pointed = kind.isin("DOUBLE", "FLOAT") | (kind.startswith("DECIMAL") & ((F.try_element_at(F.split(kind, r"[(,)]"), F.lit(2)).try_cast("int") <= 18) | text.contains(".")))
    return (
        F.when(is_null(v), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(pointed, _float_text(F.try_variant_get(v, "$", "double")))
        .otherwise(text)
    )


@_bound
def _quoted(s: Column) -> Column:
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = s.contains("'") & ~s.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _repr(v: Column, depth: int) -> Column:
    inner = F.concat(F.lit("["), F.array_join(F.transform(items(v), lambda x: _repr(x, depth - 1)), ", "), F.lit("]")) if depth else F.to_json(v)
    return F.when(is_list(v), inner).when(string(v).isNotNull(), _quoted(string(v))).otherwise(scalar(v))


@_bound
def text(v: Column) -> Column:
    """Any value as text; null is `None`."""
    return F.when(is_list(v), _repr(v, DEPTH)).otherwise(scalar(v))


@_bound
def handed_down(v: Column) -> Column:
    """As a study's value is written into a sample: the items of a list joined by `; `, null as ''."""
    return F.when(is_null(v), "").when(is_list(v), F.array_join(F.transform(items(v), text), "; ")).otherwise(scalar(v))


@_bound
def cell(v: Column, depth: int = DEPTH) -> Column:
    """As a CSV cell: null is '', a list is joined by `; `, and so are the lists in it."""
    inner = F.array_join(F.transform(items(v), lambda x: cell(x, depth - 1)), "; ") if depth else F.to_json(v)
    return F.when(is_null(v), "").when(is_list(v), inner).otherwise(scalar(v))


@_bound
def compared(v: Column) -> Column:
    """As compared with gold: lower case, stripped; a list by its sorted items."""
    listed = F.array_join(F.array_sort(F.transform(items(v), lambda x: F.lower(strip(text(x))))), ", ")
    return F.when(is_list(v), listed).otherwise(F.lower(strip(scalar(v))))


@_bound
def number(v: Column) -> Column:
    """Numbers, booleans as 1 and 0, and text that is a number; null for anything else."""
    plain = F.when(~is_list(v) & ~is_object(v) & (F.schema_of_variant(v) != "STRING"), F.try_variant_get(v, "$", "double"))
    return F.coalesce(plain, values.to_number(string(v)))


@_bound
def not_scored(v: Column) -> Column:
    """In evaluation: null, an empty list, or text that says so."""
    return is_null(v) | F.coalesce(F.size(items(v)) == 0, F.lit(False)) | F.coalesce(string(v).isNotNull() & missing.not_scored(string(v)), F.lit(False))


@_bound
def not_fanned(v: Column) -> Column:
    """When study values are handed down: null, an empty list or object, or text that says so."""
    bare = F.to_json(v).isin("[]", "{}")
    return is_null(v) | F.coalesce((is_list(v) | is_object(v)) & bare, F.lit(False)) | F.coalesce(string(v).isNotNull() & missing.not_fanned(string(v)), F.lit(False))


def snapshot_items(v: Column) -> Column:
    """(value, evidence, section, confidence) of a snapshot's rows: an item each of a list, none of null.

    An object with a `value` stands for that value and brings the rest.
    Booleans are `TRUE` and `FALSE`, numbers have no needless point.
    """
    wrapped = F.when(is_object(v) & F.try_variant_get(v, "$", "map<string,variant>")["value"].isNotNull(), F.try_variant_get(v, "$", "map<string,variant>"))
    inner = F.coalesce(wrapped["value"], v)
    several = F.coalesce(items(inner), F.array(inner))

    def spelled(x: Column) -> Column:
        plain = F.try_variant_get(x, "$", "string")
        return F.when(F.schema_of_variant(x) == "BOOLEAN", F.upper(plain)).otherwise(plain)

    rest = [F.try_variant_get(wrapped[source], "$", "string").alias(name) for source, name in (("evidence_quote", "evidence"), ("section", "section"), ("confidence", "confidence"))]
    return F.transform(F.filter(several, lambda x: ~is_null(x)), lambda x: F.struct(spelled(x).alias("value"), *rest))
