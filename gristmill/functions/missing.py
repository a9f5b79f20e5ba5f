"""The nine meanings of "missing", one predicate each.  None of them may stand in for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean "missing" in each place.
SCORED = ("not_reported", "na", "n/a", "", "none", "null")
FANNED = ("", "not_reported")
AGES = ("", "not_reported", "na", "nan")
ACCESSIONS = ("na", "nan", "not_reported", "")
PUBLICATIONS = ("", "na", "nan", "null")
UNITS = ("NA", "")
TERMS = ("not_reported", "na", "nan", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; `trim` only takes blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _among(c: Column, tokens: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*tokens), F.lit(True))


def not_scored(c: Column) -> Column:
    """In evaluation; `nan` counts as reported."""
    return _among(F.lower(strip(c)), SCORED)


def not_fanned(c: Column) -> Column:
    """When study values are handed down to samples."""
    return _among(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_")), FANNED)


def no_age(c: Column) -> Column:
    """As an age: also whatever is no number."""
    from .values import to_number

    return _among(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_")), AGES) | to_number(c).isNull()


def no_cell(c: Column) -> Column:
    """As a join key or a cell to fill: null or exactly empty."""
    return F.coalesce(c.cast("string") == "", F.lit(True))


def no_sample(c: Column) -> Column:
    """As a discovered sample id: empty, or exactly `not_reported`."""
    return _among(c, ("", "not_reported"))


def no_accession(c: Column) -> Column:
    return _among(F.lower(strip(c)), ACCESSIONS)


def no_publication(c: Column) -> Column:
    return _among(F.lower(strip(c)), PUBLICATIONS)


def no_unit(c: Column) -> Column:
    """As a gold unit: case matters."""
    return _among(c, UNITS)


def no_term(c: Column) -> Column:
    return _among(F.lower(strip(c)), TERMS)
