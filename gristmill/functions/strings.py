"""Header and term strings: normal forms, tokens, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import no_accession, no_term, strip


def squeezed(c: Column) -> Column:
    """Lower case, letters and digits only: `Sample-ID` as `sampleid`."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def tokens(c: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def containment(needle: Column, haystack: Column) -> Column:
    """Share of needle's items that haystack has; 0 for an empty needle."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, haystack)) / F.size(needle)).otherwise(0.0)


def spaced(c: Column) -> Column:
    """White space collapsed, stripped, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def parts(c: Column, pattern: str = "[;/,]") -> Column:
    """Stripped, non-empty pieces between delimiters."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def accession_key(c: Column) -> Column:
    """The first token of a list of accessions; null where there is none."""
    return F.when(~no_accession(c), F.get(F.filter(F.split(strip(c), r"[;,\s]+"), lambda x: x != ""), F.lit(0)))


def codes(c: Column) -> Column:
    """Ontology codes of a list, without tokens that mean missing."""
    return F.filter(parts(c, "[;,]"), lambda x: ~no_term(x))


def terms(c: Column, pattern: str = "[;,]") -> Column:
    """Terms of a list (a slash parts them as well)."""
    return F.filter(parts(F.replace(c, F.lit("/"), F.lit(";")), pattern), lambda x: ~no_term(x))


def subgroup_key(c: Column) -> Column:
    """Lower case, stripped, one trailing s dropped where something is left."""
    return F.regexp_replace(F.lower(strip(c)), "(?<=.)s$", "")


def whole_id(c: Column) -> Column:
    """A numeric identifier as whole-number text (`12.0` as `12`), else null."""
    from .values import to_number

    return to_number(c).try_cast("bigint").cast("string")


def identifier(c: Column) -> Column:
    """Struct (kind, id) of a publication id: `PMID:`, `PMCID:`, `PMC` or digits; null for anything else."""
    s = strip(c)
    up = F.upper(s)
    return (
        F.when(up.startswith("PMID:"), F.struct(F.lit("pmid").alias("kind"), strip(F.substr(s, F.lit(6))).alias("id")))
        .when(up.startswith("PMCID:"), F.struct(F.lit("pmcid").alias("kind"), F.regexp_replace(strip(F.substr(s, F.lit(7))), "^[PMCpmc]+", "").alias("id")))
        .when(up.startswith("PMC"), F.struct(F.lit("pmcid").alias("kind"), strip(F.substr(s, F.lit(4))).alias("id")))
        .when(s.rlike("^[0-9]+$"), F.struct(F.lit("pmid").alias("kind"), s.alias("id")))
    )
