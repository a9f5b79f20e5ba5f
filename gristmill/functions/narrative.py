"""How much a text reads like an article, and its tail of references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section headings, junk lines, the heading of a reference list, sources of structured text.
HEADINGS = (
    "introduction", "background", "materials and methods", "methods", "results", "discussion",
    "conclusion", "data availability", "availability of data", "acknowledg", "references",
)
JUNK_LINE = r"[kpcofgs]__[A-Za-z0-9_]+|\b(?:GC[AF]_|NZ_|NC_)\d"
TAIL = r"(?i)\n\s*(?:references|bibliography|literature cited)\s*\n"
STRUCTURED_SOURCES = ("pmc_fulltext", "europepmc_fulltext")
GOOD_SCORE = 1.5


def strip_tail(text: Column, heading: str = TAIL) -> Column:
    """The text before the last heading of the tail, if that stands beyond a fifth of it."""
    heads = F.regexp_extract_all(text, F.lit(heading), F.lit(0))
    start = F.length(text) - F.length(F.element_at(F.split(text, heading), -1)) - F.length(F.try_element_at(heads, F.lit(-1)))
    return F.when((F.size(heads) > 0) & (start > F.length(text) * 0.2), F.substring(text, F.lit(1), start)).otherwise(text)


def _once(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def narrative_score(text: Column, source: Column, headings: tuple[str, ...] = HEADINGS, junk: str = JUNK_LINE, tail: str = TAIL, sources=STRUCTURED_SOURCES) -> Column:
    """2 * structure + 1.5 * length + prior - 2 * junk; 0 for a blank text."""
    prior = F.when(source.isin(*sources), 0.3).otherwise(0.0)

    def structure(low: Column) -> Column:
        hits = sum((F.contains(low, F.lit(h)).cast("int") for h in headings), F.lit(0))
        return 2.0 * F.least(hits, F.lit(6)) / 6.0

    def junk_share(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(junk))) / F.size(lines)).otherwise(0.0)

    def whole(body: Column) -> Column:
        lines = F.filter(F.split(body, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: x.rlike(r"\S"))
        length = 1.5 * F.least(F.length(body), F.lit(20000)) / 20000.0
        return _once(F.lower(body), structure) + length + prior - 2.0 * _once(lines, junk_share)

    score = _once(strip_tail(text, tail), whole)
    return F.when(F.coalesce(text.rlike(r"\S"), F.lit(False)), score).otherwise(0.0)
