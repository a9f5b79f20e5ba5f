"""Headers onto schema fields, by four tiers of likeness."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Synonyms of field names.
ALIASES: dict[str, str] = {
    "gender": "sex", "participant_sex": "sex", "participantsex": "sex", "subject_sex": "sex",
    "bodysite": "body_site", "body_site_name": "body_site", "anatomical_site": "body_site", "anatomicalsite": "body_site",
    "subjectid": "subject_id", "subject": "subject_id", "participant_id": "subject_id", "participantid": "subject_id",
    "sampleid": "sample_id", "sample": "sample_id", "specimen_id": "sample_id", "specimenid": "sample_id",
    "countrycode": "country", "nation": "country",
    "ncbi": "ncbi_accession", "sra_accession": "ncbi_accession", "sraaccession": "ncbi_accession",
    "bioproject": "ncbi_accession", "bioproject_id": "ncbi_accession",
    "run": "ncbi_accession", "run_accession": "ncbi_accession", "runaccession": "ncbi_accession",
    "pmid_id": "pmid", "pubmed_id": "pmid", "pubmedid": "pmid",
    "diseasestate": "disease", "disease_status": "disease",
    "studyname": "study_name", "study": "study_name",
    "agegroup": "age_group", "age_at_collection": "age", "ageatcollection": "age", "ageyears": "age_years",
    "ageunit": "age_unit", "agemin": "age_min", "agemax": "age_max",
    "bodymassindex": "bmi", "body_mass_index": "bmi",
    "dnakit": "dna_extraction_kit", "extraction_kit": "dna_extraction_kit", "extractionkit": "dna_extraction_kit",
    "sequencing": "sequencing_platform", "platform": "sequencing_platform", "sequencer": "sequencing_platform",
    "instrument": "sequencing_platform", "instrument_model": "sequencing_platform", "instrumentmodel": "sequencing_platform",
    "treatmentname": "treatment", "smoking": "smoker", "smoking_status": "smoker",
    "isolation_source": "body_site", "westernised": "westernized",
}
FUZZY_LEAST = 90.0
#: Headers whose field is kept in a task.
MOST_KNOWN = 1 << 16


def squeezed(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.lower())


def ratio(a: str, b: str) -> float:
    """Likeness in percent by insertions and deletions alone: 200 * common subsequence / both lengths.

    The row of the table of common subsequences is one integer, a bit a letter of a.
    """
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


class Headers:
    """What a schema's fields make of a header: its field, the tier and the score; answers are kept for the next time."""

    def __init__(self, fields: list[str], aliases: dict[str, str] | None = None, fuzzy: bool = True, least: float = FUZZY_LEAST):
        self.fields, self.fuzzy, self.least = fields, fuzzy, least
        self.exact = {f.lower(): f for f in fields}
        self.plain = {squeezed(f): f for f in fields}
        self.aliases = {squeezed(k): v for k, v in (ALIASES if aliases is None else aliases).items()}
        self.letters = [(f, f.lower(), Counter(f.lower())) for f in fields]
        self.known: dict[str, tuple[str, str, float] | None] = {}

    def target(self, header: str) -> tuple[str, str, float] | None:
        if header not in self.known:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            self.known[header] = self._target(header)
        return self.known[header]

    def _target(self, header: str) -> tuple[str, str, float] | None:
        low, bare = header.lower(), squeezed(header)
        if low in self.exact:
            return self.exact[low], "exact", 100.0
        if bare in self.plain:
            return self.plain[bare], "normalized", 100.0
        if bare in self.aliases:  # an alias of no field ends the search
            return (self.aliases[bare], "alias", 100.0) if self.aliases[bare] in self.fields else None
        return self._likest(low) if self.fuzzy else None

    def _likest(self, low: str) -> tuple[str, str, float] | None:
        """The first of the likest fields, if like enough.  Letters in common bound a likeness from above, so few are worked out."""
        mine, best = Counter(low), None
        for field_, other, letters in self.letters:
            least = best[2] if best else self.least
            if 200.0 * (mine & letters).total() >= least * (len(low) + len(other)):
                score = ratio(low, other)
                if score >= self.least and (best is None or score > best[2]):
                    best = field_, "fuzzy", score
        return best


@dataclass
class Mapping:
    """mapped: header -> field; tier of each; headers left over; and those whose field was taken."""

    mapped: dict[str, str] = field(default_factory=dict)
    tier: dict[str, str] = field(default_factory=dict)
    unmapped: list[str] = field(default_factory=list)
    collisions: list[tuple[str, str]] = field(default_factory=list)


def map_headers(headers: list[str], fields: list[str], aliases: dict[str, str] | None = None, fuzzy: bool = True, least: float = FUZZY_LEAST) -> Mapping:
    """Each header's field by the first tier that has one; a field goes to the first header that asks for it."""
    known, out, taken = Headers(fields, aliases, fuzzy, least), Mapping(), set()
    for header in headers:
        found = known.target(header)
        if found is None:
            out.unmapped.append(header)
        elif found[0] in taken:
            out.collisions.append((header, found[0]))
            out.unmapped.append(header)
        else:
            out.mapped[header], out.tier[header] = found[:2]
            taken.add(found[0])
    return out


def map_header_rows(headers: DataFrame, fields: list[str], aliases: dict[str, str] | None = None, fuzzy: bool = True, least: float = FUZZY_LEAST) -> DataFrame:
    """(table_id, col_idx, header, field, tier, score, collided) of the headers of all tables, by the rules of map_headers.

    A header without a field has nulls; one whose field an earlier column of
    its table has taken keeps it with `collided`.  A null header has no field.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Headers(fields, aliases, fuzzy, least)
        for batch in batches:
            found = [known.target(h) if h is not None else None for h in batch.column(2).to_pylist()]
            columns = [pa.array([f and f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["table_id", "col_idx", "header", "field", "tier", "score"])

    plain = headers.select("table_id", F.col("col_idx").cast("long").alias("col_idx"), "header")
    kind = plain.schema["table_id"].dataType.simpleString()
    found = plain.mapInArrow(run, f"table_id {kind}, col_idx long, header string, field string, tier string, score double")
    first = F.min("col_idx").over(Window.partitionBy("table_id", "field"))
    return found.withColumn("collided", F.col("field").isNotNull() & (F.col("col_idx") > first))


def rename(df: DataFrame, mapping: Mapping) -> DataFrame:
    """df under its fields' names; where two columns end up under one name the last one's values stay, in the first one's place."""
    last: dict[str, str] = {}
    for c in df.columns:
        last[mapping.mapped.get(c, c)] = c
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in last.items()])
