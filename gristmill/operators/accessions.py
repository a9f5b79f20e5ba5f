"""Mining of dataset accessions and the choice of a study's own project."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accession patterns by kind, words of data availability, characters looked at on either side.
PATTERNS = {
    "bioproject": r"\bPRJ(?:NA|EB|DB)[0-9]+\b",
    "study": r"\b(?:SR|ER|DR)P[0-9]{5,}\b",
    "run": r"\b(?:SR|ER|DR)R[0-9]{5,}\b",
    "experiment": r"\b(?:SR|ER|DR)X[0-9]{5,}\b",
    "sample": r"\b(?:SR|ER|DR)S[0-9]{5,}\b",
    "biosample": r"\bSAM(?:N|EA|D)[A-Z]?[0-9]+\b",
}
CONTEXT_TERMS = (
    "availab", "accession", "deposit", "european nucleotide archive", " ena", "sequence read archive", " sra",
    "bioproject", "repositor", "raw read", "raw sequenc", "submitted to", "under accession", "archived", "data are",
    "have been made", "can be found", "are available", "was deposited",
)
WINDOW = 250
MOST_RESOLVED = 8


def _found(text: str, patterns: list[tuple[str, re.Pattern]], terms: tuple[str, ...], reach: int) -> dict[str, list]:
    """value -> [kind, strongest context, occurrences] of a text; a window is cut and read once for all terms."""
    out: dict[str, list] = {}
    for kind, pattern in patterns:
        for hit in pattern.finditer(text):
            start, end = hit.span()
            window = text[max(0, start - reach) : end + reach].lower()
            context = sum(t in window for t in terms)
            entry = out.setdefault(hit.group(), [kind, context, 0])
            entry[0], entry[1], entry[2] = min(entry[0], kind), max(entry[1], context), entry[2] + 1
    return out


def mine(docs: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS, terms: tuple[str, ...] = CONTEXT_TERMS, reach: int = WINDOW) -> DataFrame:
    """(key, kind, value, context_score, n): every accession of a document, its strongest context and its occurrences.

    One pass over each text; rows of an equal key are added up.  A null text has none.
    """
    compiled = [(kind, re.compile(p)) for kind, p in patterns.items()]
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "value", "context_score", "n"]
        for batch in batches:
            rows, at = [], []
            for i, value in enumerate(batch.column(1)):
                for found, (kind, context, n) in _found(value.as_py() or "", compiled, terms, reach).items():
                    at.append(i)
                    rows.append((kind, found, context, n))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {key_type}, kind string, value string, context_score long, n long")
    out = rows.groupBy("key", "value").agg(F.min("kind").alias("kind"), F.max("context_score").alias("context_score"), F.sum("n").alias("n"))
    return out.select(F.col("key").alias(key), "kind", "value", "context_score", "n")


def own_projects(accessions: DataFrame, key: str, resolved: DataFrame | None = None, project: str = "bioproject", most: int = MOST_RESOLVED) -> DataFrame:
    """(key, project, rule): the study's own projects.

    rule 1: projects with the strongest context of data availability, ties all;
    rule 2: the only project of the document; rule 3: other accessions in
    context, the strongest and most frequent first and at most `most`, looked
    up in `resolved` (value, project).  Rival projects without context give none.
    """
    by_doc = Window.partitionBy(key)
    projects = accessions.where(F.col("kind") == project)
    ranked = projects.withColumn("top", F.max("context_score").over(by_doc)).withColumn("rivals", F.count("*").over(by_doc))
    chosen = ranked.where("(top > 0 AND context_score = top) OR (top = 0 AND rivals = 1)")
    out = chosen.select(key, F.col("value").alias("project"), F.when(F.col("top") > 0, 1).otherwise(2).alias("rule"))
    if resolved is None:
        return out
    others = accessions.join(projects.select(key).distinct(), key, "left_anti").where("context_score > 0")
    order = Window.partitionBy(key).orderBy(F.desc("context_score"), F.desc("n"), "value")
    tried = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    found = tried.join(resolved, "value").select(key, "project").distinct()
    return out.unionByName(found.withColumn("rule", F.lit(3)))


def best_candidate(candidates: DataFrame, key: str, score: str = "score", order: str = "rung", body: str = "is_body") -> DataFrame:
    """One candidate text of each paper: a body before an abstract, then the best score, then the earlier rung."""
    rank = F.struct(F.col(body).cast("int").alias("a"), F.col(score).alias("b"), (-F.col(order)).alias("c"))
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("x")).select(key, *[f"x.{c}" for c in rest])


def ladder(candidates: DataFrame, key: str, good: float, score: str = "score", order: str = "rung", body: str = "is_body") -> DataFrame:
    """The candidates that a search would have looked at: it stops after the first body that scores `good`."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col(body), F.col(score))).over(before)
    return candidates.withColumn("__best", seen).where(F.col("__best").isNull() | (F.col("__best") < good)).drop("__best")
