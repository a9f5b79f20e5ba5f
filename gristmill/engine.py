"""The lifecycle: files to grids, grids to sample rows, stored model answers to records, records to metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as ev
from .operators import joins, mapping, profile, records
from .plans.table_plan import PlanError, TablePlan, execute, identity_plan, with_dropped_fields
from .shared import written
from .sources import grid as grids
from .sources import results as res
from .sources.schema import Schema

#: Given a table's name, its header and the schema's field names: a plan, or None for the identity.
Planner = Callable[[str, list[str], list[str]], TablePlan | None]


@dataclass
class Samples:
    """Sample rows, and what happened on the way to them."""

    rows: DataFrame | None
    selection: DataFrame | None
    warnings: list[str] = field(default_factory=list)
    log: joins.JoinLog | None = None


class Engine:
    """All steps over one Spark session.

    Planning has two phases: a small job profiles tables and collects a row for
    each, then one lazy plan is made of those that are kept.
    """

    def __init__(self, spark: SparkSession, gate: float = profile.GATE, planner: Planner | None = None, fuzzy: bool = True):
        self.spark, self.gate, self.planner, self.fuzzy = spark, gate, planner, fuzzy

    def ingest(self, path: str | list[str], pattern: str | None = None) -> DataFrame:
        return grids.read_files(self.spark, path, pattern)

    def score(self, grid: DataFrame, schema: Schema) -> DataFrame:
        """Relevance of every promoted grid."""
        return profile.relevance(grids.cells_of(grid), schema, grids.cleaned(grid))

    def samples(self, grid: DataFrame, schema: Schema) -> Samples:
        """Relevant tables, read by their plans, mapped to fields and joined to the most relevant one."""
        clean = grids.cleaned(grid)
        headers = {r.table_id: r for r in grids.promote(grid).collect()}
        selection = self.score(grid, schema)
        warnings: list[str] = []
        kept: list[tuple[float, str]] = []
        for r in sorted(selection.collect(), key=lambda r: r.table_id):
            if r.is_matrix:
                warnings.append(f"{r.table_id}: skipped as a measurement matrix")
            elif r.score < self.gate:
                warnings.append(f"{r.table_id}: skipped, relevance {r.score:.2f} is below {self.gate:.2f}")
            else:
                kept.append((r.score, r.table_id))
        tables = []
        for _, name in sorted(kept, key=lambda x: -x[0]):
            header, size = headers[name].columns, (headers[name].n_rows + 1, headers[name].width)
            one = clean.where(F.col("table_id") == name)
            try:
                plan = (self.planner(name, header, schema.names) if self.planner else None) or identity_plan(header)
                rows = execute(one, with_dropped_fields(plan, header, schema.names), size)
            except PlanError as error:
                warnings.append(f"{name}: {error}; read by its first row")
                rows = execute(one, identity_plan(header), size)
            places = [c for c in ("row_idx", "cat_idx") if c in rows.columns]
            found = mapping.map_headers([c for c in rows.columns if c not in places], schema.names, fuzzy=self.fuzzy)
            ordered = rows.withColumn("__at", F.struct(*places)).drop(*places)
            tables.append((name, mapping.rename(ordered, found).withColumnRenamed("__at", "row_idx")))
            warnings += [f"{name}: {h!r} collides on {f!r}" for h, f in found.collisions]
        if not tables:
            return Samples(None, selection, warnings)
        merged, log = joins.join_tables(tables)
        return Samples(merged, selection, warnings, log)

    def samples_or_manifest(self, own: DataFrame, manifest: DataFrame, schema: Schema) -> Samples:
        """The article's own tables; the manifest's only if those give no row."""
        first = self.samples(own, schema)
        if first.rows is not None and not first.rows.isEmpty():
            first.warnings.append("run manifest not used")
            return first
        second = self.samples(manifest, schema)
        second.warnings = [*first.warnings, "no rows from own tables; using the run manifest", *second.warnings]
        return second

    def records(self, raw: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(samples, fields) from stored answers: batches merged, study values handed down, age bounds filled.  Values are variants."""
        seen = written(res.parsed(raw))  # parsed once for fields, samples and subgroups
        first = res.first_fields(res.field_rows(seen))
        fields = records.bounded_study_ages(first)
        rows = res.sample_rows(seen)
        earliest = rows.groupBy("study").agg(F.min("batch").alias("batch"))
        kept = rows.join(earliest, ["study", "batch"]) if ids is None else rows
        groups = seen.where("result IS NOT NULL").groupBy(F.col("paper_id").alias("study")).agg(F.min_by("result.subgroups", "batch_idx").alias("subgroups"))
        filled = records.fan_out(kept.select("study", "row_idx", "values"), first.select("study", "field", "value", "by_subgroup"), groups)
        return records.bounded_ages(filled.select("study", "row_idx", "values")), fields

    def evaluate(self, samples: DataFrame, gold: DataFrame, field_map: dict[str, str], fields: DataFrame | None = None, **options) -> dict[str, DataFrame]:
        """cells, by_field, total, strata.  Cells are written to the shared folder, so that they are made once for all metrics."""
        cells = written(ev.cells(samples, gold, field_map, fields, **options))
        return {"cells": cells, "by_field": ev.metrics_by_field(cells, list(field_map)), "total": ev.micro(cells), "strata": ev.strata(cells)}

