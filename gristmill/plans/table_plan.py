"""Structural plans: a small description of how to read a raw grid, compiled to DataFrame operations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import map_headers


class PlanError(ValueError):
    """A plan that does not fit its table, or is no plan."""


@dataclass(frozen=True)
class MeltGroup:
    value_column: str
    sources: dict[str, int]


@dataclass(frozen=True)
class Melt:
    category_column: str
    groups: tuple[MeltGroup, ...]
    skip_missing_categories: bool = True


@dataclass(frozen=True)
class TablePlan:
    """Rows of the header, where data begins, columns to keep, and how to melt the others.

    header_merge_sep and drop_columns are read and checked but change nothing.
    """

    header_rows: tuple[int, ...]
    data_starts_at: int
    id_columns: tuple[tuple[int, str], ...]
    melt: Melt | None = None
    drop_rows: tuple[int, ...] = ()
    drop_columns: tuple[int, ...] = ()
    header_merge_sep: str = " | "
    notes: str | None = field(default=None, compare=False)

    @classmethod
    def parse(cls, text: str | dict) -> TablePlan:
        """From JSON, also inside a code fence."""
        from ..functions.jsontext import json_object

        try:
            data = text if isinstance(text, dict) else json.loads(json_object(text) or "")
            melt = data.get("melt")
            if melt is not None:
                groups = tuple(MeltGroup(g["value_column"], {str(k): int(v) for k, v in g["sources"].items()}) for g in melt["groups"])
                melt = Melt(melt["category_column"], groups, bool(melt.get("skip_missing_categories", True)))
            return cls(
                tuple(map(int, data["header_rows"])), int(data["data_starts_at"]), tuple((int(c["col"]), str(c["name"])) for c in data["id_columns"]), melt,
                tuple(map(int, data.get("drop_rows") or ())), tuple(map(int, data.get("drop_columns") or ())), data.get("header_merge_sep", " | "), data.get("notes"),
            )
        except (KeyError, TypeError, ValueError, AttributeError) as error:
            raise PlanError(f"not a table plan: {error}") from error

    @property
    def categories(self) -> list[str]:
        """Category labels over all groups, in first-seen order."""
        return list(dict.fromkeys(k for g in self.melt.groups for k in g.sources)) if self.melt else []


def identity_plan(header: list[str]) -> TablePlan:
    """One header row and every column under its own name: what is used where no plan is given."""
    return TablePlan((0,), 1, tuple(enumerate(header)))


def check(plan: TablePlan, n_rows: int, n_columns: int) -> None:
    """Raises PlanError where the plan points outside a grid of this size."""
    if not n_rows:
        raise PlanError("the table has no rows")
    outside = [r for r in plan.header_rows if not 0 <= r < n_rows]
    if outside:
        raise PlanError(f"header rows {outside} are outside {n_rows} rows")
    if not 0 <= plan.data_starts_at < n_rows:
        raise PlanError(f"data start at {plan.data_starts_at}, the table has {n_rows} rows")
    columns = [c for c, _ in plan.id_columns] + list(plan.drop_columns)
    columns += [c for g in (plan.melt.groups if plan.melt else ()) for c in g.sources.values()]
    outside = [c for c in columns if not 0 <= c < n_columns]
    if outside:
        raise PlanError(f"columns {outside} are outside {n_columns} columns")


def data_rows(grid: DataFrame, plan: TablePlan) -> DataFrame:
    """The grid's data rows."""
    rows = grid.where(F.col("row_idx") >= plan.data_starts_at)
    return rows.where(~F.col("row_idx").isin(*plan.drop_rows)) if plan.drop_rows else rows


def _cell(i: int) -> Column:
    """Cell i, '' where the row is too short."""
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def execute(grid: DataFrame, plan: TablePlan, size: tuple[int, int] | None = None) -> DataFrame:
    """The plan's rows of one grid (row_idx, cells): kept columns, then the category and a value column a group.

    row_idx stays, with cat_idx beside it after a melt, so that the order of
    rows is data.  size (rows, columns) spares the pass that measures the grid.
    """
    if size is None:
        found = grid.agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("w")).first()
        size = (found.n, found.w or 0)
    check(plan, *size)
    kept = [_cell(c).alias(name) for c, name in plan.id_columns]
    rows = data_rows(grid, plan)
    if not plan.melt or not plan.melt.groups:
        return rows.select("row_idx", *kept)
    groups = plan.melt.groups
    entries = []
    for k, label in enumerate(plan.categories):
        values = [(_cell(g.sources[label]) if label in g.sources else F.lit("")).alias(f"v{i}") for i, g in enumerate(groups)]
        entries.append(F.struct(F.lit(k).alias("cat_idx"), F.lit(label).alias("category"), *values))
    many = F.array(*entries)
    if plan.melt.skip_missing_categories:
        many = F.filter(many, lambda x: F.array_contains(F.array(*[x[f"v{i}"] != "" for i in range(len(groups))]), True))
    long = rows.select("row_idx", *[c.alias(f"k{i}") for i, c in enumerate(kept)], F.inline(many))
    named = [F.col(f"k{i}").alias(name) for i, (_, name) in enumerate(plan.id_columns)]
    return long.select("row_idx", "cat_idx", *named, F.col("category").alias(plan.melt.category_column), *[F.col(f"v{i}").alias(g.value_column) for i, g in enumerate(groups)])


def with_dropped_fields(plan: TablePlan, header: list[str], fields: list[str]) -> TablePlan:
    """The plan with those columns put back that map to a field which nothing kept maps to.

    Only for a flat plan with a single header row, where rows stay rows.
    """
    if plan.melt is not None or len(plan.header_rows) != 1:
        return plan
    names = [name for _, name in plan.id_columns]
    covered = set(map_headers(names, fields).mapped.values())
    missing = [h for h, f in map_headers(header, fields).mapped.items() if f not in covered and h not in names]
    return TablePlan(
        plan.header_rows, plan.data_starts_at, (*plan.id_columns, *((header.index(h), h) for h in missing)), None,
        plan.drop_rows, plan.drop_columns, plan.header_merge_sep, plan.notes,
    )


def merged_header(rows: list[list[str]], sep: str = " | ") -> list[str]:
    """Header rows as one: blanks take the label on their left, columns are joined, repeats one after another are not."""
    width = max(map(len, rows), default=0)
    filled = []
    for row in rows:
        last, out = "", []
        for cell in [*row, *[""] * (width - len(row))]:
            last = cell.strip() or last
            out.append(last)
        filled.append(out)
    merged = []
    for column in zip(*filled):
        labels = [c for c in column if c]
        merged.append(sep.join(c for i, c in enumerate(labels) if not i or c != labels[i - 1]))
    return merged


def shown_grids(grid: DataFrame, n: int = 20) -> DataFrame:
    """(table_id, text): the first n rows of every grid as numbered, tab-separated lines under numbered columns, to show to a planner.

    Short rows are padded to the widest of those shown; tabs and line breaks
    are blanks.  A table holds n rows here at most, so its text is small.
    """
    clean = F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\n]", " "))
    head = grid.where(F.col("row_idx") < n).select("table_id", F.struct("row_idx", clean.alias("cells")).alias("r"))
    tables = head.groupBy("table_id").agg(F.array_sort(F.collect_list("r")).alias("rows"), F.max(F.size("r.cells")).alias("width"))
    header = F.concat(F.array(F.lit("row")), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    header = F.when(F.col("width") > 0, header).otherwise(F.array(F.lit("row"), F.lit("")))

    def line(r: Column) -> Column:
        padded = F.concat(r["cells"], F.array_repeat(F.lit(""), (F.col("width") - F.size(r["cells"])).cast("int")))
        return F.concat_ws("\t", r["row_idx"].cast("string"), F.array_join(padded, "\t"))

    return tables.select("table_id", F.array_join(F.concat(F.array(F.array_join(header, "\t")), F.transform("rows", line)), "\n").alias("text"))
