"""Profiles of tables held as cells, and their relevance to a schema.

cells: table_id, row_idx, col_idx, col, value - body cells only.
grid: table_id, row_idx, cells array<string> - all rows, the header first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import containment, tokens
from ..functions.values import is_number
from ..sources.schema import Schema

#: Weights of the signals, thresholds, and patterns of feature and sample names.
W_SHAPE, W_ID, W_NAME, W_ENUM = 0.20, 0.20, 0.25, 0.35
NAME_LEAST, ENUM_LEAST = 0.5, 0.3
MATRIX_NUMERIC, MATRIX_COLUMNS, MATRIX_ROWS = 0.7, 5, 3
GATE = 0.15
TAXON = r"\b[kpcofgst]__[A-Za-z0-9_]+"
GENOME = r"^(?:GCF_|GCA_|NC_|NZ_|NW_|RefSeq)"
SAMPLE_NAME = r"^[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+$"


def column_profile(cells: DataFrame) -> DataFrame:
    """One pass over the cells: table_id, col_idx, col, n_rows, n_filled, n_distinct, n_numeric."""
    filled = F.col("value") != ""
    return cells.groupBy("table_id", "col_idx", "col").agg(
        F.count("*").alias("n_rows"),
        F.count_if(filled).alias("n_filled"),
        F.countDistinct(F.when(filled, F.col("value"))).alias("n_distinct"),
        F.count_if(is_number(F.col("value"))).alias("n_numeric"),
    )


def id_signal(profile: DataFrame) -> DataFrame:
    """(table_id, id_column, id_col): uniqueness of the most unique column with four values or more, if above 0.9; else 0."""
    share = F.when(F.col("n_filled") >= 4, F.col("n_distinct") / F.col("n_filled")).otherwise(0.0)
    best = profile.withColumn("share", share).groupBy("table_id").agg(F.max(F.struct("share", (-F.col("col_idx")).alias("o"), "col")).alias("x"))
    good = F.col("x.share") > 0.9
    return best.select("table_id", F.when(good, F.col("x.share")).otherwise(0.0).alias("id_column"), F.when(good, F.col("x.col")).alias("id_col"))


def numeric_density(profile: DataFrame) -> DataFrame:
    """(table_id, density): numeric share of the filled cells of all columns but the first."""
    body = F.col("col_idx") > 0
    out = profile.groupBy("table_id").agg(F.sum(F.when(body, F.col("n_numeric"))).alias("a"), F.sum(F.when(body, F.col("n_filled"))).alias("b"))
    return out.select("table_id", F.coalesce(F.try_divide("a", "b"), F.lit(0.0)).alias("density"))


def shape_signal(n_rows: Column, n_columns: Column) -> Column:
    """Rows up to eight, of eight; 0 for a single column."""
    return F.when(n_columns < 2, 0.0).otherwise(F.least(n_rows / 8.0, F.lit(1.0)))


def enum_overlap(cells: DataFrame, schema: Schema) -> DataFrame:
    """(table_id, field, col, share): of each enum field the column whose distinct values it allows most of, if enough."""
    allowed = [(f.name, i, sorted({v.lower() for v in f.allowed_values or ()} | {k.lower() for k in f.value_descriptions or {}})) for i, f in enumerate(schema.fields) if f.type == "enum" and f.allowed_values]
    sets = F.array(*[F.struct(F.lit(n).alias("field"), F.array(*map(F.lit, vs)).alias("allowed")) for n, _, vs in allowed])
    if not allowed:
        sets = F.array().cast("array<struct<field:string,allowed:array<string>>>")
    seen = cells.where("value <> ''").select("table_id", "col_idx", "col", F.lower("value").alias("v")).distinct()
    hits = seen.select("table_id", "col_idx", "col", F.inline(F.transform(sets, lambda s: F.struct(s["field"].alias("field"), F.array_contains(s["allowed"], F.col("v")).cast("int").alias("hit")))))
    share = hits.groupBy("table_id", "col_idx", "col", "field").agg(F.avg("hit").alias("share"))
    best = share.groupBy("table_id", "field").agg(F.max(F.struct("share", (-F.col("col_idx")).alias("o"), "col")).alias("x"))
    return best.where(F.col("x.share") >= ENUM_LEAST).select("table_id", "field", "x.col", "x.share")


def name_matches(columns: DataFrame, schema: Schema) -> DataFrame:
    """(table_id, field, col, score): of each field the column whose header fits its name or description best, if enough.

    columns: table_id, col_idx, col.  Fields are a literal array, so nothing is crossed or shuffled but headers.
    """
    fields = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.name).alias("n"), F.lit(f"{f.name} {f.description or ''}").alias("d")) for f in schema.fields])
    header = tokens(F.col("col"))

    def fit(f: Column) -> Column:
        by_name = containment(tokens(f["n"]), header)
        by_words = F.when(F.size(header) >= 2, containment(header, tokens(f["d"]))).otherwise(0.0)
        return F.struct(f["field"].alias("field"), F.greatest(by_name, by_words).alias("score"))

    long = columns.select("table_id", "col_idx", "col", F.inline(F.transform(fields, fit)))
    best = long.groupBy("table_id", "field").agg(F.max(F.struct("score", (-F.col("col_idx")).alias("o"), "col")).alias("x"))
    return best.where(F.col("x.score") >= NAME_LEAST).select("table_id", "field", "x.col", "x.score")


def schema_matches(cells: DataFrame, columns: DataFrame, schema: Schema) -> DataFrame:
    """(table_id, field, col, by): matched by allowed values, else by name."""
    enums = enum_overlap(cells, schema).select("table_id", "field", "col", F.lit("enum").alias("by"))
    names = name_matches(columns, schema).join(enums.select("table_id", "field"), ["table_id", "field"], "left_anti")
    return enums.unionByName(names.select("table_id", "field", "col", F.lit("name").alias("by")))


def feature_matrix(grid: DataFrame, probe: int = 20) -> DataFrame:
    """(table_id, is_feature_matrix): sample names in the header, or feature names in the first column over a numeric body.

    The first row sets the width; where it is mostly blank the second fills it.
    Only the first probe + 1 rows are read of each table.
    """
    sizes = grid.groupBy("table_id").agg(F.count("*").alias("n"))
    head = grid.where(F.col("row_idx") <= probe)
    tops = head.where("row_idx < 2").groupBy("table_id").agg(
        F.max(F.when(F.col("row_idx") == 0, F.col("cells"))).alias("top"), F.max(F.when(F.col("row_idx") == 1, F.col("cells"))).alias("next")
    )
    tops = tops.withColumn("w", F.size("top"))
    blank = F.size(F.filter(F.slice("top", 2, F.greatest(F.col("w") - 1, F.lit(0))), lambda h: h != ""))
    few = blank < F.greatest(F.lit(2.0), (F.col("w") - 1) * 0.3)
    filled = F.transform("top", lambda h, i: F.when(few & (h == "") & (i > 0), F.coalesce(F.get("next", i), F.lit(""))).otherwise(h))
    names = F.filter(F.slice(filled, 2, F.greatest(F.col("w") - 1, F.lit(0))), lambda h: h != "")
    like = F.filter(names, lambda h: h.rlike(SAMPLE_NAME) & h.rlike("[0-9]"))
    signal = F.when(F.size(names) > 0, F.size(like) / F.size(names)).otherwise(0.0)
    tops = tops.select("table_id", "w", signal.alias("names"))
    first = F.get("cells", F.lit(0))
    body = head.where("row_idx > 0").join(tops.select("table_id", "w"), "table_id")
    rest = F.filter(F.slice("cells", 2, F.greatest(F.col("w") - 1, F.lit(0))), lambda c: c != "")
    stats = body.groupBy("table_id").agg(
        F.try_divide(F.count_if((first != "") & (first.rlike(TAXON) | first.rlike(GENOME))), F.count_if(first != "")).alias("features"),
        F.try_divide(F.sum(F.size(F.filter(rest, is_number))), F.sum(F.size(rest))).alias("numeric"),
    )
    out = sizes.join(tops, "table_id", "left").join(stats, "table_id", "left")
    by_names = (F.col("names") >= 0.8) & (F.col("w") >= 5)
    by_body = (F.coalesce("features", F.lit(0.0)) >= 0.5) & (F.coalesce("numeric", F.lit(0.0)) >= 0.7)
    return out.select("table_id", F.coalesce((F.col("n") >= 3) & (F.col("w") >= 2) & (by_names | by_body), F.lit(False)).alias("is_feature_matrix"))


def relevance(cells: DataFrame, schema: Schema, grid: DataFrame | None = None) -> DataFrame:
    """One row a table: table_id, score, shape, id_column, name_match, enum_match, is_matrix, matched_fields.

    A feature matrix scores 0; so does a wide, dense, numeric table that
    matches nothing.  The score is not rounded.
    """
    profile = column_profile(cells)
    tables = profile.groupBy("table_id").agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("n_columns"))
    matches = schema_matches(cells, profile.select("table_id", "col_idx", "col"), schema)
    hits = matches.groupBy("table_id").agg(
        F.count_if(F.col("by") == "name").alias("names"), F.count_if(F.col("by") == "enum").alias("enums"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "col")))).alias("matched_fields"),
    )
    out = tables.join(id_signal(profile), "table_id").join(numeric_density(profile), "table_id").join(hits, "table_id", "left")
    if grid is not None:
        out = out.join(feature_matrix(grid), "table_id", "left")
    else:
        out = out.withColumn("is_feature_matrix", F.lit(False))
    n = float(max(len(schema.fields), 1))
    names, enums = F.coalesce("names", F.lit(0)) / n, F.coalesce("enums", F.lit(0)) / n
    dense = (names + enums == 0) & (F.col("n_columns") >= MATRIX_COLUMNS) & (F.col("n_rows") >= MATRIX_ROWS) & (F.col("density") >= MATRIX_NUMERIC)
    matrix = F.coalesce("is_feature_matrix", F.lit(False)) | dense
    shape = shape_signal(F.col("n_rows"), F.col("n_columns"))
    score = W_SHAPE * shape + W_ID * F.col("id_column") + W_NAME * names + W_ENUM * enums
    return out.select(
        "table_id", F.when(matrix, 0.0).otherwise(score).alias("score"), shape.alias("shape"), "id_column",
        F.when(matrix, 0.0).otherwise(names).alias("name_match"), F.when(matrix, 0.0).otherwise(enums).alias("enum_match"),
        matrix.alias("is_matrix"), F.coalesce("matched_fields", F.create_map().cast("map<string,string>")).alias("matched_fields"),
    )


def to_cells(df: DataFrame, table_id: str, row_idx: str, columns: list[str]) -> DataFrame:
    """A wide table as text cells; null becomes ''."""
    entries = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.lit(table_id).alias("table_id"), F.col(row_idx).alias("row_idx"), F.inline(entries))
