"""Stored answers of a model: extraction results as DataFrames.

No model is called here.  What it said is data: JSON documents (paper_id,
batch_idx, raw), from files or from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.ages import age_bounds
from ..functions.jsontext import recovered_json
from ..operators.records import AGE_FIELDS, AGE_NOTE, age_texts
from .grid import SPAN_ROWS, grids, read_files

#: Closed sets of the result format.
GRANULARITIES = ("study_level", "subgroup_level", "sample_level")
EXTRACTIONS = ("directly_stated", "derived", "inferred", "not_reported")
CONFIDENCES = ("high", "medium", "low")

FIELD = (
    "struct<value:variant,by_subgroup:map<string,variant>,unit:string,normalized_value:variant,normalized_unit:string,"
    "extraction_type:string,confidence:string,evidence_quote:string,section:string,notes:string>"
)
RESULT = (
    f"paper_id string, granularity string, subgroups array<string>, fields map<string,{FIELD}>, samples array<map<string,variant>>, extraction_warnings array<string>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, batch_idx, raw) of a folder of JSON files; the file's name stands in for a missing paper id."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1).alias("paper_id"), F.lit(0).alias("batch_idx"), F.col("value").alias("raw"))


def read_gold(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(study, row_idx, values) of gold tables, a tab-separated file a study, named by it; all values are text.

    The first row names the columns; rows without cells are passed over, and a
    short row's missing cells are null.
    """
    grid = grids(read_files(spark, path, "*.tsv"))
    heads = grid.where("row_idx = 0").select("table_id", F.col("cells").alias("names"))
    body = grid.where("row_idx > 0 AND size(cells) > 0").join(heads, "table_id")
    values = F.map_from_entries(F.transform("names", lambda n, i: F.struct(n.alias("key"), F.get("cells", i).alias("value"))))
    place = F.row_number().over(Window.partitionBy("table_id", F.floor(F.col("row_idx") / SPAN_ROWS)).orderBy("row_idx"))
    numbered = body.withColumn("place", place)
    spans = body.groupBy("table_id", F.floor(F.col("row_idx") / SPAN_ROWS).alias("span")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("table_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select("table_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = numbered.withColumn("span", F.floor(F.col("row_idx") / SPAN_ROWS)).join(bases, ["table_id", "span"])
    return joined.select(F.regexp_replace("table_id", r"(?i)\.tsv$", "").alias("study"), (F.col("base") + F.col("place") - 1).cast("bigint").alias("row_idx"), values.alias("values"))


def parsed(raw: DataFrame) -> DataFrame:
    """(paper_id, batch_idx, result, error): results that cannot be read, or break a closed set, have an error in place of values."""
    seen = raw.withColumn("result", F.from_json(recovered_json(F.col("raw")), RESULT, {"mode": "PERMISSIVE"}))
    fields = F.map_values("result.fields")
    bad_field = F.exists(fields, lambda f: ~F.coalesce(f["extraction_type"].isin(*EXTRACTIONS) & f["confidence"].isin(*CONFIDENCES), F.lit(False)))
    error = (
        F.when(F.col("result").isNull() | F.col("result.fields").isNull(), "not a result")
        .when(~F.coalesce(F.col("result.granularity").isin(*GRANULARITIES), F.lit(False)), "unknown granularity")
        .when(F.coalesce(bad_field, F.lit(False)), "a field has an unknown extraction type or confidence")
    )
    out = seen.withColumn("error", error)
    return out.select("paper_id", "batch_idx", F.when(F.col("error").isNull(), F.col("result")).alias("result"), "error")


def field_rows(results: DataFrame) -> DataFrame:
    """(study, batch, field, value, by_subgroup, ...) of every field of every result; values are variants."""
    long = results.where("result IS NOT NULL").select(F.col("paper_id").alias("study"), F.col("batch_idx").alias("batch"), F.explode("result.fields").alias("field", "f"))
    return long.select(
        "study", "batch", "field", "f.value", "f.by_subgroup", "f.extraction_type", "f.confidence", "f.evidence_quote", "f.section", "f.unit", "f.notes",
    )


def first_fields(rows: DataFrame) -> DataFrame:
    """Of each study's fields those of the earliest batch."""
    rest = [c for c in rows.columns if c not in ("study", "field")]
    return rows.groupBy("study", "field").agg(F.min_by(F.struct(*rest), "batch").alias("x")).select("study", "field", *[f"x.{c}" for c in rest])


def sample_rows(results: DataFrame) -> DataFrame:
    """(study, batch, row_idx, values) of every sample; values are variants."""
    long = results.where("result IS NOT NULL").select(F.col("paper_id").alias("study"), F.col("batch_idx").alias("batch"), F.posexplode("result.samples").alias("row_idx", "s"))
    return long.select("study", "batch", F.col("row_idx").cast("bigint").alias("row_idx"), F.col("s").alias("values"))


def snapshot(results: DataFrame) -> DataFrame:
    """Long form of both levels: study, level, sample_index (from 1, null for the study), field, value, evidence, section, confidence.

    A list gives a row for each of its items, null gives none.
    """
    fields = field_rows(results)
    found = F.transform(typed.snapshot_items(F.col("value")), lambda x: F.struct(x["value"].alias("value"), F.col("evidence_quote").alias("evidence"), "section", "confidence"))
    study = fields.select("study", F.lit("study").alias("level"), F.lit(None).cast("bigint").alias("sample_index"), "field", F.inline(found))
    samples = sample_rows(results).select("study", F.lit("sample").alias("level"), (F.col("row_idx") + 1).alias("sample_index"), F.explode("values").alias("field", "v"))
    return study.unionByName(samples.select("study", "level", "sample_index", "field", F.inline(typed.snapshot_items(F.col("v")))))


def _bounds(bag: Column) -> Column:
    """The age bounds rule on a map of variants: struct (age_min, age_max, n_written), bounds as variants, null where they stay."""
    texts = F.struct(*[x.alias(n) for n, x in age_texts({n: F.try_element_at(bag, F.lit(n)) for n in AGE_FIELDS}).items()])

    def changes(old: Column, new: Column) -> Column:
        changed = [F.when(~new[n].eqNullSafe(old[n]), new[n].cast("variant")).alias(n) for n in ("age_min", "age_max")]
        return F.struct(*changed, new["n_written"].alias("n_written"))

    return typed.let(texts, lambda old: typed.let(age_bounds(*[old[n] for n in AGE_FIELDS]), lambda new: changes(old, new)))


def _with(bag: Column, key: str, value: Column) -> Column:
    """bag with an entry set in its place, or added; unchanged where value is null."""
    given = F.create_map(F.lit(key), value)
    return F.when(value.isNull(), bag).otherwise(F.map_zip_with(bag, given, lambda k, old, new: F.coalesce(new, old)))


def age_retrofit(raw: DataFrame) -> DataFrame:
    """Stored answers with the age bounds rule applied after the fact: (paper_id, batch_idx, raw, n_written).

    raw is the answer's JSON with the bounds of its fields and samples in
    place; every other key stays, known to the result format or not.  A study's
    bound is set only where the answer has such a field, which is then
    `derived` and says so in its notes.  An answer that is not a JSON object
    comes back as it was, with null n_written.
    """
    top = F.from_json(recovered_json(F.col("raw")), "map<string,variant>")
    read = raw.withColumn("top", top)
    fields = F.try_variant_get(F.try_element_at("top", F.lit("fields")), "$", "map<string,map<string,variant>>")
    samples = F.try_variant_get(F.try_element_at("top", F.lit("samples")), "$", "array<map<string,variant>>")
    read = read.withColumns({"fields": fields, "samples": samples})
    read = read.withColumn("new", _bounds(F.transform_values("fields", lambda k, f: f["value"])))

    def of_study(k: Column, f: Column) -> Column:
        value = F.when(k == "age_min", F.col("new.age_min")).when(k == "age_max", F.col("new.age_max"))
        notes = typed.string(f["notes"])
        said = F.when(notes != "", F.concat(notes, F.lit(f" {AGE_NOTE}"))).otherwise(AGE_NOTE).cast("variant")
        changed = _with(_with(_with(f, "value", value), "extraction_type", F.lit("derived").cast("variant")), "notes", said)
        return F.when(value.isNull(), f).otherwise(changed)

    def of_sample(s: Column) -> Column:
        new = _bounds(s)
        return F.struct(_with(_with(s, "age_min", new["age_min"]), "age_max", new["age_max"]).alias("s"), new["n_written"].alias("n"))

    read = read.withColumns({"fields": F.transform_values("fields", of_study), "samples": F.transform("samples", of_sample)})
    there = F.size(F.filter(F.map_keys("fields"), lambda k: ((k == "age_min") & F.col("new.age_min").isNotNull()) | ((k == "age_max") & F.col("new.age_max").isNotNull())))
    n = F.greatest(F.coalesce(there, F.lit(0)), F.lit(0)) + F.aggregate(F.coalesce(F.transform("samples", lambda x: x["n"]), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = {"fields": F.to_variant_object("fields"), "samples": F.to_variant_object(F.transform("samples", lambda x: x["s"]))}
    whole = F.col("top")
    for key, value in parts.items():
        whole = F.when(F.col(key).isNull(), whole).otherwise(F.map_zip_with(whole, F.create_map(F.lit(key), value), lambda k, old, new: F.coalesce(new, old)))
    done = read.withColumn("whole", whole)
    return done.select("paper_id", "batch_idx", F.coalesce(F.to_json("whole"), "raw").alias("raw"), F.when(F.col("top").isNotNull(), n).alias("n_written"))
