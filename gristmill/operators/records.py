"""Records made of batches, and values handed down from study to sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.ages import age_bounds
from ..functions.missing import no_sample, not_fanned
from ..functions.strings import subgroup_key

#: The fields of the age bounds rule.
AGE_FIELDS = ("age", "age_years", "age_group", "age_min", "age_max")
#: Fixed value: what a changed field's notes say.
AGE_NOTE = "[age_min/age_max set from schema age-bound rule]"


def sample_ids(samples: DataFrame, order: str = "row_idx") -> DataFrame:
    """Distinct discovered sample ids with the place of the first."""
    found = F.try_element_at("values", F.lit("sample_id"))
    if typed.holds_variants(samples, "values"):
        found = F.when(~typed.is_null(found), typed.text(found))
    ids = samples.withColumn("sample_id", found).where(~no_sample(F.col("sample_id")))
    return ids.groupBy("sample_id").agg(F.min(order).alias(order))


def merge_batches(values: DataFrame, ids: DataFrame) -> DataFrame:
    """(sample_id, field, value): of each field the value of the earliest batch; ids without any value stay with null.

    values: sample_id, batch, field, value.  Samples that are not in ids go.
    """
    first = values.groupBy("sample_id", "field").agg(F.min_by("value", "batch").alias("value"), F.countDistinct("value").alias("n_values"))
    return ids.select("sample_id").distinct().join(first, "sample_id", "left")


def same_subgroups(batches: DataFrame, study: str = "study", subgroups: str = "subgroups") -> DataFrame:
    """(study, n_batches, same): whether all batches of a study name the same set of subgroups."""
    sets = batches.withColumn("__set", F.array_sort(F.array_distinct(F.coalesce(F.col(subgroups), F.array().cast("array<string>")))))
    return sets.groupBy(study).agg(F.count("*").alias("n_batches"), (F.min("__set") == F.max("__set")).alias("same"))


def merge_warnings(values: DataFrame, ids: DataFrame) -> DataFrame:
    """(batch, kind, n): rows of a batch without an id, with an unknown id, or that differ from an earlier batch."""
    known = ids.select("sample_id").distinct().withColumn("known", F.lit(True))
    first = values.groupBy("sample_id", "field").agg(F.min_by("value", "batch").alias("first"), F.min("batch").alias("at"))
    joined = values.join(known, "sample_id", "left").join(first, ["sample_id", "field"], "left")
    kind = (
        F.when(F.coalesce(F.col("sample_id") == "", F.lit(True)), "no sample_id")
        .when(F.col("known").isNull(), "unknown sample_id")
        .when((F.col("batch") > F.col("at")) & ~F.col("value").eqNullSafe(F.col("first")), "kept earlier value")
    )
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("batch", "kind").agg(F.count("*").alias("n"))


def subgroup_of(values: Column, subgroups: Column) -> Column:
    """The subgroup that the first fitting text of a record names, case and plural aside."""
    keys = F.transform(subgroups, subgroup_key)
    named = F.filter(F.transform(values, lambda v: F.get(subgroups, F.array_position(keys, subgroup_key(v)).cast("int") - 1)), lambda x: x.isNotNull())
    return F.get(named, F.lit(0))


def fan_out(samples: DataFrame, study_fields: DataFrame, subgroups: DataFrame | None = None) -> DataFrame:
    """samples (study, row_idx, values) with what they lack filled from study_fields (study, field, value, by_subgroup map).

    A subgroup's value comes before the study's; a sample's own always stays.
    Fields travel as one map a study, so a study's samples are not multiplied.
    Values may be text or variants; where either side has variants the result
    has, and a list is handed down as its items joined by `; `.
    """
    variants = typed.holds_variants(samples, "values") or typed.holds_variants(study_fields, "value")
    if variants and not typed.holds_variants(samples, "values"):
        samples = samples.withColumn("values", typed.of_map(F.col("values")))
    if variants and not typed.holds_variants(study_fields, "value"):
        study_fields = study_fields.withColumns({"value": F.col("value").cast("variant"), "by_subgroup": typed.of_map(F.col("by_subgroup"))})
    gone = typed.not_fanned if variants else not_fanned
    texts = F.transform(F.map_values("values"), typed.string) if variants else F.map_values("values")
    packed = study_fields.groupBy("study").agg(F.collect_list(F.struct("field", "value", "by_subgroup")).alias("fields"))
    joined = samples.join(packed, "study", "left")
    if subgroups is not None:
        joined = joined.join(subgroups.select("study", "subgroups"), "study", "left")
        joined = joined.withColumn("subgroup", subgroup_of(texts, F.coalesce("subgroups", F.array().cast("array<string>"))))
    else:
        joined = joined.withColumn("subgroup", F.lit(None).cast("string"))

    def filled(f: Column) -> Column:
        own = F.try_element_at("values", f["field"])
        of_group = F.when(F.col("subgroup").isNotNull(), F.try_element_at(f["by_subgroup"], F.col("subgroup")))
        value = F.when(~gone(of_group), of_group).when(~gone(f["value"]), f["value"])
        if variants:
            value = typed.let(value, lambda v: F.when(v.isNotNull(), typed.handed_down(v)).cast("variant"))
        return F.struct(f["field"].alias("key"), F.when(gone(own), value).alias("value"))

    given = F.filter(F.transform(F.coalesce("fields", F.array().cast(joined.schema["fields"].dataType)), filled), lambda x: x["value"].isNotNull())
    given_map = joined.withColumn("given", F.map_from_entries(given))
    merged = F.map_zip_with("values", "given", lambda k, x, y: F.coalesce(y, x))
    return given_map.select("study", "row_idx", merged.alias("values"), F.size("given").cast("bigint").alias("n_written"))


def age_texts(values: dict[str, Column]) -> dict[str, Column]:
    """Variants of the age fields as the bounds rule reads them: a group only if it is text, the rest as text."""
    return {n: typed.string(v) if n == "age_group" else F.when(~typed.is_null(v), typed.scalar(v)) for n, v in values.items()}


def _with_bounds(df: DataFrame, texts: dict[str, Column], as_variant: bool) -> DataFrame:
    """df with __age_min and __age_max, the bounds that the rule changes (else null), and n_written."""
    plain = df.withColumn("__old", F.struct(*[texts[n].alias(n) for n in AGE_FIELDS]))
    ruled = plain.withColumn("__new", age_bounds(*[F.col(f"__old.{n}") for n in AGE_FIELDS]))
    changed = {n: F.when(~F.col(f"__new.{n}").eqNullSafe(F.col(f"__old.{n}")), F.col(f"__new.{n}")) for n in ("age_min", "age_max")}
    out = ruled.withColumns({f"__{n}": c.cast("variant") if as_variant else c for n, c in changed.items()})
    return out.withColumn("n_written", F.col("__new.n_written")).drop("__old", "__new")


def bounded_study_ages(fields: DataFrame) -> DataFrame:
    """Study fields (study, field, value variant, extraction_type, notes, ...) with the bounds rule applied to each study.

    Only bounds that a study has a row for are set; they become `derived`.
    """
    picked = {n: F.first(F.when(F.col("field") == n, F.col("value")), ignorenulls=True).alias(n) for n in AGE_FIELDS}
    ages = fields.where(F.col("field").isin(*AGE_FIELDS)).groupBy("study").agg(*picked.values())
    ruled = _with_bounds(ages, age_texts({n: F.col(n) for n in AGE_FIELDS}), False).select("study", F.col("__age_min").alias("__low"), F.col("__age_max").alias("__high"))
    new = F.when(F.col("field") == "age_min", F.col("__low")).when(F.col("field") == "age_max", F.col("__high"))
    joined = fields.join(ruled, "study", "left").withColumn("__set", new)
    there = F.col("__set").isNotNull()
    note = F.when(F.col("notes") != "", F.concat("notes", F.lit(f" {AGE_NOTE}"))).otherwise(AGE_NOTE)
    given = {"value": F.col("__set").cast("variant"), "extraction_type": F.lit("derived"), "notes": note}
    return joined.select(*[F.when(there, given[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in fields.columns])


def bounded_ages(records: DataFrame) -> DataFrame:
    """records (with a values map of text or variants) whose age_min and age_max follow the bounds rule, and n_written.

    Bounds that stay keep their type; those written are text.
    """
    at = {n: F.try_element_at("values", F.lit(n)) for n in AGE_FIELDS}
    variants = typed.holds_variants(records, "values")
    out = _with_bounds(records, age_texts(at) if variants else at, variants)
    new = F.map_filter(F.create_map(F.lit("age_min"), F.col("__age_min"), F.lit("age_max"), F.col("__age_max")), lambda k, v: v.isNotNull())
    return out.withColumn("values", F.map_zip_with("values", new, lambda k, x, y: F.coalesce(y, x))).drop("__age_min", "__age_max")
