"""Extracted records against gold records: cells, metrics, strata, faithfulness.

Records are rows (study, row_idx, values), where values maps names to text or
to variants; study fields are rows (study, field, value, extraction_type,
confidence, evidence_quote), value being text or a variant.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.missing import no_unit, not_scored, strip
from ..functions.strings import accession_key
from ..functions.values import TOLERANCE, UNITS_A_YEAR, decision

COUNTS = ("tn", "tp_correct", "tp_wrong", "fn", "fp")
_NAMES = dict(zip(COUNTS, ("TN", "TP_correct", "TP_wrong", "FN", "FP")))


def align(extracted: DataFrame, gold: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides renumbered by accession: gold in its order where an extracted record has the key; the first such record counts.

    Numbers come from the gold row_idx, so they need not be consecutive.
    """
    def key_of(side: DataFrame) -> Column:
        value = F.try_element_at("values", F.lit(key))
        return accession_key(F.when(~typed.is_null(value), typed.text(value)) if typed.holds_variants(side, "values") else value)

    keyed = extracted.withColumn("__key", key_of(extracted)).where("__key IS NOT NULL")
    first = keyed.groupBy("study", "__key").agg(F.min_by("values", "row_idx").alias("values"))
    wanted = gold.withColumn("__key", key_of(gold)).where("__key IS NOT NULL")
    both = wanted.withColumnRenamed("values", "__gold").join(first, ["study", "__key"])
    return both.select("study", "row_idx", "values"), both.select("study", "row_idx", F.col("__gold").alias("values"))


def cells(
    extracted: DataFrame,
    gold: DataFrame,
    field_map: Mapping[str, str],
    study_fields: DataFrame | None = None,
    tolerance: float = TOLERANCE,
    unit_fields: Mapping[str, str] | None = None,
    units: Mapping[str, float] = UNITS_A_YEAR,
    skip: frozenset[str] | set[str] = frozenset(),
    missing_gold_as_fn: bool = False,
) -> DataFrame:
    """One row for each cell: study, sample_idx, ids, field, extracted, gold, decision, extraction_type, confidence.

    Records pair by (study, row_idx).  A sample's own key wins over the study's
    value even if it is blank.  With missing_gold_as_fn every gold record
    counts, and one without a sample reports nothing at all.  Variants are
    compared by their types (a list by its items in any order) and given as text.
    """
    sides = [(extracted, "values"), (gold, "values"), *([(study_fields, "value")] if study_fields is not None else [])]
    variants = any(typed.holds_variants(*s) for s in sides)
    if variants:
        extracted, gold = (x if typed.holds_variants(x, "values") else x.withColumn("values", typed.of_map(F.col("values"))) for x in (extracted, gold))
        study_fields = study_fields.withColumn("value", F.col("value").cast("variant")) if study_fields is not None else None
    kind = "variant" if variants else "string"
    plain = (lambda v: typed.string(v)) if variants else (lambda v: v)
    shown = (lambda v: F.when(~typed.is_null(v), typed.text(v))) if variants else (lambda v: v)
    fields = {e: g for e, g in field_map.items() if e not in skip}
    e, g = extracted.select("study", "row_idx", F.col("values").alias("ev")), gold.select("study", "row_idx", F.col("values").alias("gv"))
    paired = g.join(e.withColumn("there", F.lit(True)), ["study", "row_idx"], "left" if missing_gold_as_fn else "inner")
    unit_fields = unit_fields or {}

    def entry(name: str, of_gold: str) -> Column:
        unit = unit_fields.get(name)
        u = plain(F.try_element_at("gv", F.lit(unit))) if unit else F.lit(None).cast("string")
        return F.struct(
            F.lit(name).alias("field"),
            F.try_element_at("ev", F.lit(name)).alias("own"),
            F.coalesce(F.map_contains_key("ev", name), F.lit(False)).alias("has"),
            F.try_element_at("gv", F.lit(of_gold)).alias("gold"),
            (plain(F.try_element_at("ev", F.lit(unit))) if unit else F.lit(None).cast("string")).alias("ext_unit"),
            F.when(~no_unit(u), u).alias("gold_unit"),
        )

    entries = F.array(*[entry(n, o) for n, o in fields.items()])
    ids = [shown(F.try_element_at(m, F.lit("sample_id"))).alias(n) for m, n in (("ev", "ext_sample_id"), ("gv", "gold_sample_id"))]
    long = paired.select("study", F.col("row_idx").alias("sample_idx"), *ids, "there", F.inline(entries))
    if study_fields is not None:
        known = study_fields.select("study", "field", F.col("value").alias("of_study"), "extraction_type", "confidence")
        long = long.join(known, ["study", "field"], "left")
    else:
        empty = F.lit(None).cast("string")
        long = long.withColumns({"of_study": F.lit(None).cast(kind), "extraction_type": empty, "confidence": empty})
    value = F.when(F.col("has"), F.col("own")).when(F.col("there"), F.col("of_study"))
    long = long.withColumn("extracted", value)
    verdict = decision(F.col("extracted"), F.col("gold"), tolerance=tolerance, extracted_unit=F.col("ext_unit"), gold_unit=F.col("gold_unit"), units=units, typed=variants)
    return long.select(
        "study", "sample_idx", "ext_sample_id", "gold_sample_id", "field", shown(F.col("extracted")).alias("extracted"), shown(F.col("gold")).alias("gold"), verdict.alias("decision"), "extraction_type", "confidence"
    )


def counted() -> list[Column]:
    """The five decision counts of a group of cells."""
    return [F.count_if(F.col("decision") == name).alias(c) for c, name in _NAMES.items()]


def ratios(df: DataFrame) -> DataFrame:
    """Adds n, tp, precision, recall, f1, value_accuracy, total_accuracy; null where the denominator is 0."""
    out = df.withColumns({"n": sum((F.col(c) for c in COUNTS), F.lit(0)).cast("bigint"), "tp": (F.col("tp_correct") + F.col("tp_wrong")).cast("bigint")})
    out = out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns(
        {
            "f1": F.try_divide(2 * p * r, p + r),
            "value_accuracy": F.try_divide("tp_correct", "tp"),
            "total_accuracy": F.try_divide(F.col("tp_correct") + F.col("tn"), "n"),
        }
    )


def strict_ratios(df: DataFrame) -> DataFrame:
    """p, r, f1, value_accuracy of counters; f1 is null also where p or r is 0 - the rule of the reports."""
    tp = F.col("tp_correct") + F.col("tp_wrong")
    out = df.withColumns({"p": F.try_divide(tp, tp + F.col("fp")), "r": F.try_divide(tp, tp + F.col("fn")), "value_accuracy": F.try_divide("tp_correct", tp)})
    some = (F.col("p") != 0) & (F.col("r") != 0)
    return out.withColumn("f1", F.when(some, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))


def metrics_by_field(cell: DataFrame, fields: list[str]) -> DataFrame:
    """Counts and ratios of each field; a field without cells has zeros."""
    listed = cell.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    found = listed.join(cell.groupBy("field").agg(*counted()), "field", "left").na.fill(0, list(COUNTS))
    return ratios(found)


def micro(cell: DataFrame) -> DataFrame:
    """Counts and ratios of all cells together."""
    return ratios(cell.agg(*counted()))


def strata(cell: DataFrame) -> DataFrame:
    """Counts and ratios by extraction type and by confidence: columns stratum, label."""
    cut = F.array(
        F.struct(F.lit("extraction_type").alias("stratum"), F.col("extraction_type").alias("label")),
        F.struct(F.lit("confidence").alias("stratum"), F.col("confidence").alias("label")),
    )
    long = cell.select("decision", F.inline(cut)).where("label <> ''")
    return ratios(long.groupBy("stratum", "label").agg(*counted()))


def _missing_in(study_fields: DataFrame):
    return typed.not_scored if typed.holds_variants(study_fields, "value") else not_scored


def faithfulness(study_fields: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: violations, checked, matched, rate.

    A reported value without a quote is a violation; a quote is checked if its
    paper (study, text) has text, and matches if the text has it, case aside.
    """
    quote, missing = strip(F.coalesce("evidence_quote", F.lit(""))), _missing_in(study_fields)
    # a study's quotes meet its text once; they are as many as it has fields
    of_study = study_fields.groupBy("study").agg(
        F.count_if(~missing(F.col("value")) & (quote == "")).alias("bare"), F.collect_list(F.when(quote != "", F.lower(quote))).alias("quotes")
    )
    joined = of_study.join(papers.select("study", F.lower("text").alias("text")), "study", "left")
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    found = F.size(F.filter("quotes", lambda q: F.contains(F.col("text"), q)))
    out = joined.agg(
        F.coalesce(F.sum("bare"), F.lit(0)).alias("violations"),
        F.coalesce(F.sum(F.when(has_text, F.size("quotes")).otherwise(0)), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(has_text, found).otherwise(0)), F.lit(0)).alias("matched"),
    )
    return out.withColumn("rate", F.try_divide("matched", "checked"))


def field_map(fields: list[str], gold_columns: list[str]) -> dict[str, str]:
    """Each field to the gold column of its name; fields that gold does not have are left out."""
    there = set(gold_columns)
    return {f: f for f in fields if f in there}


def by_study(cell: DataFrame) -> DataFrame:
    """Counts and ratios of each field of each study; all studies in one job."""
    return ratios(cell.groupBy("study", "field").agg(*counted()))


def violations(study_fields: DataFrame, papers: DataFrame, most: int | None = None) -> DataFrame:
    """(study, field, problem): values without a quote, and quotes that the paper does not have; the first `most` by study and field."""
    quotes = study_fields.select("study", "field", "value", strip(F.coalesce("evidence_quote", F.lit(""))).alias("quote"))
    joined = quotes.join(papers.select("study", "text"), "study", "left")
    lost = (F.col("quote") != "") & (F.col("text") != "") & ~F.contains(F.lower("text"), F.lower("quote"))
    problem = F.when(~_missing_in(study_fields)(F.col("value")) & (F.col("quote") == ""), "no quote").when(lost, "quote not in the text")
    out = joined.select("study", "field", problem.alias("problem")).where("problem IS NOT NULL")
    return out if most is None else out.orderBy("study", "field").limit(most)


def over_fields(metrics: DataFrame, fields: list[str]) -> DataFrame:
    """Summed counters of a set of fields."""
    return metrics.where(F.col("field").isin(*fields)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def repeats_summary(runs: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Exact median, min and max of values over repeated runs, nulls left out."""
    out = []
    for v in values:
        out += [F.median(v).alias(f"{v}_median"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return runs.groupBy(by).agg(*out)
