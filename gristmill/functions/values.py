"""Numbers, units, and the comparison of an extracted value with a gold value."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import not_scored, strip

TOLERANCE = 0.05
#: Units of time and how many of them make a year.
UNITS_A_YEAR: Mapping[str, float] = {"month": 12.0, "months": 12.0, "day": 365.25, "days": 365.25, "week": 52.0, "weeks": 52.0}

_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_SPECIAL = r"^[+-]?(?:nan|inf|infinity)$"


def let(v: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(v) with v bound once, as the only item of an array: rules name it often, and it may be long."""
    return F.get(F.transform(F.array(v), rule), F.lit(0))


def to_number(c: Column) -> Column:
    """The text as a double, null if it is none.

    Guarded by a pattern, as a bare cast would also take `1d` or `0x1p3`;
    digits may be grouped by underscores, `nan` and `inf` are numbers.
    """
    s = F.lower(strip(c))
    plain = F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(s.contains("nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(s.rlike(_SPECIAL), special).otherwise(plain)


def is_number(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False)) & to_number(c).isNotNull()


def to_years(value: Column, unit: Column | None, units: Mapping[str, float] = UNITS_A_YEAR) -> Column:
    """value / units a year; an unknown or missing unit leaves it."""
    if unit is None:
        return value
    table = F.create_map(*[F.lit(x) for item in units.items() for x in item])
    return F.coalesce(value / F.try_element_at(table, F.lower(strip(unit))), value)


def plain_text(c: Column) -> Column:
    """Lower-cased and stripped; null reads as `none`."""
    return F.coalesce(F.lower(strip(c)), F.lit("none"))


def values_match(
    extracted: Column,
    gold: Column,
    tolerance: float = TOLERANCE,
    extracted_unit: Column | None = None,
    gold_unit: Column | None = None,
    units: Mapping[str, float] = UNITS_A_YEAR,
    typed: bool = False,
) -> Column:
    """Two numbers agree within the tolerance of the gold one (in years); all else must be equal as text.

    Both are text, or with `typed` both variants: lists then agree if their
    sorted items do, in any order and case.
    """
    from . import typed as variants

    e, g = (variants.number(x) if typed else to_number(x) for x in (extracted, gold))
    both = e.isNotNull() & g.isNotNull()
    e, g = to_years(e, extracted_unit, units), to_years(g, gold_unit, units)
    close = F.when(g == 0, F.abs(e) < 1e-9).otherwise(~F.isnan(e) & ~F.isnan(g) & (F.abs(e - g) / F.greatest(F.abs(g), F.lit(1e-9)) <= tolerance))
    spelled = variants.compared if typed else plain_text
    return F.when(both, close).otherwise(spelled(extracted) == spelled(gold))


def decision(extracted: Column, gold: Column, typed: bool = False, **options) -> Column:
    """TN, FN, FP, TP_correct or TP_wrong; both are text, or with `typed` variants."""
    from . import typed as variants

    e, g = (variants.not_scored(x) if typed else not_scored(x) for x in (extracted, gold))
    return (
        F.when(e & g, "TN")
        .when(e, "FN")
        .when(g, "FP")
        .when(values_match(extracted, gold, typed=typed, **options), "TP_correct")
        .otherwise("TP_wrong")
    )


def whole_number_text(x: Column) -> Column:
    """18.0 as `18`, 18.5 as `18.5`."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def cost_usd(counts: Mapping[str, Column], prices: Mapping[str, Column]) -> Column:
    """Sum of counts times prices a million."""
    total = F.lit(0.0)
    for name, count in counts.items():
        total = total + F.coalesce(count, F.lit(0)) * F.coalesce(prices[name], F.lit(0.0)) / 1_000_000
    return total
