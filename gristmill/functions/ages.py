"""Age bounds of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import no_age, strip
from .values import let, to_number, whole_number_text

#: Bounds in years of the age groups that have any.
GROUP_BOUNDS = {"Infant": (0, 2), "Child": (2, 11), "Adolescent": (11, 18), "Adult": (18, 65), "Elderly": (65, 130)}


def age_number(c: Column) -> Column:
    return F.when(~no_age(c), to_number(c))


def age_bounds(age: Column, age_years: Column, group: Column, low: Column, high: Column) -> Column:
    """Struct (age_min, age_max, n_written).

    An age of the record fills what bounds are missing.  Otherwise a numeric
    bound keeps both as they are.  Otherwise the group's bounds are written.
    """
    given = {"low": low, "high": high, "known": F.coalesce(age_number(age), age_number(age_years)), "no_low": age_number(low).isNull(), "no_high": age_number(high).isNull(), "group": strip(group)}
    return let(F.struct(*[c.alias(n) for n, c in given.items()]), _ruled)


def _ruled(given: Column) -> Column:
    known, group, none = given["known"], given["group"], given["no_low"] & given["no_high"]
    outs, writes = [], []
    for place, (bound, gone) in enumerate(((given["low"], given["no_low"]), (given["high"], given["no_high"]))):
        table = F.create_map(*[F.lit(x) for k, v in GROUP_BOUNDS.items() for x in (k, str(v[place]))])
        of_group = F.try_element_at(table, group)
        by_age = known.isNotNull() & gone
        by_group = known.isNull() & none & of_group.isNotNull() & (F.coalesce(strip(bound), F.lit("")) != of_group)
        outs.append(F.when(by_age, whole_number_text(known)).when(by_group, of_group).otherwise(bound))
        writes.append((by_age | by_group).cast("int"))
    total = F.coalesce(writes[0], F.lit(0)) + F.coalesce(writes[1], F.lit(0))
    return F.struct(outs[0].alias("age_min"), outs[1].alias("age_max"), total.cast("bigint").alias("n_written"))
