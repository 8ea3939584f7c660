"""Numbers, flags and row predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cyclelake.functions.text import null_if_token, strip

# --- fixed values ---------------------------------------------------------------------
TRUE_WORDS = ["true", "1", "yes", "y", "oui"]
SCRAP_WORDS = ["scrap", "reject", "non_conforme", "non-conforme"]
SCRAP_FLAG_WORDS = ["1", "true", "t", "yes", "y", "scrap", "reject"]
PLAIN_GOOD_WORDS = ["", "good", "ok", "valid"]
# Factor from a source unit to the canonical unit.
UNIT_FACTORS = [
    ("ms", "s", 0.001),
    ("min", "s", 60.0),
    ("h", "s", 3600.0),
    ("psi", "bar", 0.0689475729),
    ("pa", "bar", 0.00001),
    ("mpa", "bar", 10.0),
]
CYCLE_TIME_RANGE_S = (0.5, 3600.0)
# --------------------------------------------------------------------------------------


def finite(value: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(
        ~F.isnan(value) & (value != F.lit(float("inf"))) & (value != F.lit(float("-inf"))), value
    )


def decimal_text(text: Column) -> Column:
    """Number written with a decimal point or comma; null where it is not a number."""
    return F.replace(null_if_token(text), F.lit(","), F.lit(".")).try_cast("double")


def first_finite(*columns: Column) -> Column:
    """First of the columns holding a finite number, read from text where needed."""
    return F.coalesce(*[finite(strip(c.cast("string")).try_cast("double")) for c in columns])


def unit_factor(source: Column, target: Column) -> Column:
    """Conversion factor between two normalised units; null where there is none."""
    factor = F.when(source == target, F.lit(1.0))
    for unit, canonical, value in UNIT_FACTORS:
        factor = factor.when((source == unit) & (target == canonical), F.lit(value))
    return factor


def flag(text: Column, default: bool = False) -> Column:
    """Boolean from a text or number flag; missing or empty gives the default."""
    words = F.lower(strip(text.cast("string")))
    number = words.try_cast("double")
    return (
        F.when(text.isNull() | (text.cast("string") == ""), F.lit(default))
        .when(number.isNotNull() & ~F.isnan(number), number != 0)
        .otherwise(words.isin(TRUE_WORDS))
    )


def good_part_count(text: Column) -> Column:
    """0 or 1; a missing flag counts as a good part."""
    return flag(text, default=True).cast("int")


def part_status(scrap: Column) -> Column:
    return F.when(scrap, F.lit("scrap")).otherwise(F.lit("good"))


def part_defect(source_flag: Column) -> Column:
    """Defect named by the source's quality flag; null for the plain "good" words."""
    text = strip(F.coalesce(source_flag, F.lit("good")))
    return F.when(~F.lower(text).isin(PLAIN_GOOD_WORDS), text)


def canonical_or_raw(value: Column, raw: Column, name: str) -> Column:
    """Canonical value, else the unmapped source value kept under the same name."""
    return F.coalesce(value, F.element_at(raw, F.lit(name)))


def plausibility(cycle_time: Column) -> Column:
    low, high = CYCLE_TIME_RANGE_S
    return F.when((cycle_time < low) | (cycle_time > high), F.lit("outlier")).otherwise(F.lit("valid"))


def order_matches(order_id: Column, requested: Column) -> Column:
    """Order equals the requested one, or lies in an inclusive `A to B` range.

    No requested order accepts everything; a missing order is accepted only then.
    """
    parts = F.split(requested, " to ", 2)
    ranged = requested.contains(" to ")
    low, high = strip(parts[0]), strip(F.try_element_at(parts, F.lit(2)))
    hit = F.when(ranged, order_id.between(low, high)).otherwise(order_id == requested)
    return F.when(requested.isNull(), F.lit(True)).otherwise(F.coalesce(hit, F.lit(False)))


def order_endpoints(requested: Column) -> Column:
    """The order ids named by a request: one id, or both ends of `A to B`."""
    return F.when(
        F.coalesce(requested, F.lit("")) == "", F.array().cast("array<string>")
    ).otherwise(F.transform(F.split(requested, " to ", 2), lambda part: strip(part)))


def order_related(order_id: Column, requested: Column) -> Column:
    """Context rows: blank order is machine-level context, else the id must be named."""
    own = strip(F.coalesce(order_id, F.lit("")))
    named = order_endpoints(requested)
    return (F.size(named) == 0) | (own == "") | F.array_contains(named, own)


def is_scrap(scrap_flag: Column, status: Column) -> Column:
    """Scrap by flag or by any of the part status words (cause ranking)."""
    by_flag = F.lower(strip(F.coalesce(scrap_flag.cast("string"), F.lit("")))).isin(SCRAP_FLAG_WORDS)
    return by_flag | F.lower(F.coalesce(status, F.lit(""))).isin(SCRAP_WORDS)


def is_detector_scrap(scrap_flag: Column, status: Column) -> Column:
    """Scrap by flag or by status `scrap` only (burst detector)."""
    return F.coalesce(scrap_flag, F.lit(False)) | (F.lower(F.coalesce(status, F.lit(""))) == "scrap")


def is_valid_data(status: Column) -> Column:
    return F.coalesce(status, F.lit("valid")) == "valid"


def all_of(predicates: list[Column]) -> Column:
    """Conjunction of the given predicates; true for an empty list."""
    return reduce(lambda left, right: left & right, predicates, F.lit(True))


def impact_estimate(
    material_cost: Column, scrap_parts: Column, hourly_cost: Column, hours: Column
) -> Column:
    """Cost impact; null where an assumption is negative or not finite."""
    inputs = [material_cost, scrap_parts, hourly_cost, hours]
    usable = all_of([F.coalesce(finite(c.cast("double")) >= 0, F.lit(False)) for c in inputs])
    return F.when(usable, material_cost * scrap_parts + hourly_cost * hours)
