"""Times: parsing, zones, time buckets on integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cyclelake.functions.text import strip

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR

# --- fixed values: accepted day/month/year forms, in order ------------------------------
SOURCE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd.MM.yy HH:mm:ss",
    "dd.MM.yy HH:mm",
]
# --------------------------------------------------------------------------------------
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
ZONED_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"
EPOCH_PATTERN = r"^\d{10}(\.\d+)?$"


def micros(time: Column) -> Column:
    return F.unix_micros(time)


def time_bucket(microseconds: Column, width: int) -> Column:
    """Number of the fixed-width bucket holding an instant (exact, also before 1970)."""
    step = F.lit(width)
    return ((microseconds - F.pmod(microseconds, step)) / step).cast("long")


def parse_source_time(text: Column, zone: Column | str = "UTC") -> Column:
    """Instant (UTC) of a source text: epoch seconds, ISO, or one of the day/month forms.

    Texts that carry a zone or are epoch seconds ignore `zone`; naive ones are read in it.
    """
    value = strip(text)
    epoch = F.timestamp_micros((value.try_cast("double") * F.lit(SECOND)).cast("long"))
    iso = F.replace(value, F.lit(","), F.lit(".")).try_cast("timestamp")
    zoned = value.rlike(ZONED_PATTERN) & value.rlike(r"[T ]\d{2}:")
    # Two-digit years must not be read by the four-digit patterns and the other way round.
    short_year = value.rlike(r"^\d{2}\.\d{2}\.\d{2} ")
    forms = [
        F.when(short_year if " yy HH" in f.replace(".", " ") else ~short_year, F.try_to_timestamp(value, F.lit(f)))
        for f in SOURCE_FORMATS
    ]
    naive = F.to_utc_timestamp(
        F.coalesce(F.when(value.rlike(ISO_PATTERN), iso), *forms),
        F.lit(zone) if isinstance(zone, str) else zone,
    )
    return (
        F.when(value.rlike(EPOCH_PATTERN), epoch)
        .when(value.rlike(ISO_PATTERN) & zoned, iso)
        .otherwise(naive)
    )


def local_to_utc(time: Column, zone: Column | str) -> Column:
    """Naive site time read in the site's declared zone."""
    return F.to_utc_timestamp(time, F.lit(zone) if isinstance(zone, str) else zone)


def day_fraction_time(day: Column, fraction: Column) -> Column:
    """Instant of a day fraction such as 0,488518519 (seconds truncated)."""
    number = F.replace(strip(fraction), F.lit(","), F.lit(".")).try_cast("double")
    return F.timestamp_micros(
        F.unix_micros(day.cast("timestamp")) + F.floor(number * F.lit(86400)) * F.lit(SECOND)
    )
