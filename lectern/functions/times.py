"""Seconds as text."""

from pyspark.sql import Column, functions as F


def hms(seconds: Column) -> Column:
    """HH:MM:SS; negative and null seconds count as 0, hours are not bounded."""
    s = F.greatest(F.lit(0), F.coalesce(F.floor(seconds), F.lit(0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def mmss(seconds: Column) -> Column:
    """H:MM:SS from one hour on, else MM:SS; fractions are cut off."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def exif_date(raw: Column) -> Column:
    """`YYYY:MM:DD hh:mm:ss` with dashes in the date; other forms unchanged."""
    return F.regexp_replace(raw, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees with fractions; south and west are negative."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def log_name(when: Column) -> Column:
    """Name of the log of a run that began then."""
    return F.concat(F.date_format(when, "yyyy-MM-dd_HHmmss"), F.lit(".log"))


def between_anchors(value: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """The straight line through two points (value, result), cut off beyond them, as a whole number; the lower result for null."""
    (a, x), (b, y) = low, high
    line = F.lit(x) + (value - F.lit(a)) * F.lit((y - x) / (b - a))
    return F.least(F.greatest(F.coalesce(line, F.lit(x)), F.lit(x)), F.lit(y)).cast("int")
