"""Lenient parsing, rounding and formatting of numbers, distances and dates."""
from pyspark.sql import Column, functions as F

from ringside import vocab

_NUMERIC = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def lenient_bool(value) -> Column:
    """"true", "1" and "oui" in any case are true; null stays null; all else is false."""
    return F.lower(F.trim(value.cast("string"))).isin("true", "1", "oui")


def lenient_int(value) -> Column:
    """Integer part of anything that reads as a number, else null."""
    text = value.cast("string")
    return F.when(text.rlike(_NUMERIC), text.try_cast("double").try_cast("int"))


def nonzero(value) -> Column:
    """Zero means "not filled in" for counts and years."""
    return F.when(value != 0, value)


def half_even(value, digits) -> Column:
    return F.bround(value, digits)


def half_up(value, digits=0) -> Column:
    """Rounding of positive numbers the way a browser does it."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / scale


def rounded_coordinate(value) -> Column:
    return F.bround(value, 5)


def format_distance(km) -> Column:
    """Metres below 1 km, one decimal below 10 km, whole km above."""
    return (F.when(km < 1, F.concat(half_up(km * 1000).cast("int").cast("string"), F.lit(" m")))
            .when(km < 10, F.concat(F.format_number(km, 1), F.lit(" km")))
            .otherwise(F.concat(half_up(km).cast("int").cast("string"), F.lit(" km"))))


def format_note(note, lang="fr") -> Column:
    text = F.format_number(note, 1)
    return F.replace(text, F.lit("."), F.lit(",")) if lang == "fr" else text


def format_date(iso, lang="fr") -> Column:
    """"2026-08-03" -> "3 août 2026"; anything that is not an ISO date is returned as it is."""
    part = lambda n: F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})$", n)
    month = F.try_element_at(F.array(*[F.lit(m) for m in vocab.MONTHS[lang]]),
                             part(2).try_cast("int"))
    spelled = F.concat_ws(" ", part(3).try_cast("int").cast("string"), month, part(1))
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$") & month.isNotNull(), spelled).otherwise(iso)


def format_thousands(n, lang="fr") -> Column:
    """Narrow no-break spaces in French, commas in English."""
    text = F.format_number(n, 0)
    return F.replace(text, F.lit(","), F.lit(" ")) if lang == "fr" else text
