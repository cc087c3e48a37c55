"""Dates held as text, year labels and duration titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remap.functions.text import _col, empty_to_null, oconcat

# The two date layouts and the duration unit words in the old data.
_SLASH_DATE = r"^\d{2}/\d{2}/\d{4}$"
_DASH_DATE = r"^\d{4}-\d{2}-\d{2}$"
_DURATION_UNITS = {"years": "năm", "months": "tháng", "days": "ngày"}


def slash_date(c: Column | str) -> Column:
    """``dd/MM/yyyy`` text as a timestamp; anything else is NULL.

    An impossible day such as 31 February gives NULL too, so one bad row cannot
    stop a load.
    """
    text = _col(c)
    parsed = F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("timestamp_ntz")
    return F.when(text.rlike(_SLASH_DATE), parsed)


def iso_date_text(c: Column | str) -> Column:
    """Both known layouts as ``yyyy-MM-dd`` text; anything else is NULL.

    Text that already has the target layout is passed through unchecked.
    """
    text = _col(c)
    return F.when(
        text.rlike(_SLASH_DATE), F.date_format(slash_date(text), "yyyy-MM-dd")
    ).when(text.rlike(_DASH_DATE), text)


def year_label(c: Column | str, prefix: str = "") -> Column:
    """Four-digit year as text, with an optional prefix."""
    return oconcat(F.lit(prefix), F.date_format(_col(c), "yyyy"))


def duration_parts(c: Column | str) -> Column:
    """Duration title as ``struct(years, months, days)``.

    A part that is not named counts 0; a missing title gives NULL parts.
    """
    title = empty_to_null(c)

    def part(word: str) -> Column:
        digits = F.regexp_extract(title, r"(?iu)(\d+)\s*" + word, 1)
        number = F.nullif(digits, F.lit("")).try_cast("bigint")
        return F.when(title.isNotNull(), F.coalesce(number, F.lit(0)))

    return F.struct(*[part(w).alias(n) for n, w in _DURATION_UNITS.items()])


def age_cutoff_parse(c: Column | str) -> Column:
    """Log time as a timestamp, NULL where the text is not a log time."""
    parsed = F.try_to_timestamp(F.trim(_col(c)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return parsed.cast("timestamp_ntz")
