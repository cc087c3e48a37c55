"""Column functions: null rules, text, dates, numbers, code lists."""

from remap.functions.dates import (
    age_cutoff_parse,
    duration_parts,
    iso_date_text,
    slash_date,
    year_label,
)
from remap.functions.lists import bracketed, split_codes, zip_pairs
from remap.functions.numbers import balance, null_safe_sum, try_number
from remap.functions.text import (
    after_delimiter,
    before_delimiter,
    blank_to_null,
    clip,
    contains_any,
    empty_to_null,
    first_filled,
    fold_accents,
    has_letter,
    key_text,
    oconcat,
    strip_prefix,
)

__all__ = [
    "after_delimiter",
    "age_cutoff_parse",
    "balance",
    "before_delimiter",
    "blank_to_null",
    "bracketed",
    "clip",
    "contains_any",
    "duration_parts",
    "empty_to_null",
    "first_filled",
    "fold_accents",
    "has_letter",
    "iso_date_text",
    "key_text",
    "null_safe_sum",
    "oconcat",
    "slash_date",
    "split_codes",
    "strip_prefix",
    "try_number",
    "year_label",
    "zip_pairs",
]
