"""Delimited code lists held in one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remap.functions.text import _col, empty_to_null


def split_raw(c: Column | str, delimiters: str = ";") -> Column:
    """Array of everything between the delimiters; NULL and ``''`` give NULL.

    Several delimiters are first mapped to one, so the text is split at a
    single character instead of by a pattern.
    """
    first, rest = delimiters[0], delimiters[1:]
    text = empty_to_null(c)
    if rest:
        text = F.translate(text, rest, first * len(rest))
    return F.split(text, first if first.isalnum() or first == " " else "\\" + first)


def split_codes(
    c: Column | str, delimiters: str = ";", trim: bool = True, blank: str = "skip"
) -> Column:
    """Array of the codes in a list; NULL and ``''`` give NULL.

    Empty tokens never count.  ``blank`` says what a token of spaces does:
    ``skip`` drops it, ``stop`` ends the list there, ``keep`` leaves it in.
    ``trim=False`` hands the tokens on exactly as written.
    """
    if blank not in ("skip", "stop", "keep"):
        raise ValueError(f"unknown blank rule: {blank}")
    tokens = F.filter(split_raw(c, delimiters), lambda t: t != "")
    if blank == "skip":
        tokens = F.filter(tokens, lambda t: F.trim(t) != "")
    elif blank == "stop":
        first = F.array_position(F.transform(tokens, lambda t: F.trim(t)), "")
        tokens = F.when(first > 0, F.slice(tokens, 1, first.cast("int") - 1)).otherwise(tokens)
    return F.transform(tokens, lambda t: F.trim(t)) if trim else tokens


def bracketed(c: Column | str) -> Column:
    """``[text]``; a NULL text gives ``[]``."""
    return F.concat(F.lit("["), F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("]"))


def zip_pairs(left: Column, right: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    """Pair two arrays by position, cut to the shorter one."""
    n = F.least(F.size(left), F.size(right))
    zipped = F.arrays_zip(
        F.slice(left, F.lit(1), n).alias(names[0]), F.slice(right, F.lit(1), n).alias(names[1])
    )
    return F.transform(
        zipped,
        lambda p: F.struct(p[names[0]].alias(names[0]), p[names[1]].alias(names[1])),
    )
