"""Arithmetic with the old NULL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from remap.functions.text import _col


def try_number(c: Column | str, to: str = "bigint") -> Column:
    """Number from text, NULL where the text is not a number."""
    return F.trim(_col(c)).try_cast(to)


def null_safe_sum(*parts: Column | str) -> Column:
    """Sum of columns reading NULL as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(p), F.lit(0)) for p in parts])


def balance(due: Column | str, paid: Column | str) -> Column:
    """``due - paid``; a missing payment is 0, a missing amount stays NULL."""
    return _col(due) - F.coalesce(_col(paid), F.lit(0))
