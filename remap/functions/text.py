"""Text rules of the old database, spelled out as Spark expressions.

The old database stores the empty string as NULL, and its ``||`` reads NULL as
empty.  Spark does neither, so every text expression goes through the helpers
here instead of calling ``concat`` or comparing with ``''`` directly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Vietnamese letters and the plain letters they fold to.
_ACCENTED = (
    "àáảãạ" "ăằắẳẵặ" "âầấẩẫậ" "đ" "èéẻẽẹ" "êềếểễệ" "ìíỉĩị"
    "òóỏõọ" "ôồốổỗộ" "ơờớởỡợ" "ùúủũụ" "ưừứửữự" "ỳýỷỹỵ"
)
_PLAIN = (
    "aaaaa" "aaaaaa" "aaaaaa" "d" "eeeee" "eeeeee" "iiiii"
    "ooooo" "oooooo" "oooooo" "uuuuu" "uuuuuu" "yyyyy"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: Column | str) -> Column:
    """``''`` becomes NULL; other text, blanks included, is kept."""
    return F.nullif(_col(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, NULL where nothing is left."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def oconcat(*parts: Column | str) -> Column:
    """Concatenate reading NULL as empty; an empty result is NULL."""
    pieces = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    return F.nullif(F.concat(*pieces), F.lit(""))


def first_filled(*parts: Column | str) -> Column:
    """First argument that is not NULL and not the empty string."""
    return F.coalesce(*[empty_to_null(p) for p in parts])


def code_text(c: Column) -> Column:
    """A code as text.  Numbers have no zeros after their last decimal digit, and whole
    ones no decimal point, so 5, 5.0 and 5.00 are the code ``5``."""
    text = c.cast("string")
    # The exponent form of large and small doubles is spelled out first.
    plain = F.when(text.contains("E"), F.coalesce(text.try_cast("decimal(38,12)").cast("string"), text)).otherwise(text)
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.typeof(c).rlike("^(decimal|double|float)"), trimmed).otherwise(text)


def key_text(c: Column | str) -> Column:
    """Join key in one shape: text, trimmed, blank as NULL."""
    return blank_to_null(_col(c).cast("string"))


def clip(c: Column | str, width: int) -> Column:
    """Cut text to the width of the target column, in characters."""
    return empty_to_null(F.substring(_col(c), 1, width))


def has_letter(c: Column | str) -> Column:
    """True where the text holds at least one letter of any script."""
    return _col(c).rlike(r"\p{L}")


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """Case-insensitive "contains one of" test."""
    upper = F.upper(_col(c))
    tests = [upper.contains(n.upper()) for n in needles]
    return reduce(lambda a, b: a | b, tests)


def before_delimiter(c: Column | str, delimiter: str) -> Column:
    """Trimmed text before the first delimiter; NULL where there is none."""
    text = _col(c)
    at = F.instr(text, delimiter)
    return F.when(at > 0, blank_to_null(F.substr(text, F.lit(1), at - 1)))


def after_delimiter(c: Column | str, delimiter: str) -> Column:
    """Trimmed text after the first delimiter; NULL where there is none."""
    text = _col(c)
    at = F.instr(text, delimiter)
    return F.when(at > 0, blank_to_null(F.substr(text, at + len(delimiter))))


def strip_prefix(c: Column | str, prefixes: list[str]) -> Column:
    """Drop one leading word of ``prefixes`` in any letter case.

    ``(?iu)`` is needed: plain ``(?i)`` folds ASCII letters only.
    """
    pattern = r"(?iu)^(" + "|".join(rf"\Q{p}\E" for p in prefixes) + r")\s+"
    return empty_to_null(F.regexp_replace(F.trim(_col(c)), pattern, ""))


def fold_accents(c: Column | str) -> Column:
    """Lower-case, trimmed, accents removed (combining marks included)."""
    plain = F.translate(F.lower(F.trim(_col(c))), _ACCENTED, _PLAIN)
    return empty_to_null(F.regexp_replace(plain, r"\p{M}+", ""))
