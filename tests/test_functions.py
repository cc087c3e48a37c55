from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from remap.functions import (
    after_delimiter,
    age_cutoff_parse,
    balance,
    before_delimiter,
    blank_to_null,
    bracketed,
    clip,
    contains_any,
    duration_parts,
    empty_to_null,
    first_filled,
    fold_accents,
    has_letter,
    iso_date_text,
    key_text,
    null_safe_sum,
    oconcat,
    slash_date,
    split_codes,
    strip_prefix,
    try_number,
    year_label,
    zip_pairs,
)
from tests.helpers import values

BLANKS = [None, "", "  ", " a "]


def test_null_rules(spark):
    assert values(spark, BLANKS, empty_to_null("x")) == [None, None, "  ", " a "]
    assert values(spark, BLANKS, blank_to_null("x")) == [None, None, None, "a"]
    assert values(spark, BLANKS, key_text("x")) == [None, None, None, "a"]


def test_concat_reads_null_as_empty(spark):
    got = values(spark, [None, "", "a"], oconcat("x", F.lit(None).cast("string"), F.lit(None)))
    assert got == [None, None, "a"]
    assert values(spark, [None, "a"], oconcat("x", F.lit(", "), F.lit("b"))) == [", b", "a, b"]


def test_first_filled_keeps_blanks(spark):
    assert values(spark, [None, "", "  ", "a"], first_filled("x", F.lit("z"))) == ["z", "z", "  ", "a"]


def test_letters_of_any_script(spark):
    assert values(spark, ["123", "1a", "Đ1", "-:", None], has_letter("x")) == [
        False, True, True, False, None,
    ]


def test_delimiters(spark):
    texts = ["a, b", "a,b,c", "ab", ",b", "a,", None]
    assert values(spark, texts, before_delimiter("x", ",")) == ["a", "a", None, None, "a", None]
    assert values(spark, texts, after_delimiter("x", ",")) == ["b", "b,c", None, "b", None, None]


def test_prefix_case_and_rest(spark):
    texts = ["Xã An", "XÃ An", "phường  An", "Xãn", "An Xã", "Xã", None]
    got = values(spark, texts, strip_prefix("x", ["Xã", "Phường"]))
    assert got == ["An", "An", "An", "Xãn", "An Xã", "Xã", None]


def test_accents(spark):
    texts = [" Đà Nẵng ", "HUẾ", "Thừa Thiên", "é", "", None]
    assert values(spark, texts, fold_accents("x")) == [
        "da nang", "hue", "thua thien", "e", None, None,
    ]


def test_contains_any(spark):
    assert values(spark, ["xABx", "xcd", "e", None], contains_any("x", ["ab", "CD"])) == [
        True, True, False, None,
    ]


def test_clip_counts_characters(spark):
    assert values(spark, ["Đđabc", "a", "", None], clip("x", 2)) == ["Đđ", "a", None, None]


def test_dates(spark):
    texts = ["05/03/1998", "1998-03-05", "31/02/2020", "5/3/1998", "abc", "9999-99-99", None]
    assert values(spark, texts, iso_date_text("x")) == [
        "1998-03-05", "1998-03-05", None, None, None, "9999-99-99", None,
    ]
    assert values(spark, texts, slash_date("x")) == [dt.datetime(1998, 3, 5)] + [None] * 6


def test_duration(spark):
    texts = ["2 năm 3 ngày", "5 THÁNG", "1năm 2 tháng 3 NGÀY", "không rõ", "", None]
    got = [tuple(r) for r in values(spark, texts, duration_parts("x"))]
    assert got == [
        (2, 0, 3), (0, 5, 0), (1, 2, 3), (0, 0, 0), (None, None, None), (None, None, None),
    ]


def test_year_label(spark):
    day = F.to_date("x")
    assert values(spark, ["2020-01-02", None], year_label(day, "Y ")) == ["Y 2020", "Y "]
    assert values(spark, [None], year_label(day)) == [None]


def test_log_time(spark):
    assert values(spark, ["2024-01-02 03:04:05", "n/a", None], age_cutoff_parse("x")) == [
        dt.datetime(2024, 1, 2, 3, 4, 5), None, None,
    ]


def test_numbers(spark):
    assert values(spark, [" 12 ", "x", "", None], try_number("x")) == [12, None, None, None]
    n = try_number("x")
    assert values(spark, ["3", None], null_safe_sum(n, F.lit(4))) == [7, 4]
    assert values(spark, ["3", None], balance(F.lit(10), n)) == [7, 10]
    assert values(spark, ["3", None], balance(n, F.lit(None).cast("int"))) == [3, None]


LISTS = [None, "", "a", "a;b", "a;;b", "b;a", "a;a", " a ; b ", "a,b", "a; ;b"]


def test_split_codes(spark):
    assert values(spark, LISTS, split_codes("x")) == [
        None, None, ["a"], ["a", "b"], ["a", "b"], ["b", "a"], ["a", "a"], ["a", "b"], ["a,b"], ["a", "b"],
    ]
    assert values(spark, LISTS[-2:], split_codes("x", ",;")) == [["a", "b"], ["a", "b"]]
    assert values(spark, LISTS[-3:], split_codes("x", blank="stop")) == [["a", "b"], ["a,b"], ["a"]]
    assert values(spark, [" ;a", "a"], split_codes("x", blank="stop")) == [[], ["a"]]
    assert values(spark, [" a ;; "], split_codes("x", trim=False, blank="keep")) == [[" a ", " "]]


def test_bracketed(spark):
    assert values(spark, ["1,2", None], bracketed("x")) == ["[1,2]", "[]"]


def test_zip_cuts_to_the_shorter(spark):
    pairs = zip_pairs(split_codes("x"), F.array(F.lit("p"), F.lit("q")))
    got = values(spark, ["a", "a;b;c"], pairs)
    assert [[tuple(p) for p in g] for g in got] == [[("a", "p")], [("a", "p"), ("b", "q")]]
