"""Small tables with everything that is unusual, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, and names of their results.
CLASHES = "id string, key string, line string, h string, bucket string, score string, h1 string, text_ string, rep string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["ra", "the", "ion", "ber", "que", "ol", "es", "ment", "ü", "ça"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 60)
    long = "\n".join(prose(100 + i, 40) for i in range(60))
    other = base.replace(base.split()[30], "changed")
    return [
        (1, base, "en", "a", 1), (2, base, "en", None, None), (3, other, None, "a", 2), (4, None, None, None, None),
        (5, "", "en", "b", 0), (6, "   \n \t", "fr", "b", 6), (7, "1234 !!!", "de", "c", 8), (8, "x", "de", "c", 1),
        (9, long, "fr", "d", len(long)), (10, prose(2, 60) + "\n" + prose(3, 20), "fr", "d", 3),
        (11, prose(4, 60) + "\n" + prose(3, 20), "es", "d", 4), (None, base, "en", None, 5),
        (13, prose(5, 3), "en", "e", 6), (14, "  double  spaces \n\n and \u00a0 <|endoftext|> it's 12½ Ⅷ", "en", "e", 7),
        (15, base, "en", "e", 1), (15, base, "en", "e", 1),
    ]


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, copies, repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(rows(), SCHEMA)
    for name in CLASHES.split(", "):
        df = df.selectExpr("*", f"'clash' AS {name.split()[0]}")
    return df


def empty_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).where("false")


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
