"""A training corpus from raw documents, in five stages.

Each stage takes the documents its predecessor kept, applies one operator of
``remap.llm`` to all of them and returns what stays, with the columns of documents; the
last returns packed pieces.  Every stage's result is written to the shared folder and
read again by the next, so a lost executor never repeats an earlier stage.

Columns beyond those of documents are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remap.llm import language
from remap.llm.decontamination import find_overlaps
from remap.llm.jaccard_join import join_near
from remap.llm.line_dedup import dedup_lines, without_repeats
from remap.llm.texts import table
from remap.llm.tokens import tokenizer_spec
from remap.llm.vector_packing import pack_documents
from remap.session import new_path, prepare, recording, release
from remap.sinks.files import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
CACHE = 150_000  # workers still hold what the stages before left in them

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []  # work tables of the stage before, whose result is written by now


def stage(fn: Stage) -> Stage:
    """Start a stage by deleting the work tables of the one before."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        with recording() as new:
            out = fn(spark, docs, sf_dir)
        _left[:] = new
        return out

    return run_stage



@stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in no language the model is at least even on, go."""
    docs = docs.select(COLUMNS)
    model = language.train(docs)
    judged = language.identify(docs, model, "text", COLUMNS)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of equal and nearly equal lines the first stays; a document of repeats only goes."""
    docs = docs.select(COLUMNS)
    kept = without_repeats(docs, dedup_lines(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of copies and near copies the least id stays."""
    docs = docs.select(COLUMNS)
    gone = join_near(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of a benchmark item go."""
    judged = find_overlaps(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), COLUMNS)
    return judged.where("NOT contaminated").select(COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every id of every document in sequences of at most 1024 tokens."""
    tokenizer = tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(docs, tokenizer, cache=CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# SQL cannot express a trained model or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last stage's table stays."""
    prepare(spark)
    docs, path = table(spark, sf_dir, "documents"), None
    for name, fn in STAGES:
        done = new_path(spark, f"stage-{name}")
        fn(spark, docs, sf_dir).write.parquet(done)
        docs = spark.read.parquet(done)
        if path:
            remove(spark, path)
        path = done
    release(spark, _left)
    _left.clear()
    return docs
