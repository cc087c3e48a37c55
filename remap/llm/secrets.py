"""Secret scans over an incremental blob ledger, in Spark expressions only.

Every text is content-addressed (``sha2`` of its UTF-8 bytes): a *blob*.  A ledger
folder keeps which (blob, rule version) pairs were scanned and what they found, so a
later run scans only blobs it has not seen, or rules whose version is new, and joins
the findings back to every row that holds the blob.  Copies of one text, however many,
are scanned once: the blobs are deduplicated by an aggregate that keeps one text per
blob in every map task before the shuffle, so a hot text never gathers in one task.

A rule is a Java/RE2 pattern scanned leftmost and non-overlapping (``find`` from the end
of the previous match).  A match whose ``group`` is shorter than ``least`` characters is
dropped after the scan, so it still consumes its text.  Positions are code points, end
exclusive: the pieces between matches come from ``split`` with the same pattern, and a
running sum over them (a window per blob, which already lies in one partition after the
deduplication) gives every start.  Nothing here leaves the JVM.

Defined results: a null text is the empty text (no findings); an empty table gives an
empty result; rows repeat as they came in (one output row per input row, copies
included); spans sort by start, then by the rule order of :data:`RULES`; only the id
and text columns are read, so other columns of any name do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remap.session import new_path


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class SecretRule:
    kind: str
    version: int
    pattern: str  # where the matches are taken
    group: int  # the group whose length is tested
    least: int  # characters the group needs, else the match is dropped

    @property
    def ledger_key(self) -> str:
        return f"{self.kind}:{self.version}"


# The three base rules of the contract.  The keyword letters match in
# either case.  For ``access`` and ``hex`` the pattern asks the least length itself:
# their matches are maximal runs, so dropping short runs after the scan and not
# matching them at all leave the same spans, and the split stays small.
ASSIGN = SecretRule(
    "assign", 1,
    "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token"))
    + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    2, 12)
ACCESS = SecretRule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18)
HEX = SecretRule("hex", 1, "[0-9a-f]{16,}", 0, 16)
BASE_RULES = (ASSIGN, ACCESS, HEX)

# Rules this method adds (version 1 of each): private key blocks and personal tokens.
PEM = SecretRule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0)
PERSONAL_TOKEN = SecretRule("personal_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 36)
RULES = (*BASE_RULES, PEM, PERSONAL_TOKEN)


def _matches(text: Column, rule: SecretRule, order: int) -> Column:
    """Per match: rule order, index, and the lengths of match, tested group and gap before it."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    return F.transform(
        F.arrays_zip(found.alias("m"), group.alias("g"), F.slice(gaps, 1, F.size(found)).alias("p")),
        lambda x, i: F.struct(
            F.lit(order).alias("ord"), i.alias("i"), F.length(x["m"]).alias("m_len"),
            F.length(x["g"]).alias("g_len"), F.length(x["p"]).alias("p_len")),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...], done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Scan (blob, text) rows with the rules not yet in ``done`` (blob, done array).

    Returns the scanned pairs (blob, rule) and the findings (blob, rule, kind, ord, start, end).
    """
    keys = F.array(*[F.lit(r.ledger_key) for r in rules])
    if done is not None:
        blobs = blobs.join(done, "__blob", "left")
        todo = F.filter(keys, lambda k: ~F.array_contains(F.coalesce("__done", F.array().cast("array<string>")), k))
    else:
        todo = keys
    blobs = blobs.withColumn("__todo", todo)
    parts = [
        F.when(F.array_contains("__todo", r.ledger_key), _matches(F.col("__text"), r, n))
        .otherwise(F.array())
        for n, r in enumerate(rules)
    ]
    found = blobs.select("__blob", "__todo", F.concat(*parts).alias("__m"))
    scanned = found.select("__blob", F.explode("__todo").alias("rule"))
    each = found.select("__blob", F.explode("__m").alias("m")).select("__blob", "m.*")
    running = Window.partitionBy("__blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("p_len") + F.col("m_len")).over(running))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("ord") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("ord") + 1)
    rule = F.element_at(keys, F.col("ord") + 1)
    findings = each.where(F.col("g_len") >= least).select(
        "__blob", rule.alias("rule"), kind.alias("kind"), "ord",
        (F.col("end") - F.col("m_len")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return scanned, findings


def scan_secrets(
    docs: DataFrame,
    *,
    ledger: str | None = None,
    rules: tuple[SecretRule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Findings of ``rules`` in every row of ``docs``, scanning only blobs the ledger lacks.

    ``ledger`` is a folder on shared storage (a new one in the work folder if None)
    with the tables ``scanned`` and ``findings``; this call appends what it scans.
    Returns per input row: ``id_col``, ``blob`` (sha256 hex of the text), ``spans``
    (array of kind, start, end; sorted by start, then rule order) and one count column
    ``n_<kind>`` per rule.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "secret-ledger")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__blob", F.sha2("__text", 256))
    blobs = rows.groupBy("__blob").agg(F.first("__text").alias("__text"))
    done = None
    if _exists(spark, f"{ledger}/scanned"):
        done = spark.read.parquet(f"{ledger}/scanned").groupBy(F.col("blob").alias("__blob")).agg(
            F.collect_set("rule").alias("__done"))
    scanned, findings = scan_blobs(blobs, rules, done)
    findings.withColumnRenamed("__blob", "blob").write.mode("append").parquet(f"{ledger}/findings")
    scanned.withColumnRenamed("__blob", "blob").write.mode("append").parquet(f"{ledger}/scanned")

    current = [r.ledger_key for r in rules]
    known = spark.read.parquet(f"{ledger}/findings").where(F.col("rule").isin(current)).dropDuplicates(
        ["blob", "rule", "start", "end"])
    summary = known.groupBy(F.col("blob").alias("__blob")).agg(
        F.sort_array(F.collect_list(F.struct("start", "ord", "kind", "end"))).alias("__s"),
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules],
    )
    spans = F.transform(F.coalesce("__s", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules]
    return rows.join(summary, "__blob", "left").select(
        F.col("__id").alias(id_col), F.col("__blob").alias("blob"), spans.alias("spans"), *counts)


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of ``kinds`` only, if given), comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)
