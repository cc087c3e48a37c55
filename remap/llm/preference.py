"""Preference formatting: one prompt and two masked completions per pair.

The prompt of a pair is the longest run of first turns on which the chosen and the
rejected conversation agree (role and text).  It is rendered once; what follows in each
conversation is its completion, with the character ranges that bear loss: the words of
the assistant and the mark that ends them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remap.llm.texts import ended_buckets


@dataclass(frozen=True)
class Template:
    """A turn is ``open role close text end``."""

    open: str = "<|"
    close: str = "|>\n"
    end: str = "<|end|>"
    after: str = "\n"
    trained_role: str = "assistant"

    def render(self, turn: Column) -> Column:
        return F.concat(F.lit(self.open), turn["role"], F.lit(self.close), turn["text"], F.lit(self.end + self.after))

    def text(self, turns: Column) -> Column:
        return F.array_join(F.transform(turns, self.render), "")

    def loss_ranges(self, turns: Column) -> Column:
        """Start and end (exclusive) of what bears loss, as characters of the rendered turns."""
        spans = "array<struct<start:int,end:int>>"

        def step(state: Column, turn: Column) -> Column:
            start = state["at"] + len(self.open + self.close) + F.length(turn["role"])
            stop = start + F.length(turn["text"]) + len(self.end)
            span = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("end")))
            return F.struct(
                (stop + len(self.after)).cast("int").alias("at"),
                F.when(turn["role"] == self.trained_role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))
        return F.aggregate(turns, start, step, lambda s: s["spans"])


def _conversations(turns: DataFrame, name: str) -> DataFrame:
    """Turn lists per pair; null roles and texts are empty, equal turn numbers go by role and text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("pair_id IS NOT NULL")
    return rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(name))


def preference_examples(chosen: DataFrame, rejected: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per pair: pair_id, prompt, chosen, rejected, prompt_turns, chosen_loss, rejected_loss, differs.

    Both tables have pair_id, turn, role, text; other columns are ignored.  A row holds
    one pair, as a training example must.  Rows without a pair_id belong to no pair and
    are left out.  Null turns come first.  A side that is missing has no turns, so the
    prompt is empty; equal sides leave both completions empty (``differs`` is false).
    A repeated turn row is a repeated turn.
    """
    template = template or Template()
    both = _conversations(chosen, "c").join(_conversations(rejected, "r"), "pair_id", "full_outer")
    none = F.array().cast(both.schema["c"].dataType)
    both = both.select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    # The first turn on which they differ; without one, all turns agree.
    differ = F.array_position(same, False)
    both = both.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int"))
    rest = {side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))) for side in "cr"}
    return both.select(
        "pair_id",
        template.text(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        template.text(rest["c"]).alias("chosen"),
        template.text(rest["r"]).alias("rejected"),
        F.col("n").alias("prompt_turns"),
        template.loss_ranges(rest["c"]).alias("chosen_loss"),
        template.loss_ranges(rest["r"]).alias("rejected_loss"),
        (differ > 0).alias("differs"),
    )


def swapped_replies(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Rejected conversations: the last reply replaced by that of the next conversation.

    ``turns`` has pair_id, turn, role, text.  The next conversation is that of the next
    greater pair_id with a reply; the last is followed by the first.  A conversation
    without a reply stays as it is.
    """
    spark = turns.sparkSession
    replies = turns.where((F.col("role") == role) & F.col("pair_id").isNotNull()).groupBy("pair_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")
    )
    bucketed, _ = ended_buckets(replies, "pair_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    following = F.lead("last.text").over(Window.partitionBy("bucket").orderBy("ahead", "pair_id"))
    swap = bucketed.select("pair_id", "ahead", "last", following.alias("reply")).where("ahead = 0")
    swap = swap.select("pair_id", F.col("last.turn").alias("at"), F.col("last.text").alias("own"), "reply")
    hit = F.col("turn").eqNullSafe(F.col("at")) & (F.col("role") == role) & (F.coalesce("text", F.lit("")) == F.col("own"))
    return turns.join(swap, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(hit, F.col("reply")).otherwise(F.col("text")).alias("text")
    )
