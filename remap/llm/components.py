"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remap.session import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge, root being the least node of its component.

    Every step is a grouping with map-side minima and a join, and is written to the
    shared folder, so a lost executor repeats one step at most.  The minima are written
    too: joins against them can then split a hub's edges over many tasks.  Loops, repeated
    and empty edges are fine.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    current = materialize(pairs, "edges")
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = materialize(both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("root")), "least")
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        large = materialize(large.distinct(), "edges")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("root")), "least")
        small = large.join(least, "hi")
        small = small.select(F.when(F.col("lo") == F.col("root"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("root").alias("lo"))
        # A node keeps its own edge to the root; the other neighbours are moved to the root.
        small = small.unionByName(least.select("hi", F.col("root").alias("lo"))).where("hi > lo").distinct()
        current, before = materialize(small, "edges"), state
        state = _state(current)
        if state == before:
            break
    roots = current.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
