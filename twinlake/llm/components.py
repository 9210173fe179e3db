"""Connected components of a link table, by alternating large-star and small-star steps
(Kiveris et al., 2014). Every step is an aggregation and a join of (a, b) rows, the smaller id
second; nothing is gathered by component. A hub's links are the rows of a join, which Spark splits
where they are too many for a task. Each round is written down, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm._stage import discard, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (id, component): the smallest id reachable. Ids without a link to another don't appear."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        # Large star: what is larger than its neighbour goes to that neighbour's least one; a root has none.
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small star: what is smaller goes to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct(), "links")
        discard(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
