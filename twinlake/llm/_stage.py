"""Staging of phases, as everywhere in the library, and what the corpus operators share besides: whole rows as structs, task counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.sources.staging import discard, release, shared_dir, shuffle_partitions, stage

__all__ = ["discard", "fields", "release", "renamed", "shared_dir", "shuffle_partitions", "stage", "tasks_for", "whole_row"]
#: Bytes of input files whose records one task of a shuffle may be given.
TASK_BYTES = 64 << 20


def renamed(columns: list[str], own: set[str]) -> dict[str, str]:
    """What an operator's result calls the input's columns: one with the name of a column of its own gets ``_input`` after it."""
    out: dict[str, str] = {}
    for c in columns:
        name = c
        while name.lower() in own | {x.lower() for x in out.values()}:
            name += "_input"
        out[c] = name
    return out


def whole_row(columns: list[str]) -> Column:
    """A row's columns, whatever their names, as one struct."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])


def fields(row: str, names: dict[str, str] | list[str]) -> list[Column]:
    """The columns of such a struct again."""
    names = names if isinstance(names, dict) else {c: c for c in names}
    return [F.col(row).getField(c).alias(name) for c, name in names.items()]


def tasks_for(df: DataFrame) -> int:
    """How many tasks should share what ``df`` reads: the session's shuffle partitions, or more where the input is large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # relations without files have no size
    return max(shuffle_partitions(df.sparkSession), -(-known // TASK_BYTES))
