"""Chat formatting with cumulative-snapshot collapse. Built-in functions only.

A logger that writes a conversation after every turn leaves many prefixes of the longest
snapshot. Every turn gets a rolling hash of all turns up to it (the exclusive or of
position-tagged turn hashes, 128 bits, a running window aggregate). A conversation whose last
hash is the hash of an earlier turn elsewhere is a prefix of a longer one; an anti-join
leaves the maximal conversations, and only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|", "<|end|>\n"


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("|>\n"), text, F.lit(END))


def collapse_snapshots(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, text.

    Turns are ordered by turn number (null first), then role and text; null roles count as
    ``user``, null texts as empty; very long texts count whole. A conversation that equals another
    is kept once, under the smallest id (n_copies counts them); one that is a proper prefix of
    another, turn by turn, is dropped. A row without a conversation id is a conversation of one
    turn, with a null id if no other equals it. Repeated rows are turns of their own; other
    columns, whatever their names, are ignored; an empty table gives an empty table.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    lone, t = t.where("conv_id is null"), t.where("conv_id is not null")
    of_turn = lambda seed, k: F.xxhash64(F.lit(seed), k, "role", "text")
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"k": F.row_number().over(ordered), "last": F.lead("role").over(ordered).isNull()})
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = t.select("conv_id", "k", "last", *[F.bit_xor(of_turn(seed, F.col("k"))).over(running).alias(f"h{seed}") for seed in (1, 2)])
    lone = lone.select("conv_id", "role", "text", F.lit(1).alias("k"), *[of_turn(seed, F.lit(1)).alias(f"h{seed}") for seed in (1, 2)])
    at = ["h1", "h2", "k"]
    whole = hashed.where("last").select("conv_id", *at).unionByName(lone.select("conv_id", *at)).groupBy(*at).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashed.where("not last").select(*at).distinct()
    maximal = whole.join(inner, at, "left_anti")
    kept = t.join(maximal.where("conv_id is not null").select("conv_id", "n_copies"), "conv_id")
    line = render_turn(F.col("role"), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))
    out = kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"), lines.alias("lines"))
    out = out.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
    turn = lone.groupBy(*at).agg(F.first(line).alias("text"))
    alone = maximal.where("conv_id is null").join(turn, at).select("conv_id", F.lit(1).cast("long").alias("n_turns"), "n_copies", "text")
    return out.unionByName(alone)


ORACLE = """
WITH c AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
), t AS (
  SELECT conv_id, lone, turn, '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
         row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k,
         count(*) OVER (PARTITION BY conv_id, lone) AS n
  FROM c
), p AS (
  SELECT conv_id, k, n, string_agg(line, '') OVER (PARTITION BY conv_id, lone ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM t
), w AS (
  SELECT s, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY s, n
)
SELECT conv_id, n AS n_turns, n_copies, s AS text FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.s = w.s)
"""
