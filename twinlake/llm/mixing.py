"""Mix sources to target weights: hash-random keys, range order within a source, prefix sums, exact cuts.

Built-in functions only. Each document gets a random key (the MD5 of a seed and its id).
Within a source, documents are ordered by key; the key's first digits cut that order into
ranges, so that a prefix sum of word counts is the sum over earlier ranges (a small table)
plus a running sum inside one range. A source with a third of all rows is spread over all
of its ranges; no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from twinlake.llm._stage import fields, renamed, stage, whole_row

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(snull, skey, source_size) -> the same with ``weight`` and ``target``.

    ``share`` of all words is dealt by weight; no source gets more than ``cap`` times its own
    words, and what is over is dealt again by weight. Sources are filled in the order of
    cap / weight: those before the first one that the common level doesn't overflow keep
    their cap, the others get level x weight. One row per source, so one small window.
    """
    by_name = Window.orderBy("snull", "skey")
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    filled = Window.orderBy("ratio", "snull", "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumns({
        "capped": F.coalesce(F.sum("cap").over(filled), F.lit(0.0)),
        "used": F.coalesce(F.sum("weight").over(filled), F.lit(0.0)),
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "all_weight": F.sum("weight").over(everything),
    })
    t = t.withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "snull", "skey"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return t.withColumn("target", target).select("snull", "skey", "source_size", "weight", "target")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix-1",
    digits: int = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns, per input row: doc_id, size, source_size, target (its source's), taken, plus the
    columns in ``keep``. A source of S words and a target of t takes floor(t) words: whole
    passes over all its documents, then documents in key order until the budget is met; the
    last one is taken in part. Null or empty texts have size 0 and take 0, very long ones count
    whole; null sources form one source, the last. A row with a null id gets its key from its
    text, so that many of them spread; rows of equal keys are ordered by id, size and a hash of
    the text, so only rows with equal id and text can change places. An empty table gives an
    empty table. Kept columns may have any name and type; one with the name of a column of the
    result comes back with ``_input`` after its name. ``digits`` hex digits of the key make
    16**digits ranges a source; the targets are computed on one row a source in one task.
    """
    out = _mixed(docs, list(keep), id_col, text_col, source_col, weights, share, cap, seed, digits)
    return out.select("doc_id", "size", "source_size", "target", "taken", *fields("kept", renamed(list(keep), {"doc_id", "size", "source_size", "target", "taken"})))


def _mixed(
    docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", digits: int = 3,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, kept) of each row: what it gives to the mix, and the columns in ``keep`` as a struct."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().cast("int").alias("snull"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))).cast("binary")).alias("key"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        (whole_row(keep) if keep else F.lit(None).cast("int")).alias("kept"),
    )
    rows = stage(rows, "mixing").withColumn("cell", F.substring("key", 1, digits))
    src, at = ["snull", "skey"], ["snull", "skey", "cell"]
    cells = rows.groupBy(*at).agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy(*src).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    targets = source_targets(cells.groupBy(*src).agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    cells = cells.join(targets, src).select(*at, "before", "source_size", "target")
    inside = Window.partitionBy(*at).orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(cells, at).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("start")))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "kept")


def repeat_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them, with the same columns, whatever their names and types.

    A document taken in part comes with its first words only, joined by one space, and a numeric
    n_chars counted anew. Documents without words add nothing to a mix of words. Nulls, ties and empty
    tables count as in :func:`mix_sources`.
    """
    mixed = _mixed(docs, docs.columns, **options).where("taken > 0")
    text = F.col("kept").getField("text")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, part), " ")
    texts = F.concat(F.array_repeat(text, whole), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = mixed.select("kept", (part > 0).alias("in_part"), F.explode(texts).alias("new_text"))
    new = {"text": F.col("new_text").alias("text")}
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType):
        new["n_chars"] = F.when(F.col("in_part"), F.char_length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("kept").getField("n_chars")).alias("n_chars")
    return out.select(*[new.get(c, x) for c, x in zip(docs.columns, fields("kept", docs.columns), strict=True)])


ORACLE = r"""
WITH r AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS snull, coalesce(source, '') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT snull, skey, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY snull, skey
), w AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY snull, skey) - 1) % 3) + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), v AS (SELECT *, cap / weight AS ratio FROM w
), u AS (
  SELECT *, coalesce(sum(cap) OVER f, 0) AS capped, coalesce(sum(weight) OVER f, 0) AS used,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight
  FROM v WINDOW f AS (ORDER BY ratio, snull, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (budget - capped) / (all_weight - used) AS lvl FROM u
), m AS (
  SELECT *, (SELECT lvl FROM l WHERE lvl <= ratio ORDER BY ratio, snull, skey LIMIT 1) AS level FROM l
), t AS (
  SELECT snull, skey, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM m
), p AS (
  SELECT r.*, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY snull, skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start,
         CAST(floor(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM r JOIN t USING (snull, skey)
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, budget - passes * source_size - start)) AS BIGINT) AS taken
FROM p
"""
