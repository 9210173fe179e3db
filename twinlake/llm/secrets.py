"""Secret scans with corpus-wide ownership frequency.

Built-in functions only. Patterns give candidate spans per document; the hashes of the
candidate values are then counted over the whole corpus by distinct repositories and
distinct owners. A value that many owners hold is a copied example, one that a single owner
holds and that looks random is a live-looking credential. Owner-specific random strings
outside the base patterns are added as further spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from twinlake.llm._stage import fields, renamed, stage, whole_row


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"(?:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "owned")
MATCH = "array<struct<kind:int,pos:int,gap:bigint,size:bigint,value:string>>"
#: Characters of a value that count, by kind; matches with fewer are dropped after their places are known.
LEAST = (6, 20, 24, 24)


def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """A pattern's leftmost non-overlapping matches: number, characters since the one before, size, and the group that ends the match.

    Gaps come from split, matches from regexp_extract_all: a match starts where the gaps and matches before it end.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(
        F.filter(both, lambda x: x["whole"].isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["whole"]).cast("long").alias("size"), x["value"].alias("value")),
    )
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(MATCH))


def candidates(text: Column) -> Column:
    """All matches in a text, null as empty: the base kinds, and runs of letters and digits as the fourth kind."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(_matches(t, ASSIGN, 0, 1), _matches(t, ACCESS, 1, 0), _matches(t, HEX, 2, 0), _matches(t, OPAQUE, 3, 0))


def _placed(found: DataFrame) -> DataFrame:
    """(rid, .., found) -> a row a span with start and end, in code points; the fourth kind only where letters of both cases and digits mix."""
    each = found.select(*[c for c in found.columns if c != "found"], F.explode("found").alias("x"))
    until = F.sum(F.col("x.gap") + F.col("x.size")).over(Window.partitionBy("rid", "x.kind").orderBy("x.pos").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", until).withColumn("start", F.col("end") - F.col("x.size"))
    value = F.col("x.value")
    enough = F.char_length(value) >= F.element_at(F.array(*map(F.lit, LEAST)), F.col("x.kind") + 1)
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[A-Z]"))
    return each.where(enough & ((F.col("x.kind") < 3) | mixed))


def _live_looking(value: Column) -> Column:
    """A digit and a letter, at least eight distinct characters, and none of the words that mark a placeholder."""
    return (
        F.rlike(value, F.lit("[0-9]"))
        & F.rlike(value, F.lit("[A-Za-z]"))
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & ~F.rlike(F.lower(value), F.lit("example|sample|dummy|changeme|placeholder|xxxx"))
    )


def scan_secrets(
    docs: DataFrame,
    *,
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    keep: Sequence[str] = ("doc_id",),
    example_owners: int = 3,
) -> DataFrame:
    """Spans of secrets in each row, each with its class over the whole corpus.

    Returns the columns in ``keep`` and ``spans``: array of (start, kind, end, value, class),
    sorted by start and kind; kind indexes KINDS; class is ``example`` (at least
    ``example_owners`` distinct owners, or as many repositories and two owners), ``live`` (one
    owner, random-looking) or ``shared``. Base spans always stay; spans of the fourth kind
    stay where they are live and lie outside every base span. Null and empty texts have no spans;
    very long ones are scanned whole. Null owners and repositories count as one owner and one
    repository; repeated rows are rows of their own; an empty table gives an empty table. A kept
    column may have any name and type; one called ``spans`` comes back as ``spans_input``. A value
    that a third of all rows hold is counted by partial aggregation, and its join back is one that
    Spark splits when skewed.
    """
    found = _scan(docs, list(keep), text_col, owner, repository, example_owners)
    return found.select(*fields("kept", renamed(list(keep), {"spans"})), "spans")


def _scan(docs: DataFrame, keep: list[str], text_col: str = "text", owner: Column | None = None, repository: Column | None = None, example_owners: int = 3) -> DataFrame:
    """(kept, spans) of each row: the columns in ``keep`` as a struct, and its spans."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    base = docs.select(
        whole_row(keep).alias("kept"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repo"),
        candidates(F.col(text_col)).alias("found"),
    )
    base = stage(base.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    some = base.where(F.size("found") > 0)
    each = _placed(some.select("rid", "owner", "repo", "found")).withColumn("h", F.sha2(F.col("x.value").cast("binary"), 256))
    each = stage(each.select("rid", "owner", "repo", "h", "start", "end", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")), "spans")
    held = each.groupBy("h", "owner", "repo").agg(F.first("value").alias("value"))
    counts = held.groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repos"), F.first("value").alias("value"))
    wide = (F.col("owners") >= example_owners) | ((F.col("owners") >= 2) & (F.col("repos") >= example_owners))
    classes = counts.select("h", F.when(wide, "example").when((F.col("owners") == 1) & _live_looking(F.col("value")), "live").otherwise("shared").alias("class"))
    spans = each.join(classes, "h").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "class"))).alias("spans"))
    inside = lambda x: F.exists(F.filter("spans", lambda y: y["kind"] < 3), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    spans = spans.withColumn("spans", F.filter("spans", lambda x: (x["kind"] < 3) | ((x["class"] == "live") & ~inside(x))))
    nothing = F.array().cast(spans.schema["spans"].dataType)
    none = base.where(F.size("found") == 0).select("kept", nothing.alias("spans"))
    return some.select("rid", "kept").join(spans, "rid", "left").select("kept", F.coalesce("spans", nothing).alias("spans")).unionByName(none)


def _named(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])


def digest(found: DataFrame) -> DataFrame:
    """The report of :func:`scan_secrets`: counts by kind, the hash of the base spans and all spans as text."""
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    cls = lambda c: F.size(F.filter("spans", lambda x: x["class"] == c)).cast("long")
    joined = lambda col: F.array_join(F.transform(col, _named), ",")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        n(3).alias("n_added"), cls("live").alias("n_live"), cls("example").alias("n_example"),
    )


def mask_live(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """The rows of ``docs`` with every live-looking span replaced by ``mark``.

    Other columns, whatever their names and types, come back as they were, but a numeric n_chars is
    counted anew where the text changed. Texts, nulls, repeated rows and empty tables count as in
    :func:`scan_secrets`.
    """
    found = _scan(docs, docs.columns, **options)
    text = F.col("kept").getField("text")
    live = F.filter("spans", lambda x: x["class"] == "live")
    # Overlapping spans of two kinds are cut where the earlier one ended.
    cut = F.aggregate(
        live,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda acc, x: F.when(
            x["end"] > acc["at"],
            F.struct(x["end"].alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(F.array(acc["at"], x["start"])))).otherwise(acc["out"]).alias("out")),
        ).otherwise(acc),
    )
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    out = found.withColumn("cut", cut).withColumn("masked", F.when(
        F.size("cut.out") > 0,
        F.concat(F.array_join(F.transform("cut.out", lambda x: F.concat(piece(x[0], x[1]), F.lit(mark))), ""), piece(F.col("cut.at"), F.char_length(text).cast("long"))),
    ))
    new = {"text": F.coalesce("masked", text).alias("text")}
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType):
        new["n_chars"] = F.when(F.col("masked").isNotNull(), F.char_length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("kept").getField("n_chars")).alias("n_chars")
    return out.select(*[new.get(c, x) for c, x in zip(docs.columns, fields("kept", docs.columns), strict=True)])


def oracle() -> str:
    """DuckDB SQL of the digest columns."""
    def part(kind: int, rx: str, group: int, least: int) -> str:
        rx = rx.replace("'", "''")
        return f"""
  SELECT rid, {kind} AS kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
      s := CAST(coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS BIGINT),
      n := length(ms[i]), v := vs[i]))) AS x
  FROM (SELECT rid, string_split_regex(t, '{rx}') AS gs, regexp_extract_all(t, '{rx}') AS ms, regexp_extract_all(t, '{rx}', {group}) AS vs FROM d WHERE regexp_matches(t, '{rx}'))"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
a AS ({part(0, ASSIGN, 1, 6)}
  UNION ALL {part(1, ACCESS, 0, 20)}
  UNION ALL {part(2, HEX, 0, 24)}
  UNION ALL {part(3, OPAQUE, 0, 24)}),
c AS (
  SELECT rid, kind, x.s AS s, x.s + x.n AS e, x.v AS v FROM a
  WHERE (kind = 0 AND length(x.v) >= 6) OR kind IN (1, 2)
     OR (kind = 3 AND regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]'))),
n AS (
  SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (coalesce(source, ''), concat_ws('/', source, lang))) AS repos
  FROM c JOIN d USING (rid) GROUP BY v),
k AS (
  SELECT c.*, CASE WHEN owners >= 3 OR (owners >= 2 AND repos >= 3) THEN 'example'
    WHEN owners = 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8
      AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|xxxx') THEN 'live' ELSE 'shared' END AS cls
  FROM c JOIN n USING (v)),
q AS (
  SELECT * FROM k WHERE kind < 3
  UNION ALL SELECT k.* FROM k WHERE kind = 3 AND cls = 'live' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.rid = k.rid AND b.kind < 3 AND b.s < k.e AND k.s < b.e)),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (kind = 3) AS n_added, count(*) FILTER (cls = 'live') AS n_live, count(*) FILTER (cls = 'example') AS n_example
  FROM q GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""
