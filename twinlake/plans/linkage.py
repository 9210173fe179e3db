"""Record-linkage queries over the test tables: one per operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions import fuzzy, phonetic
from twinlake.functions import text as X
from twinlake.operators import blocking as B
from twinlake.operators import decision as D
from twinlake.operators import features as FE
from twinlake.operators import gather as G
from twinlake.operators import matcher as M
from twinlake.operators import metrics as ME
from twinlake.operators import validation as V
from twinlake.plans import linkage_sql as S
from twinlake.sources import tables as T
from twinlake.sources.staging import in_round, rounds_of, stage, stage_rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Production limits, depth and budget, as in the SQL; tests set smaller ones here and there.
PROFILE = B.PROD


#: Tables of the query that is being built; its parts share them.
_held: dict[str, DataFrame] | None = None


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            global _held
            outer, _held = _held, {} if _held is None else _held
            try:
                return f(spark, sf)
            finally:
                _held = outer

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def once(name: str, *rounds: Callable[[], DataFrame]) -> DataFrame:
    """A table that several parts of a query read: made, in one round or more, and written once a query."""
    if _held is None:
        return reduce(DataFrame.unionByName, [make() for make in rounds])
    if name not in _held:
        _held[name] = stage(rounds[0](), name) if len(rounds) == 1 else stage_rounds((make() for make in rounds), name)
    return _held[name]


def records(spark: SparkSession, sf: str) -> DataFrame:
    return T.prepare(T.records_of_documents(spark, sf))


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = once("records", lambda: records(spark, sf))
    return r.where("k = 0"), r.where("k > 0").withColumn("is_s2", (F.col("k") == 1).cast("int"))


def lean_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same, not written: whole texts and their words take more disk than the documents, and most parts read a name only."""
    r = records(spark, sf)
    return r.where("k = 0"), r.where("k > 0").withColumn("is_s2", (F.col("k") == 1).cast("int"))


def listed(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


_sorted = lambda x: f"array_to_string(list_sort({x}), ',')"


def _text(name: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of scalar functions over all records."""
    oracle = S.sql("SELECT id, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM n", S.RECORDS)
    query(name, oracle)(lambda spark, sf: records(spark, sf).select("id", *[f().alias(c) for c, (f, _) in columns.items()]))


_text("normalize_name", {"norm_name": (lambda: F.col("norm_name"), "norm_name")})
_text("name_tokens", {"core": (lambda: F.array_join("core", " "), "array_to_string(core, ' ')"), "suffixes": (lambda: F.array_join(X.suffix_tokens(F.col("norm_name")), " "), f"array_to_string(list_filter(words, lambda t: list_contains({S._list(S.LEGAL_SUFFIXES)}, t)), ' ')")})
_text("normalize_address", {"norm_addr": (lambda: F.col("norm_addr"), "norm_addr")})
_text("address_digits", {"digits": (lambda: listed(F.col("digits")), _sorted("list_distinct(own_runs)"))})
_text("addr_blocking_keys", {"keys": (lambda: listed(X.address_keys(F.col("addr"), F.col("norm_addr"))), _sorted("addr_keys"))})
_text("prepare_record", {
    "norm_name": (lambda: F.col("norm_name"), "norm_name"), "norm_addr": (lambda: F.col("norm_addr"), "norm_addr"), "core": (lambda: F.array_join("core", " "), "array_to_string(core, ' ')"),
    "prefix6": (lambda: F.col("prefix6"), "substr(norm_name, 1, 6)"), "postal": (lambda: F.col("postal"), f"coalesce(({S._sized('own_runs', 4, 6)})[1], '')"), "street_num": (lambda: F.col("street_num"), f"coalesce(({S._sized('own_runs', 1, 5)})[1], '')"),
    "addr_words": (lambda: listed(F.col("addr_words")), _sorted("list_distinct(awords)")),
})
_text("has_indic", {"indic": (lambda: X.has_indic_script(F.col("name")), r"regexp_matches(name, '[\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}\x{0A80}-\x{0AFF}\x{0B00}-\x{0B7F}\x{0B80}-\x{0BFF}\x{0C00}-\x{0C7F}\x{0C80}-\x{0CFF}\x{0D00}-\x{0D7F}]')")})
_text("compact_alnum", {"compact": (lambda: X.compact_alnum(F.col("norm_name")), "regexp_replace(lower(norm_name), '[^a-z0-9]', '', 'g')")})
_text("extract_phones", {"phones": (lambda: listed(X.phones(F.col("addr"))), _sorted(S.all_phones("addr")))})
_text("acronyms", {"acronyms": (lambda: listed(X.acronyms(F.col("norm_name"), F.col("core"))), _sorted("acr"))})
_text("initials", {"initials": (lambda: X.initials(F.col("core")), S.initials("core"))})
_text("postal_prefixes", {"prefixes": (lambda: listed(X.postal_prefixes(F.col("addr"), F.col("norm_addr"))), _sorted("post2"))})
_text("char_ngrams", {f"g{n}": (lambda n=n: listed(X.ngrams(F.col("norm_name"), n)), _sorted(S.gram_set("norm_name", n))) for n in (2, 3, 4)})
_text("name_concat_keys", {"keys": (lambda: listed(X.concat_keys(F.col("norm_name"), F.col("core"))), _sorted(S.CONCATS))})
_text("suffix_variants", {"variants": (lambda: listed(X.suffix_variants(F.concat("norm_name", F.lit(" pvt ltd")))), _sorted(S.VARIANTS.replace("norm_name", "(norm_name || ' pvt ltd')")))})
_text("schwa_variants", {"variants": (lambda: F.array_join(F.filter(F.transform("core", X.schwa_variant), lambda x: x.isNotNull()), ","), "array_to_string(list_filter(list_transform(core, lambda t: CASE WHEN length(t) >= 3 AND t NOT LIKE '%a' THEN t || 'a' WHEN length(t) >= 4 THEN substr(t, 1, length(t) - 1) END), lambda t: t IS NOT NULL), ',')")})
_text("hash_split", {"half": (lambda: X.hash_split(F.col("id")), "CAST(CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) % 2 AS INTEGER)")})
_text("url_flag", {"flag": (lambda: X.url_or_handle(F.concat("name", F.lit(" "), "addr")), r"regexp_matches(name || ' ' || addr, '(?i)(@|\.com|\.in|\.org|\.net|www\.)')")})
_text("script_class", {"script": (lambda: X.script_class(F.col("name")), r"CASE WHEN regexp_matches(name, '\p{Latin}') AND regexp_matches(name, '\p{Devanagari}') THEN 'mixed' WHEN regexp_matches(name, '\p{Devanagari}') THEN 'devanagari' WHEN regexp_matches(name, '\p{Latin}') THEN 'latin' ELSE 'other' END")})
_code = "CASE WHEN c IN ('b','f','p','v') THEN '1' WHEN c IN ('c','g','j','k','q','s','x','z') THEN '2' WHEN c IN ('d','t') THEN '3' WHEN c = 'l' THEN '4' WHEN c IN ('m','n') THEN '5' WHEN c = 'r' THEN '6' ELSE '' END"
query("soundex_ref", f"""WITH {S.RECORDS}, w AS (SELECT DISTINCT unnest(core) AS token FROM n), l AS (SELECT token, regexp_replace(lower(token), '[^a-z]', '', 'g') AS a FROM w),
d AS (SELECT token, a, list_transform(string_split(substr(a, 2), ''), lambda c: {_code}) AS d FROM l)
SELECT token, CASE WHEN a = '' THEN '' ELSE rpad(substr(upper(substr(a, 1, 1)) || array_to_string(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i > 1 AND d[i] = d[i - 1] THEN '' ELSE d[i] END), ''), 1, 4), 4, '0') END AS code FROM d""")(
    lambda spark, sf: records(spark, sf).select(F.explode("core").alias("token")).distinct().select("token", X.soundex_code(F.col("token")).alias("code"))
)
query("match_bucket", "SELECT c_custkey % 9 AS n, count(*) AS k, any_value(CASE WHEN c_custkey % 9 <= 3 THEN CAST(c_custkey % 9 AS VARCHAR) WHEN c_custkey % 9 <= 6 THEN '4-6' ELSE '7+' END) AS bucket FROM customer GROUP BY 1")(
    lambda spark, sf: spark.read.parquet(f"{sf}/customer.parquet").groupBy((F.col("c_custkey") % 9).alias("n")).agg(F.count("*").alias("k")).withColumn("bucket", X.match_bucket(F.col("n")))
)


@query("scan_union_sources", S.sql("SELECT id, name, country, CASE WHEN k = 1 THEN 1 ELSE 0 END AS is_s2 FROM er WHERE k > 0", S.RECORDS))
def scan_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    r = T.records_of_documents(spark, sf).select("id", "name", "country", "k")
    return T.union_sources(r.where("k = 1").drop("k"), r.where("k = 2").drop("k"))


@query("scan_partition_filter", S.sql("SELECT id, name, addr FROM er WHERE country = 'fr'", S.RECORDS))
def scan_partition_filter(spark: SparkSession, sf: str) -> DataFrame:
    return T.of_country(T.records_of_documents(spark, sf), "fr").select("id", "name", "addr")


@query("ground_truth_parse", "SELECT DISTINCT 'S1-' || a AS s1_id, trim(x) AS target_id FROM (SELECT l_orderkey AS a, unnest(string_split(string_agg('S2-' || l_partkey, ' ,'), ',')) AS x FROM lineitem GROUP BY 1) WHERE trim(x) <> ''")
def ground_truth_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.concat(F.lit("S1-"), "l_orderkey").alias("source1_entity_id"))
    return T.parse_truth(lines.agg(F.array_join(F.collect_list(F.concat(F.lit("S2-"), "l_partkey")), " ,").alias("matched_entity_ids")))


@query("pool_sample", S.sql("SELECT id FROM er WHERE k > 0 AND (id IN (SELECT id FROM er WHERE k > 0 ORDER BY id LIMIT 50) OR id IN (SELECT target_id FROM truth))", S.RECORDS, S.SCORED.split(",\nlinked")[0][S.SCORED.index("truth AS"):]))
def pool_sample(spark: SparkSession, sf: str) -> DataFrame:
    return T.pool_sample(T.records_of_documents(spark, sf).where("k > 0").select("id"), T.truth_of_documents(spark, sf), 50)


@query("country_counts", S.sql("SELECT country, count(*) AS n FROM er WHERE k = 0 GROUP BY country", S.RECORDS))
def country_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ME.country_counts(T.records_of_documents(spark, sf).where("k = 0"))


@query("profile_source", S.sql("""SELECT country, count(*) AS n_rows, count(DISTINCT id) AS ids, count(*) FILTER (name = '') AS empty_names, count(*) FILTER (addr = '') AS empty_addresses, min(length(name)) AS name_min, max(length(name)) AS name_max,
  round(avg(length(name)), 6) AS name_mean, min(length(addr)) AS addr_min, max(length(addr)) AS addr_max, round(avg(length(addr)), 6) AS addr_mean FROM er GROUP BY GROUPING SETS ((country), ())""", S.RECORDS))
def profile_source(spark: SparkSession, sf: str) -> DataFrame:
    return ME.profile_source(T.records_of_documents(spark, sf)).withColumns({c: F.round(c, 6) for c in ("name_mean", "addr_mean")})


@query("min_slice_token_prefix_topk", S.sql("""SELECT s1_id, target_id, weight, CAST(r - 1 AS INTEGER) AS rank FROM (
  SELECT s1_id, target_id, sum(w) AS weight, row_number() OVER (PARTITION BY s1_id ORDER BY sum(w) DESC, target_id) AS r FROM hit WHERE rule IN ('token', 'prefix') GROUP BY 1, 2) WHERE r <= 10""", S.RECORDS, S.POSTINGS, S.STATS, S.HITS))
def min_slice(spark: SparkSession, sf: str) -> DataFrame:
    """For each first-source record the ten others of its country that share most words and its prefix."""
    s1, targets = sides(spark, sf)
    profile = B.Profile(channels=("token", "prefix"), limits=PROFILE.limits, cross_field=0.0, many_tokens=0.0)
    return B.top_k(B.retrieve(s1, targets, profile), 10).select("s1_id", "target_id", "weight", "rank")


def _channel(name: str) -> None:
    query(f"post_{name}", S.sql(f"SELECT country, key, target_id FROM post WHERE channel = '{name}'", S.RECORDS, S.POSTINGS))(lambda spark, sf: B.postings(sides(spark, sf)[1], (name,)).select("country", "key", "target_id"))


for _c in S.TARGET_KEYS:
    _channel(_c)


def posted(spark: SparkSession, sf: str) -> DataFrame:
    return B.unfolded(filed(spark, sf))


def filed(spark: SparkSession, sf: str) -> DataFrame:
    return once("filed", lambda: B.filed(lean_sides(spark, sf)[1]))


query("key_counts", S.sql("SELECT country, channel, key, n FROM counts", S.RECORDS, S.POSTINGS, S.STATS))(lambda spark, sf: B.key_counts(posted(spark, sf)))
query("prune_frequent", S.sql("SELECT p.country, p.channel, p.key, p.target_id FROM post p SEMI JOIN stats USING (country, channel, key)", S.RECORDS, S.POSTINGS, S.STATS))(lambda spark, sf: B.prune(posted(spark, sf), PROFILE.limits))
for _c in ("addr", "ngram", "addr_tok"):
    query(f"idf_{_c}", S.sql(f"SELECT country, key, round(idf, 6) AS idf FROM stats WHERE channel = '{_c}'", S.RECORDS, S.POSTINGS, S.STATS))(
        lambda spark, sf, c=_c: B.within_limits(B.idf(B.key_counts(B.postings(sides(spark, sf)[1], (c,))), sides(spark, sf)[1]), PROFILE.limits).select("country", "key", F.round("idf", 6).alias("idf"))
    )


def found(spark: SparkSession, sf: str, rule: str | None = None) -> DataFrame:
    s1, targets = sides(spark, sf)
    asked = B.query_keys(s1, PROFILE)
    p = posted(spark, sf)
    if rule:
        asked, p = asked.where(F.col("rule") == rule), p.where(F.col("channel") == {"concat": "token"}.get(rule, rule))
    return B.hits(B.weighted_keys(asked, B.idf(B.key_counts(p), targets), PROFILE), p)


_ALL = (S.RECORDS, S.POSTINGS, S.STATS, S.HITS, S.SCORES)
for _r in ("exact", "addr", "token", "concat", "prefix", "acronym", "tokpost", "addr_tok", "ngram", "phone"):
    query(f"join_{_r}", S.sql(f"SELECT s1_id, target_id, round(sum(w), 6) AS weight FROM hit WHERE rule = '{_r}' GROUP BY 1, 2", *_ALL))(
        lambda spark, sf, r=_r: found(spark, sf, r).groupBy("s1_id", "target_id").agg(F.round(F.sum("w"), 6).alias("weight"))
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return once("scored", lambda: B.score(found(spark, sf), PROFILE))


def gathered(spark: SparkSession, sf: str, cut: G.Cut) -> DataFrame:
    """The scored candidates that a query needs, cut a record where hits arise."""
    s1, targets = lean_sides(spark, sf)
    f = filed(spark, sf)
    p, n = B.unfolded(f), rounds_of(f)
    stats = once("stats", lambda: B.within_limits(B.idf(B.key_counts(p), targets), PROFILE.limits))
    # Of all words of a text the rarest few are kept, so the keys asked take many times what is left of them.
    weighted = lambda i: B.weighted_keys(B.query_keys(s1.where(in_round(i, n, "id")), PROFILE), stats, PROFILE)
    keys = once("keys", *[lambda i=i: weighted(i) for i in range(n)])
    return G.gather(keys, stats, p, f.select("target_id"), PROFILE, cut, n)


def ranked(spark: SparkSession, sf: str, k: int | None = None) -> DataFrame:
    k = PROFILE.budget if k is None else k
    return once(f"ranked-{k}", lambda: B.top_k(gathered(spark, sf, G.Cut(best=k)), k))


def difficulty_of(spark: SparkSession, sf: str) -> DataFrame:
    return once("difficulty", lambda: B.tiers(lean_sides(spark, sf)[0], gathered(spark, sf, G.Cut(summary=True))))


query("score_sum", S.sql("SELECT s1_id, target_id, round(weight, 6) AS weight FROM sc", *_ALL))(lambda spark, sf: scored(spark, sf).select("s1_id", "target_id", F.round("weight", 6).alias("weight")))
query("provenance", S.sql("SELECT s1_id, target_id, array_to_string(channels, ',') AS channels FROM sc", *_ALL))(lambda spark, sf: scored(spark, sf).select("s1_id", "target_id", F.array_join("channels", ",").alias("channels")))
query("union_of_channels", S.sql("SELECT s1_id, target_id, count(DISTINCT rule) AS rules FROM hit GROUP BY 1, 2", *_ALL))(lambda spark, sf: found(spark, sf).groupBy("s1_id", "target_id").agg(F.countDistinct("rule").alias("rules")))
query("bonus_multi_token", S.sql("SELECT s1_id, target_id, token_hits FROM sc WHERE token_hits >= 2", *_ALL))(lambda spark, sf: gathered(spark, sf, G.Cut(evidence="token_hits")).select("s1_id", "target_id", "token_hits"))
query("bonus_cross_field", S.sql("SELECT s1_id, target_id FROM sc WHERE cross_field", *_ALL))(lambda spark, sf: gathered(spark, sf, G.Cut(evidence="cross_field")).select("s1_id", "target_id"))
query("topk_by_score", S.sql("SELECT s1_id, target_id, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank < " + S.BUDGET, *_ALL))(lambda spark, sf: ranked(spark, sf).select("s1_id", "target_id", F.round("weight", 6).alias("weight"), "rank"))
_TIER = """
tier AS (
  SELECT s.id AS s1_id, coalesce(n, 0) AS n, coalesce(best, 0) AS best,
    CASE WHEN coalesce(n, 0) = 0 OR best < 3 OR norm_addr = '' OR len(core) <= 1 OR n >= 1000 THEN 'hard' WHEN n >= 150 OR best < 8 THEN 'medium' ELSE 'easy' END AS tier,
    EXISTS (SELECT 1 FROM post p WHERE p.channel = 'exact' AND p.country = s.country AND p.key = s.norm_name) AS named
  FROM s LEFT JOIN (SELECT s1_id, count(*) AS n, max(weight) AS best FROM sc GROUP BY 1) c ON c.s1_id = s.id),
bud AS (SELECT s1_id, CASE WHEN tier = 'hard' AND named THEN 'medium' ELSE tier END AS tier FROM tier)"""
query("difficulty_tier", S.sql("SELECT s1_id, n, round(best, 6) AS best, tier FROM tier", *_ALL, _TIER))(lambda spark, sf: difficulty_of(spark, sf).withColumn("best", F.round("best", 6)))
query("adaptive_budget", S.sql("SELECT s1_id, tier, CASE tier WHEN 'easy' THEN 60 WHEN 'medium' THEN 150 ELSE 250 END AS budget FROM bud", *_ALL, _TIER))(lambda spark, sf: B.budgets_of(lean_sides(spark, sf)[0], difficulty_of(spark, sf), posted(spark, sf)))
query("must_include", S.sql("SELECT s1_id, target_id FROM rk WHERE rank < 5 OR token_hits >= 2 OR cross_field", *_ALL))(lambda spark, sf: B.must_include(scored(spark, sf), 5).select("s1_id", "target_id"))
_RERANK = f"""
re AS (
  SELECT rk.s1_id, rk.target_id, CASE WHEN n > {S.BUDGET} THEN weight + 8 * {S.jaccard("x3", "y3")} ELSE weight END AS weight
  FROM rk JOIN (SELECT id AS s1_id, {S.gram_set("norm_name", 3)} AS x3 FROM s) USING (s1_id) JOIN (SELECT id AS target_id, {S.gram_set("norm_name", 3)} AS y3 FROM t) USING (target_id)
  WHERE rank < {S.DEPTH} OR token_hits >= 2 OR cross_field)"""
query("rerank_trigram", S.sql("SELECT s1_id, target_id, weight, rank FROM (SELECT s1_id, target_id, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(weight, 6) DESC, target_id) - 1 AS INTEGER) AS rank FROM re) WHERE rank < " + S.BUDGET, *_ALL, _RERANK))(
    lambda spark, sf: B.rerank(scored(spark, sf), *sides(spark, sf), PROFILE.budget, PROFILE).select("s1_id", "target_id", F.round("weight", 6).alias("weight"), "rank")
)
query("rerank_adaptive", S.sql("SELECT s1_id, target_id, weight, rank FROM (SELECT s1_id, target_id, budget, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(weight, 6) DESC, target_id) - 1 AS INTEGER) AS rank FROM rb) WHERE rank < budget", *_ALL, _TIER, f"""
lim AS (SELECT s1_id, CASE tier WHEN 'easy' THEN 60 WHEN 'medium' THEN 150 ELSE 250 END AS budget FROM bud),
rb AS (
  SELECT rk.s1_id, rk.target_id, lim.budget, CASE WHEN rk.n > lim.budget THEN rk.weight + 8 * {S.jaccard("x3", "y3")} ELSE rk.weight END AS weight
  FROM rk JOIN lim USING (s1_id) JOIN (SELECT id AS s1_id, {S.gram_set("norm_name", 3)} AS x3 FROM s) USING (s1_id) JOIN (SELECT id AS target_id, {S.gram_set("norm_name", 3)} AS y3 FROM t) USING (target_id)
  WHERE (rank < {S.DEPTH} OR token_hits >= 2 OR cross_field) AND (rk.n > lim.budget OR rank < lim.budget))"""))(
    lambda spark, sf: B.rerank(scored(spark, sf), *sides(spark, sf), B.budgets(sides(spark, sf)[0], scored(spark, sf), posted(spark, sf)), PROFILE).select("s1_id", "target_id", F.round("weight", 6).alias("weight"), "rank")
)
_QUOTA = f"""
named AS (SELECT *, len(list_intersect(channels, ['exact', 'token', 'prefix', 'acronym', 'tokpost'])) > 0 AS named FROM sc),
first AS (SELECT *, named AND row_number() OVER (PARTITION BY s1_id, named ORDER BY round(weight, 6) DESC, target_id) <= {S.BUDGET} - {S.BUDGET} // 2 AS reserved FROM named),
quota AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY reserved DESC, round(weight, 6) DESC, target_id) - 1 AS rank FROM first)"""
query("family_quota", S.sql(f"SELECT s1_id, target_id, array_to_string(channels, ',') AS channels, CAST(rank AS INTEGER) AS rank FROM quota WHERE rank < {S.BUDGET}", *_ALL, _QUOTA))(lambda spark, sf: B.family_quota(gathered(spark, sf, G.Cut(best=2 * PROFILE.budget, named=PROFILE.budget)), PROFILE.budget).select("s1_id", "target_id", F.array_join("channels", ",").alias("channels"), "rank"))
for _name, _profile in (("baseline_profile", B.BASELINE), ("mem_profile", B.MEM), ("prod_profile", B.PROD), ("multi_pass_profile", B.MULTI_PASS)):
    query(_name, S.PROFILES[_name])(lambda spark, sf, p=_profile: B.top_k(B.retrieve(*sides(spark, sf), p), p.budget).select("s1_id", "target_id", F.round("weight", 6).alias("weight"), "rank"))


def probable(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidates, with name similarity as a stand-in for a model's probability."""
    best, n = ranked(spark, sf), rounds_of(filed(spark, sf))
    grams = once("grams", lambda: records(spark, sf).select("id", "k", X.gram_codes(F.col("norm_name"), 3).alias("g")))
    names = lambda side, a, b: grams.where(side).select(F.col("id").alias(a), F.col("g").alias(b))

    def compared(i: int) -> DataFrame:
        # Pairs travel with the grams of their record, in many times the room that they take themselves.
        pairs = best.where(in_round(i, n, "s1_id")).join(names("k = 0", "s1_id", "g1").where(in_round(i, n, "s1_id")), "s1_id")
        return pairs.join(names("k > 0", "target_id", "g2"), "target_id").withColumn("p", F.round(X.set_jaccard(F.col("g1"), F.col("g2")), 6)).drop("g1", "g2")

    return once("probable", *[lambda i=i: compared(i) for i in range(n)])


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return T.records_of_documents(spark, sf).where("k = 0").select(F.col("id").alias("s1_id"), "country", "name")


def links(spark: SparkSession, sf: str) -> DataFrame:
    return D.two_stage(probable(spark, sf))


_P = (*_ALL, S.SCORED)
_LINKS, _CANDS = S.per_record("(SELECT * FROM linked WHERE accepted)"), S.per_record("cand")


def _records(spark: SparkSession, sf: str, candidates: bool = False) -> DataFrame:
    predicted = ranked(spark, sf) if candidates else links(spark, sf).where("accepted")
    return ME.per_record(ids(spark, sf), T.truth_of_documents(spark, sf), predicted)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


query("macro_f05", S.sql(f"SELECT round(avg({S.F05}), 6) AS macro_f05 FROM rec", *_P, _LINKS))(lambda spark, sf: _rounded(ME.macro_f05(_records(spark, sf))))
query("evaluate_metrics", S.sql(f"SELECT {S.SUMMARY} FROM rec", *_P, _LINKS))(lambda spark, sf: _rounded(ME.evaluate(_records(spark, sf))))
_groups = r"""SELECT kind, label, {} FROM (
  SELECT *, 'country' AS kind, country AS label FROM rec UNION ALL SELECT *, 'script', CASE WHEN regexp_matches(name, '\p{{Latin}}') THEN 'latin' ELSE 'other' END FROM rec
  UNION ALL SELECT *, 'cardinality', CASE WHEN n_truth = 0 THEN 'singleton' WHEN n_truth = 1 THEN 'one' ELSE 'multi' END FROM rec) GROUP BY kind, label"""
query("group_metrics", S.sql(_groups.format(S.SUMMARY), *_P, _LINKS))(lambda spark, sf: _rounded(ME.evaluate_groups(_records(spark, sf))))
query("candidate_recall", S.sql("SELECT round(CAST(sum(tp) AS DOUBLE) / greatest(1, sum(n_truth)), 6) AS pair_recall, count(*) FILTER (tp = n_truth) AS full_recall, count(*) FILTER (n_truth > 0 AND tp = 0) AS zero_recovery, count(*) FILTER (n_truth > 0) AS with_truth FROM rec", *_P, _CANDS))(lambda spark, sf: _rounded(ME.candidate_recall(_records(spark, sf, True))))
query("entity_full_recall", S.sql("SELECT s1_id, tp = n_truth AS full, n_truth > 0 AND tp = 0 AS zero FROM rec", *_P, _CANDS))(lambda spark, sf: _records(spark, sf, True).select("s1_id", (F.col("tp") == F.col("n_truth")).alias("full"), ((F.col("n_truth") > 0) & (F.col("tp") == 0)).alias("zero")))
_BUDGETS = (1, 2, 5, 10, 20)
query("recall_at_budget", S.sql("SELECT CAST(b AS INTEGER) AS budget, round(avg(CASE WHEN rank < b THEN 1 ELSE 0 END), 6) AS recall FROM truth LEFT JOIN cand USING (s1_id, target_id), (SELECT unnest([1, 2, 5, 10, 20]) AS b) GROUP BY b", *_P))(lambda spark, sf: _rounded(ME.recall_at(T.truth_of_documents(spark, sf), ranked(spark, sf), _BUDGETS)))
query("oracle_f05", S.sql(f"SELECT round(avg({S.F05}), 6) AS macro_f05 FROM rec", *_P, S.per_record("(SELECT truth.* FROM truth SEMI JOIN cand USING (s1_id, target_id))")))(lambda spark, sf: _rounded(ME.oracle_f05(ids(spark, sf), T.truth_of_documents(spark, sf), ranked(spark, sf))))


def diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    return ME.diagnose(lean_sides(spark, sf)[0], T.truth_of_documents(spark, sf), ranked(spark, sf))


query("candidate_diagnostic", S.sql("""SELECT rec.s1_id, n_truth AS gt_count, tp AS recovered_gt_count, n_pred AS candidate_count, coalesce(a.lo, 0) AS gt_min_rank, coalesce(a.hi, 0) AS gt_max_rank, round(coalesce(a.mean, 0), 6) AS channel_agreement_mean,
  coalesce(m.missing, '') AS missing_gt_ids, CAST(len(s.core) <= 1 AS INTEGER) AS single_token_name FROM rec JOIN s ON s.id = rec.s1_id
  LEFT JOIN (SELECT c.s1_id, coalesce(CAST(min(CASE WHEN truth.target_id IS NOT NULL THEN rank + 1 END) AS INTEGER), 0) AS lo, coalesce(CAST(max(CASE WHEN truth.target_id IS NOT NULL THEN rank + 1 END) AS INTEGER), 0) AS hi, avg(len(channels)) AS mean FROM cand c LEFT JOIN truth USING (s1_id, target_id) GROUP BY 1) a ON a.s1_id = rec.s1_id
  LEFT JOIN (SELECT s1_id, string_agg(target_id, ',' ORDER BY target_id) AS missing FROM truth ANTI JOIN cand USING (s1_id, target_id) GROUP BY 1) m ON m.s1_id = rec.s1_id""", *_P, _CANDS))(
    lambda spark, sf: _rounded(diagnosed(spark, sf)).fillna(0, ["gt_min_rank", "gt_max_rank"]).select("s1_id", "gt_count", "recovered_gt_count", "candidate_count", "gt_min_rank", "gt_max_rank", "channel_agreement_mean", "missing_gt_ids", "single_token_name")
)
query("summarize_retrieval", S.sql("""SELECT round(CAST(sum(tp) AS DOUBLE) / sum(n_truth), 6) AS candidate_pair_recall, CAST(sum(n_pred) AS BIGINT) AS candidate_total, min(n_pred) AS least, max(n_pred) AS most,
  (list_sort(list(n_pred)))[CAST(round_even((count(*) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, (list_sort(list(n_pred)))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM rec""", *_P, _CANDS))(
    lambda spark, sf: _rounded(ME.summarize(diagnosed(spark, sf))).select("candidate_pair_recall", "candidate_total", "least", "most", "p50", "p95")
)
query("channel_membership", S.sql("""SELECT s1_id, target_id, coalesce(array_to_string(list_sort(list_distinct(list(channel))), ','), '') AS shared FROM (
  SELECT truth.s1_id, truth.target_id, q.channel FROM truth LEFT JOIN (SELECT p.target_id AS tid, q.id AS sid, p.channel FROM post p JOIN qpost q USING (country, channel, key)) q ON q.tid = truth.target_id AND q.sid = truth.s1_id) GROUP BY 1, 2""",
  *_P, "qpost AS (" + S.POSTINGS.removeprefix("post AS (").replace("id AS target_id FROM t", "id FROM s")))(
    lambda spark, sf: ME.channel_membership(T.truth_of_documents(spark, sf), B.postings(sides(spark, sf)[0]), posted(spark, sf))
)


def _faulty_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The truth, with unknown targets for every seventh document and the record itself for every eleventh."""
    d = T.records_of_documents(spark, sf).where("k = 0").select(F.col("id").alias("s1_id"), "doc_id")
    odd = F.filter(F.array(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("S2-x"), "doc_id")), F.when(F.col("doc_id") % 11 == 0, F.col("s1_id"))), lambda x: x.isNotNull())
    return T.truth_of_documents(spark, sf).unionByName(d.select("s1_id", F.explode(odd).alias("target_id")))


_faulty_sql = """
ft AS (SELECT s1_id, target_id FROM truth UNION ALL SELECT id, 'S2-x' || doc_id FROM s WHERE doc_id % 7 = 0 UNION ALL SELECT id, id FROM s WHERE doc_id % 11 = 0),
fn AS (SELECT s.id, (SELECT count(*) FROM ft WHERE ft.s1_id = s.id) AS n_truth FROM s)"""
query("profile_ground_truth", S.sql("""SELECT count(*) AS records, count(*) FILTER (n_truth = 0) AS singletons, round(avg(n_truth), 6) AS mean, (list_sort(list(n_truth)))[count(*) // 2 + 1] AS median, max(n_truth) AS most,
  (SELECT count(*) FROM ft WHERE target_id NOT IN (SELECT id FROM t)) AS orphans, (SELECT count(*) FROM ft WHERE NOT regexp_matches(target_id, '^S[23]-')) AS wrong_prefix, (SELECT count(*) FROM ft WHERE target_id = s1_id) AS self_matches FROM fn""", *_P, _faulty_sql))(
    lambda spark, sf: _rounded(ME.profile_truth(ids(spark, sf), _faulty_truth(spark, sf), sides(spark, sf)[1]))
)
query("stratified_split", S.sql("""SELECT s1_id AS id, country || '/' || CASE WHEN n_truth <= 3 THEN CAST(n_truth AS VARCHAR) WHEN n_truth <= 6 THEN '4-6' ELSE '7+' END AS stratum,
  CASE WHEN pl < 60 THEN 'train' WHEN pl < 80 THEN 'dev' WHEN pl < 95 THEN 'holdout' ELSE 'rest' END AS part FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY country, CASE WHEN n_truth <= 3 THEN CAST(n_truth AS VARCHAR) WHEN n_truth <= 6 THEN '4-6' ELSE '7+' END ORDER BY md5('split-1:' || s1_id), s1_id) - 1 AS DOUBLE) * 100
    / count(*) OVER (PARTITION BY country, CASE WHEN n_truth <= 3 THEN CAST(n_truth AS VARCHAR) WHEN n_truth <= 6 THEN '4-6' ELSE '7+' END) AS pl FROM rec)""", *_P, _CANDS))(
    lambda spark, sf: ME.stratified_split(_records(spark, sf, True).withColumnRenamed("s1_id", "id"), {"train": 60, "dev": 20, "holdout": 15})
)
_bucket = "CASE WHEN n_truth <= 3 THEN CAST(n_truth AS VARCHAR) WHEN n_truth <= 6 THEN '4-6' ELSE '7+' END"
_place = lambda seed: f"(SELECT s1_id AS id, CAST(row_number() OVER (PARTITION BY country, {_bucket} ORDER BY md5('{seed}:' || s1_id), s1_id) - 1 AS DOUBLE) * 100 / count(*) OVER (PARTITION BY country, {_bucket}) AS pl FROM rec)"
# The parts of one split are disjoint; those of two seeds are not, so this finds something.
query("split_disjoint", S.sql(f"SELECT id FROM {_place('split-1')} WHERE pl < 60 AND id IN (SELECT id FROM {_place('split-2')} WHERE pl >= 60 AND pl < 80)", *_P, _CANDS))(lambda spark, sf: split_overlap(spark, sf))


def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf, True).withColumnRenamed("s1_id", "id")
    one, two = (ME.stratified_split(r, {"train": 60, "dev": 20, "holdout": 15}, seed) for seed in ("split-1", "split-2"))
    return V.overlap(one.where("part = 'train'").unionByName(two.where("part = 'dev'")), "train", "dev")



_sets = f"* EXCLUDE (id), list_distinct(core) AS dc, list_distinct(awords) AS da, {S.gram_set('norm_name', 2)} AS g2, {S.gram_set('norm_name', 3)} AS g3, {S.gram_set('norm_name', 4)} AS g4, {S.gram_set('norm_addr', 3)} AS ag3"
_sets_of = lambda x="", y="": f"x AS MATERIALIZED (SELECT id AS s1_id, {_sets}{x} FROM s),\ny AS MATERIALIZED (SELECT id AS target_id, {_sets}{y} FROM t)"
_SETS = _sets_of()
_key_sql = "SELECT s1_id, target_id, {} FROM cand JOIN x USING (s1_id) JOIN y USING (target_id)"


def pairs(spark: SparkSession, sf: str, names: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """All candidates with their records; with ``fields`` only those, straight from the documents."""
    return FE.paired(ranked(spark, sf), *(sides if fields is None else lean_sides)(spark, sf), names, fields)


def _features(name: str, columns: dict[str, str], fields: list[str] | None = None, sets: str = _SETS) -> None:
    oracle = S.sql(_key_sql.format(", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {c}" for c, sql in columns.items())), *_P, sets)
    query(name, oracle)(lambda spark, sf: _rounded(pairs(spark, sf, list(columns), fields).withColumns({c: f for c, f in {**FE.base_columns(), **FE.extra_columns()}.items() if c in columns}).select("s1_id", "target_id", *columns)))


_c1, _c2, _w1, _w2 = "x.dc", "y.dc", "x.da", "y.da"
_d1, _d2 = "list_distinct(x.own_runs)", f"list_distinct({S.whole_numbers('y.norm_addr')})"
_there = lambda x: f"CASE WHEN y.norm_addr = '' THEN 0 ELSE {x} END"
_contain = lambda a, b: f"CASE WHEN least(len({a}), len({b})) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) ELSE 0 END"
_gap = lambda a, b: f"CAST(abs(length({a}) - length({b})) AS DOUBLE) / greatest(length({a}), length({b}), 1)"
_features("feat_arrays", {
    "name_jaccard": S.jaccard(_c1, _c2), "name_ngram_jaccard": S.jaccard("x.g3", "y.g3"), "addr_jaccard": _there(S.jaccard(_w1, _w2)), "num_overlap": _there(S.jaccard(_d1, _d2)),
    "has_matching_digits": _there(f"CASE WHEN len(list_intersect({_d1}, {_d2})) > 0 THEN 1 ELSE 0 END"), "addr_token_containment": _there(_contain(_w1, _w2)),
    "char2_jaccard": S.jaccard("x.g2", "y.g2"), "char4_jaccard": S.jaccard("x.g4", "y.g4"),
    "name_containment": _contain(_c1, _c2), "shared_sig_count": f"len(list_intersect({_c1}, {_c2}))", "shared_sig_ratio": f"CAST(len(list_intersect({_c1}, {_c2})) AS DOUBLE) / greatest(1, len({_c1}), len({_c2}))",
    "tokcount_diff": f"CAST(abs(len({_c1}) - len({_c2})) AS DOUBLE) / greatest(1, len({_c1}) + len({_c2}))",
    "addr_char3_jaccard": f"CASE WHEN x.norm_addr <> '' AND y.norm_addr <> '' THEN {S.jaccard("x.ag3", "y.ag3")} ELSE 0 END",
    "addr_coverage": f"CASE WHEN len({_w1}) > 0 THEN CAST(len(list_intersect({_w1}, {_w2})) AS DOUBLE) / len({_w1}) ELSE 0 END",
})
_i1, _i2 = S.initials("x.core"), S.initials("y.core")
_has = lambda *c: "CASE WHEN " + " OR ".join(f"list_contains(channels, '{x}')" for x in c) + " THEN 1 ELSE 0 END"
_family = "CASE WHEN c IN ('exact','token','prefix','acronym','ngram') THEN 'name' WHEN c IN ('tr_name','tr_tok') THEN 'trlit' WHEN c IN ('addr','addr_tok') THEN 'addr' WHEN c = 'tokpost' THEN 'mix' ELSE c END"
# Phones of the raw address and of the normalised one; a target's raw address counts if it isn't plain ASCII.
_foreign = r"CASE WHEN regexp_matches(addr, '[^\x00-\x7F]') THEN addr ELSE '' END"
_numbers = lambda raw: f"list_concat({S.all_phones(raw)}, {S.all_phones('norm_addr')})"
_features("feat_flags", {
    "name_exact": "CASE WHEN x.norm_name = y.norm_name AND x.norm_name <> '' THEN 1 ELSE 0 END", "addr_missing": "CASE WHEN y.norm_addr = '' THEN 1 ELSE 0 END", "is_s2": "CASE WHEN y.k = 1 THEN 1 ELSE 0 END",
    "name_acronym_match": f"CASE WHEN ({_i1} <> '' AND (y.norm_name = {_i1} OR {_i1} = {_i2})) OR ({_i2} <> '' AND x.norm_name = {_i2}) THEN 1 ELSE 0 END",
    "street_num_exact_match": _there(f"CASE WHEN coalesce(({S._sized('x.own_runs', 1, 5)})[1], '') <> '' AND ({S._sized('x.own_runs', 1, 5)})[1] = ({S._sized(S.whole_numbers('y.norm_addr'), 1, 5)})[1] THEN 1 ELSE 0 END"),
    "name_first_token_match": "CASE WHEN x.core[1] = y.core[1] THEN 1 ELSE 0 END", "is_top1_candidate": "CASE WHEN rank = 0 THEN 1 ELSE 0 END",
    "phone_agree": "CASE WHEN len(list_intersect(x.phones, y.phones)) > 0 THEN 1 ELSE 0 END",
    "agree_count": "len(channels)", "family_count": f"len(list_distinct(list_transform(channels, lambda c: {_family})))", "has_tr_chan": _has("tr_name", "tr_tok"), "has_phon_chan": _has("phon"), "has_phone_chan": _has("phone"),
    "ngram_only": "CASE WHEN array_to_string(channels, ',') = 'ngram' THEN 1 ELSE 0 END",
}, ["norm_name", "addr_size", "core", "street_num", "is_s2"], _sets_of(f", {_numbers('addr')} AS phones", f", {_numbers(_foreign)} AS phones"))
_features("feat_numeric", {
    "name_len_diff": _gap("x.norm_name", "y.norm_name"), "addr_len_diff": f"CASE WHEN y.norm_addr = '' THEN 1 ELSE {_gap('x.norm_addr', 'y.norm_addr')} END", "score_rank_in_candidate_pool": "rank", "raw_blocking_weight": "weight",
    "blocking_weight_ratio": "weight / greatest(1e-5, max(weight) OVER (PARTITION BY s1_id))", "gap_to_top": "greatest(0, 1 - weight / greatest(1e-5, max(weight) OVER (PARTITION BY s1_id)))",
    "w_zscore": "(weight - avg(weight) OVER (PARTITION BY s1_id)) / greatest(1e-5, CASE WHEN count(*) OVER (PARTITION BY s1_id) > 1 THEN stddev_pop(weight) OVER (PARTITION BY s1_id) ELSE 1 END)",
}, ["norm_name", "addr_size"])
# The oracle compares bytes, so the one letter beyond ASCII is replaced on both sides.
query("feat_jaro_winkler", S.sql(_key_sql.format("round(jaro_winkler_similarity(translate(x.norm_name, 'ß', 'z'), translate(y.norm_name, 'ß', 'z')), 6) AS name_jaro_winkler"), *_P, _SETS))(
    lambda spark, sf: pairs(spark, sf, [], ["norm_name"]).select("s1_id", "target_id", F.round(fuzzy.jaro_winkler_udf(F.translate("x.norm_name", "ß", "z"), F.translate("y.norm_name", "ß", "z")), 6).alias("name_jaro_winkler"))
)
query("feat_fuzzy")(lambda spark, sf: pairs(spark, sf).select("s1_id", "target_id", fuzzy.fuzzy_features(F.col("x.norm_name"), F.col("y.norm_name"), F.col("x.norm_addr"), F.col("y.norm_addr")).alias("f")).select("s1_id", "target_id", "f.*"))
query("all_features")(lambda spark, sf: FE.all_features(pairs(spark, sf)).withColumn("channels", F.array_join("channels", ",")))

_link = "SELECT s1_id, target_id, p FROM linked WHERE accepted"
query("decision_two_stage", S.sql(_link, *_P))(lambda spark, sf: links(spark, sf).where("accepted").select("s1_id", "target_id", "p"))
query("decision_threshold", S.sql("SELECT s1_id, target_id, p FROM cand WHERE p >= 0.65", *_P))(lambda spark, sf: D.threshold(probable(spark, sf), 0.65).where("accepted").select("s1_id", "target_id", "p"))
query("decision_secondary", S.sql("SELECT s1_id, target_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, target_id) AS pl FROM linked) WHERE accepted AND (pl = 1 OR list_contains(channels, 'exact'))", *_P))(
    lambda spark, sf: D.secondary(probable(spark, sf), F.array_contains("channels", "exact")).where("accepted").select("s1_id", "target_id", "p")
)
_GATES, _FLOORS, _MARGINS = (0.6, 0.8), (0.3, 0.4), (0.05, 0.1, 0.2)
_grid = f"""
grid AS (SELECT * FROM (SELECT unnest([0.6::DOUBLE, 0.8::DOUBLE]) AS gate), (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE]) AS floor), (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS margin)),
nt AS (SELECT id AS s1_id, (SELECT count(*) FROM truth WHERE truth.s1_id = s.id) AS n_truth FROM s),
ok AS (SELECT gate, floor, margin, c.s1_id, count(*) AS n_pred, count(truth.target_id) AS tp FROM (SELECT *, max(p) OVER (PARTITION BY s1_id) AS best FROM cand) c CROSS JOIN grid LEFT JOIN truth USING (s1_id, target_id) WHERE best >= gate AND p >= greatest(floor, best - margin) GROUP BY ALL),
res AS (SELECT gate, floor, margin, round(avg({S.F05}), 6) AS macro_f05 FROM (SELECT g.*, nt.s1_id, n_truth, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM grid g CROSS JOIN nt LEFT JOIN ok USING (gate, floor, margin, s1_id)) GROUP BY ALL)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(D.grid_search(probable(spark, sf), T.truth_of_documents(spark, sf), ids(spark, sf), _GATES, _FLOORS, _MARGINS))


query("threshold_grid", S.sql("SELECT * FROM res", *_P, _grid))(grid)
query("best_thresholds", S.sql("SELECT * FROM res ORDER BY macro_f05 DESC, gate, floor, margin LIMIT 1", *_P, _grid))(lambda spark, sf: D.best_thresholds(grid(spark, sf)))
query("threshold_sweep_1d", S.sql("SELECT gate, macro_f05 FROM res", *_P, _grid.replace("[0.6::DOUBLE, 0.8::DOUBLE]", "[0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]").replace("[0.3::DOUBLE, 0.4::DOUBLE]", "[0.0::DOUBLE]").replace("[0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]", "[0.1::DOUBLE]")))(
    lambda spark, sf: _rounded(D.grid_search(probable(spark, sf), T.truth_of_documents(spark, sf), ids(spark, sf), (0.5, 0.7, 0.9), (0.0,), (0.1,))).select("gate", "macro_f05")
)
_own = """
own AS (SELECT target_id, s1_id, p, CASE WHEN p < 0.5 THEN 'probability' WHEN nx IS NOT NULL AND p - nx < 0.05 THEN 'margin' END AS reason
  FROM (SELECT *, row_number() OVER w AS pl, lead(p) OVER w AS nx FROM (SELECT * FROM linked WHERE accepted) WINDOW w AS (PARTITION BY target_id ORDER BY p DESC, s1_id)) WHERE pl = 1)"""
query("select_owner", S.sql("SELECT * FROM own", *_P, _own))(lambda spark, sf: D.select_owner(links(spark, sf).where("accepted"), 0.5, 0.05))
_OWNED = S.sql("SELECT s.id AS s1_id, coalesce(o.ids, '') AS ids FROM s LEFT JOIN (SELECT s1_id, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM own WHERE reason IS NULL GROUP BY 1) o ON o.s1_id = s.id", *_P, _own)
query("resolve_ownership", _OWNED)(lambda spark, sf: D.resolve_ownership(ids(spark, sf), links(spark, sf).where("accepted"), 0.5, 0.05))
query("assign_ownership", S.sql("SELECT s1_id, target_id, p FROM (SELECT *, row_number() OVER w AS pl, lead(p) OVER w AS nx FROM linked WINDOW w AS (PARTITION BY target_id ORDER BY p DESC, s1_id)) WHERE pl = 1 AND accepted AND (nx IS NULL OR p - nx >= 0.05)", *_P))(lambda spark, sf: D.owners_of_all(links(spark, sf), 0.05))
query("assert_global_unique", S.sql("SELECT target_id, count(*) AS n FROM linked WHERE accepted GROUP BY 1 HAVING count(*) > 1", *_P))(lambda spark, sf: D.not_unique(links(spark, sf).where("accepted")))


def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    return T.id_lists(ids(spark, sf).select("s1_id"), links(spark, sf).where("accepted"), order="rank")


query("sink_id_lists", S.sql("SELECT s.id AS s1_id, coalesce(l.ids, '') AS ids FROM s LEFT JOIN (SELECT s1_id, string_agg(target_id, ',' ORDER BY rank) AS ids FROM linked WHERE accepted GROUP BY 1) l ON l.s1_id = s.id", *_P))(id_lists)
query("sink_scores", S.sql("SELECT target_id, s1_id AS candidate_s1_id, p AS model_probability, round(weight, 6) AS retrieval_score, CAST(rank + 1 AS INTEGER) AS candidate_rank FROM linked WHERE accepted", *_P))(lambda spark, sf: _rounded(T.accepted_scores(links(spark, sf))))
query("output_summary", S.sql("SELECT count(*) FILTER (n_pred > 0) AS matched, count(*) FILTER (n_pred = 0) AS singletons, CAST(sum(n_pred) AS BIGINT) AS links, round(CAST(sum(n_pred) AS DOUBLE) / greatest(1, count(*) FILTER (n_pred > 0)), 6) AS links_per_matched FROM rec", *_P, _LINKS))(lambda spark, sf: _rounded(ME.output_summary(id_lists(spark, sf))))
query("error_taxonomy", S.sql("""SELECT kind, reason, count(*) AS n FROM (
  SELECT 'FN' AS kind, CASE WHEN l.p IS NULL THEN 'never_retrieved' WHEN b.best >= 0.76 AND l.p >= 0.45 THEN 'margin' ELSE 'rejected' END AS reason FROM truth LEFT JOIN linked l USING (s1_id, target_id) LEFT JOIN (SELECT s1_id, max(p) AS best FROM cand GROUP BY 1) b USING (s1_id) WHERE l.accepted IS NULL OR NOT l.accepted
  UNION ALL SELECT 'FP', CASE WHEN EXISTS (SELECT 1 FROM truth x WHERE x.s1_id = l.s1_id) THEN 'multi_match_excess' ELSE 'singleton_alarm' END FROM linked l ANTI JOIN truth USING (s1_id, target_id) WHERE accepted) GROUP BY ALL""", *_P))(
    lambda spark, sf: ME.error_taxonomy(T.truth_of_documents(spark, sf), links(spark, sf))
)
query("fp_breakdown", S.sql("""SELECT count(*) FILTER (NOT known) AS on_singletons, count(*) FILTER (known) AS on_matched FROM (SELECT EXISTS (SELECT 1 FROM truth x WHERE x.s1_id = l.s1_id) AS known FROM linked l ANTI JOIN truth USING (s1_id, target_id) WHERE accepted)""", *_P))(
    lambda spark, sf: ME.fp_breakdown(T.truth_of_documents(spark, sf), links(spark, sf).where("accepted").select("s1_id", "target_id"))
)
_indic = lambda c: rf"regexp_matches({c}, '[\x{{0900}}-\x{{0D7F}}]')"
_url = lambda c: rf"regexp_matches({c}, '(?i)(@|\.com|\.in|\.org|\.net|www\.)')"
_CAUSES = f"""
top AS (SELECT * FROM rk WHERE rank < 1),
busy AS (SELECT country, w FROM (SELECT country, unnest(list_distinct(core)) AS w FROM t) GROUP BY ALL HAVING count(*) > 3000),
worn AS (SELECT DISTINCT s1_id FROM (SELECT id AS s1_id, country, unnest(core) AS w FROM s) SEMI JOIN busy USING (country, w)),
cause AS (
  SELECT CASE WHEN y.id IS NULL THEN 'target_not_in_pool' WHEN EXISTS (SELECT 1 FROM top WHERE top.s1_id = m.s1_id) THEN 'candidate_cap_truncation' WHEN y.addr = '' THEN 'missing_address_in_target'
    WHEN {_indic("x.name")} <> {_indic("y.name")} THEN 'indic_script_mismatch' WHEN {_url("x.name")} <> {_url("y.name")} THEN 'url_domain_handle_mismatch' WHEN m.s1_id IN (SELECT s1_id FROM worn) THEN 'high_frequency_token_pruned'
    WHEN len(x.own_runs) > 0 AND len(y.own_runs) > 0 AND len(list_intersect(x.own_runs, y.own_runs)) = 0 THEN 'numeric_address_mismatch' WHEN len(list_intersect(x.core, y.core)) = 0 THEN 'name_token_mismatch' ELSE 'compound_address_failure' END AS cause
  FROM (SELECT truth.* FROM truth ANTI JOIN top USING (s1_id, target_id)) m JOIN s x ON x.id = m.s1_id LEFT JOIN t y ON y.id = m.target_id)"""
query("miss_taxonomy", S.sql("SELECT cause, count(*) AS n FROM cause GROUP BY cause", *_P, _CAUSES))(lambda spark, sf: ME.miss_taxonomy(T.truth_of_documents(spark, sf), *sides(spark, sf), ranked(spark, sf, 1), 1))
query("learn_token_mapping", S.sql("""SELECT variant, canonical, n FROM (SELECT variant, canonical, n, sum(n) OVER v AS total, max(n) OVER v AS best, count(*) OVER (PARTITION BY variant, n) AS ties FROM (
  SELECT a AS variant, b AS canonical, count(*) AS n FROM (SELECT unnest(x.core) AS a, unnest(y.core) AS b FROM cand JOIN s x ON x.id = s1_id JOIN t y ON y.id = target_id WHERE len(x.core) = len(y.core))
  WHERE regexp_matches(a, '^[\\x00-\\x7F]{3,}$') AND regexp_matches(b, '^[\\x00-\\x7F]{3,}$') GROUP BY 1, 2) WINDOW v AS (PARTITION BY variant)) WHERE n = best AND ties = 1 AND n >= 2 AND CAST(n AS DOUBLE) / total >= 0.4 AND variant <> canonical""".replace("\\\\", "\\"), *_P))(
    lambda spark, sf: ME.learn_token_mapping(pairs(spark, sf).select(F.col("x.core").alias("a"), F.col("y.core").alias("b")), 2, 0.4)
)
query("reverse_variants", S.sql("SELECT core[1] AS canonical, string_agg(DISTINCT core[2], ',' ORDER BY core[2]) AS variants FROM n WHERE len(core) >= 2 GROUP BY 1", S.RECORDS))(lambda spark, sf: ME.reverse_variants(records(spark, sf).where("size(core) >= 2").select(F.element_at("core", 1).alias("canonical"), F.element_at("core", 2).alias("variant"))))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """Result lists with planted faults: every seventh row repeats an id, every eleventh names an unknown one."""
    i = F.substring_index("s1_id", "-", -1).cast("long")
    base = once("lists", lambda: id_lists(spark, sf))
    return base.withColumn("ids", F.when(i % 7 == 0, "S2-1,S2-1").when(i % 11 == 0, F.concat(F.lit("S2-x"), i.cast("string"))).otherwise(F.col("ids")))


_broken_sql = """
res AS (SELECT s.id AS s1_id, CASE WHEN s.doc_id % 7 = 0 THEN 'S2-1,S2-1' WHEN s.doc_id % 11 = 0 THEN 'S2-x' || s.doc_id ELSE coalesce(l.ids, '') END AS ids FROM s LEFT JOIN (SELECT s1_id, string_agg(target_id, ',' ORDER BY rank) AS ids FROM linked WHERE accepted GROUP BY 1) l ON l.s1_id = s.id),
ex AS (SELECT s1_id, unnest(string_split(ids, ',')) AS target_id FROM res WHERE ids <> '')"""
_five = lambda x: f"coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT v FROM ({x}) ORDER BY v LIMIT 5)), '')"
_rule = lambda name, x: f"SELECT '{name}' AS rule, (SELECT count(*) FROM ({x})) AS n, {_five(x)} AS samples"
_findings = " UNION ALL ".join([
    _rule("duplicate_row", "SELECT s1_id AS v FROM res GROUP BY s1_id HAVING count(*) > 1"), _rule("duplicate_in_list", "SELECT target_id AS v FROM ex GROUP BY s1_id, target_id HAVING count(*) > 1"),
    _rule("empty_in_list", "SELECT s1_id AS v FROM ex WHERE target_id = ''"), _rule("self_match", "SELECT s1_id AS v FROM ex WHERE s1_id = target_id"), _rule("bad_prefix", "SELECT target_id AS v FROM ex WHERE NOT regexp_matches(target_id, '^S[23]-')"),
    _rule("unknown_id", "SELECT target_id AS v FROM ex WHERE target_id NOT IN (SELECT id FROM t)"), _rule("missing_s1", "SELECT id AS v FROM s WHERE id NOT IN (SELECT s1_id FROM res)"), _rule("extra_s1", "SELECT s1_id AS v FROM res WHERE s1_id NOT IN (SELECT id FROM s)"),
])
query("validate_submission", S.sql(_findings, *_P, _broken_sql))(lambda spark, sf: V.validate(_broken(spark, sf), ids(spark, sf).select("s1_id"), sides(spark, sf)[1]))
query("subset_check", S.sql("SELECT s1_id, target_id FROM ex ANTI JOIN cand USING (s1_id, target_id)", *_P, _broken_sql))(
    lambda spark, sf: V.not_in_candidates(_broken(spark, sf), T.id_lists(ids(spark, sf).select("s1_id"), ranked(spark, sf), order="rank"))
)


@query("validate_fast", S.sql(_findings + " UNION ALL " + _rule("order", "SELECT coalesce(m.s1_id, o.id) AS v FROM (SELECT doc_id AS seq, id FROM s) o FULL OUTER JOIN (SELECT CAST(substr(s1_id, 4) AS BIGINT) + CASE CAST(substr(s1_id, 4) AS BIGINT) // 3 % 10 WHEN 4 THEN 3 WHEN 5 THEN -3 ELSE 0 END AS seq, s1_id FROM res) m USING (seq) WHERE o.id IS DISTINCT FROM m.s1_id") + " UNION ALL " + _rule("not_in_candidates", "SELECT target_id AS v FROM ex ANTI JOIN cand USING (s1_id, target_id)"), *_P, _broken_sql))
def validate_fast(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.substring_index("s1_id", "-", -1).cast("long").alias("seq")
    s1 = ids(spark, sf).select("s1_id", seq)
    lists = T.id_lists(s1.select("s1_id"), ranked(spark, sf), order="rank")
    # Two neighbours in ten change places.
    turn = F.col("seq") + F.when(F.floor(F.col("seq") / 3) % 10 == 4, 3).when(F.floor(F.col("seq") / 3) % 10 == 5, -3).otherwise(0)
    return V.validate_strictly(_broken(spark, sf).select("*", seq).withColumn("seq", turn), lists, s1, sides(spark, sf)[1])


query("training_pairs", S.sql("SELECT s1_id, target_id, CASE WHEN truth.target_id IS NULL THEN 0 ELSE 1 END AS is_match FROM cand LEFT JOIN truth USING (s1_id, target_id) UNION ALL SELECT s1_id, target_id, 1 FROM truth ANTI JOIN cand USING (s1_id, target_id)", *_P))(
    lambda spark, sf: M.training_pairs(ranked(spark, sf), T.truth_of_documents(spark, sf), lean_sides(spark, sf)[1]).select("s1_id", "target_id", "is_match")
)
query("hard_negatives", S.sql("SELECT s1_id, target_id, is_match FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, is_match ORDER BY round(weight, 6) DESC, target_id) AS r FROM (SELECT cand.*, CASE WHEN truth.target_id IS NULL THEN 0 ELSE 1 END AS is_match FROM cand LEFT JOIN truth USING (s1_id, target_id))) WHERE is_match = 1 OR r <= 5", *_P))(
    lambda spark, sf: M.hard_negatives(M.training_pairs(ranked(spark, sf), T.truth_of_documents(spark, sf), lean_sides(spark, sf)[1], False), 5).select("s1_id", "target_id", "is_match")
)


def sounded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = once("sounded", lambda: phonetic.with_sounds(records(spark, sf)))
    return r.where("k = 0"), r.where("k > 0").withColumn("is_s2", (F.col("k") == 1).cast("int"))


WITH_SOUNDS = B.FULL
query("metaphone_primary")(lambda spark, sf: records(spark, sf).select(F.explode("core").alias("token")).distinct().select("token", phonetic.metaphone(F.col("token")).alias("code")))
query("transliterate")(lambda spark, sf: records(spark, sf).select("id", phonetic.clean_transliteration(F.col("name")).alias("latin")))
query("join_phon")(lambda spark, sf: B.top_k(B.retrieve(*sounded(spark, sf), B.Profile(channels=("phon",), limits=WITH_SOUNDS.limits, many_phonetic=20.0)), WITH_SOUNDS.budget).select("s1_id", "target_id", "weight", "phon_hits"))
query("join_tr_name")(lambda spark, sf: B.retrieve(*sounded(spark, sf), B.Profile(channels=("exact", "token", "tr_name", "tr_tok"), limits=WITH_SOUNDS.limits)).select("s1_id", "target_id", "weight"))
for _c in ("tr_name", "tr_tok", "phon"):
    query(f"post_{_c}")(lambda spark, sf, c=_c: B.postings(sounded(spark, sf)[1], (c,)).select("country", "key", "target_id"))
query("join_tr_tok")(lambda spark, sf: B.retrieve(*sounded(spark, sf), B.Profile(channels=("token", "tr_tok"), limits=WITH_SOUNDS.limits, many_tokens=0.0)).select("s1_id", "target_id", "weight"))
query("bonus_multi_phon")(lambda spark, sf: B.retrieve(*sounded(spark, sf), B.Profile(channels=("phon",), limits=WITH_SOUNDS.limits, many_phonetic=20.0)).where("phon_hits >= 2").select("s1_id", "target_id", "weight", "phon_hits"))


@query("all_channels")
def all_channels(spark: SparkSession, sf: str) -> DataFrame:
    """The whole retrieval as an inference runs it: twelve channels, schwa variants, a budget a record, ranks by names and sounds."""
    s1, targets = sounded(spark, sf)
    p = once("all-postings", lambda: B.postings(targets, WITH_SOUNDS.channels))
    every = once("all-scored", lambda: B.retrieve(s1, targets, WITH_SOUNDS, p))
    return B.rerank(every, s1, targets, B.budgets(s1, every, p), WITH_SOUNDS).select("s1_id", "target_id", F.round("weight", 6).alias("weight"), "rank")


_schwa = "list_distinct(list_filter(list_transform(core, lambda t: CASE WHEN length(t) >= 3 AND t NOT LIKE '%a' THEN t || 'a' WHEN length(t) >= 4 THEN substr(t, 1, length(t) - 1) END), lambda t: t IS NOT NULL))"
# The names of the test tables hold no Indic letter, so every variant falls back to words; tests/test_jobs.py has both cases.
query("join_schwa", S.sql(f"SELECT a.s1_id, p.target_id, 3.0::DOUBLE * count(*) AS weight FROM (SELECT country, id AS s1_id, unnest({_schwa}) AS key FROM s) a JOIN stats ON stats.channel = 'token' AND stats.country = a.country AND stats.key = a.key JOIN post p ON p.channel = 'token' AND p.country = a.country AND p.key = a.key GROUP BY 1, 2", S.RECORDS, S.POSTINGS, S.STATS))(
    lambda spark, sf: join_schwa(spark, sf)
)


def join_schwa(spark: SparkSession, sf: str) -> DataFrame:
    s1, targets = sounded(spark, sf)
    profile = B.Profile(channels=("token", "tr_tok"), limits=WITH_SOUNDS.limits, schwa=True)
    p = B.postings(targets, profile.channels)
    asked = B.query_keys(s1, profile).where(F.col("rule").isin("schwa", "schwa_token"))
    found = B.hits(B.weighted_keys(asked, B.idf(B.key_counts(p), targets), profile), p)
    return found.groupBy("s1_id", "target_id").agg(F.sum("w").alias("weight"))


_text("address_views", {"norm": (lambda: F.col("norm_addr"), "norm_addr"), "translit": (lambda: phonetic.clean_transliteration(F.col("addr")), "''"), "compact": (lambda: X.compact_alnum(F.col("norm_addr")), "regexp_replace(lower(norm_addr), '[^a-z0-9]', '', 'g')"), "phones": (lambda: listed(X.phones(F.col("addr"))), _sorted(S.all_phones("addr")))})
query("name_views")(lambda spark, sf: phonetic.name_views(records(spark, sf)).select("id", "norm", "translit", *[F.array_join(c, " ").alias(c) for c in ("translit_tokens", "phonetic", "soundex")], "compact", "initials"))


def _hops(spark: SparkSession, sf: str) -> DataFrame:
    return once("hops", lambda: D.hops(links(spark, sf), sides(spark, sf)[1], posted(spark, sf), PROFILE))


@query("graph_bridge")
def graph_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Third-source records that resemble a sure second-source link, of which all links to the third source are held back.

    Name similarity stands in for a probability, so no model checks them here.
    """
    second = F.startswith(F.col("target_id"), F.lit("S2-"))
    return D.bridge(links(spark, sf).where(second), _hops(spark, sf))


@query("graph_bridge_features")
def graph_bridge_features(spark: SparkSession, sf: str) -> DataFrame:
    """The bridged pairs as the model sees them."""
    s1, targets = sides(spark, sf)
    return D.bridged_pairs(graph_bridge(spark, sf), _hops(spark, sf), s1, targets).drop("channels")


# Links and candidates of the sinks: half of the candidates are held back, so that something is missed.
_few = "few AS (SELECT * FROM linked WHERE rank % 2 = 0)"


def filed_but_grams(spark: SparkSession, sf: str) -> DataFrame:
    return filed(spark, sf).withColumn("filed", F.filter("filed", lambda x: x["channel"] != "ngram"))


def few(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).where("rank % 2 = 0")


query("sink_misses", S.sql("""SELECT m.s1_id, m.target_id, s.country, CASE WHEN m.target_id IN (SELECT id FROM t) THEN 'blocking_or_budget' ELSE 'target_absent' END AS reason, (SELECT count(*) FROM few WHERE few.s1_id = m.s1_id) AS candidate_count
  FROM (SELECT * FROM truth ANTI JOIN few USING (s1_id, target_id)) m JOIN s ON s.id = m.s1_id""", *_P, _few))(lambda spark, sf: ME.misses(ids(spark, sf), T.truth_of_documents(spark, sf), sides(spark, sf)[1], few(spark, sf)))
query("sink_score_distribution", S.sql("SELECT f.s1_id, f.target_id, s.country, CASE WHEN truth.s1_id IS NULL THEN 0 ELSE 1 END AS is_match, p AS score FROM few f JOIN s ON s.id = f.s1_id LEFT JOIN truth ON truth.s1_id = f.s1_id AND truth.target_id = f.target_id", *_P, _few))(lambda spark, sf: ME.score_distribution(ids(spark, sf), T.truth_of_documents(spark, sf), few(spark, sf)))
_top = "(SELECT *, max(p) OVER (PARTITION BY s1_id) AS best FROM linked)"
query("sink_false_positives", S.sql(f"SELECT l.s1_id, l.target_id, s.country, p AS score, best AS best_score FROM {_top} l JOIN s ON s.id = l.s1_id ANTI JOIN truth ON truth.s1_id = l.s1_id AND truth.target_id = l.target_id WHERE accepted", *_P))(lambda spark, sf: ME.false_positives(ids(spark, sf), T.truth_of_documents(spark, sf), links(spark, sf)))
# A gate and a margin strict enough to reject true pairs.
_strict = "strict AS (SELECT * EXCLUDE (accepted), max(p) OVER (PARTITION BY s1_id) AS best, p < 0.97 AND p > 0.5 AS accepted FROM linked)"
query("sink_false_negatives", S.sql("SELECT l.s1_id, l.target_id, s.country, p AS score, best AS best_score, CASE WHEN best < 0.8 THEN 'singleton_gate' ELSE 'threshold_or_margin' END AS reason FROM strict l JOIN s ON s.id = l.s1_id SEMI JOIN truth ON truth.s1_id = l.s1_id AND truth.target_id = l.target_id WHERE NOT accepted", *_P, _strict))(
    lambda spark, sf: ME.false_negatives(ids(spark, sf), T.truth_of_documents(spark, sf), links(spark, sf).withColumn("accepted", F.col("p").between(0.5, 0.97) & (F.col("p") > 0.5) & (F.col("p") < 0.97)), 0.8)
)
query("graph_recovery", S.sql("""SELECT s1_id, target_id, count(DISTINCT near) AS retrieved_true, count(DISTINCT CASE WHEN accepted THEN near END) AS accepted_true, coalesce(string_agg(DISTINCT channel, ',' ORDER BY channel), '') AS bridge_channels,
  coalesce(string_agg(DISTINCT CASE WHEN accepted THEN channel END, ',' ORDER BY CASE WHEN accepted THEN channel END), '') AS accepted_bridge_channels FROM (
  SELECT m.s1_id, m.target_id, h.near, h.accepted, b.channel FROM (SELECT * FROM truth ANTI JOIN few USING (s1_id, target_id)) m LEFT JOIN (SELECT s1_id, target_id AS near, accepted FROM few SEMI JOIN truth USING (s1_id, target_id)) h USING (s1_id)
  LEFT JOIN (SELECT DISTINCT a.target_id AS one, b.target_id AS two, channel FROM post a JOIN post b USING (country, channel, key) WHERE a.channel <> 'ngram' AND a.target_id IN (SELECT target_id FROM truth) AND b.target_id IN (SELECT target_id FROM truth)) b ON b.one = m.target_id AND b.two = h.near) GROUP BY 1, 2""", *_P, _few))(
    lambda spark, sf: ME.graph_recovery(T.truth_of_documents(spark, sf), few(spark, sf), filed_but_grams(spark, sf))
)
_RULES = f"""
rules AS (SELECT * FROM (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE]) AS least_p), (SELECT unnest([20.0::DOUBLE, 40.0::DOUBLE]) AS least_agreement)),
rl AS (
  SELECT DISTINCT least_p, least_agreement, s1_id, target_id FROM (
    SELECT least_p, least_agreement, s1_id, target_id FROM linked CROSS JOIN rules WHERE accepted
    UNION ALL SELECT least_p, least_agreement, s1_id, target_id FROM linked CROSS JOIN rules WHERE NOT accepted AND p >= least_p AND weight >= least_agreement)),
rc AS (SELECT least_p, least_agreement, rl.s1_id, count(*) AS n_pred, count(truth.target_id) AS tp FROM rl LEFT JOIN truth USING (s1_id, target_id) GROUP BY ALL),
nt AS (SELECT id AS s1_id, (SELECT count(*) FROM truth WHERE truth.s1_id = s.id) AS n_truth FROM s),
searched AS (SELECT least_p, least_agreement, round(avg({S.F05}), 6) AS macro_f05, round(CAST(sum(tp) AS DOUBLE) / greatest(1, sum(n_pred)), 6) AS "precision", round(CAST(sum(tp) AS DOUBLE) / greatest(1, sum(n_truth)), 6) AS recall
  FROM (SELECT r.*, nt.s1_id, n_truth, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM rules r CROSS JOIN nt LEFT JOIN rc USING (least_p, least_agreement, s1_id)) GROUP BY ALL)"""


def rule_search(spark: SparkSession, sf: str) -> DataFrame:
    """With retrieval weights as a stand-in for the agreement of a bridge."""
    l = links(spark, sf)  # noqa: E741
    return _rounded(D.rule_search(ids(spark, sf), T.truth_of_documents(spark, sf), l.where("accepted"), l.where("not accepted").withColumn("agreement", F.col("weight")), (0.5, 0.7), (20, 40)))


query("graph_rule_search", S.sql("SELECT * FROM searched", *_P, _RULES))(rule_search)


@query("graph_expand")
def graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    """More candidates by way of each record's two surest links."""
    found = _hops(spark, sf).select("via", "target_id", "weight")
    return D.expand(probable(spark, sf), found).withColumn("weight", F.round("weight", 6))


@query("gbt_scores")
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate, scored by a model of all features trained on the other half of the records, by a hash of the id."""
    names = [*FE.BASE, *FE.EXTRA]
    f = FE.all_features(pairs(spark, sf)).select("s1_id", "target_id", "weight", *names)
    f = f.join(T.truth_of_documents(spark, sf).withColumn("is_match", F.lit(1)), ["s1_id", "target_id"], "left").fillna(0, ["is_match"]).withColumn("half", X.hash_split(F.col("s1_id"))).persist()
    return M.cross_fit(f, names).select("s1_id", "target_id", F.round("p", 6).alias("p"))


@query("end_to_end")
def end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates, probabilities, decision, ownership: one list per record."""
    return D.resolve_ownership(ids(spark, sf), D.two_stage(gbt_scores(spark, sf), D.Thresholds(0.5, 0.4, 0.1)).where("accepted"))
