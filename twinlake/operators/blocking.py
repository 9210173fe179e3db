"""Blocking channels, key statistics, pruning and weighted retrieval.

Postings and query keys are long tables, each made by one projection and one explode. Key
counts meet the (small) query side first, so a frequent key is dropped before it is ever
joined with its postings: that is both the pruning rule and the cure for skew.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions import text as X

NAME_FAMILY = ("exact", "token", "concat", "prefix", "acronym", "tokpost", "tr_name", "tr_exact", "tr_tok", "tr_token", "schwa", "schwa_token", "phon")
ADDRESS_FAMILY = ("addr", "tokpost")
#: Channel under which a rule's hits are reported; the rest report under their own name.
REPORTED = {"concat": "token", "tr_exact": "tr_name", "tr_token": "tr_tok", "schwa": "tr_tok", "schwa_token": "token"}
# Weights, limits and budgets of the retrieval rules.
WEIGHTS = {"exact": 15.0, "token": 3.0, "concat": 15.0, "prefix": 1.0, "acronym": 8.0, "tokpost": 7.0, "tr_name": 12.0, "tr_exact": 12.0, "tr_tok": 4.0, "tr_token": 3.0, "schwa": 3.0, "schwa_token": 3.0, "phon": 2.0, "phone": 9.0}
DISK_LIMITS = {"token": 40000, "prefix": 12000, "addr": 12000, "addr_tok": 10000, "acronym": 12000, "tokpost": 12000, "ngram": 1500, "tr_name": 8000, "tr_tok": 8000, "phon": 8000}
MEMORY_LIMITS = DISK_LIMITS | {"token": 12000, "addr_tok": 3000}
BUDGETS = {"easy": 60, "medium": 150, "hard": 250}
# End of fixed values.


@dataclass(frozen=True)
class Profile:
    """Which rules a retrieval uses, their weights and limits."""

    channels: tuple[str, ...] = ("exact", "token", "prefix", "addr", "addr_tok", "acronym", "tokpost", "ngram", "phone")
    limits: dict[str, int] = field(default_factory=lambda: dict(DISK_LIMITS))
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    wider_addresses: bool = True
    dropped_suffixes: bool = True
    cross_field: float = 20.0
    many_tokens: float = 25.0
    #: Ask for words with a last ``a`` more or less, too: among transliterated words, else among words.
    schwa: bool = False
    #: Compare transliterated names and sounds, too, when candidates are ranked again.
    rank_by_sounds: bool = False
    many_phonetic: float = 0.0
    addr_weight: float | None = None
    rarest_words: int = 6
    rarest_grams: int = 8
    boost: float = 8.0
    depth: int = 1500
    budget: int = 60


PROD = Profile()
#: All twelve channels with schwa variants, as an inference over files uses them.
FULL = Profile(channels=(*PROD.channels, "tr_name", "tr_tok", "phon"), schwa=True, rank_by_sounds=True)
MEM = Profile(limits=dict(MEMORY_LIMITS), wider_addresses=False, dropped_suffixes=False, cross_field=0.0, many_phonetic=20.0)
BASELINE = Profile(channels=("token", "prefix", "addr"), limits={"token": 3000, "prefix": 3000, "addr": 3000}, wider_addresses=False, cross_field=0.0, many_tokens=0.0, addr_weight=4.0, budget=25)
MULTI_PASS = Profile(channels=("exact", "token", "prefix", "addr"), limits={"token": 4000, "prefix": 4000, "addr": 150}, weights=WEIGHTS | {"exact": 10.0}, wider_addresses=False, dropped_suffixes=False, cross_field=0.0, many_tokens=0.0, addr_weight=6.0, budget=35)


def _at_least(words: Column, n: int) -> Column:
    return F.filter(words, lambda t: F.char_length(t) >= n)


def _post_key(core: Column, prefixes: Column) -> Column:
    return F.when(F.size(core) > 0, F.transform(prefixes, lambda p: F.concat(F.try_element_at(core, F.lit(1)), F.lit("|"), p))).otherwise(F.array().cast("array<string>"))


def schwa_keys(core: Column) -> Column:
    """The words of a name with a last ``a`` more or less."""
    return F.array_distinct(F.filter(F.transform(core, X.schwa_variant), lambda t: t.isNotNull()))


#: The parts of address keys, made once a record.
PARTS = ("addr_runs", "addr_places")


def _with_parts(records: DataFrame) -> DataFrame:
    return records.withColumns(dict(zip(PARTS, X.address_parts(F.col("addr"), F.col("norm_addr")), strict=True)))


def target_keys(channel: str) -> Column:
    """The keys under which a prepared target, with its ``PARTS``, is filed in a channel."""
    norm, core, addr, norm_addr = F.col("norm_name"), F.col("core"), F.col("addr"), F.col("norm_addr")
    size, none = F.char_length(norm), F.array().cast("array<string>")
    return {
        "exact": lambda: F.when(size >= 3, F.array(norm)).otherwise(none),
        "token": lambda: F.array_distinct(_at_least(core, 3)),
        "prefix": lambda: F.when(size >= 4, F.array(F.substring(norm, 1, 4))).otherwise(none),
        "addr": lambda: X.address_keys(addr, norm_addr, (F.col(PARTS[0]), F.col(PARTS[1]))),
        "addr_tok": lambda: F.filter(F.col("addr_words"), lambda t: (F.char_length(t) >= 4) & ~F.rlike(t, F.lit(r"^\p{Nd}+$"))),
        "acronym": lambda: X.acronyms(norm, core),
        "tokpost": lambda: _post_key(core, X.postal_prefixes(addr, norm_addr)),
        "ngram": lambda: F.when(size >= 3, X.ngrams(norm, 3)).otherwise(none),
        "phone": lambda: X.phones(addr),
        "tr_name": lambda: F.when(F.char_length("tr_name") >= 3, F.array("tr_name")).otherwise(none),
        "tr_tok": lambda: F.array_distinct(_at_least(X.tokens(F.col("tr_name")), 3)),
        "phon": lambda: F.col("phon_index"),
    }[channel]()


def filed(targets: DataFrame, channels: tuple[str, ...] = PROD.channels) -> DataFrame:
    """(country, target_id, filed): a row a prepared target, with all its (channel, key)."""
    own = lambda c: F.transform(target_keys(c), lambda k: F.struct(F.lit(c).alias("channel"), k.alias("key")))
    return (_with_parts(targets) if "addr" in channels else targets).select("country", F.col("id").alias("target_id"), F.flatten(F.array(*map(own, channels))).alias("filed"))


def unfolded(rows: DataFrame) -> DataFrame:
    """(country, channel, key, target_id) of filed targets."""
    return rows.select("country", F.explode("filed").alias("x"), "target_id").select("country", "x.channel", "x.key", "target_id")


def postings(targets: DataFrame, channels: tuple[str, ...] = PROD.channels) -> DataFrame:
    """(country, channel, key, target_id) of prepared targets."""
    return unfolded(filed(targets, channels))


def key_counts(posted: DataFrame) -> DataFrame:
    return posted.groupBy("country", "channel", "key").agg(F.count("*").alias("n"))


def within_limits(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return counts.where(F.coalesce(F.col("n") <= F.try_element_at(limit, F.col("channel")), F.lit(True)))


def prune(posted: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Postings without those of too frequent keys."""
    return posted.join(within_limits(key_counts(posted), limits).drop("n"), ["country", "channel", "key"], "left_semi")


def idf(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts with ``idf``: the selectivity weight of address keys, address words and trigrams."""
    total = targets.groupBy("country").agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    raw = F.log((F.col("total") + 1) / (F.col("n") + 1))
    weight = F.when(F.col("channel") == "addr", F.least(F.lit(8.0), F.greatest(F.lit(1.5), raw))).when(F.col("channel") == "ngram", raw + 1).when(F.col("channel") == "addr_tok", F.least(F.lit(8.0), raw))
    return counts.join(total, "country").withColumn("idf", weight).drop("total")


def query_keys(s1: DataFrame, profile: Profile = PROD) -> DataFrame:
    """(country, s1_id, rule, channel, key, pos): what each record asks of which channel."""
    norm, core, addr, norm_addr = F.col("norm_name"), F.col("core"), F.col("addr"), F.col("norm_addr")
    parts = (F.col(PARTS[0]), F.col(PARTS[1]))
    rules = {
        "exact": ("exact", lambda: X.suffix_variants(norm, profile.dropped_suffixes)),
        "addr": ("addr", lambda: X.wider_address_keys(addr, norm_addr, parts) if profile.wider_addresses else X.address_keys(addr, norm_addr, parts)),
        "token": ("token", lambda: F.array_distinct(core)),
        "concat": ("token", lambda: X.concat_keys(norm, core)),
        "prefix": ("prefix", lambda: target_keys("prefix")),
        "acronym": ("acronym", lambda: X.acronyms(norm, core)),
        "tokpost": ("tokpost", lambda: _post_key(core, X.postal_prefixes(addr, norm_addr))),
        "addr_tok": ("addr_tok", lambda: F.col("addr_words")),
        "ngram": ("ngram", lambda: X.ngram_list(norm, 3)),
        "phone": ("phone", lambda: X.phones(addr)),
        "tr_exact": ("exact", lambda: F.filter(F.array("tr_name"), lambda x: x != "")),
        "tr_name": ("tr_name", lambda: F.filter(F.array("tr_name"), lambda x: x != "")),
        "tr_token": ("token", lambda: _at_least(F.array_distinct(X.tokens(F.col("tr_name"))), 3)),
        "tr_tok": ("tr_tok", lambda: F.array_distinct(X.tokens(F.col("tr_name")))),
        "phon": ("phon", lambda: F.col("phon_query")),
        "schwa": ("tr_tok", lambda: schwa_keys(core)),
        "schwa_token": ("token", lambda: schwa_keys(core)),
    }
    every = []

    def asked(rule: str, channel: str, keys: Column) -> Column:
        return F.transform(keys, lambda k, i: F.struct(F.lit(rule).alias("rule"), F.lit(channel).alias("channel"), k.alias("key"), i.alias("pos")))

    for rule, (channel, keys) in rules.items():
        wanted = {"concat": "token" in profile.channels and profile.many_tokens > 0, "tr_exact": "tr_name" in profile.channels, "tr_token": "tr_tok" in profile.channels, "schwa": profile.schwa and "tr_tok" in profile.channels, "schwa_token": profile.schwa and "token" in profile.channels}.get(rule, channel in profile.channels)
        if wanted:
            every.append(asked(rule, channel, keys()))
    return (_with_parts(s1) if "addr" in profile.channels else s1).select("country", F.col("id").alias("s1_id"), F.explode(F.flatten(F.array(*every))).alias("q")).select("country", "s1_id", "q.*")


def weighted_keys(asked: DataFrame, stats: DataFrame, profile: Profile = PROD) -> DataFrame:
    """Query keys that exist within limits, each with its weight; address words and trigrams only the rarest."""
    # A key has one row of statistics, so they are hashed and the many query keys needn't be sorted.
    kept = asked.join(within_limits(stats, profile.limits).hint("shuffle_hash"), ["country", "channel", "key"])
    if profile.schwa:
        # Among words only where no transliterated word has the key.
        variant = F.col("rule").isin("schwa", "schwa_token")
        found = F.max(F.col("rule") == "schwa").over(Window.partitionBy("s1_id", F.when(variant, F.col("key"))))
        kept = kept.withColumn("found", found).where((F.col("rule") != "schwa_token") | ~F.col("found")).drop("found")
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for pair in profile.weights.items() for x in pair]), F.col("rule"))
    weight = F.when(F.col("rule") == "addr", F.col("idf") if profile.addr_weight is None else F.lit(profile.addr_weight)).when(F.col("rule") == "addr_tok", 2 * F.col("idf")).when(F.col("rule") == "ngram", F.col("idf")).otherwise(fixed)
    w = Window.partitionBy("s1_id", "rule").orderBy(F.desc("idf"), F.when(F.col("rule") == "ngram", F.col("pos")).otherwise(0), "key", "pos")
    most = F.when(F.col("rule") == "addr_tok", profile.rarest_words).when(F.col("rule") == "ngram", profile.rarest_grams)
    return kept.withColumns({"w": weight, "r": F.row_number().over(w)}).where(most.isNull() | (F.col("r") <= most)).drop("r", "n", "idf", "pos")


def hits(keys: DataFrame, posted: DataFrame) -> DataFrame:
    """A row for every posting that a key finds: (country, channel, key, s1_id, rule, w, target_id)."""
    return keys.join(posted, ["country", "channel", "key"])


def score(found: DataFrame, profile: Profile = PROD) -> DataFrame:
    """Hits summed per pair, with bonuses: weight, channels (sorted), hit counts by rule family."""
    reported = F.col("rule")
    for rule, channel in REPORTED.items():
        reported = F.when(F.col("rule") == rule, F.lit(channel)).otherwise(reported)
    family = lambda rules: F.max(F.col("rule").isin(list(rules)).cast("int"))
    count = lambda rule: F.sum((F.col("rule") == rule).cast("int"))
    g = found.withColumn("reported", reported).groupBy("s1_id", "target_id").agg(
        F.sum("w").alias("raw"), F.collect_set("reported").alias("channels"), count("token").alias("token_hits"), count("phon").alias("phon_hits"), family(NAME_FAMILY).alias("by_name"), family(ADDRESS_FAMILY).alias("by_addr")
    )
    both = (F.col("by_name") == 1) & (F.col("by_addr") == 1) & F.lit(profile.cross_field > 0)
    bonus = F.when(F.col("token_hits") >= 2, profile.many_tokens).otherwise(0.0) + F.when(both, profile.cross_field).otherwise(0.0) + F.when(F.col("phon_hits") >= 2, profile.many_phonetic).otherwise(0.0)
    names = F.when(both, F.array_union("channels", F.array(F.lit("addr")))).otherwise(F.col("channels"))
    return g.select("s1_id", "target_id", (F.col("raw") + bonus).alias("weight"), F.array_sort(names).alias("channels"), "token_hits", "phon_hits", both.alias("cross_field"))


def top_k(scored: DataFrame, k: int | Column) -> DataFrame:
    """The k best targets of each record, ranks from 0; ties by id."""
    w = Window.partitionBy("s1_id").orderBy(F.desc(F.round("weight", 6)), "target_id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def difficulty(s1: DataFrame, scored: DataFrame) -> DataFrame:
    """(s1_id, n, best, tier) of every record."""
    return tiers(s1, scored.groupBy("s1_id").agg(F.count("*").alias("n"), F.max("weight").alias("best")))


def tiers(s1: DataFrame, g: DataFrame) -> DataFrame:
    """The same from (s1_id, n, best) of the records that have candidates."""
    t = s1.select(F.col("id").alias("s1_id"), F.size("core").alias("words"), "norm_addr").join(g, "s1_id", "left").fillna({"n": 0, "best": 0.0})
    hard = (F.col("n") == 0) | (F.col("best") < 3) | (F.col("norm_addr") == "") | (F.col("words") <= 1) | (F.col("n") >= 1000)
    return t.select("s1_id", "n", "best", F.when(hard, "hard").when((F.col("n") >= 150) | (F.col("best") < 8), "medium").otherwise("easy").alias("tier"))


def budgets(s1: DataFrame, scored: DataFrame, posted: DataFrame) -> DataFrame:
    """(s1_id, tier, budget): a hard record whose exact name is filed counts as medium."""
    return budgets_of(s1, difficulty(s1, scored), posted)


def budgets_of(s1: DataFrame, tiered: DataFrame, posted: DataFrame) -> DataFrame:
    """The same from the tiers of all records."""
    named = s1.select("country", F.col("norm_name").alias("key"), F.col("id").alias("s1_id"))
    exact = named.join(posted.where("channel = 'exact'"), ["country", "key"], "left_semi").select("s1_id", F.lit(True).alias("exact"))
    t = tiered.join(exact, "s1_id", "left")
    tier = F.when((F.col("tier") == "hard") & F.coalesce("exact", F.lit(False)), "medium").otherwise(F.col("tier"))
    return t.select("s1_id", tier.alias("tier"), F.try_element_at(F.create_map(*[F.lit(x) for p in BUDGETS.items() for x in p]), tier).alias("budget"))


def must_include(scored: DataFrame, depth: int) -> DataFrame:
    """Candidates within ``depth``, or with evidence that must not be cut off."""
    w = Window.partitionBy("s1_id").orderBy(F.desc(F.round("weight", 6)), "target_id")
    return scored.withColumn("place", F.row_number().over(w)).where((F.col("place") <= depth) | (F.col("token_hits") >= 2) | (F.col("phon_hits") >= 2) | F.col("cross_field"))


def _name_similarity(sounds: bool) -> Column:
    """Of x and y, by trigrams; with ``sounds`` also of their transliterations, and by the share of x's sound codes in those of y's."""
    grams = lambda c: X.ngrams(F.col(c), 3)
    plain = X.jaccard(grams("x.norm_name"), grams("y.norm_name"))
    if not sounds:
        return plain
    asked, filed = F.col("x.phon_query"), F.col("y.tr_phon")
    heard = F.when(F.size(F.array_distinct(asked)) > 0, F.size(F.array_intersect(asked, filed)) / F.size(F.array_distinct(asked))).otherwise(0.0)
    across = lambda a, b: X.jaccard(grams(a), grams(b))
    tx, ty = F.col("x.tr_name") != "", F.col("y.tr_name") != ""
    return F.greatest(
        plain, F.when(tx, across("x.tr_name", "y.norm_name")).otherwise(0.0), F.when(ty, F.greatest(across("x.norm_name", "y.tr_name"), heard)).otherwise(0.0),
        F.when(tx & ty, across("x.tr_name", "y.tr_name")).otherwise(0.0),
    )


def rerank(scored: DataFrame, s1: DataFrame, targets: DataFrame, limit: DataFrame | int, profile: Profile = PROD) -> DataFrame:
    """The best candidates within each record's limit; where there are more, weights first gain boost x trigram similarity."""
    if isinstance(limit, int):
        sized = scored.withColumn("budget", F.lit(limit))
    else:
        sized = scored.join(limit.select("s1_id", "budget"), "s1_id")
    every = sized.withColumn("n", F.count("*").over(Window.partitionBy("s1_id")))
    kept = must_include(every, profile.depth)
    kept = kept.where((F.col("n") > F.col("budget")) | (F.col("place") <= F.col("budget")))
    sounds = ["tr_name", "phon_query", "tr_phon"] if profile.rank_by_sounds else []
    names = lambda df, a, b: df.select(F.col("id").alias(a), F.struct("norm_name", *sounds).alias(b))
    pair = kept.join(names(s1, "s1_id", "x"), "s1_id").join(names(targets, "target_id", "y"), "target_id")
    similar = _name_similarity(profile.rank_by_sounds)
    pair = pair.withColumn("weight", F.when(F.col("n") > F.col("budget"), F.col("weight") + profile.boost * similar).otherwise(F.col("weight")))
    return top_k(pair.drop("x", "y", "n", "place"), F.col("budget")).drop("budget")


def family_quota(scored: DataFrame, budget: int) -> DataFrame:
    """At least half of each budget goes to candidates with name evidence."""
    named = F.exists("channels", lambda c: c.isin("exact", "token", "prefix", "acronym", "tokpost"))
    w = Window.partitionBy("s1_id", named).orderBy(F.desc(F.round("weight", 6)), "target_id")
    first = scored.withColumn("reserved", named & (F.row_number().over(w) <= budget - budget // 2))
    order = Window.partitionBy("s1_id").orderBy(F.desc("reserved"), F.desc(F.round("weight", 6)), "target_id")
    return first.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < budget).drop("reserved")


def retrieve(s1: DataFrame, targets: DataFrame, profile: Profile = PROD, posted: DataFrame | None = None) -> DataFrame:
    """All scored candidates of prepared records among prepared targets (or their postings, if at hand), before any cut."""
    if posted is None:
        posted = postings(targets, profile.channels)
    return score(hits(weighted_keys(query_keys(s1, profile), idf(key_counts(posted), targets), profile), posted), profile)
