"""Pair features. Both sides' derived fields and sets are computed once per record; a pair only compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions import fuzzy
from twinlake.functions import text as X
from twinlake.functions.phonetic import metaphone, transliterate

# The order of features is a contract of the model; families decide family_count.
BASE = [
    "name_token_set", "name_token_sort", "name_ratio", "name_exact", "name_jaccard", "name_ngram_jaccard", "name_len_diff", "addr_token_set", "addr_token_sort", "addr_ratio",
    "addr_jaccard", "num_overlap", "has_matching_digits", "addr_missing", "addr_len_diff", "composite_score", "is_s2", "name_jaro_winkler", "name_acronym_match",
    "name_prefix_similarity", "addr_token_containment", "postal_prefix_match_len", "street_num_exact_match", "score_rank_in_candidate_pool", "blocking_weight_ratio",
    "raw_blocking_weight", "addr_jaro_winkler", "name_first_token_match", "is_top1_candidate", "name_partial_ratio",
]
EXTRA = [
    "tr_name_set", "phon_jaccard", "soundex_jaccard", "char2_jaccard", "char4_jaccard", "name_containment", "shared_sig_count", "shared_sig_ratio", "tokcount_diff",
    "addr_tr_set", "addr_char3_jaccard", "phone_agree", "postal_exact", "addr_coverage", "agree_count", "family_count", "has_tr_chan", "has_phon_chan", "has_phone_chan",
    "ngram_only", "gap_to_top", "w_zscore",
]
FAMILIES = {
    "exact": "name", "token": "name", "prefix": "name", "acronym": "name", "ngram": "name", "tr_name": "trlit", "tr_tok": "trlit", "phon": "phon", "addr": "addr",
    "tokpost": "mix", "addr_tok": "addr", "phone": "phone",
}
# End of fixed values.

_SIDE = ["norm_name", "norm_addr", "core", "addr_words", "digits", "postal", "street_num", "name", "addr", "country"]
_codes = lambda f: F.array_distinct(F.filter(F.transform(F.filter(F.array_distinct("core"), lambda t: F.char_length(t) >= 3), f), lambda v: v != ""))
_sized = lambda runs, low, high: F.filter(runs, lambda d: F.char_length(d).between(low, high))
#: Sets that features compare, made once a record: the columns that need them and how they come from a prepared record.
SETS = {
    "g2": (["char2_jaccard"], lambda: X.gram_codes(F.col("norm_name"), 2)),
    "g3": (["name_ngram_jaccard"], lambda: X.gram_codes(F.col("norm_name"), 3)),
    "g4": (["char4_jaccard"], lambda: X.ngrams(F.col("norm_name"), 4)),
    "addr_g3": (["addr_char3_jaccard"], lambda: X.gram_codes(F.col("norm_addr"), 3)),
    "sounds": (["phon_jaccard"], lambda: _codes(metaphone)),
    "soundex": (["soundex_jaccard"], lambda: _codes(X.soundex_code)),
    "phones": (["phone_agree"], lambda: F.array_union(X.phones(F.col("addr")), X.phones(F.col("norm_addr")))),
    "postals": (["postal_exact"], lambda: _sized(F.col("digits"), 4, 6)),
    "initials": (["name_acronym_match"], lambda: X.initials(F.col("core"))),
}


def paired(candidates: DataFrame, s1: DataFrame, targets: DataFrame, names: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Candidates with both prepared records, as structs x and y, and the sets that the named features (all if None) compare.

    With ``fields`` the structs hold these only, so that whole texts needn't travel with each of their pairs.
    Raw texts of a target count only if not plain ASCII.
    """
    t = targets if "is_s2" in targets.columns else targets.withColumn("is_s2", F.lit(0))
    raw = lambda c: F.when(F.rlike(F.col(c), F.lit("[^\\x{00}-\\x{7F}]")), F.col(c)).otherwise(F.lit(""))
    # A target's numbers are whole words of its normalised address, a record's are all runs of its raw one.
    words = X.number_words(F.col("norm_addr"))
    first = lambda low, high: F.coalesce(F.try_element_at(_sized(words, low, high), F.lit(1)), F.lit(""))
    wanted = {k: make for k, (columns, make) in SETS.items() if names is None or set(columns) & set(names)}
    own = [make().alias(k) for k, make in wanted.items()]
    runs = F.concat(X.number_runs(F.col("norm_addr")), X.number_runs(raw("addr")))
    theirs = [(_sized(runs, 4, 6) if k == "postals" else F.array_union(X.phones(raw("addr")), X.phones(F.col("norm_addr"))) if k == "phones" else make()).alias(k) for k, make in wanted.items()]
    size = F.char_length("norm_addr").alias("addr_size")
    pick = lambda have: [c for k, c in have.items() if fields is None or k in fields]
    mine = {c: F.col(c) for c in _SIDE} | {"addr_size": size}
    yours = {c: F.col(c) for c in ("norm_name", "norm_addr", "core", "addr_words")} | {
        "digits": F.array_distinct(words).alias("digits"), "postal": first(4, 6).alias("postal"), "street_num": first(1, 5).alias("street_num"), "name": raw("name").alias("name"), "addr": raw("addr").alias("addr"), "is_s2": F.col("is_s2"), "addr_size": size,
    }
    y = t.select(F.col("id").alias("target_id"), F.struct(*pick(yours), *theirs).alias("y"))
    x = s1.select(F.col("id").alias("s1_id"), F.struct(*pick(mine), *own).alias("x"))
    return candidates.join(x, "s1_id").join(y, "target_id")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def base_columns() -> dict[str, Column]:
    """The base features that need no Python."""
    n1, n2, s1, s2 = F.col("x.norm_name"), F.col("y.norm_name"), F.col("x.addr_size"), F.col("y.addr_size")
    there = lambda c, otherwise=0.0: F.when(s2 == 0, otherwise).otherwise(c)
    i1, i2 = F.col("x.initials"), F.col("y.initials")
    prefix = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.char_length("x.postal") >= i) & (F.substring("x.postal", i, F.lit(1)) == F.substring("y.postal", i, F.lit(1))), i).otherwise(n))
    w = Window.partitionBy("s1_id")
    first = F.first_value("weight").over(w.orderBy("rank"))
    return {
        "name_exact": _flag((n1 == n2) & (n1 != "")),
        "name_jaccard": X.jaccard(F.col("x.core"), F.col("y.core")),
        "name_ngram_jaccard": X.set_jaccard(F.col("x.g3"), F.col("y.g3")),
        "name_len_diff": X.length_gap(n1, n2),
        "addr_jaccard": there(X.set_jaccard(F.col("x.addr_words"), F.col("y.addr_words"))),
        "num_overlap": there(X.jaccard(F.col("x.digits"), F.col("y.digits"))),
        "has_matching_digits": there(_flag(F.arrays_overlap("x.digits", "y.digits"))),
        "addr_missing": _flag(s2 == 0),
        "addr_len_diff": there(F.abs(s1 - s2) / F.greatest(s1, s2, F.lit(1)), 1.0),
        "is_s2": F.col("y.is_s2").cast("double"),
        "name_acronym_match": _flag(((i1 != "") & ((n2 == i1) | (i1 == i2))) | ((i2 != "") & (n1 == i2))),
        "addr_token_containment": there(X.containment(F.col("x.addr_words"), F.col("y.addr_words"))),
        "postal_prefix_match_len": there(prefix.cast("double")),
        "street_num_exact_match": there(_flag((F.col("x.street_num") != "") & (F.col("x.street_num") == F.col("y.street_num")))),
        "score_rank_in_candidate_pool": F.col("rank").cast("double"),
        "blocking_weight_ratio": F.col("weight") / F.greatest(F.lit(1e-5), first),
        "raw_blocking_weight": F.col("weight"),
        "name_first_token_match": _flag(F.coalesce(F.try_element_at("x.core", F.lit(1)) == F.try_element_at("y.core", F.lit(1)), F.lit(False))),
        "is_top1_candidate": _flag(F.col("rank") == 0),
    }


def extra_columns() -> dict[str, Column]:
    """The extra features that need no Python."""
    n1, n2, a1, a2 = F.col("x.norm_name"), F.col("y.norm_name"), F.col("x.norm_addr"), F.col("y.norm_addr")
    c1, c2 = F.array_distinct("x.core"), F.array_distinct("y.core")
    family = F.create_map(*[F.lit(v) for p in FAMILIES.items() for v in p])
    has = lambda *names: _flag(F.arrays_overlap("channels", F.array(*map(F.lit, names))))
    w = Window.partitionBy("s1_id")
    first = F.first_value("weight").over(w.orderBy("rank"))
    spread = F.when(F.count("*").over(w) > 1, F.stddev_pop("weight").over(w)).otherwise(1.0)
    n_both = X.shared(F.col("x.addr_words"), F.col("y.addr_words"))
    return {
        "phon_jaccard": X.set_jaccard(F.col("x.sounds"), F.col("y.sounds")),
        "soundex_jaccard": X.set_jaccard(F.col("x.soundex"), F.col("y.soundex")),
        "char2_jaccard": X.set_jaccard(F.col("x.g2"), F.col("y.g2")),
        "char4_jaccard": X.set_jaccard(F.col("x.g4"), F.col("y.g4")),
        "name_containment": X.containment(c1, c2),
        "shared_sig_count": X.shared(c1, c2).cast("double"),
        "shared_sig_ratio": X.shared(c1, c2) / F.greatest(F.lit(1), F.size(c1), F.size(c2)),
        "tokcount_diff": F.abs(F.size(c1) - F.size(c2)) / F.greatest(F.lit(1), F.size(c1) + F.size(c2)),
        "addr_char3_jaccard": F.when((a1 != "") & (a2 != ""), X.set_jaccard(F.col("x.addr_g3"), F.col("y.addr_g3"))).otherwise(0.0),
        "phone_agree": _flag(F.arrays_overlap("x.phones", "y.phones")),
        "postal_exact": _flag(F.arrays_overlap("x.postals", "y.postals")),
        "addr_coverage": F.when(F.size("x.addr_words") > 0, n_both / F.size("x.addr_words")).otherwise(0.0),
        "agree_count": F.size("channels").cast("double"),
        "family_count": F.size(F.array_distinct(F.transform("channels", lambda c: F.coalesce(F.try_element_at(family, c), F.lit("other"))))).cast("double"),
        "has_tr_chan": has("tr_name", "tr_tok"),
        "has_phon_chan": has("phon"),
        "has_phone_chan": has("phone"),
        "ngram_only": _flag(F.array_join("channels", ",") == "ngram"),
        "gap_to_top": F.greatest(F.lit(0.0), 1 - F.col("weight") / F.greatest(F.lit(1e-5), first)),
        "w_zscore": (F.col("weight") - F.avg("weight").over(w)) / F.greatest(F.lit(1e-5), spread),
    }


def all_features(pairs: DataFrame) -> DataFrame:
    """Every feature, in the order of the contract: built-in ones first, one Arrow pass for the fuzzy ones."""
    p = pairs.withColumns(base_columns()).withColumns(extra_columns())
    p = p.withColumn("f", fuzzy.fuzzy_features(F.col("x.norm_name"), F.col("y.norm_name"), F.col("x.norm_addr"), F.col("y.norm_addr")))
    p = p.withColumns({c: F.col(f"f.{c}") for c in (f.split()[0] for f in fuzzy.FUZZY.split(", "))})
    harmonic = 2 * F.col("name_token_set") * F.col("addr_token_set") / F.greatest(F.lit(1e-5), F.col("name_token_set") + F.col("addr_token_set"))
    p = p.withColumn("composite_score", F.when(F.col("addr_missing") == 1, F.col("name_token_set")).otherwise(harmonic))
    cross = lambda raw1, raw2, norm1, norm2: F.greatest(*[fuzzy.token_set_udf(a, b) for a, b in ((transliterate(raw1), transliterate(raw2)), (transliterate(raw1), norm2), (norm1, transliterate(raw2)))])
    p = p.withColumns({
        "tr_name_set": cross(F.col("x.name"), F.col("y.name"), F.col("x.norm_name"), F.col("y.norm_name")),
        "addr_tr_set": cross(F.col("x.addr"), F.col("y.addr"), F.col("x.norm_addr"), F.col("y.norm_addr")),
    })
    return p.select("s1_id", "target_id", "rank", "weight", "channels", *BASE, *EXTRA)
