"""DuckDB SQL of the record-linkage queries: a library of common table expressions, and one SELECT a query."""

from __future__ import annotations

# Word lists, weights, limits, depth and budget, stated here again so that the SQL doesn't follow a change of the code.
LEGAL_SUFFIXES = ["inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "pvt", "private", "co", "company", "llp", "gmbh", "sarl", "sas", "sa", "plc", "spa", "bv"]
STOPWORDS = ["and", "the", "of", "in", "for", "to", "at", "by", "from", "&", "a", "an", "limited", "private", "llc", "inc", "ltd", "pvt", "corp", "co", "company"]
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "dr": "drive", "blvd": "boulevard", "ln": "lane", "ct": "court", "hwy": "highway", "pk": "park",
    "pkwy": "parkway", "apt": "apartment", "ste": "suite", "bldg": "building", "fl": "floor", "pl": "place", "cir": "circle", "sq": "square", "terr": "terrace",
}
ADDRESS_STOPWORDS = [
    "road", "street", "avenue", "drive", "lane", "boulevard", "floor", "suite", "apartment", "unit", "ste", "apt", "bldg", "building", "fl", "pl", "circle",
    "square", "near", "opp", "opposite", "behind", "beside", "at", "post", "po", "dist", "door", "no", "plot", "block", "phase", "sector", "stage",
]
WEIGHTS = {"exact": 15.0, "token": 3.0, "concat": 15.0, "prefix": 1.0, "acronym": 8.0, "tokpost": 7.0, "phone": 9.0}
LIMITS = {"token": 40000, "prefix": 12000, "addr": 12000, "addr_tok": 10000, "acronym": 12000, "tokpost": 12000, "ngram": 1500}
DEPTH, BUDGET = "/*depth*/1500", "/*budget*/60"
MEMORY_LIMITS = {"token": 12000, "prefix": 12000, "addr": 12000, "addr_tok": 3000, "acronym": 12000, "tokpost": 12000, "ngram": 1500}
BASELINE_LIMITS = {"token": 3000, "prefix": 3000, "addr": 3000}
MULTI_PASS_LIMITS = {"token": 4000, "prefix": 4000, "addr": 150}
# End of fixed values.

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_map = lambda pairs: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"
_squeeze = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\p{{Z}}\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_sized = lambda x, a, b: f"list_filter({x}, lambda v: length(v) BETWEEN {a} AND {b})"
_cross = lambda kind, a, b: f"flatten(list_transform({a}, lambda p: list_transform({b}, lambda q: '{kind}|' || p || '|' || q)))"
_grams = lambda x, n: f"list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, CAST(i AS INTEGER), {n}))"
gram_set = lambda x, n: f"CASE WHEN length({x}) >= {n} THEN list_distinct({_grams(x, n)}) WHEN length({x}) > 0 THEN [{x}] ELSE [] END"
jaccard = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0::DOUBLE END"
initials = lambda x: f"array_to_string(list_transform({x}, lambda t: substr(t, 1, 1)), '')"
whole_numbers = lambda x: rf"list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_matches(t, '^\p{{Nd}}+$'))"
phones = lambda x: rf"list_filter(list_transform(regexp_extract_all({x}, '\+?\p{{Nd}}[\p{{Nd}}\s\-()]{{6,}}\p{{Nd}}'), lambda m: regexp_replace(m, '\P{{Nd}}', '', 'g')), lambda d: length(d) BETWEEN 7 AND 13)"
_local = "list_filter(list_transform({0}, lambda d: CASE WHEN length(d) = 12 AND starts_with(d, '91') THEN substr(d, 3) WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) END), lambda d: d IS NOT NULL)"
all_phones = lambda x: f"list_distinct(list_concat({phones(x)}, {_local.format(phones(x))}))"

RECORDS = rf"""
er AS (
  SELECT doc_id, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, doc_id % 3 AS k, lang AS country,
         replace(substr(coalesce(text, ''), 1, 40), chr(10), ' ') AS name, replace(substr(coalesce(text, ''), 41), chr(10), ' ') AS addr
  FROM documents),
n0 AS (
  SELECT *, {_squeeze(r"regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(name)), '^[@*#\s]+', ''), '^www\.', ''), '\.(com|in|org|net|co|io|fr|us)\b', '', 'g')")} AS norm_name,
         array_to_string(list_transform(list_filter(string_split({_squeeze("lower(strip_accents(addr))")}, ' '), lambda t: t <> ''), lambda t: coalesce({_map(ADDRESS_WORDS)}[t], t)), ' ') AS norm_addr
  FROM er),
n1 AS (
  SELECT *, list_filter(string_split(norm_name, ' '), lambda t: t <> '') AS words, list_filter(string_split(norm_addr, ' '), lambda t: t <> '') AS awords,
         list_filter(string_split(norm_name, ' '), lambda t: length(t) >= 2 AND NOT list_contains({_list([*LEGAL_SUFFIXES, *STOPWORDS])}, t)) AS core,
         regexp_extract_all(CASE WHEN addr <> '' THEN addr ELSE norm_addr END, '\p{{Nd}}+') AS runs, regexp_extract_all(addr, '\p{{Nd}}+') AS own_runs
  FROM n0),
n2 AS (
  SELECT *, list_filter(awords, lambda t: length(t) >= 4 AND NOT list_contains({_list(ADDRESS_STOPWORDS)}, t)) AS places,
         {_sized("runs", 4, 6)} AS postals, ({_sized("runs", 1, 5)})[1:3] AS streets,
         list_distinct(list_transform(({_sized(whole_numbers("CASE WHEN addr <> '' THEN addr ELSE norm_addr END"), 4, 6)})[1:3], lambda x: substr(x, 1, 2))) AS post2
  FROM n1),
n AS (
  SELECT *, list_concat(list_concat({_cross("ST_POST", "streets", "postals[1:2]")}, {_cross("ST_LOC", "streets", "CASE WHEN len(places) > 3 THEN list_distinct(list_concat(places[1:2], places[-2:])) ELSE list_distinct(places) END")}),
           list_concat(list_concat(CASE WHEN len(places) >= 2 THEN ['LOC_PAIR|' || places[1] || '|' || places[-1]] ELSE [] END, CASE WHEN len(places) >= 3 THEN ['LOC_PAIR|' || places[1] || '|' || places[2]] ELSE [] END),
             list_transform(postals[1:1], lambda p: 'POSTAL|' || p))) AS addr_keys,
         list_distinct(list_concat(list_concat(CASE WHEN len(core) >= 2 THEN [{initials("core")}] ELSE [] END, CASE WHEN len(words) >= 2 THEN [{initials("words")}] ELSE [] END),
           CASE WHEN length(norm_name) BETWEEN 2 AND 5 AND NOT contains(norm_name, ' ') THEN [norm_name] ELSE [] END)) AS acr,
         CASE WHEN len(core) > 0 THEN list_transform(post2, lambda p: core[1] || '|' || p) ELSE [] END AS tokpost
  FROM n2),
t AS (SELECT * FROM n WHERE k > 0),
s AS (SELECT * FROM n WHERE k = 0)"""

_variants = """list_distinct(list_concat(list_concat(list_concat(list_concat([norm_name],
    CASE WHEN contains(norm_name, ' limited') OR contains(norm_name, ' private') THEN [replace(replace(norm_name, ' limited', ' ltd'), ' private', ' pvt'), trim(replace(replace(norm_name, ' limited', ''), ' ltd', ''))] ELSE [] END),
    CASE WHEN contains(norm_name, ' ltd') OR contains(norm_name, ' pvt') THEN [replace(replace(norm_name, ' ltd', ' limited'), ' pvt', ' private'), trim(replace(replace(norm_name, ' ltd', ''), ' limited', ''))] ELSE [] END),
    CASE WHEN contains(norm_name, ' llp') THEN [replace(norm_name, ' llp', ' l l p')] ELSE [] END), CASE WHEN contains(norm_name, ' l l p') THEN [replace(norm_name, ' l l p', ' llp')] ELSE [] END))"""


def _concat(w: str) -> str:
    two, three = f"array_to_string({w}[1:2], '')", f"array_to_string({w}[1:3], '')"
    return f"""CASE WHEN len({w}) >= 2 THEN list_concat(CASE WHEN length({two}) >= 5 THEN [{two}, replace({two}, 'brothers', 'bros')] ELSE [] END,
      CASE WHEN len({w}) >= 3 AND length({three}) >= 6 THEN [{three}, replace(replace({three}, 'brothers', 'bros'), 'private', 'pvt')] ELSE [] END) ELSE [] END"""


CONCATS = f"list_distinct(list_concat({_concat('core')}, {_concat('words')}))"
VARIANTS = _variants
WIDER = f"list_distinct(list_concat(addr_keys, {_cross('ST_LOC', 'streets', 'places[1:6]')}))"
TARGET_KEYS = {
    "exact": "CASE WHEN length(norm_name) >= 3 THEN [norm_name] ELSE [] END",
    "token": "list_distinct(list_filter(core, lambda v: length(v) >= 3))",
    "prefix": "CASE WHEN length(norm_name) >= 4 THEN [substr(norm_name, 1, 4)] ELSE [] END",
    "addr": "addr_keys",
    "addr_tok": r"list_distinct(list_filter(awords, lambda v: length(v) >= 4 AND NOT regexp_matches(v, '^\p{Nd}+$')))",
    "acronym": "acr",
    "tokpost": "tokpost",
    "ngram": f"CASE WHEN length(norm_name) >= 3 THEN {gram_set('norm_name', 3)} ELSE [] END",
    "phone": all_phones("addr"),
}
POSTINGS = "post AS (" + " UNION ALL ".join(f"SELECT country, '{c}' AS channel, unnest({keys}) AS key, id AS target_id FROM t" for c, keys in TARGET_KEYS.items()) + ")"
_limit = lambda limits: "CASE channel " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in limits.items()) + " END"
_stats = lambda limits: f"""
total AS (SELECT country, greatest(count(*), 1) AS total FROM t GROUP BY country),
counts AS (SELECT country, channel, key, count(*) AS n FROM post GROUP BY ALL),
stats AS (
  SELECT c.* EXCLUDE (r), CASE channel WHEN 'addr' THEN least(8, greatest(1.5, r)) WHEN 'ngram' THEN r + 1 WHEN 'addr_tok' THEN least(8, r) END AS idf
  FROM (SELECT counts.*, ln(CAST(total + 1 AS DOUBLE) / (n + 1)) AS r FROM counts JOIN total USING (country)) c
  WHERE coalesce(n <= {_limit(limits)}, true))"""  # noqa: E731
STATS = _stats(LIMITS)
_rules = {
    "exact": ("exact", _variants), "addr": ("addr", WIDER), "token": ("token", "list_distinct(core)"), "concat": ("token", CONCATS), "prefix": ("prefix", TARGET_KEYS["prefix"]),
    "acronym": ("acronym", "acr"), "tokpost": ("tokpost", "tokpost"), "addr_tok": ("addr_tok", "list_distinct(awords)"), "phone": ("phone", TARGET_KEYS["phone"]),
}
_grams_asked = f"SELECT country, id AS s1_id, 'ngram' AS rule, 'ngram' AS channel, unnest(CASE WHEN length(norm_name) >= 3 THEN {_grams('norm_name', 3)} ELSE [] END) AS key, unnest(range(0, greatest(length(norm_name) - 2, 0))) AS pos FROM s"


def _hits(rules: dict[str, tuple[str, str]], weights: dict[str, float], addr: str = "idf", grams: bool = True) -> str:
    asked = " UNION ALL ".join([f"SELECT country, id AS s1_id, '{r}' AS rule, '{c}' AS channel, unnest({k}) AS key, 0 AS pos FROM s" for r, (c, k) in rules.items()] + [_grams_asked] * grams)
    fixed = " ".join(f"WHEN '{r}' THEN {w}" for r, w in weights.items())
    return f"""
asked AS ({asked}),
keyed AS (
  SELECT *, CASE rule WHEN 'addr' THEN {addr} WHEN 'addr_tok' THEN 2 * idf WHEN 'ngram' THEN idf {fixed} END AS w,
         row_number() OVER (PARTITION BY s1_id, rule ORDER BY idf DESC, CASE WHEN rule = 'ngram' THEN pos ELSE 0 END, key, pos) AS r
  FROM asked JOIN stats USING (country, channel, key)),
hit AS (
  SELECT k.s1_id, p.target_id, k.rule, k.channel, k.key, k.w FROM keyed k JOIN post p USING (country, channel, key)
  WHERE CASE rule WHEN 'addr_tok' THEN r <= 6 WHEN 'ngram' THEN r <= 8 ELSE true END)"""


def _scores(tokens: int = 25, cross: int = 20) -> str:
    return f"""
agg AS (
  SELECT s1_id, target_id, sum(w) AS raw, list_sort(list_distinct(list(CASE WHEN rule = 'concat' THEN 'token' ELSE rule END))) AS ch, count(*) FILTER (rule = 'token') AS token_hits,
         {cross} > 0 AND bool_or(rule IN ('exact', 'token', 'concat', 'prefix', 'acronym', 'tokpost')) AND bool_or(rule IN ('addr', 'tokpost')) AS cross_field
  FROM hit GROUP BY s1_id, target_id),
sc AS (
  SELECT s1_id, target_id, raw + CASE WHEN token_hits >= 2 THEN {tokens} ELSE 0 END + CASE WHEN cross_field THEN {cross} ELSE 0 END AS weight,
         CASE WHEN cross_field THEN list_sort(list_distinct(list_concat(ch, ['addr']))) ELSE ch END AS channels, token_hits, cross_field
  FROM agg),
rk AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(weight, 6) DESC, target_id) - 1 AS rank, count(*) OVER (PARTITION BY s1_id) AS n FROM sc)"""


HITS, SCORES = _hits(_rules, WEIGHTS), _scores()
# The smaller profiles: no spelling without its suffix, the address keys as they are filed.
_plain = _rules | {"exact": ("exact", _variants.replace(", trim(replace(replace(norm_name, ' limited', ''), ' ltd', ''))]", "]").replace(", trim(replace(replace(norm_name, ' ltd', ''), ' limited', ''))]", "]")), "addr": ("addr", "addr_keys")}
_only = lambda *names: {r: _plain[r] for r in names}
_best = "SELECT s1_id, target_id, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank < "
#: Candidates of the later queries: the best within the budget, with name similarity as a stand-in for a probability.
SCORED = f"""
cand AS (
  SELECT rk.*, round({jaccard("x3", "y3")}, 6) AS p
  FROM rk JOIN (SELECT id AS s1_id, {gram_set("norm_name", 3)} AS x3 FROM s) USING (s1_id) JOIN (SELECT id AS target_id, {gram_set("norm_name", 3)} AS y3 FROM t) USING (target_id)
  WHERE rank < {BUDGET}),
truth AS (
  SELECT DISTINCT 'S1-' || a.doc_id AS s1_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id AS target_id
  FROM documents a JOIN documents b ON a.lang = b.lang AND a.text = b.text WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0),
linked AS (
  SELECT *, max(p) OVER (PARTITION BY s1_id) >= 0.8 AND p >= greatest(0.4, max(p) OVER (PARTITION BY s1_id) - 0.1) AS accepted FROM cand)"""


def per_record(predicted: str) -> str:
    """The table of counts per record, as a CTE named rec."""
    return f"""
rec AS (
  SELECT s.id AS s1_id, s.country, s.name, coalesce(c.n_truth, 0) AS n_truth, coalesce(c.n_pred, 0) AS n_pred, coalesce(c.tp, 0) AS tp
  FROM s LEFT JOIN (
    SELECT coalesce(a.s1_id, b.s1_id) AS s1_id, count(a.target_id) AS n_truth, count(b.target_id) AS n_pred, count(*) FILTER (a.target_id IS NOT NULL AND b.target_id IS NOT NULL) AS tp
    FROM truth a FULL OUTER JOIN (SELECT DISTINCT s1_id, target_id FROM {predicted}) b ON a.s1_id = b.s1_id AND a.target_id = b.target_id GROUP BY 1) c ON c.s1_id = s.id)"""


F05 = """CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1.0 WHEN n_pred = 0 OR n_truth = 0 OR tp = 0 THEN 0.0
  ELSE 1.25 * (CAST(tp AS DOUBLE) / n_pred) * (CAST(tp AS DOUBLE) / n_truth) / (0.25 * (CAST(tp AS DOUBLE) / n_pred) + CAST(tp AS DOUBLE) / n_truth) END"""
SUMMARY = f"""round(avg({F05}), 6) AS macro_f05, round(CAST(sum(tp) AS DOUBLE) / greatest(1, sum(n_pred)), 6) AS "precision", round(CAST(sum(tp) AS DOUBLE) / greatest(1, sum(n_truth)), 6) AS recall,
  round(CAST(count(*) FILTER (n_truth = 0 AND n_pred = 0) AS DOUBLE) / greatest(1, count(*) FILTER (n_truth = 0)), 6) AS singleton_accuracy,
  count(*) FILTER (n_pred = 0) AS predicted_singletons, count(*) AS records"""


def sql(final: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


PROFILES = {
    "prod_profile": sql(_best + BUDGET, RECORDS, POSTINGS, STATS, HITS, SCORES),
    "mem_profile": sql(_best + BUDGET, RECORDS, POSTINGS, _stats(MEMORY_LIMITS), _hits(_plain, WEIGHTS), _scores(cross=0)),
    "baseline_profile": sql(_best + "25", RECORDS, POSTINGS, _stats(BASELINE_LIMITS), _hits(_only("token", "prefix", "addr"), WEIGHTS, "4.0::DOUBLE", False), _scores(0, 0)),
    "multi_pass_profile": sql(_best + "35", RECORDS, POSTINGS, _stats(MULTI_PASS_LIMITS), _hits(_only("exact", "token", "prefix", "addr"), WEIGHTS | {"exact": 10.0}, "6.0::DOUBLE", False), _scores(0, 0)),
}


def resized(text: str, limits: dict[str, int], depth: int, budget: int) -> str:
    """The same SQL with other limits, depth and budget, for fixtures small enough to prune something."""
    return text.replace(_limit(LIMITS), _limit(limits)).replace(DEPTH, str(depth)).replace(BUDGET, str(budget))
