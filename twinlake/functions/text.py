"""Text normalisation and key functions as Column expressions; no Python runs per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns below decide results and must be as they are.
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
HANDLE = r"^[@*#\s]+"
WWW = r"^www\."
DOMAIN = r"\.(com|in|org|net|co|io|fr|us)(?![\p{L}\p{N}_])"
URL = r"(?i)(@|\.com|\.in|\.org|\.net|www\.)"
PHONE = r"\+?\p{Nd}[\p{Nd}\s\-()]{6,}\p{Nd}"
INDIC = r"[\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}\x{0A80}-\x{0AFF}\x{0B00}-\x{0B7F}\x{0B80}-\x{0BFF}\x{0C00}-\x{0C7F}\x{0C80}-\x{0CFF}\x{0D00}-\x{0D7F}]"
# End of fixed values.

PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s]"
SPACE = r"(?U)\s+"


@lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks: characters that become one, that vanish, and that become several."""
    one, gone, several = {}, [], {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000)]:
        if 0x0900 <= code <= 0x0D7F or 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c:
            continue
        if not folded:
            gone.append(c)
        elif len(folded) == 1:
            one[c] = folded
        elif code < 0x2200 or 0xFB00 <= code <= 0xFB06:
            several[c] = folded
    return "".join([*one, *gone]), "".join(one.values()), several


@lru_cache(1)
def _composed() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """Compatibility forms of single characters that keep their marks: those that become one and several, and Indic pairs that become one."""
    one, several = {}, {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000)]:
        c = chr(code)
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and folded != c:
            one[c] = folded
        elif len(folded) > 1 and (code < 0x2200 or 0xFB00 <= code <= 0xFB06):
            several[c] = folded
    pairs = {}
    for code in range(0x0900, 0x0D80):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and unicodedata.normalize("NFC", chr(code)) == chr(code):
            pairs["".join(chr(int(x, 16)) for x in parts)] = chr(code)
    return "".join(one), "".join(one.values()), several, pairs


def _compose(text: Column) -> Column:
    """A text with Indic letters, composed: what NFKC makes of it, but for loose marks on other letters."""
    source, target, several, pairs = _composed()
    folds = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    out = F.array_join(F.transform(F.split(F.translate(text, source, target), ""), lambda c: F.coalesce(F.try_element_at(folds, c), c)), "")
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), out)


def clean_unicode(text: Column) -> Column:
    """Accents and compatibility forms folded; a text with letters of an Indic script is composed and keeps its marks.

    Folding is one ``translate``. Ligatures, fractions and the like are looked up a character at a
    time, only in texts that hold one. Rarer forms that decompose into several characters are folded by
    :func:`twinlake.functions.fuzzy.clean_unicode_exact`.
    """
    text = F.coalesce(text, F.lit(""))
    source, target, several = _folds()
    out = F.translate(text, source, target)
    folds = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    rare = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(folds, c), c)), "")
    plain = F.rlike(text, F.lit("^[\\x{00}-\\x{7F}]*$"))
    # Deleting them tells whether a text holds one, faster than a pattern of so many letters.
    holds = F.char_length(F.translate(text, "".join(several), "")) < F.char_length(text)
    out = F.when(holds, rare).otherwise(out)
    return F.when(plain, text).when(has_indic_script(text), _compose(text)).otherwise(out)


def has_indic_script(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(INDIC))


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), SPACE, " "))


def normalize_name(name: Column) -> Column:
    s = F.lower(clean_unicode(name))
    s = F.regexp_replace(F.regexp_replace(s, HANDLE, ""), WWW, "")
    return _squeeze(F.regexp_replace(s, DOMAIN, ""))


def tokens(text: Column) -> Column:
    """Words of a squeezed text, in order, with repeats; none for an empty text."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def core_tokens(norm: Column) -> Column:
    drop = [*LEGAL_SUFFIXES, *STOPWORDS]
    return F.filter(tokens(norm), lambda t: ~t.isin(drop) & (F.char_length(t) >= 2))


def suffix_tokens(norm: Column) -> Column:
    return F.filter(tokens(norm), lambda t: t.isin(LEGAL_SUFFIXES))


def normalize_address(address: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.array_join(F.transform(tokens(_squeeze(F.lower(clean_unicode(address)))), lambda t: F.coalesce(F.try_element_at(words, t), t)), " ")


def number_runs(text: Column) -> Column:
    """All runs of digits, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Nd}+"), F.lit(0))


def number_words(text: Column) -> Column:
    """Runs of digits that are whole words, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"), F.lit(0))


def address_digits(address: Column) -> Column:
    return F.array_distinct(number_runs(address))


def _sized(runs: Column, low: int, high: int) -> Column:
    return F.filter(runs, lambda x: F.char_length(x).between(low, high))


def postal(address: Column) -> Column:
    return F.coalesce(F.try_element_at(_sized(number_runs(address), 4, 6), F.lit(1)), F.lit(""))


def street_number(address: Column) -> Column:
    return F.coalesce(F.try_element_at(_sized(number_runs(address), 1, 5), F.lit(1)), F.lit(""))


def _pairs(kind: str, left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(F.lit(kind + "|"), a, F.lit("|"), b))))


def locality_words(norm_address: Column) -> Column:
    return F.filter(tokens(norm_address), lambda t: (F.char_length(t) >= 4) & ~t.isin(ADDRESS_STOPWORDS))


def address_parts(address: Column, norm_address: Column) -> tuple[Column, Column]:
    """The runs of digits and the words that address keys are made of."""
    return number_runs(F.when(F.coalesce(address, F.lit("")) != "", address).otherwise(norm_address)), locality_words(norm_address)


def address_keys(address: Column, norm_address: Column, parts: tuple[Column, Column] | None = None) -> Column:
    """Compound keys, as ``KIND|part|part``; a key may come more than once. ``parts``: columns that have the parts already."""
    runs, words = parts or address_parts(address, norm_address)
    n = F.size(words)
    postals, streets = _sized(runs, 4, 6), F.slice(_sized(runs, 1, 5), 1, 3)
    near = F.array_distinct(F.when(n > 3, F.concat(F.slice(words, 1, 2), F.slice(words, -2, 2))).otherwise(words))
    pick = lambda i: F.try_element_at(words, F.lit(i))
    no_keys = F.array().cast("array<string>")
    return F.concat(
        _pairs("ST_POST", streets, F.slice(postals, 1, 2)),
        _pairs("ST_LOC", streets, near),
        F.when(n >= 2, F.array(F.concat(F.lit("LOC_PAIR|"), pick(1), F.lit("|"), pick(-1)))).otherwise(no_keys),
        F.when(n >= 3, F.array(F.concat(F.lit("LOC_PAIR|"), pick(1), F.lit("|"), pick(2)))).otherwise(no_keys),
        F.transform(F.slice(postals, 1, 1), lambda p: F.concat(F.lit("POSTAL|"), p)),
    )


def wider_address_keys(address: Column, norm_address: Column, parts: tuple[Column, Column] | None = None) -> Column:
    """Query side: the distinct keys, and house numbers with each of the first six words."""
    runs, words = parts or address_parts(address, norm_address)
    more = _pairs("ST_LOC", F.slice(_sized(runs, 1, 5), 1, 3), F.slice(words, 1, 6))
    return F.array_distinct(F.concat(address_keys(address, norm_address, (runs, words)), more))


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def acronyms(norm: Column, core: Column) -> Column:
    every, none = tokens(norm), F.array().cast("array<string>")
    first = F.when(F.size(core) >= 2, F.array(initials(core))).otherwise(none)
    second = F.when(F.size(every) >= 2, F.array(initials(every))).otherwise(none)
    short = F.when(F.char_length(norm).between(2, 5) & ~F.contains(norm, F.lit(" ")), F.array(norm)).otherwise(none)
    return F.array_distinct(F.concat(first, second, short))


def postal_prefixes(address: Column, norm_address: Column) -> Column:
    words = number_words(F.when(F.coalesce(address, F.lit("")) != "", address).otherwise(norm_address))
    return F.array_distinct(F.transform(F.slice(_sized(words, 4, 6), 1, 3), lambda x: F.substring(x, 1, 2)))


def ngram_list(text: Column, n: int) -> Column:
    """Every n-gram in order, with repeats; none if the text is shorter."""
    size = F.char_length(text)
    # Letters are bound once: a substring would walk a long text from its start for every n-gram.
    grams = F.flatten(F.transform(F.array(F.split(text, "")), lambda c: F.transform(F.sequence(F.lit(0), size - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, n: int) -> Column:
    """The set of n-grams; the text itself if it is shorter, nothing if it is empty."""
    size = F.char_length(text)
    return F.when(size >= n, F.array_distinct(ngram_list(text, n))).when(size > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def gram_codes(text: Column, n: int) -> Column:
    """The same set with each n-gram (n up to 3) as one number, 21 bits a character: comparing sets needs no strings."""
    size = F.char_length(text)
    code = lambda letters, i: sum(((F.coalesce(F.get(letters, i + k), F.lit(0)) * F.lit(1 << 21 * (2 - k))) for k in range(n)), F.lit(0))
    letters = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long") + 1)
    every = F.flatten(F.transform(F.array(letters), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: code(c, i))))
    return F.when(size > 0, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))


def concat_keys(norm: Column, core: Column) -> Column:
    def joined(words: Column) -> Column:
        two, three = F.array_join(F.slice(words, 1, 2), ""), F.array_join(F.slice(words, 1, 3), "")
        bros = lambda x: F.replace(x, F.lit("brothers"), F.lit("bros"))
        none = F.array().cast("array<string>")
        return F.when(
            F.size(words) >= 2,
            F.concat(
                F.when(F.char_length(two) >= 5, F.array(two, bros(two))).otherwise(none),
                F.when((F.size(words) >= 3) & (F.char_length(three) >= 6), F.array(three, F.replace(bros(three), F.lit("private"), F.lit("pvt")))).otherwise(none),
            ),
        ).otherwise(none)

    return F.array_distinct(F.concat(joined(core), joined(tokens(norm))))


def suffix_variants(norm: Column, dropped: bool = True) -> Column:
    """The name and its spellings with long, short or (if ``dropped``) no legal suffix."""
    swap = lambda x, *pairs: swap(F.replace(x, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else x
    has = lambda *words: F.rlike(norm, F.lit("|".join(" " + w for w in words)))
    none = F.array().cast("array<string>")
    long = F.array(swap(norm, (" limited", " ltd"), (" private", " pvt")), *([F.trim(swap(norm, (" limited", ""), (" ltd", "")))] if dropped else []))
    short = F.array(swap(norm, (" ltd", " limited"), (" pvt", " private")), *([F.trim(swap(norm, (" ltd", ""), (" limited", "")))] if dropped else []))
    return F.array_distinct(F.concat(
        F.array(norm), F.when(has("limited", "private"), long).otherwise(none), F.when(has("ltd", "pvt"), short).otherwise(none),
        F.when(has("llp"), F.array(swap(norm, (" llp", " l l p")))).otherwise(none), F.when(has("l l p"), F.array(swap(norm, (" l l p", " llp")))).otherwise(none),
    ))


def schwa_variant(token: Column) -> Column:
    """A token with, or without, a last ``a``; null if there is none."""
    return F.when(F.char_length(token) >= 3, F.when(~F.endswith(token, F.lit("a")), F.concat(token, F.lit("a"))).when(F.char_length(token) >= 4, F.substring(token, F.lit(1), F.char_length(token) - 1)))


def compact_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), F.lit(0)), lambda m: F.regexp_replace(m, r"\P{Nd}", ""))
    found = F.filter(found, lambda d: F.char_length(d).between(7, 13))
    local = F.transform(found, lambda d: F.when(F.startswith(d, F.lit("91")) & (F.char_length(d) == 12), F.substring(d, 3, 10)).when(F.startswith(d, F.lit("1")) & (F.char_length(d) == 11), F.substring(d, 2, 10)))
    return F.array_distinct(F.concat(found, F.filter(local, lambda d: d.isNotNull())))


def match_bucket(n: Column) -> Column:
    return F.when(n <= 3, n.cast("string")).when(n <= 6, "4-6").otherwise("7+")


def url_or_handle(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(URL))


def script_class(text: Column) -> Column:
    latin, deva = F.rlike(text, F.lit(r"\p{IsLatin}")), F.rlike(text, F.lit(r"\p{IsDevanagari}"))
    return F.when(latin & deva, "mixed").when(deva, "devanagari").when(latin, "latin").otherwise("other")


def hash_split(identifier: Column) -> Column:
    """0 or 1: the parity of the first byte of the id's SHA-256."""
    return (F.conv(F.substring(F.sha2(identifier.cast("binary"), 256), 1, 2), 16, 10).cast("int") % 2).cast("int")


def soundex_code(token: Column) -> Column:
    """Letter and three digits. Vowels, h, w and y end a repeat; the first letter's own digit does not start one."""
    letters = F.regexp_replace(F.lower(F.coalesce(token, F.lit(""))), "[^a-z]", "")
    codes = F.translate(F.substring(letters, F.lit(2), F.char_length(letters)), "bfpvcgjkqsxzdtlmnraeiouhwy", "111122222222334556" + "0" * 8)
    return F.when(letters == "", "").otherwise(F.rpad(F.substring(F.concat(F.upper(F.substring(letters, 1, 1)), F.replace(F.regexp_replace(codes, r"(.)\1+", "$1"), F.lit("0"), F.lit(""))), 1, 4), 4, "0"))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared(a, b) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """The same of two arrays without repeats."""
    both = shared(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that lies in the larger; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, shared(a, b) / least).otherwise(F.lit(0.0))


def length_gap(a: Column, b: Column) -> Column:
    x, y = F.char_length(a), F.char_length(b)
    return F.abs(x - y) / F.greatest(x, y, F.lit(1))
