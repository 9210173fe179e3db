"""Transliteration of Indic scripts and a metaphone code, as Column expressions.

The nine scripts share one layout of their Unicode blocks, so all are first shifted onto one
block; a letter table for that block then serves them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlake.functions.text import compact_alnum, has_indic_script, initials, phones, soundex_code

_BLOCKS = [0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00]
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ~n ch chh j jh ~n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(), strict=True))
_VOWELS = dict(zip(range(0x05, 0x15), "a aa i ii u uu rr ll e e e ai o o o au".split(), strict=True))
_SIGNS = dict(zip(range(0x3E, 0x4D), "aa i ii u uu rr rr e e e ai o o o au".split(), strict=True))
_MARKS = {0x01: "n", 0x02: "m", 0x03: "h", 0x3C: "", 0x3D: "", 0x4D: "", 0x50: "om", 0x64: " ", 0x65: " "}


def transliterate(text: Column) -> Column:
    """Latin letters for Indic ones, lower case; empty if the text has none."""
    source = "".join(chr(b + o) for b in _BLOCKS[1:] for o in range(0x80))
    target = "".join(chr(0x0900 + o) for _ in _BLOCKS[1:] for o in range(0x80))
    s = F.translate(F.coalesce(text, F.lit("")), source, target)
    # A consonant keeps its inherent a unless a vowel sign or a virama follows.
    s = F.regexp_replace(s, "([क-ह]़?)(?![़ा-्])", "$1a")
    letters = _CONSONANTS | _VOWELS | _SIGNS | _MARKS
    s = reduce(lambda c, x: F.replace(c, F.lit(chr(0x0900 + x[0])), F.lit(x[1].replace("~", ""))), letters.items(), s)
    s = F.translate(s, "".join(chr(0x0966 + i) for i in range(10)), "0123456789")
    return F.when(has_indic_script(text), F.lower(s)).otherwise(F.lit(""))


def clean_transliteration(text: Column) -> Column:
    return F.trim(F.regexp_replace(transliterate(text), "[^a-z0-9 ]", " "))


#: Spelling to sound, in this order, on lower-case letters; capitals are finished sounds.
_SOUNDS = [
    (r"^(?:kn|gn|pn|wr|ps)", "N"), (r"^x", "S"), (r"^wh", "W"), (r"mb$", "M"), (r"sch", "SK"), (r"tch", "X"), (r"(?:ch|sh)", "X"), (r"ph", "F"), (r"th", "0"),
    (r"(?:tia|tio)", "Xa"), (r"(?:sia|sio)", "Xa"), (r"gh(?=[aeiou])", "K"), (r"gh", ""), (r"dg(?=[eiy])", "J"), (r"c(?=[eiy])", "S"), (r"ck", "K"), (r"g(?=[eiy])", "J"),
    (r"q", "K"), (r"x", "KS"), (r"[cgk]", "K"), (r"[dt]", "T"), (r"[bp]", "P"), (r"[fv]", "F"), (r"z", "S"), (r"s", "S"), (r"j", "J"), (r"l", "L"), (r"m", "M"), (r"n", "N"), (r"r", "R"),
    (r"^[aeiou]+", "A"), (r"w(?=[aeiou])", "W"), (r"y(?=[aeiou])", "Y"), (r"h(?=[aeiou])", "H"), (r"[a-z]", ""), (r"(.)\1+", "$1"),
]


def metaphone(token: Column) -> Column:
    """A sound code of the letters a-z, lower case, of at most four sounds; our own rules in the manner of metaphone."""
    s = F.regexp_replace(F.lower(F.coalesce(token, F.lit(""))), "[^a-z]", "")
    return F.lower(F.substring(reduce(lambda c, x: F.regexp_replace(c, *x), _SOUNDS, s), 1, 4))


def with_sounds(prepared: "DataFrame") -> "DataFrame":  # noqa: F821
    """Prepared records with tr_name, phon_query, phon_index (the target side also files confused v/b and m/n) and tr_phon, the codes of tr_name."""
    long = lambda c: F.filter(c, lambda t: F.char_length(t) >= 3)
    codes = lambda c: F.array_distinct(F.filter(F.transform(long(c), metaphone), lambda x: x != ""))
    tr = F.filter(F.split("tr_name", " "), lambda t: t != "")
    swapped = lambda a, b: F.transform(tr, lambda t: F.replace(t, F.lit(a), F.lit(b)))
    out = prepared.withColumn("tr_name", clean_transliteration(F.col("name")))
    query = F.filter(F.transform(long(F.array_distinct("core")), metaphone), lambda x: x != "")
    return out.withColumns({"phon_query": query, "tr_phon": codes(tr), "phon_index": F.array_distinct(F.concat(codes(F.col("core")), codes(tr), codes(swapped("v", "b")), codes(swapped("m", "n"))))})


def name_views(prepared: "DataFrame") -> "DataFrame":  # noqa: F821
    """Every spelling of a record's name under which it may be found: (id, norm, translit, translit_tokens, compact, initials, phonetic, soundex)."""
    p, core = with_sounds(prepared), F.col("core")
    soundex = F.transform(F.filter(core, lambda t: F.char_length(t) >= 3), soundex_code)
    return p.select(
        "id", F.col("norm_name").alias("norm"), F.col("tr_name").alias("translit"), F.filter(F.split("tr_name", " "), lambda t: F.char_length(t) >= 2).alias("translit_tokens"),
        compact_alnum(F.col("norm_name")).alias("compact"), initials(core).alias("initials"), F.filter(F.transform(core, metaphone), lambda x: x != "").alias("phonetic"), soundex.alias("soundex"),
    )


def address_views(prepared: "DataFrame") -> "DataFrame":  # noqa: F821
    """The same of its address: (id, norm, translit, compact, phones)."""
    return prepared.select("id", F.col("norm_addr").alias("norm"), clean_transliteration(F.col("addr")).alias("translit"), compact_alnum(F.col("norm_addr")).alias("compact"), phones(F.col("addr")).alias("phones"))
