"""String similarities by common subsequences, as Arrow-batched UDFs over distinct pairs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUZZY = "name_token_set double, name_token_sort double, name_ratio double, name_partial_ratio double, name_prefix_similarity double, name_jaro_winkler double, addr_token_set double, addr_token_sort double, addr_ratio double, addr_jaro_winkler double"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine-word operation a character (Hyyro, 2004)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """2 x common / total length; two empty strings are equal."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of what both share against what either adds; 1 if one adds nothing, 0 if one is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 1.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = ratio(left, right)
    if both:
        n = len(both)
        best = max(best, 2 * n / (n + len(left)), 2 * n / (n + len(right)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, a tenth of the gap to 1 added for each of up to four common first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    # Windows only move on, so each letter's places in b are passed once.
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        at = places.get(c, [])
        while at and at[-1] < i - reach:
            at.pop()
        if at and at[-1] <= i + reach:
            free[at.pop()] = False
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if not free[j]]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _over_pairs(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        cached = lru_cache(1 << 16)(f)
        return pd.Series([cached(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


ratio_udf, token_sort_udf, token_set_udf, partial_ratio_udf, jaro_winkler_udf = map(_over_pairs, (ratio, token_sort, token_set, partial_ratio, jaro_winkler))


@F.pandas_udf(T.StructType([T.StructField(c.split()[0], T.DoubleType()) for c in FUZZY.split(", ")]))
def fuzzy_features(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    """All fuzzy features of name and address pairs in one pass; address values are 0 without a target address."""
    one = lru_cache(1 << 15)(lambda x, y: (token_set(x, y), token_sort(x, y), ratio(x, y), partial_ratio(x, y), ratio(x[:6], y[:6]) if x and y else 0.0, jaro_winkler(x, y)))
    two = lru_cache(1 << 15)(lambda x, y: (token_set(x, y), token_sort(x, y), ratio(x, y), jaro_winkler(x, y)) if y else (0.0,) * 4)
    return pd.DataFrame([one(a, b) + two(c, d) for a, b, c, d in zip(n1, n2, a1, a2, strict=True)], columns=[c.split()[0] for c in FUZZY.split(", ")], dtype="float64")


@F.pandas_udf(T.StringType())
def clean_unicode_exact(text: pd.Series) -> pd.Series:
    """Accents and compatibility forms folded for every code point; the slow form of ``text.clean_unicode``."""

    def clean(s: str | None) -> str:
        if not s:
            return ""
        if any(0x0900 <= ord(c) <= 0x0D7F for c in s):
            return unicodedata.normalize("NFKC", s)
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return text.map(clean)
