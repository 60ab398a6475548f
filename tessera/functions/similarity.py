"""Similarity of names, as columns. All but Jaro-Winkler, which Spark has no function for, stay in the JVM."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .naming import strip_prefix

# Weights of the parts of the compound score, and what a match must exceed.
JARO_WINKLER, LEVENSHTEIN, BIGRAM, CONTAINED = 0.45, 0.30, 0.25, 0.1
LEAST = 0.4


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with a prefix bonus of 0.1 for each of up to four equal first letters, whatever the Jaro part."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    places: dict[str, list[int]] = defaultdict(list)
    for j, ch in enumerate(b):
        places[ch].append(j)
    used_a, used_b = [], []
    for i, ch in enumerate(a):
        j = next((j for j in places[ch] if abs(i - j) <= reach), None) if reach >= 0 else None
        if j is not None:
            places[ch].remove(j)
            used_a.append(i)
            used_b.append(j)
    m = len(used_a)
    if not m:
        return 0.0
    swapped = sum(a[i] != b[j] for i, j in zip(used_a, sorted(used_b), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3.0
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return jaro + same * 0.1 * (1.0 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def grams(a: Column, n: int = 2) -> Column:
    """Distinct n-grams; none for shorter strings."""
    return F.when(F.length(a) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(a) - (n - 1)), lambda i: F.substring(a, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column, n: int = 2) -> Column:
    """Dice coefficient of the n-gram sets; 0 if either string is shorter than n."""
    x, y = grams(a, n), grams(b, n)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def compound(query: Column, candidate: Column) -> Column:
    """1 for equal strings, 0.95 but for case, else the weighted sum of the three similarities of the lower-case
    strings, with a bonus for a candidate that contains the query."""
    q, c = F.lower(query), F.lower(candidate)
    score = jaro_winkler(q, c) * JARO_WINKLER + levenshtein_similarity(q, c) * LEVENSHTEIN + dice(q, c) * BIGRAM
    inside = F.when(F.contains(c, q) & (F.length(c) > 0), F.least(F.lit(1.0), score + CONTAINED * (F.length(q) / F.length(c)))).otherwise(score)
    return F.when(query == candidate, 1.0).when(q == c, 0.95).otherwise(inside)


def most_compound(query: Column, candidate: Column) -> Column:
    """No less than ``compound``, from columns of the JVM alone: the Jaro part takes at most the letters of each that the other has,
    and the prefix bonus needs an equal first letter."""
    q, c = F.lower(query), F.lower(candidate)
    held = lambda a, b: F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    m = F.least(held(q, c), held(c, q))
    jaro = F.when(m > 0, (m / F.length(q) + m / F.length(c) + 1.0) / 3.0).otherwise(F.lit(0.0))
    jaro = F.when(F.substring(q, 1, 1) == F.substring(c, 1, 1), jaro + 0.4 * (1.0 - jaro)).otherwise(jaro)
    jaro = F.when(q == c, 1.0).otherwise(jaro)
    inside = F.when(F.contains(c, q), CONTAINED).otherwise(F.lit(0.0))
    return jaro * JARO_WINKLER + levenshtein_similarity(q, c) * LEVENSHTEIN + dice(q, c) * BIGRAM + inside


def may_match(query: Column, candidate: Column) -> Column:
    """False only where ``match_quality`` is 0: a filter in the JVM before the one function that needs Python."""
    qs, cs = strip_prefix(query), strip_prefix(candidate)
    return (F.lower(qs) == F.lower(cs)) | (F.greatest(most_compound(query, candidate), most_compound(qs, cs)) > LEAST - 1e-9)


def match_quality(query: Column, candidate: Column, fuzzy: bool = True) -> Column:
    """1 for equal names (case aside), 0.9 if they are equal without their prefixes, else 0, or with ``fuzzy`` the
    better compound score, with or without prefixes, if it exceeds LEAST."""
    qs, cs = strip_prefix(query), strip_prefix(candidate)
    exact = F.when(F.lower(query) == F.lower(candidate), 1.0).when(F.lower(qs) == F.lower(cs), 0.9)
    if not fuzzy:
        return exact.otherwise(F.lit(0.0))
    best = F.greatest(compound(query, candidate), compound(qs, cs))
    return exact.otherwise(F.when(best > LEAST, best).otherwise(F.lit(0.0)))
