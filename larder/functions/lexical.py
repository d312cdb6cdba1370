"""Lexical similarity of two texts as column expressions. Null on either side gives null, unless a blank side is defined as 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import fuzzy
from larder.functions.text import set_jaccard as jaccard
from larder.functions.text import words


def _blank(a: Column, b: Column) -> Column:
    return (F.trim(a) == "") | (F.trim(b) == "")


def similarity(a: Column, b: Column) -> Column:
    """L1, L2: one less the Levenshtein distance over the longer length; a blank side gives 0."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(_blank(a, b), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def token_jaccard(a: Column, b: Column) -> Column:
    """L3: words in lower case, punctuation kept."""
    return jaccard(token_set(a), token_set(b))


def shared_tokens(a: Column, b: Column) -> Column:
    """L4: sorted words that both have."""
    return F.array_sort(F.array_intersect(token_set(a), token_set(b)))


def common_substring_ratio(a: Column, b: Column) -> Column:
    """Length of the longest common substring over the shorter length; a blank side gives 0."""
    got = F.length(fuzzy.longest_common_substring(F.lower(a), F.lower(b)))
    return F.when(_blank(a, b), F.lit(0.0)).otherwise(got / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that both begin with, whatever the case."""
    x, y = F.lower(a), F.lower(b)
    n = F.least(F.length(x), F.length(y))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))
    return F.size(at)


def shared_suffix(a: Column, b: Column) -> Column:
    """L8."""
    return shared_prefix(F.reverse(a), F.reverse(b))


def char_grams(c: Column, n: int) -> Column:
    """Set of n-grams of letters in lower case; empty for shorter texts."""
    letters = F.split(F.lower(c), "")
    # The array beside itself, moved on by one letter each time: no lambda looks back at the text.
    grams = letters
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(letters, F.lit(k + 1), F.size(letters)), lambda x, y: F.concat(x, y))
    return F.when(c.isNotNull(), F.array_distinct(F.filter(grams, lambda x: x.isNotNull() & (x != ""))))


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    """Shared over all n-grams of two texts in lower case; 0 where one has none. Sets of slices in Arrow batches are
    several times faster than lambdas over arrays of letters."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            p, q = ({z[i : i + n] for i in range(len(z) - n + 1)} if z else set() for z in (s, t))
            both = len(p & q)
            out.append(both / (len(p) + len(q) - both) if both else 0.0)
        return pd.Series(out, dtype=float)

    return f(F.lower(a), F.lower(b))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length; 0 if both are empty."""
    return F.coalesce(F.least(F.length(a), F.length(b)) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def contains(a: Column, b: Column) -> Column:
    """B stands in a, whatever the case."""
    return F.lower(a).contains(F.lower(b))


def sounds_alike(a: Column, b: Column) -> Column:
    """Equal Soundex keys."""
    return F.soundex(a) == F.soundex(b)


def phonetic_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of phonetic keys."""
    return fuzzy.jaro_winkler_similarity(fuzzy.phonetic_key(a), fuzzy.phonetic_key(b))
