"""String scorers that Spark lacks, from their published definitions: LCS and indel ratio, token ratios, Jaro-Winkler, a phonetic key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & mask
    return (~s & mask).bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity, 0 to 100; two empty strings give 100."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs_length(a, b) / n


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    left, right = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    return max(ratio(left, right), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0)


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of its length, or a shorter one at its ends."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 0.0
    best = max(ratio(a, b[i : i + n]) for i in range(len(b) - n + 1))
    for k in range(n - 1, 0, -1):
        if 200.0 * k / (n + k) <= best:
            break
        best = max(best, ratio(a, b[:k]), ratio(a, b[-k:]))
    return best


def weighted(a: str, b: str, least: float = 0.0) -> float:
    """Composite: plain and token ratios for strings of like length, partial ones, discounted, for others. 0 if a side is empty.

    Exact where it is at or above `least`; below, it may be less than the composite.
    """
    if not a or not b:
        return 0.0
    low, high = sorted((len(a), len(b)))
    common = lcs_length(a, b)
    best = 200.0 * common / (low + high)
    if high < 1.5 * low:
        return max(best, 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if high < 8 * low else 0.6
    x, y = set(a.split()), set(b.split())
    if x & y:
        best = max(best, 95.0 * scale)
    else:
        for p, q in {(" ".join(sorted(p)), " ".join(sorted(q))) for p, q in ((x, y), (a.split(), b.split()))}:
            if min(len(p), len(q)) and 0.95 * scale * _most(lcs_length(p, q), min(len(p), len(q))) >= max(best, least):
                best = max(best, 0.95 * scale * partial(p, q))
    return max(best, scale * partial(a, b)) if scale * _most(common, low) >= max(best, least) else best


def _most(common: int, short: int) -> float:
    """The most that a stretch no longer than the shorter string can give: their common subsequence agrees at best."""
    return 200.0 * common / (short + common) if common else 0.0


class Weighted:
    """weighted() of one string against all of a list at once.

    Plain and sorted strings are compared by bit-parallel subsequences, one bit for each character, over the whole list.
    They give the score itself, or, where stretches or common words enter, a bound that leaves out only what stays below
    the cutoff; the stretches of the rest are compared in the same way, all together. Strings beyond 64 characters or
    with repeated words are scored one by one.
    """

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        words = [s.split() for s in strings]
        self.sets = [frozenset(w) for w in words]
        in_order = [" ".join(sorted(w)) for w in words]
        self.size = np.array([len(s) for s in strings], np.int64)
        self.sorted_size = np.array([len(s) for s in in_order], np.int64)
        self.single = np.array([0 < len(s) <= 64 and len(w) == len(t) and len(o) == len(s) for s, w, t, o in zip(strings, words, self.sets, in_order)], bool)
        self.full = np.array([(1 << min(64, len(s))) - 1 for s in strings], np.uint64)
        self.letter = {c: i for i, c in enumerate(sorted({c for s in strings for c in s}), 1)}  # 0: no letter of the list
        self.codes = self._codes(strings), self._codes(in_order)
        self.bits = self._bits(self.codes[0]), self._bits(self.codes[1])
        self.holding: dict[str, list[int]] = {}
        for i, w in enumerate(self.sets):
            for x in w:
                self.holding.setdefault(x, []).append(i)

    def _codes(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), 64), np.int32)
        for i, s in enumerate(strings):
            out[i, : len(s)] = [self.letter[c] for c in s[:64]]
        return out

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        """Where each letter stands in each string (letters x strings)."""
        out = np.zeros((len(self.letter) + 1, len(codes)), np.uint64)
        for j in range(codes.shape[1]):
            out[codes[:, j], np.arange(len(codes))] |= np.uint64(1 << j)
        out[0] = 0
        return out

    def _common(self, text: str, bits: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence with each string."""
        return _subsequence((bits[i] for c in text if (i := self.letter.get(c))), self.full)

    def _stretches(self, text: str, places: np.ndarray, kind: int) -> np.ndarray:
        """partial() with the plain (0) or sorted (1) strings of these places; text of at most 64 characters."""
        codes, bits = self.codes[kind], self.bits[kind]
        ids = np.array([self.letter.get(c, 0) for c in text])
        own = np.zeros(len(self.letter) + 1, np.uint64)
        for j, i in enumerate(ids):
            own[i] |= np.uint64(1 << j)
        own[0] = 0
        m, n = self.size[places], len(text)
        short, long = np.minimum(m, n), np.maximum(m, n)
        inner, ends = long - short + 1, short - 1
        pair = np.concatenate([np.repeat(np.arange(len(places)), k) for k in (inner, ends, ends)])
        no = np.concatenate([np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) for k in (inner, ends, ends)])
        whole, tail = np.arange(len(pair)) < inner.sum(), np.arange(len(pair)) >= inner.sum() + ends.sum()
        length = np.where(whole, short[pair], no + 1)
        start = np.where(whole, no, np.where(tail, long[pair] - length, 0))
        best = np.zeros(len(places))
        for text_is_short in (True, False):
            pick = np.flatnonzero((m >= n)[pair] == text_is_short)
            if not len(pick):
                continue
            at, first, size = places[pair[pick]], start[pick], length[pick]

            def masks():
                for j in range(int(size.max())):
                    where = np.minimum(first + j, 63)
                    got = own[codes[at, where]] if text_is_short else bits[ids[np.minimum(where, n - 1)], at]
                    yield np.where(j < size, got, np.uint64(0))

            full = np.full(len(pick), (1 << n) - 1, np.uint64) if text_is_short else self.full[at]
            np.maximum.at(best, pair[pick], 200.0 * _subsequence(masks(), full) / (short[pair[pick]] + size))
        return best

    def _by_words(self, mine: set[str], i: int) -> float:
        """token_set() of strings that have a word in common and none twice."""
        both, a, b = sorted(mine & self.sets[i]), sorted(mine - self.sets[i]), sorted(self.sets[i] - mine)
        if not a or not b:
            return 100.0
        k, x, y = len(" ".join(both)), " ".join(a), " ".join(b)
        p, q = k + 1 + len(x), k + 1 + len(y)  # the common words stand in front of both
        return max(200.0 * (k + 1 + lcs_length(x, y)) / (p + q), 200.0 * k / (k + p), 200.0 * k / (k + q))

    def __call__(self, text: str, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the strings at or above the cutoff."""
        if not text or not self.strings:
            return (np.arange(len(self.strings)), np.zeros(len(self.strings))) if cutoff <= 0 else (np.zeros(0, int), np.zeros(0))
        words, n = text.split(), len(text)
        in_order = " ".join(sorted(words))
        mine, m = set(words), self.size
        low, high = np.minimum(n, m), np.maximum(n, m)
        far, scale = high >= 1.5 * low, np.where(high < 8 * low, 0.9, 0.6)
        plain, by_word = self._common(text, self.bits[0]), self._common(in_order, self.bits[1])
        score = 200.0 * plain / (n + m)
        shared = np.zeros(len(m), bool)
        for w in mine:
            shared[self.holding.get(w, [])] = True
        odd = ~self.single | (len(mine) < len(words)) | (len(in_order) != n) | (n > 64)
        score = np.where(far, score, np.maximum(score, 0.95 * 200.0 * by_word / np.maximum(1, len(in_order) + self.sorted_size)))
        score = np.where(far & shared, np.maximum(score, 95.0 * scale), score)

        def more(worth: np.ndarray, found) -> None:
            # Of a stretch no longer than the shorter string at most the common subsequence agrees.
            at = np.flatnonzero(far & ~odd & (worth > score) & (worth >= cutoff))
            if len(at):
                score[at] = np.maximum(score[at], found(at))

        most = lambda k: 200.0 * k / np.maximum(1, low + k)
        more(scale * most(plain), lambda at: scale[at] * self._stretches(text, at, 0))
        more(np.where(shared, 0.0, 0.95 * scale * most(by_word)), lambda at: 0.95 * scale[at] * self._stretches(in_order, at, 1))
        for i in np.flatnonzero(shared & ~far & ~odd).tolist():
            score[i] = max(score[i], 0.95 * self._by_words(mine, i))
        for i in np.flatnonzero(odd).tolist():
            score[i] = weighted(text, self.strings[i], cutoff)
        at = np.flatnonzero(score >= cutoff)
        return at, score[at]


def _subsequence(masks, full: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences; masks: for each character of one side where it stands in the other."""
    s = np.full(len(full), ~np.uint64(0))
    for m in masks:
        u = s & m
        s = (s + u) | (s - u)
    return np.bitwise_count(~s & full).astype(np.int64)


def common_substring(a: str, b: str) -> str:
    """The longest common substring, the first in a of several. Its length is found by halving, as all shorter ones are common too."""
    low, high, best = 0, min(len(a), len(b)), ""
    while low < high:
        n = (low + high + 1) // 2
        there = {b[j : j + n] for j in range(len(b) - n + 1)}
        got = next((a[i : i + n] for i in range(len(a) - n + 1) if a[i : i + n] in there), None)
        if got is None:
            high = n - 1
        else:
            low, best = n, got
    return best


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * boost * (1 - jaro)


def phonetic(word: str) -> str:
    """A key of how an English word sounds: consonants by sound, vowels only in front."""
    w = "".join(c for c in word.lower() if c.isalpha())
    for a, b in (("ough", "f"), ("tch", "x"), ("sch", "sk"), ("ph", "f"), ("gh", ""), ("kn", "n"), ("wr", "r"), ("ck", "k"), ("sh", "x"), ("ch", "x"), ("th", "0"), ("qu", "kw"), ("x", "ks") if not w.startswith("x") else ("x", "s")):
        w = w.replace(a, b)
    out = ""
    for i, c in enumerate(w):
        after = w[i + 1 : i + 2]
        c = "s" if c == "c" and after and after in "eiy" else "k" if c in "cq" else "j" if c == "g" and after and after in "eiy" else "k" if c == "g" else "f" if c == "v" else "s" if c == "z" else "t" if c == "d" else c
        if c in "aeiou" and i or c in "hwy" and i:
            continue
        if not out or out[-1] != c:
            out += c
    return out


def _pairs(f, kind):
    @F.pandas_udf(kind)
    def g(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return g


weighted_ratio = _pairs(weighted, DoubleType())
indel_ratio = _pairs(ratio, DoubleType())
longest_common_substring = _pairs(common_substring, StringType())
jaro_winkler_similarity = _pairs(jaro_winkler, DoubleType())


@F.pandas_udf(StringType())
def phonetic_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(phonetic(w) for w in x.split()))
