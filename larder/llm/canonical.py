"""Free-entered values mapped to a reference list.

A multi-pattern automaton over the list's names and aliases finds the names embedded in a value, an index of their
sorted words those that stand there in another order; the longest that don't overlap win. A value is settled if they
leave nothing but modifiers: words that no name has and that stand beside many different names of the list, learned from
all values. The rest goes to token-set similarity: words agree if they are equal, one edit apart or an abbreviation, and
a value and a name agree if all their words can be paired; names are also compared as one string in any order of their
words, one edit apart, for words run together or cut apart.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.lookalike import Plain
from larder.operators.packed import NAMES, Style, split_array

#: Rows and characters that a reference list may have: it goes to every executor. Larger lists are refused.
MOST_TERMS, MOST_LETTERS = 200_000, 1 << 27
#: Different terms beside whose names a word must stand before it counts as a modifier, and their least share of all terms that have such words.
BESIDE, BESIDE_SHARE = 3, 0.02
#: Price of what doesn't agree; agreeing words cost less.
APART = 9.0
#: What replaces the name of a value that is not in the list.
NONE = "NONE"
_TOKEN = re.compile(r"[^\W_]+")


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("oes", "ches", "shes", "xes", "sses")):
        return word[:-2]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def words_of(text: str) -> list[str]:
    """Words without accents, in lower case."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))
    return _TOKEN.findall(flat)


def tokens(text: str) -> list[str]:
    """Words without accents, in lower case and singular."""
    return [singular(w) for w in words_of(text)]


def one_edit(a: str, b: str) -> float:
    """Price of the edit between strings one edit apart (insertion, deletion, substitution or swap of neighbours), else 9.
    Swaps, losses and doubled letters are likelier than a foreign letter."""
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return 9.0
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        if a[i + 1 :] == b[i + 1 :]:
            return 1.2
        return 1.0 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 9.0
    if n < m:  # a lacks a letter of b
        return 1.0 if a[i:] == b[i + 1 :] else 9.0
    if a[i + 1 :] == b[i:]:
        return 1.0 if i and a[i] == a[i - 1] else 1.2
    return 9.0


def abbreviates(short: str, word: str) -> bool:
    """short begins like word and is a beginning of three letters or more, or drops vowels alone."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if len(short) >= 3 and word.startswith(short):
        return True
    i = 0
    for c in word:
        if i < len(short) and short[i] == c:
            i += 1
        elif c not in "aeiou":
            return False
    return i == len(short)


class Matcher:
    """match(value) gives the code and how it was found. names: (code, name) pairs; modifiers: words that change nothing."""

    def __init__(self, names: list[tuple[str, str]], modifiers: frozenset[str] = frozenset()) -> None:
        import ahocorasick

        self.modifiers, self.plain, self.memo, self.agree = modifiers, Plain(), {}, {}
        self.sets: dict[tuple[str, ...], str] = {}
        freq: dict[str, set[str]] = defaultdict(set)
        self.find = ahocorasick.Automaton()
        for code, name in sorted(names, key=lambda x: (len(x[1]), x)):
            plain = self.plain(name)
            texts = [plain, re.sub(r"\(.*?\)", " ", plain)] if "(" in name else [plain]
            for v in (f(x) for x in texts for f in (tokens, words_of)):
                if not v or (key := tuple(sorted(v))) in self.sets:
                    continue
                self.sets[key] = code
                for w in v:
                    freq[w].add(code)
                self.find.add_word(f" {' '.join(v)} ", (code, len(v)))
        if len(self.find):
            self.find.make_automaton()
        self.vocabulary = set(freq)
        self.longest = max((sum(map(len, key)) for key in self.sets), default=0) + 1
        self.sizes = sorted({len(key) for key in self.sets}, reverse=True)
        self.having: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        # Names by their letters in alphabetical order, whole and with one letter lost, whatever the order of their words.
        self.letters: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        self.loss: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for key in self.sets:
            for w in set(key):
                self.having[w].append(key)
            flat = "".join(sorted("".join(key)))
            self.letters[flat].append(key)
            if len(flat) > 3 and not any(c.isdigit() for c in flat):
                for x in _losses(flat):
                    self.loss[x].append(key)
        self.common = {w for w, codes in freq.items() if len(codes) >= 12}
        self.starts: dict[str, list[str]] = defaultdict(list)
        self.word_loss: dict[str, set[str]] = defaultdict(set)
        for w in sorted(self.vocabulary):
            if len(w) > 3:
                self.starts[w[0]].append(w)
            if len(w) > 2 and not any(c.isdigit() for c in w):
                for x in _losses(w):
                    self.word_loss[x].add(w)

    def match(self, value: str | None) -> tuple[str, str]:
        if not value:
            return NONE, "none"
        got = self.memo.get(value)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self._match(value)
            if len(value) < 300:
                self.memo[value] = got
        return got

    def _match(self, value: str) -> tuple[str, str]:
        words = tokens(self.plain(value))
        if not words or not len(self.find):
            return NONE, "none"
        found = self.mentions(words)
        codes = {code for code, _, _ in found}
        if len(codes) == 1 and not self.remainder(words, found):
            return codes.pop(), "mention"
        kept = [w for w in words if w not in self.modifiers]
        if not kept:
            return NONE, "none"
        if any(c.isdigit() for w in kept for c in w):
            code = self.joined(kept)
            return (code, "joined") if code else (NONE, "none")
        got = self.similar(kept)
        if got[0] == NONE:  # a slip in the ending may have misled the singular
            whole = [w for w in words_of(self.plain(value)) if singular(w) not in self.modifiers]
            got = self.similar(whole) if whole != kept else got
        return got

    def evidence(self, value: str | None) -> list[tuple[str, str]]:
        """(word, code): words of the value that no name has, beside the one term that it mentions, unless a slip explains them."""
        words = tokens(self.plain(value)) if value else []
        if not words or not len(self.find):
            return []
        found = self.mentions(words)
        codes = {code for code, _, _ in found}
        beside = {w for w in self.remainder(words, found) if w not in self.vocabulary and not any(c.isdigit() for c in w)}
        if len(codes) != 1 or not beside or self.similar(words)[0] != NONE:
            return []
        whole = words_of(self.plain(value))
        if whole != words and self.similar(whole)[0] != NONE:
            return []
        code = codes.pop()
        return [(w, code) for w in sorted(beside)]

    def mentions(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(code, words, first word) of the longest names that don't overlap, in any order of their words."""
        text, number, at = f" {' '.join(words)} ", {}, 0
        for i, w in enumerate(words):
            at += len(w) + 1
            number[at] = i  # where the blank behind word i stands
        hits = {(n, number[end] - n + 1, code) for end, (code, n) in self.find.iter(text)}
        known = [w in self.vocabulary for w in words]
        for n in self.sizes:
            for first in range(len(words) - n + 1) if n > 1 else ():
                if all(known[first : first + n]) and (code := self.sets.get(tuple(sorted(words[first : first + n])))):
                    hits.add((n, first, code))
        taken: set[int] = set()
        out = []
        for n, first, code in sorted(hits, key=lambda h: (-h[0], h[1], h[2])):
            if taken.isdisjoint(range(first, first + n)):
                taken.update(range(first, first + n))
                out.append((code, n, first))
        return out

    def remainder(self, words: list[str], found: list[tuple[str, int, int]]) -> list[str]:
        taken = {i for _, n, first in found for i in range(first, first + n)}
        return [w for i, w in enumerate(words) if i not in taken and w not in self.modifiers]

    def joined(self, words: list[str]) -> str | None:
        """The code of a name of the same letters whose words, in some order, run together like these in some order."""
        for key in self.letters.get("".join(sorted("".join(words))), ()):
            if _same_run(tuple(sorted(words)), key):
                return self.sets[key]
        return None

    def agreeing(self, word: str) -> dict[str, float]:
        """Words of the list that agree with a word, with the price of each."""
        got = self.agree.get(word)
        if got is None:
            if len(self.agree) > 50_000:
                self.agree.clear()
            got = self.agree[word] = {word: 0.0} if word in self.vocabulary else {}
            for v in {v for x in _losses(word) for v in self.word_loss.get(x, ())} if 2 < len(word) <= self.longest else ():
                if (price := one_edit(word, v)) < APART:
                    got[v] = min(price, got.get(v, APART))
            for v in self.starts.get(word[0], ()):
                if abbreviates(word, v):
                    got[v] = min(0.9 if v in self.common else 1.1, got.get(v, APART))
        return got

    def similar(self, words: list[str]) -> tuple[str, str]:
        if code := self.joined(words):
            return code, "joined"
        best: tuple[float, str] | None = None
        glued = "".join(words)
        if 3 < len(glued) <= self.longest:
            near = {key for x in _losses("".join(sorted(glued))) for key in self.loss.get(x, ())}
            run = min((got for key in near if (got := _run_price(glued, key))[0] < APART), default=None)
            if run:
                best = (run[0], self.sets[run[2]])
        options = [self.agreeing(w) for w in words]
        # Names that have as many words and, for each word of the value, one that agrees with it.
        near = None
        for mine in options:
            here = {key for v in mine for key in self.having[v] if len(key) == len(words)}
            near = here if near is None else near & here
            if not near:
                break
        for key in near or ():
            price = paired([[o.get(v, APART) for v in key] for o in options])
            if price < APART and (best is None or (price, self.sets[key]) < best):
                best = (price, self.sets[key])
        return (best[1], "similar") if best else (NONE, "none")


def _losses(s: str) -> set[str]:
    """s, and s without each of its letters."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def _same_run(left: tuple[str, ...], right: tuple[str, ...], rest: str = "") -> bool:
    """Whether two piles of words, each in some order, run together to one string. rest: what the right pile still has to match."""
    if not rest:
        if not left:
            return not right
        return any(_same_run(left[:i] + left[i + 1 :], right, w) for i, w in enumerate(left) if w not in left[:i])
    for i, w in enumerate(right):
        if w in right[:i]:
            continue
        if rest.startswith(w):
            if _same_run(left, right[:i] + right[i + 1 :], rest[len(w) :]):
                return True
        elif w.startswith(rest) and _same_run(right[:i] + right[i + 1 :], left, w[len(rest) :]):
            return True
    return False


def _run_price(glued: str, words: tuple[str, ...]) -> tuple[float, str, tuple[str, ...]]:
    """The least price of an edit between glued and the words run together in some order, that run, and the words."""
    best = (APART, "", words)

    def go(run: str, left: tuple[str, ...]) -> None:
        nonlocal best
        if not left:
            best = min(best, (one_edit(glued, run), run, words))
            return
        for i, w in enumerate(left):
            if w not in left[:i]:
                more = run + w
                if min(one_edit(glued[: len(more) + d], more) for d in (-1, 0, 1)) < APART:
                    go(more, left[:i] + left[i + 1 :])

    go("", words)
    return best


def paired(cost: list[list[float]]) -> float:
    """The least sum of a pairing of rows with columns (as many), by shortest augmenting paths; APART if one must pair at APART."""
    n = len(cost)
    far = APART * (n + 1)  # one pair that doesn't agree outweighs all others
    price = [[far if c >= APART else c for c in row] for row in cost]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[at]:
            used[at], row, step, go = True, match[at], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    slack = price[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, at
                    if least[j] < step:
                        step, go = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = go
        while at:
            match[at] = match[way[at]]
            at = way[at]
    total = sum(price[match[j] - 1][j - 1] for j in range(1, n + 1))
    return total if total < far else APART


def reference_names(terms: DataFrame, code: str, name: str, aliases: str | None, style: Style = NAMES) -> list[tuple[str, str]]:
    """(code, name) of names and aliases of a list of at most MOST_TERMS rows and MOST_LETTERS characters; rows without code or name are left out."""
    cols = [code, name, *([aliases] if aliases else [])]
    few = terms.select(*(F.col(c).cast("string") for c in cols)).where(F.col(code).isNotNull())
    size = few.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(F.concat_ws("", *cols))), F.lit(0)).alias("letters")).head()
    if size["rows"] > MOST_TERMS or size["letters"] > MOST_LETTERS:
        raise ValueError(f"the reference list has {size['rows']} rows of {size['letters']} characters; {MOST_TERMS} and {MOST_LETTERS} can be held")
    rows = few.orderBy(code).toPandas()
    out = [(c, n) for c, n in zip(rows[code], rows[name]) if isinstance(n, str)]
    if aliases:
        parent, _, values = split_array(pa.array([x if isinstance(x, str) else None for x in rows[aliases]], pa.string()), style)
        out += [(rows[code].iloc[p], v) for p, v in zip(parent.tolist(), values.to_pylist())]
    return out


_held: dict[str, Matcher] = {}


def _once(token: str, make) -> Matcher:
    """One matcher for all tasks of a worker that run one plan."""
    if token not in _held:
        _held.clear()
        _held[token] = make()
    return _held[token]


def learn_modifiers(df: DataFrame, value: str, names: list[tuple[str, str]], beside: int = BESIDE, share: float = BESIDE_SHARE) -> frozenset[str]:
    """Words of `value` that no name has and that stand beside the names of at least `beside` different terms, and of
    at least that share of the terms beside which such words stand at all.

    Every different value counts once, over all rows. Values that a slip of the pen explains ("aple jiuce") are no
    evidence. Only the words themselves reach the driver, at most MOST_TERMS of them.
    """
    shared, token = df.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _once(token, lambda: Matcher(shared.value))
        for b in batches:
            yield pd.DataFrame(sorted({pair for x in b["v"] for pair in matcher.evidence(x)}), columns=["word", "code"])

    values = df.select(df[value].alias("v")).where("v is not null").distinct()
    pairs = values.mapInPandas(run, "word string, code string").distinct()
    counted = pairs.rollup("word").agg(F.count_distinct("code").alias("n")).where((F.col("n") >= beside) | F.col("word").isNull())
    rows = counted.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} modifiers")
    least = share * max((r.n for r in rows if r.word is None), default=0)
    return frozenset(r.word for r in rows if r.word is not None and r.n >= least)


def map_to_list(
    df: DataFrame, terms: DataFrame, value: str = "ingredient", keys: tuple[str, ...] = ("row_id",), code: str = "termCode", name: str = "termExtendedName",
    aliases: str | None = "commonNames", out: str = "term_code", modifiers: frozenset[str] | None = None,
) -> DataFrame:
    """keys, `out` (a code of the list, or NONE) and `how`: mention, joined, similar or none.

    modifiers: words that change nothing ("organic"); None learns them from the different values of df, which are
    shuffled for that, but nothing else is. Null, empty and blank values are NONE, and all values if the list is empty.
    Names that two codes share go to the one with the shorter, then smaller name. Repeated values are looked up once
    per worker. Values with digits must agree letter by letter, spaces aside.
    """
    names = reference_names(terms, code, name, aliases)
    if modifiers is None:
        modifiers = learn_modifiers(df, value, names)
    shared, token = df.sparkSession.sparkContext.broadcast((names, modifiers)), uuid.uuid4().hex
    few = df.select(*keys, df[value].alias("__value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _once(token, lambda: Matcher(*shared.value))
        for b in batches:
            got = [matcher.match(x) for x in b["__value"]]
            yield b.drop(columns="__value").assign(**{out: [c for c, _ in got], "how": [h for _, h in got]})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return few.mapInPandas(run, f"{kinds}, `{out}` string, how string")
