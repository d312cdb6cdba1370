"""Visually identical text with different characters: one plain form for every value.

Ignorable characters go, compatibility forms of letters, spaces and hyphens become ordinary ones, accents are
composed. Words that still mix scripts, and words of another script among Latin ones whose letters all look Latin, are
read as a lattice, every letter with the letters of each script that it looks like; the best path inside one script
under that script's letter bigrams is found by Viterbi. A mixed word is Latin if it has a Latin path, else its cheapest;
a word wholly in another script stays in it unless the scores, with the share of each script's words, are for Latin.
Bigrams are counted over all values.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters that they look like, the closest first.
CYRILLIC = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "г": "r", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I",
}
GREEK = {
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "nh", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "σ": "o", "ρ": "p", "τ": "t", "υ": "uy", "ω": "w", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
}
#: Latin letters of phonetic use that look like plain ones, and hyphens.
PHONETIC, HYPHENS = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "Y"}, "‐‑﹣－"
#: Invisible characters beyond the categories of format and control characters.
_BLANK = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\U000e0100-\U000e01ef]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
#: Printable ASCII and composed Latin letters that nothing unfolds: text of these alone is plain.
_SURELY_PLAIN = re.compile(r"[\x20-\x7E\t\n\rÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž]*\Z")
_NOT_PLAIN = r"[^\x{20}-\x{7E}\t\n\r]"


def script(c: str) -> str:
    """L, C, G for Latin, Cyrillic and Greek letters, ? for others."""
    o = ord(c)
    if o < 0x250 or 0x250 <= o < 0x2B0 or 0x1E00 <= o < 0x1F00 or 0xA720 <= o < 0xA800:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return "C" if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 else "?"


def _readings() -> dict[str, dict[str, str]]:
    """Script -> letter -> letters of that script that it can stand for."""
    out: dict[str, dict[str, str]] = {"L": dict(PHONETIC), "C": {}, "G": {}}
    for name, letters in (("C", CYRILLIC), ("G", GREEK)):
        for other, latin in letters.items():
            out["L"][other] = latin
            for x in latin:
                out[name].setdefault(x, other)
    for a, b in (("C", GREEK), ("G", CYRILLIC)):  # over the common Latin letter
        for other, latin in b.items():
            if latin[0] in out[a]:
                out[a].setdefault(other, out[a][latin[0]])
    return out


_READ = _readings()


def _unfold(c: str) -> str:
    kind = unicodedata.decomposition(c)
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs":
        return " "
    if kind.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or kind.startswith("<compat>") and c != "µ" and unicodedata.category(c) in ("Ll", "Lu", "Lt", "Lo", "Nl"):
        return unicodedata.normalize("NFKC", c)
    return c


class Plain:
    """Plain form of a value. bigrams: (script, two letters) -> count; ^ and $ stand for the ends of a word."""

    def __init__(self, bigrams: dict[tuple[str, str], int] | None = None) -> None:
        self.memo: dict[str, str] = {}
        self.char: dict[str, str] = {}
        self.seen = bigrams or {}
        total: dict[tuple[str, str], int] = defaultdict(int)
        ends: dict[tuple[str, str], int] = defaultdict(int)
        for (s, g), n in self.seen.items():
            total[s, g[0]] += n
            ends[s, g[1]] += n
        every: dict[str, int] = defaultdict(int)
        for (s, _), n in ends.items():
            every[s] += n
        self.before = total
        self.share = {k: (n + 0.5) / (every[k[0]] + 20) for k, n in ends.items()}  # of a letter among all that follow one
        self.none = {s: 0.5 / (n + 20) for s, n in every.items()}
        said = {s: total.get((s, "^"), 0) for s in "LCG"}
        #: Price of a script: how rare its words are. Without counts nothing speaks against Latin.
        self.rare = {s: -math.log((n + 0.5) / (sum(said.values()) + 1.5)) for s, n in said.items()}

    def __call__(self, value: str) -> str:
        if _SURELY_PLAIN.match(value):
            return value
        got = self.memo.get(value)
        if got is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            got = self._plain(value)
            if len(value) < 500:
                self.memo[value] = got
        return got

    def simple(self, value: str) -> str:
        """All but look-alike letters."""
        out = []
        for c in _BLANK.sub("", value):
            got = self.char.get(c)
            if got is None:
                kind = unicodedata.category(c)
                got = self.char[c] = "" if kind == "Cf" or kind == "Cc" and c not in "\t\n\r" else _unfold(c)
            out.append(got)
        return unicodedata.normalize("NFC", "".join(out))

    def _plain(self, value: str) -> str:
        text = self.simple(value)
        if text.isascii() or all(script(c) == "L" and c not in PHONETIC for c in text if c.isalpha()):
            return text
        text = unicodedata.normalize("NFD", text)
        words = [m for m in _WORD.finditer(text)]
        sure = {script(c) for w in words for c in w[0] if c.isalpha() and script(c) != "L" and c not in _READ["L"]}
        latin = any(script(c) == "L" for w in words for c in w[0] if c.isalpha())
        out, at = [], 0
        for w in words:
            out.append(text[at : w.start()])
            out.append(self.word(w[0], latin and not sure))
            at = w.end()
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))

    def word(self, word: str, among_latin: bool) -> str:
        """The word in one script. A word wholly in another script stays, unless its neighbours are Latin, each of its letters looks Latin, and the scores are for Latin."""
        letters = [c for c in word if c.isalpha()]
        own = {script(c) for c in letters}
        if own == {"L"} and not any(c in PHONETIC for c in letters) or len(own) == 1 and own != {"L"} and not among_latin:
            return word
        read = {s: self.viterbi(letters, s) for s in "LCG"}
        cost = {s: c + self.rare[s] for s, (path, c) in read.items() if path}
        if not cost:
            return word
        if "L" in cost and (len(own) > 1 or own == {"L"}):  # a mixed word
            best = "L"
        elif len(own) == 1:
            best = min((s for s in cost if s in own or s == "L"), key=lambda s: (cost[s], s != "L"))
        else:
            best = min(cost, key=lambda s: (cost[s], s))
        it = iter(read[best][0])
        return "".join(next(it) if c.isalpha() else c for c in word)

    def viterbi(self, letters: list[str], s: str) -> tuple[list[str], float]:
        """The cheapest reading of the letters in script s; empty if a letter has none."""
        paths: dict[str, tuple[float, list[str]]] = {"^": (0.0, [])}
        for c in letters:
            options = c if script(c) == s and c not in PHONETIC else _READ[s].get(c, "")
            step: dict[str, tuple[float, list[str]]] = {}
            for rank, o in enumerate(options):
                here = min(((cost + self._cost(s, last, o) + 0.5 * rank, path) for last, (cost, path) in paths.items()), key=lambda x: x[0])
                step[o] = (here[0], [*here[1], o])
            if not step:
                return [], math.inf
            paths = step
        cost, path = min(((cost + self._cost(s, last, "$"), path) for last, (cost, path) in paths.items()), key=lambda x: x[0])
        return path, cost

    def _cost(self, s: str, a: str, b: str) -> float:
        """Of the bigram, drawn towards the share of its second letter the more, the rarer the first is."""
        a, b = a.lower(), b.lower()
        if s not in self.none:  # no word of this script was counted
            return 4.0
        n = self.before.get((s, a), 0)
        pull = 5 + math.sqrt(n)
        return -math.log((self.seen.get((s, a + b), 0) + pull * self.share.get((s, b), self.none[s])) / (n + pull))


def letter_bigrams(df: DataFrame, column: str) -> dict[tuple[str, str], int]:
    """Bigrams of the one-script words of all values of `column`, for Plain. The result is bounded by the letters of
    each of three scripts squared, whatever the number of values; only these counts reach the driver."""
    word = F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+"), F.lit(0)))
    words = df.where(F.col(column).isNotNull()).select(word.alias("w")).groupBy("w").count()
    kind = F.when(F.col("w").rlike(r"^\p{IsLatin}+$"), "L").when(F.col("w").rlike(r"^\p{IsCyrillic}+$"), "C").when(F.col("w").rlike(r"^\p{IsGreek}+$"), "G")
    pairs = words.select(kind.alias("s"), "count", F.expr("concat('^', w, '$')").alias("w")).where("s is not null")
    pairs = pairs.select("s", "count", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("g"))
    rows = pairs.groupBy("s", "g").agg(F.sum("count").alias("n")).collect()
    return {(r.s, r.g): r.n for r in rows}


def plain_values(df: DataFrame, column: str, keys: tuple[str, ...] = ("row_id",), out: str = "plain", bigrams: dict[tuple[str, str], int] | None = None, changed_only: bool = True) -> DataFrame:
    """keys and `out`, the plain form of `column`; with changed_only just the values that are not in plain form.

    Letter case, the number of ordinary spaces and ordinary punctuation stay. Null stays null and is never a changed
    value; an empty value stays empty; a value of invisible characters alone becomes empty. Values of printable ASCII
    are plain and never leave the JVM. Repeated rows are judged alike, other columns are not read. No shuffle, but for
    the count of letter bigrams where they are not given.
    """
    few = df.select(*keys, df[column].alias("__value"))
    if bigrams is None:
        bigrams = letter_bigrams(df.select(df[column].alias("__value")), "__value")
    odd = F.col("__value").rlike(_NOT_PLAIN)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = Plain(bigrams)
        for b in batches:
            made = [plain(x) for x in b["__value"]]
            b = b.assign(**{out: made})
            if changed_only:
                b = b[b[out] != b["__value"]]
            yield b.drop(columns="__value")

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    done = few.where(odd).mapInPandas(run, f"{kinds}, `{out}` string")
    return done if changed_only else done.unionByName(few.where(F.coalesce(~odd, F.lit(True))).withColumnRenamed("__value", out))
