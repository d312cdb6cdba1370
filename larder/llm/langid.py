"""Languages of texts and of the segments of mixed texts.

One bit-sliced Bloom filter holds the letter n-grams and words of all languages: each slot is a mask with a bit for
each language, and the masks of an n-gram's slots, and-ed, name all languages that have it. Hits per language are
counted by weight and corrected for the filter's false positives. A text of several values gets the best sequence of
languages, in which a change has a price, so a loan word makes no segment. Masks are learned in tasks and or-ed
together; confidence is the share of a language in the scores, after a temperature fitted on texts that the filter has
not seen.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.lookalike import Plain
from larder.operators.packed import LABEL_TEXT, split_array

#: Labelled rows to learn from (about as many of each language), and slots of the filter; it goes to every executor.
SAMPLE_ROWS, SLOTS, PROBES = 20_000, 1 << 20, 3
#: Languages that one mask can hold.
MOST_LANGUAGES = 63
#: Temperatures among which calibration chooses.
TEMPERATURES = tuple(round(0.25 * 1.15**i, 4) for i in range(32))
#: Weight of n-grams by length, of whole words (0), and the price of a change of language between two values.
WEIGHT, CHANGE = {3: 0.15, 4: 0.25, 5: 0.35, 0: 1.5}, 3.5
UNKNOWN = "und"
#: Languages told by script alone, where the samples have none of that script; Latin is left to the filter.
SCRIPTS = (
    ("el", "Ͱ-Ͽἀ-῿"), ("ru", "Ѐ-ԯ"), ("hy", "԰-֏"), ("he", "֐-׿"), ("ar", "؀-ۿݐ-ݿ"), ("hi", "ऀ-ॿ"), ("bn", "ঀ-৿"),
    ("ta", "஀-௿"), ("th", "฀-๿"), ("ka", "Ⴀ-ჿ"), ("ko", "가-힯ᄀ-ᇿ"), ("ja", "぀-ヿ"), ("zh", "一-鿿"),
)
_SCRIPT = tuple((lang, re.compile(f"[{chars}]")) for lang, chars in SCRIPTS)
_JAPANESE = next(i for i, (lang, _) in enumerate(SCRIPTS) if lang == "ja")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CODE = re.compile(r"\b[Ee][- ]?\d{3,4}[a-z]?\b")


def grams(word: str) -> list[tuple[str, float]]:
    """The word's n-grams and itself, with their weights."""
    w = f"^{word}$"
    out = [(w[i : i + n], WEIGHT[n]) for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return [*out, (f"={word}", WEIGHT[0] if len(word) > 2 else 0.5)]


def words(text: str) -> list[str]:
    return _WORD.findall(_CODE.sub(" ", text).lower())


def _slots(gram: str) -> list[int]:
    h = xxhash.xxh64_intdigest(gram)
    return [(h >> 20 * i) % SLOTS for i in range(PROBES)]


class Filters:
    """Masks of all languages, and the share of slots that each language fills. scripts: places in SCRIPTS of the scripts
    in which learned languages are written; temperature: what scores are divided by before they become confidence."""

    def __init__(self, languages: list[str], masks: np.ndarray, scripts: frozenset[int] = frozenset(), temperature: float = 1.0) -> None:
        self.languages, self.masks, self.scripts, self.temperature = languages, masks, scripts, temperature
        fill = np.array([np.count_nonzero(masks & masks.dtype.type(1 << i)) / SLOTS for i in range(len(languages))])
        self.false = fill**PROBES

    @classmethod
    def learn(cls, samples: list[tuple[str, str]]) -> Filters:
        lesson = Lesson(sorted({lang for lang, _ in samples}))
        for lang, text in samples:
            lesson.add(lang, text)
        return cls(lesson.languages, lesson.masks, frozenset(lesson.scripts))

    def __or__(self, other: Filters) -> Filters:
        return Filters(self.languages, self.masks | other.masks, self.scripts | other.scripts, self.temperature)


class Lesson:
    """Masks that grow by texts."""

    def __init__(self, languages: list[str]) -> None:
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"{len(languages)} languages; a mask holds {MOST_LANGUAGES}")
        kind = next(k for bits, k in ((16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(languages) <= bits)
        self.languages, self.masks = languages, np.zeros(SLOTS, kind)
        self.bit = {lang: kind(1 << i) for i, lang in enumerate(languages)}
        self.seen: set[tuple[str, str]] = set()
        self.scripts: dict[int, int] = {}

    def add(self, lang: str, text: str) -> None:
        bit = self.bit[lang]
        for w in words(text):
            if (lang, w) not in self.seen:
                self.seen.add((lang, w))
                for g, _ in grams(w):
                    self.masks[_slots(g)] |= bit
        if (no := script_of(text)) is not None:
            self.scripts[no] = self.scripts.get(no, 0) | int(bit)

    def rows(self) -> pd.DataFrame:
        """Slots that are set, and the scripts as slots below 0."""
        at = np.flatnonzero(self.masks)
        return pd.DataFrame({
            "slot": np.concatenate((at, np.array([-1 - no for no in self.scripts], int))).astype(np.int32),
            "mask": np.concatenate((self.masks[at].astype(np.int64), np.array(list(self.scripts.values()), np.int64))),
        })


def script_of(text: str) -> int | None:
    """Place in SCRIPTS of the script whose letters outnumber all others in the text; None for Latin."""
    if not text or max(text) < "Ͱ":  # Latin letters and signs alone
        return None
    n, no = max((len(p.findall(text)), -i) for i, (_, p) in enumerate(_SCRIPT))
    if not n or n <= sum(c.isalpha() for c in text) - n:
        return None
    return _JAPANESE if SCRIPTS[-no][0] == "zh" and _SCRIPT[_JAPANESE][1].search(text) else -no


class Reader:
    """Languages of texts by given filters. One per Python worker."""

    def __init__(self, filters: Filters) -> None:
        self.f, self.n = filters, len(filters.languages)
        self.memo: dict[str, np.ndarray] = {}
        self.phrases: dict[str, np.ndarray] = {}
        self.plain = Plain()

    def score(self, word: str) -> np.ndarray:
        """Corrected hits of each language; n-grams that no language has say nothing."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = np.zeros(self.n)
            bits = np.arange(self.n)
            for g, weight in grams(word):
                mask = int(np.bitwise_and.reduce(self.f.masks[_slots(g)]))
                if mask:
                    hit = (mask >> bits) & 1
                    got += weight * (hit - self.f.false) / (1 - self.f.false)
            if len(word) <= 60:
                self.memo[word] = got
        return got

    def scores(self, text: str) -> np.ndarray:
        said = words(text)
        key = " ".join(said)
        got = self.phrases.get(key)
        if got is None:
            got = sum((self.score(w) for w in said), np.zeros(self.n))
            if len(key) <= 80:
                if len(self.phrases) > 100_000:
                    self.phrases.clear()
                self.phrases[key] = got
        return got

    def script(self, text: str) -> str | None:
        """Language told by script: its letters outnumber the others and no learned language is written in it."""
        no = script_of(text)
        return None if no is None or no in self.f.scripts else SCRIPTS[no][0]

    def sure(self, scores: np.ndarray, of: int) -> float:
        """Confidence in one of the languages."""
        p = np.exp((scores - scores.max()) / self.f.temperature)
        return float(p[of] / p.sum())

    def decide(self, scores: np.ndarray) -> tuple[str, float]:
        if not scores.any():
            return UNKNOWN, 0.0
        best = int(scores.argmax())
        return self.f.languages[best], self.sure(scores, best)

    def one(self, text: str) -> tuple[str, float] | None:
        """Language of a text in one language; None if it has no words."""
        text = self.plain(text)
        if not words(text):
            return None
        if lang := self.script(text):
            return lang, 1.0
        return self.decide(self.scores(text))

    def segments(self, values: list[str], leads: list[str]) -> list[tuple[str, float, int]]:
        """(language, confidence, values) of the longest runs in one language. leads: caption before each value, or ''."""
        rows, sure = [], []
        for v, lead in zip(values, leads):
            if not v.isascii():
                v = self.plain(v)
            sure.append(None if v.isascii() else self.script(v))
            rows.append(self.scores(v) + self.scores(lead) if lead else self.scores(v))
        told = any(sure)
        if not rows:
            return []
        all_rows = np.array(rows)
        loud = all_rows.any(axis=1)
        if not told:
            if not loud.any():
                return []
            first = all_rows[loud].argmax(axis=1)
            if (first == first[0]).all():  # the best language of every value: no path can be better
                return [(self.f.languages[int(first[0])], self.sure(all_rows.sum(axis=0), int(first[0])), len(values))]
        # Languages of other scripts stand beside those of the filter.
        extra = sorted({s for s in sure if s})
        states = [*self.f.languages, *(x for x in extra if x not in self.f.languages)]
        emit = np.zeros((len(values), len(states)))
        for i, (r, s) in enumerate(zip(rows, sure)):
            emit[i, : self.n] = r
            if s is not None:
                emit[i] = 0
                emit[i, states.index(s)] = 20.0
        best, back = emit[0].copy(), []
        for i in range(1, len(values)):
            change = best.max() - (CHANGE * 0.4 if leads[i] else CHANGE)
            stay = best >= change
            back.append(np.where(stay, np.arange(len(states)), int(best.argmax())))
            best = np.where(stay, best, change) + emit[i]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        out: list[tuple[str, float, int]] = []
        at = 0
        while at < len(path):
            end = at
            while end < len(path) and path[end] == path[at]:
                end += 1
            out.append((states[path[at]], self.sure(emit[at:end].sum(axis=0), path[at]), end - at))
            at = end
        return out


_CAPTION = re.compile(r"(?:\A|[.,;|/\n•·])\s*([^\W\d_][^\W\d_ ]*(?: [^\W\d_]+)*)\s*:")


def parts(texts: list[str | None]) -> list[tuple[list[str], list[str]]]:
    """For each text its values, and the caption that stands before each value ('' where none does)."""
    parent, _, values = split_array(pa.array(texts, pa.string()), LABEL_TEXT)
    out: list[tuple[list[str], list[str]]] = [([], []) for _ in texts]
    for p, v in zip(parent.tolist(), values.to_pylist()):
        out[p][0].append(v)
    for text, (vals, leads) in zip(texts, out):
        caps = list(_CAPTION.finditer(text)) if text and ":" in text else []
        at, k = 0, 0
        for v in vals:
            at = max(at, text.find(v, at))
            lead = ""
            while k < len(caps) and caps[k].start(1) <= at:
                lead, k = caps[k][1], k + 1
            leads.append(lead)
            at += len(v)
    return out


def _collect(lessons: DataFrame, languages: list[str]) -> Filters:
    """Masks of all tasks or-ed together. At most SLOTS numbers reach the driver, whatever was learned from."""
    got = lessons.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks, slot, mask = Lesson(languages).masks, got["slot"].to_numpy(int), got["mask"].to_numpy(np.int64)
    masks[slot[slot >= 0]] = mask[slot >= 0].astype(masks.dtype)
    return Filters(languages, masks, frozenset((-1 - slot[slot < 0]).tolist()))


_LESSON = "slot int, mask long"


def learn(rows: DataFrame, samples: DataFrame, fields: tuple[tuple[str, str], ...], key: str = "row_id", sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from all samples (lang, text), widened by about `sample_rows` labelled texts of `rows`, as many of each
    language as there are, chosen by the hash of their key: those that the samples alone place, as a whole, in the
    language of their label. fields: (text, label) columns.

    Tasks learn and their masks are or-ed; counts by language, masks and sums of errors reach the driver. The temperature
    of the confidence is the one that fits best how a filter of the labelled rows alone places the values of the samples.
    """
    known = samples.select("lang", "text").where("lang is not null and text is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not languages:
        return Filters.learn([])

    def of_samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lesson = Lesson(languages)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                lesson.add(lang, text)
        yield lesson.rows()

    base = _collect(known.mapInPandas(of_samples, _LESSON), languages)
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((base.languages, base.masks, base.scripts))

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, lesson = Reader(Filters(*shared.value)), Lesson(languages)
        for b in batches:
            texts = [reader.plain(t) for t in b["text"]]
            for t, lang, (vals, leads) in zip(texts, b["lang"], parts(texts)):
                seg = reader.segments(vals, leads)
                if len(seg) == 1 and seg[0][0] == lang and seg[0][1] > 0.99:
                    lesson.add(lang, t)
        yield lesson.rows()

    each = [rows.select(F.xxhash64(F.lit(text), key).alias("h"), F.col(label).alias("lang"), F.col(text).alias("text")) for text, label in fields]
    labelled = reduce(DataFrame.unionByName, each).where(F.col("lang").isin(languages) & F.col("text").isNotNull())
    have = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, sample_rows / len(languages) / max(1, have.get(lang, 0)))))
    chosen = labelled.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")
    wide = _collect(chosen.mapInPandas(of_rows, _LESSON), languages)
    full = base | wide
    full.temperature = _temperature(known, wide)
    return full


def _temperature(samples: DataFrame, filters: Filters) -> float:
    """The temperature at which the confidence of `filters` in the labels of the samples' values is likeliest; 1 without evidence."""
    shared = samples.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(Filters(*shared.value))
        for b in batches:
            loss = np.zeros(len(TEMPERATURES))
            for lang, (vals, _) in zip(b["lang"], parts([reader.plain(t) for t in b["text"]])):
                for v in vals:
                    s = reader.scores(v)
                    if s.any():
                        z = (s - s.max())[None, :] / np.array(TEMPERATURES)[:, None]
                        loss += np.log(np.exp(z).sum(axis=1)) - z[:, reader.f.languages.index(lang)]
            yield pd.DataFrame({"no": np.arange(len(loss), dtype=np.int32), "loss": loss})

    got = samples.mapInPandas(run, "no int, loss double").groupBy("no").agg(F.sum("loss").alias("loss")).where("loss > 0").toPandas()
    return TEMPERATURES[int(got.loc[got["loss"].idxmin(), "no"])] if len(got) else 1.0


_held: dict[str, Reader] = {}


def _once(token: str, make) -> Reader:
    """One reader for all tasks of a worker that run one plan."""
    if token not in _held:
        _held.clear()
        _held[token] = make()
    return _held[token]


def identify(df: DataFrame, text: str, filters: Filters, keys: tuple[str, ...] = ("row_id",), mixed: bool = True) -> DataFrame:
    """keys, seg_no (int, from 0), lang, confidence (double), n_values and n_segments (int) of each segment of each text.

    With mixed, segments are the longest runs of values in one language; without, each text is one segment. Null and
    blank texts and texts without words (numbers, E-numbers) give no rows; words that no language knows give `und`
    with confidence 0. Repeated rows are judged alike; other columns are not read. One narrow pass.
    """
    shared, token = df.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.scripts, filters.temperature)), uuid.uuid4().hex
    few = df.select(*keys, df[text].alias("__text")).where("__text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _once(token, lambda: Reader(Filters(*shared.value)))
        for b in batches:
            who, no, lang, conf, size, of = [], [], [], [], [], []
            texts = b["__text"].tolist()
            found = parts(texts) if mixed else [([t], [""]) for t in texts]
            for i, (vals, leads) in enumerate(found):
                if mixed:
                    segs = reader.segments(vals, leads)
                    if not segs and any(words(v) for v in vals):
                        segs = [(UNKNOWN, 0.0, len(vals))]
                else:
                    one = reader.one(vals[0])
                    segs = [(*one, 1)] if one else []
                for k, (x, c, n) in enumerate(segs):
                    who.append(i), no.append(k), lang.append(x), conf.append(c), size.append(n), of.append(len(segs))
            out = b.drop(columns="__text").iloc[who].reset_index(drop=True)
            yield out.assign(seg_no=np.array(no, np.int32), lang=np.array(lang, object), confidence=np.array(conf, float), n_values=np.array(size, np.int32), n_segments=np.array(of, np.int32))

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return few.mapInPandas(run, f"{kinds}, seg_no int, lang string, confidence double, n_values int, n_segments int")


def label_cases(df: DataFrame, text: str, label: str, filters: Filters, key: str = "row_id", mixed: bool = True) -> DataFrame:
    """key, seg_no, lang, confidence of the texts whose label is not exactly their language, or that have several."""
    got = identify(df.select(key, F.col(text).alias("t"), F.col(label).alias("__label")), "t", filters, (key, "__label"), mixed)
    return got.where((F.col("n_segments") > 1) | ~F.col("__label").eqNullSafe(F.col("lang"))).select(key, "seg_no", "lang", "confidence")
