"""Language labels by a pluggable detector, loaded once in each Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Common words of each language.
COMMON = {
    "en": "the and of with in for from is to or by on", "fr": "le la les de des et avec du dans pour est par", "de": "der die das und mit von aus für ist im auf den",
    "es": "el los las de con y para en por una del es", "it": "il gli di con e per della nel una dei che è", "nl": "de het een van met en voor uit is op bij door", "pt": "o os as de com e para em por uma do da",
}
_WORD = re.compile(r"[^\W\d_]+")


def common_words() -> Callable[[str], str | None]:
    """A detector by common words; None where no word tells. Ties go to the language whose code comes first."""
    sets = {lang: set(w.split()) for lang, w in sorted(COMMON.items())}

    def detect(text: str) -> str | None:
        seen = _WORD.findall(text.lower())
        best = max(((sum(w in s for w in seen), -i, lang) for i, (lang, s) in enumerate(sets.items())), default=(0, 0, None))
        return best[2] if best[0] else None

    return detect


def detect_language(df: DataFrame, text: str, keys: tuple[str, ...], out: str = "lang", make: Callable[[], Callable[[str], str | None]] = common_words, least: int = 10, most: int | None = None) -> DataFrame:
    """keys and `out`: the detector's label of the stripped text, line feeds as spaces; with `most`, of its first characters only.

    Null, blank and texts shorter than `least` give null. make is called once in each task.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = make()
        for b in batches:
            got = [None if x is None or len(x.strip()) < least else detect(x.strip()[:most].replace("\n", " ")) for x in b["__t"]]
            yield b.drop(columns="__t").assign(**{out: got})

    return df.select(*keys, df[text].alias("__t")).mapInPandas(run, f"{kinds}, `{out}` string")
