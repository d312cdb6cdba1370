"""Text and tag cleaning as column expressions. Only compatibility normalisation leaves the JVM (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python sees it.
WS = r"(?U)\s+"

#: Words and phrases of the cleaning rules.
BOILERPLATE = (
    "manufactured", "distributed", "refrigerat", "best before", "calorie", "calories", "remove", "set aside", "made from", "plant that", "company",
    "consumer information", "see base", "packaging", "per serving", "daily value", "directions", "warning", "product is", "for distribution",
    "contains allergen", "allergen", "servings?", "flush", "consume", "responsibly", "celebrat", "irradiat", "processed with", "use by", "sell by",
    "keep refrigerat", "store in", "may also contain", "trace of", "nutrition", "suitable for", "less than", "per package", "contains no",
)
SHORT_WORDS = tuple(
    """oil egg rye oat fat fig yam roe gin rum soy gum ice pea nut
    salt milk corn beef pork lamb rice malt lard whey wine beer miso tofu fish lime mint sage dill clam crab duck agar bran plum date oats
    eggs nuts beet cane palm peas seed tuna kale okra figs nori suet veal goat teff kelp ghee cola lees
    sugar cream water wheat honey yeast onion lemon apple cocoa flour spice juice olive thyme basil cacao carob chili clove dates herbs maple pasta
    spelt sumac peach grape melon mango berry prune agave anise brine caper cress cumin curry grain guava kamut kombu kvass leeks lupin mirin natto
    okara olein pecan perch prawn quark squid stout syrup umami vodka wafer""".split()
)
CONTEXT_TERMS = (
    "fruit", "vegetable", "root vegetable", "taproot vegetable", "fruit vegetable", "berries", "tuber", "oil and fat", "vegetable oil and fat", "added sugar",
    "disaccharide", "monosaccharide", "cereal", "cereal flour", "protein", "plant protein", "animal protein", "minerals", "vitamins", "ferment",
    "microbial culture", "colour", "color", "flavouring", "flavoring", "stabiliser", "stabilizer", "preservative",
)
UNITS = ("g", "mg", "kg", "ml", "l", "oz", "lb", "kcal", "kj", "cal", "iu")
MEASURES = ("tbsp", "tsp", "cups?", "tablespoons?", "teaspoons?")
PURPOSES = ("colou?r", "flavou?r", "aroma", "texture", "preservation", "coloring", "colouring")
NOISE_STARTS = (r"to\s+(?:preserve|promote|maintain|retain)", r"cured\s+with", r"contains\s+live", r"contains\s+\d+", r"contains\s+less\s+than", r"and\s+less\s+of", r"or\s+less\s+of")
SPELLINGS = (
    ("yoghurt", "yogurt"), ("flavour", "flavor"), ("colour", "color"), ("skimmed", "skim"),
    ("sulphur", "sulfur"), ("fibre", "fiber"), ("litre", "liter"), ("centre", "center"),
)

E_CODE = r"(?i)^e\s*-?\s*(\d{3,4})\s*([a-z]?\s*(?:\([ivx]+\))?)?$"
UNIT_TOKEN = r"(?i)^\d[\d.,]*\s*(?:" + "|".join(UNITS) + r")?$"
BOILERPLATE_PATTERN = r"(?iU)\b(?:" + "|".join(BOILERPLATE) + r")\b"
NOISE_PATTERN = r"(?iU)^(?:" + "|".join(NOISE_STARTS) + r")\b|^contains$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, WS, " ")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def lookup_key(c: Column, normal: bool = False) -> Column:
    """NFKC, lower case, `-` and `_` to spaces, white space collapsed. Null and blank give ''. normal: c is in NFKC already."""
    t = strip(F.lower(c if normal else nfkc(c)))
    return F.when(blank(c), "").otherwise(strip(collapse(F.translate(t, "-_", "  "))))


def clean_text(c: Column, normal: bool = False) -> Column:
    """NFKC, white space collapsed before `-` and `_` become spaces; the case stays. Null and blank give ''."""
    return F.when(blank(c), "").otherwise(strip(F.translate(collapse(strip(c if normal else nfkc(c))), "-_", "  ")))


def printable_text(c: Column, most: int | None = None) -> Column:
    """Everything but printable ASCII and Latin-1 letters becomes a space; white space collapsed; cut to `most`."""
    t = strip(collapse(F.regexp_replace(collapse(strip(c)), r"[^\x20-\x7E\x{C0}-\x{FF}]", " ")))
    t = F.substring(t, 1, most) if most else t
    return F.when(blank(c), "").otherwise(t)


def clean_token(c: Column) -> Column:
    """T4: shares, leading counts, kitchen measures, purposes and trailing numbers go, in this order."""
    for pattern in (
        r"(?U)\s*\d+[.,]?\d*\s*%", r"(?U)^\d+\s+", r"(?iU)\b\d+\s*(?:" + "|".join(MEASURES) + r")\b",
        r"(?iU)\s+for\s+(?:" + "|".join(PURPOSES) + r")\b.*$", r"(?<=[a-z])\d+$", r"(?U)\s+\d+$",
    ):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def is_e_code(c: Column) -> Column:
    return F.lower(strip(c)).rlike(E_CODE)


def words(c: Column) -> Column:
    # No lambda: the planner then computes repeated uses once.
    return F.array_remove(F.split(c, WS), "")


def _share_letters_beyond_latin(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.length(F.regexp_replace(c, r"[^\p{L}]|[\x{0}-\x{24F}]", "")) / F.greatest(letters, F.lit(1))


def valid_ingredient(c: Column, most_words: int = 5, e_codes_pass: bool = True, two_word_rule: bool = False) -> Column:
    """T5; T6 with most_words=8, e_codes_pass=False and two_word_rule=True. Null gives false."""
    w, n = words(c), F.length(c)
    units = F.size(F.filter(w, lambda x: x.rlike(UNIT_TOKEN)))
    digits = F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))
    rules = F.when(n < 3, False)
    if e_codes_pass:
        rules = rules.when(is_e_code(c), True)
    rules = (
        rules.when(F.size(w) > most_words, False).when(c.rlike(BOILERPLATE_PATTERN), False).when(_share_letters_beyond_latin(c) > 0.25, False)
        .when(units / F.greatest(F.size(w), F.lit(1)) > 0.5, False).when(digits / F.greatest(n, F.lit(1)) > 0.4, False)
    )
    if two_word_rule:
        rules = rules.when((F.size(w) <= 2) & F.exists(w, lambda x: F.length(x) <= 2), False)
    return F.coalesce(rules.when((F.size(w) == 1) & (n <= 5) & ~F.lower(c).isin(*SHORT_WORDS), False).when(c.isNull(), False).otherwise(True), F.lit(False))


def is_additive(key: Column) -> Column:
    """T7, of a lookup key."""
    return F.coalesce(key.rlike(E_CODE), F.lit(False))


def is_noise(key: Column) -> Column:
    """T8, of a lookup key."""
    return F.coalesce(key.rlike(NOISE_PATTERN), F.lit(False))


def is_context(key: Column) -> Column:
    """T9, of a lookup key."""
    return F.coalesce(key.isin(*CONTEXT_TERMS), F.lit(False))


def normalize_e_code(c: Column) -> Column:
    """`E-330`, `e 471(i)` to `e330`, `e471i`; other text as it is."""
    t = strip(c)
    suffix = F.lower(F.regexp_replace(F.regexp_extract(t, E_CODE, 2), r"[\s()\-]", ""))
    return F.when(t.rlike(E_CODE), F.concat(F.lit("e"), F.regexp_extract(t, E_CODE, 1), suffix)).otherwise(c)


def token(c: Column, normal: bool = False) -> Column:
    """The cleaning of one tag or label part: T2, T10, and T4 unless it is an E-code."""
    t = normalize_e_code(clean_text(c, normal))
    return F.when(is_e_code(t), t).otherwise(clean_token(t))


def low_unit_share(tags: Column) -> Column:
    """Less than 0.4 of the tags are numbers or amounts; blank gives false."""
    t = F.filter(F.transform(F.split(tags, ","), strip), lambda x: x != "")
    bare = F.transform(t, lambda x: F.regexp_replace(x, "^[a-z]{2}:", ""))
    return F.when(blank(tags) | (F.size(t) == 0), False).otherwise(F.size(F.filter(bare, lambda x: x.rlike(UNIT_TOKEN))) / F.greatest(F.size(t), F.lit(1)) < 0.4)


def tags_to_text(tags: Column) -> Column:
    """`en:dried-fruit,en:nuts` to `dried fruit, nuts`."""
    bare = F.transform(F.split(tags, ","), lambda x: strip(F.translate(F.regexp_replace(strip(x), "^[a-z]{2}:", ""), "-_", "  ")))
    return F.when(blank(tags), "").otherwise(F.array_join(F.filter(bare, lambda x: x != ""), ", "))


def sentence_join(*parts: Column) -> Column:
    """Parts that aren't empty, each closed by one full stop, joined by spaces."""
    closed = [F.regexp_replace(p, r"\.+$", "") for p in parts]
    return F.concat_ws(" ", *(F.when(p.isNotNull() & (p != ""), F.concat(p, F.lit("."))) for p in closed))


def product_text(name: Column, generic: Column, categories: Column, groups: Column, ingredients: Column, most: int = 500) -> Column:
    """The rich text of a product."""
    n, g = printable_text(name), printable_text(generic)
    return sentence_join(n, F.when(F.lower(g) != F.lower(n), g), tags_to_text(categories), tags_to_text(groups), printable_text(ingredients, most))


def term_text(name: Column, common: Column, scientific: Column) -> Column:
    """Names of a term joined by `. `."""
    return F.concat_ws(". ", *(F.when(~blank(c), strip(c)) for c in (name, common, scientific)))


def term_full_text(name: Column, short: Column, common: Column, scientific: Column, note: Column) -> Column:
    """All names, the scope note and one full stop after each."""
    names = F.transform(name_list(common), lambda x: F.concat(F.regexp_replace(strip(x), r"\.+$", ""), F.lit(".")))
    return F.concat_ws(" ", sentence_join(strip(name), strip(short)), F.when(F.size(names) > 0, F.array_join(names, " ")), F.nullif(sentence_join(strip(scientific), scope_note(note)), F.lit("")))


def scope_note(c: Column) -> Column:
    """What stands before the first pound sign, white space collapsed."""
    return F.coalesce(strip(collapse(F.substring_index(c, "£", 1))), F.lit(""))


def name_list(c: Column) -> Column:
    """`$`-separated names, trimmed, empty ones dropped; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(F.split(c, r"\$"), strip), lambda x: x != ""), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def approx_tokens(c: Column) -> Column:
    """Words times 1.3, rounded half to even."""
    return F.bround(word_count(c) * F.lit(1.3), 0).cast("int")


def tag_count(c: Column) -> Column:
    """Tags of a cell; blank gives 0."""
    return F.when(blank(c), 0).otherwise(F.size(F.split(c, ",")))


def noisy(c: Column) -> Column:
    """Shorter than 3, more than 10 words, more than 0.3 digits or more than 8 spaces."""
    digits, spaces = F.length(F.regexp_replace(c, r"[^\p{Nd}]", "")), F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (F.length(c) < 3) | (F.size(words(c)) > 10) | (digits / F.greatest(F.length(c), F.lit(1)) > 0.3) | (spaces > 8)


def cache_key(c: Column, normal: bool = False) -> Column:
    """clean_text in lower case."""
    return F.lower(clean_text(c, normal))


def highlight(c: Column, what: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The first occurrence of `what`, whatever the case, between two marks."""
    i = F.call_function("locate", F.lower(what), F.lower(c))
    n = F.length(what)
    marked = F.concat(F.substring(c, F.lit(1), i - 1), F.lit(before), F.substring(c, i, n), F.lit(after), F.substring(c, i + n, F.length(c)))
    return F.when(F.coalesce((i > 0) & (n > 0), F.lit(False)), marked).otherwise(c)


def term_key(c: Column, normal: bool = False) -> Column:
    """M1: lookup key without brackets and slashes."""
    return strip(collapse(F.translate(lookup_key(c, normal), "()/", "   ")))


def spelling_variants(c: Column) -> Column:
    """M2: closure over British and American spellings, pair by pair, as an array. `skimmed` also gives `skimmedmed`, as the pairs overlap."""
    pairs = F.array(*(F.struct(F.lit(british).alias("b"), F.lit(american).alias("a")) for british, american in SPELLINGS))

    def widen(seen: Column, p: Column) -> Column:
        from_b = F.transform(F.filter(seen, lambda x: x.contains(p["b"])), lambda x: F.replace(x, p["b"], p["a"]))
        from_a = F.transform(F.filter(seen, lambda x: x.contains(p["a"])), lambda x: F.replace(x, p["a"], p["b"]))
        return F.array_union(seen, F.array_union(from_b, from_a))

    return F.aggregate(pairs, F.array(c), widen)


def comma_variants(c: Column, normal: bool = False) -> Column:
    """M3: the name, its comma parts reversed, its first two parts swapped, each in all spellings."""
    parts = F.filter(F.transform(F.split(lookup_key(c, normal), ","), lambda x: strip(collapse(F.translate(x, "()/", "   ")))), lambda x: x != "")
    swapped = F.array_join(F.concat(F.array(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))), F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1)))), " ")
    forms = F.when(c.contains(",") & (F.size(parts) >= 2), F.array_distinct(F.array(term_key(c, normal), F.array_join(F.reverse(parts), " "), swapped))).otherwise(F.array(term_key(c, normal)))
    return F.array_distinct(F.flatten(F.transform(forms, spelling_variants)))


def token_set(c: Column, normal: bool = False) -> Column:
    return F.array_distinct(words(F.regexp_replace(lookup_key(c, normal), r"(?U)[^\p{L}\p{N}_\s]", " ")))


def token_jaccard(a: Column, b: Column, normal: bool = False) -> Column:
    """M8: shared words over all words of two lookup keys, punctuation aside; an empty side gives 0."""
    return set_jaccard(token_set(a, normal), token_set(b, normal))


def set_jaccard(x: Column, y: Column) -> Column:
    """Shared over all elements of two arrays without repeats; 0 if a side is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0))
