import random
import unicodedata

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import tags


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head().y


def test_keys(spark):
    assert one(spark, "  Glucose-Fructose_syrup ", T.lookup_key) == "glucose fructose syrup"
    assert one(spark, "ｆｕｌｌ　ﬂour", T.lookup_key) == "full flour"
    assert one(spark, "a - b", T.clean_text) == "a   b" and one(spark, None, T.lookup_key) == "" and one(spark, " ", T.clean_text) == ""
    key = one(spark, "A  b_C", T.lookup_key)
    assert one(spark, key, T.lookup_key) == key


def test_tokens(spark):
    for raw, want in (("cream 35%", "cream"), ("paprika for colour", "paprika"), ("juice1", "juice"), ("2 tbsp oil", "tbsp oil"), ("green chard 1", "green chard")):
        assert one(spark, raw, T.clean_token) == want
    for raw, want in (("e-330", "e330"), ("E 330", "e330"), ("e 471(i)", "e471i"), ("salt", "salt")):
        assert one(spark, raw, T.normalize_e_code) == want
    code = one(spark, "e-330", T.normalize_e_code)
    assert one(spark, code, T.normalize_e_code) == code


def test_validity(spark):
    for raw, want in (("salt", True), ("magne", False), ("e330", True), ("refrigerated dough", True), ("best before end", False), ("a b c d e f", False), ("молоко", False), ("100g 5kg", False), ("e500ii", False), (None, False)):
        assert one(spark, raw, T.valid_ingredient) is want


def test_variants(spark):
    assert sorted(one(spark, "Juice, apple", T.comma_variants)) == ["apple juice", "juice, apple"]
    assert "skimmedmed milk" in one(spark, "skimmed milk", T.spelling_variants)
    assert one(spark, 2.5 and "w w w w w", T.approx_tokens) == 6


def test_rich_tags(spark):
    df = spark.createDataFrame([(1, "EN:Sugar, fr:sucre,,sugar,en:added-sugar,en:contains,en:e500(ii)"), (2, None), (3, " ")], "row_id long, ingredients_tags string")
    got = {r.original_tag: r for r in tags.parse_tags(df).collect()}
    assert got["EN:Sugar"].tag_lang == "en" and got["sugar"].tag_lang == "" and got["en:added-sugar"].is_context_term and got["en:contains"].is_noise_phrase and not got["en:e500(ii)"].is_valid
    english = [r.ingredient for r in tags.english_tags(spark.createDataFrame([(1, "en:sugar,fr:sucre,en:salt")], "row_id long, ingredients_tags string")).orderBy("pos").collect()]
    assert english == ["sugar", "salt"]


def test_taxonomy(spark):
    lines = spark.createDataFrame([(1, "en:Milk, whole milk"), (2, "fr:lait"), (3, "en:Cream, whole-milk"), (4, "en:, x")], "line_no int, value string")
    assert {r.key: r.canonical for r in tags.build_taxonomy(lines).collect()} == {"milk": "milk", "whole milk": "cream", "cream": "cream"}


def test_sentences(spark):
    df = spark.createDataFrame([("Name.", "NAME", None)], "a string, b string, c string")
    assert df.select(T.product_text(F.col("a"), F.col("b"), F.col("c"), F.lit("en:x-y"), F.lit("i"))).head()[0] == "Name. NAME. x y. i."


def test_keys_follow_the_unicode_tables(spark):
    """T1 and T2 against the standard library, over texts of many scripts."""
    rng = random.Random(7)
    blocks = [(0x20, 0x7E), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2070, 0x218F), (0x3000, 0x30FF), (0xAC00, 0xAC40), (0xFB00, 0xFB06), (0xFF00, 0xFFEE)]
    texts = ["".join(chr(rng.randint(*rng.choice(blocks))) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.lookup_key(F.col("x")).alias("key"), T.clean_text(F.col("x")).alias("clean")).collect()
    for r in got:
        x = texts[r.i]
        flat = unicodedata.normalize("NFKC", x)
        low = "".join(c.lower() if c not in "Σİ" else c for c in flat)
        if not x.strip() or "Σ" in flat or "İ" in flat:
            continue  # context-dependent lower case
        assert r.key == " ".join(low.strip().translate({45: " ", 95: " "}).split()), repr(x)
        assert r.clean == " ".join(flat.split()).translate({45: " ", 95: " "}).strip(), repr(x)
