import random
from pathlib import Path

import pytest

from larder.llm import langid

DATA = Path("/root/testdata/sf0.01")
SAMPLES = [
    ("en", "wheat flour, sugar, sea salt, whole milk, butter, Ingredients: eggs with honey"), ("fr", "farine de blé, sucre, sel de mer, lait entier, beurre, Ingrédients : œufs avec miel"),
    ("de", "Weizenmehl, Zucker, Meersalz, Vollmilch, Zutaten: Eier mit Honig und Butterreinfett"),
]
READER = langid.Reader(langid.Filters.learn(SAMPLES))


def segments(text):
    return [(lang, n) for lang, _, n in READER.segments(*langid.parts([text])[0])]


def test_texts():
    assert segments("sugar, whole milk, E330, butter") == [("en", 4)]
    assert segments("Ingrédients : sucre, lait entier. Zutaten: Zucker, Vollmilch, Weizenmehl") == [("fr", 2), ("de", 3)]
    assert segments("E330, E 471") == [] and segments(None) == [] and segments(" ") == []
    assert READER.one("Каша овсяная с ягодами")[0] == "ru" and READER.one("Γιαούρτι με μέλι")[0] == "el"
    assert READER.one("ｗｈｅａｔ ｆｌｏｕｒ with sugаr")[0] == "en" and READER.one("12 %") is None and READER.one("xqzk") == ("und", 0.0)


def test_false_positives_are_corrected():
    f = langid.Filters.learn(SAMPLES)
    assert ((0 <= f.false) & (f.false < 0.01)).all()
    full = langid.Filters(f.languages, f.masks | 1)  # the first language seems to have everything
    assert full.false[0] == 1 and full.languages == f.languages


def test_table(spark):
    f = langid.Filters.learn(SAMPLES)
    data = [(1, "sugar, milk", "en", 1), (2, "sugar, milk", "EN", 1), (3, "sucre, lait entier, sel de mer. Zutaten: Zucker, Vollmilch, Meersalz", "fr", 1), (4, None, "en", 1), (5, "E330", None, 1), (6, " ", "x", 1), (7, "sugar, milk, butter", None, 1), (7, "sugar, milk, butter", None, 1), (8, "sugar, " * 20_000, "en", 1)]
    df = spark.createDataFrame(data, "row_id long, t string, label string, lang int")
    got = sorted((r.row_id, r.seg_no, r.lang) for r in langid.label_cases(df, "t", "label", f).collect())
    assert got == [(2, 0, "en"), (3, 0, "fr"), (3, 1, "de"), (7, 0, "en"), (7, 0, "en")]
    assert langid.identify(df.limit(0), "t", f).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    """Labels of rows that weren't learned from: most are right, and a wrong one is found."""
    rows, samples = spark.read.parquet(f"{DATA}/products_with_language1.parquet"), spark.read.parquet(f"{DATA}/lang_samples.parquet")
    fields = (("ingredients_text", "lang_ingredients_text"),)
    f = langid.learn(rows.where("row_id % 2 = 0"), samples, fields)
    got = {r.row_id: r.lang for r in langid.identify(rows.where("row_id % 2 = 1"), "ingredients_text", f).where("n_segments = 1").collect()}
    labels = {r.row_id: r.lang_ingredients_text for r in rows.where("row_id % 2 = 1").collect()}
    known = {k: v for k, v in got.items() if labels[k] in f.languages}
    assert sum(labels[k] == v for k, v in known.items()) / len(known) > 0.93


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_joined_texts_are_cut_where_they_were_joined(spark):
    rows, samples = spark.read.parquet(f"{DATA}/products_with_language1.parquet"), spark.read.parquet(f"{DATA}/lang_samples.parquet")
    f = langid.learn(rows, samples, (("ingredients_text", "lang_ingredients_text"),))
    reader, rng = langid.Reader(f), random.Random(3)
    texts = [(r.lang, r.text) for r in samples.collect() if r.text.count(",") >= 5]
    right = 0
    for _ in range(200):
        (a, x), (b, y) = rng.sample(texts, 2)
        got = [lang for lang, _, _ in reader.segments(*langid.parts([x.rstrip(" .") + ", " + y])[0])]
        right += got == ([a, b] if a != b else [a])
    assert right >= 195


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_both_fields_have_a_language_and_confidence(spark):
    from larder.llm.queries import QUERIES

    at = str(DATA).replace("sf0.01", "sf0.001")
    got = QUERIES["p3_languages"](spark, at).toPandas()
    assert set(got["field"]) == {"ingredients_text", "product_name"} and got["confidence"].between(0, 1).all() and got["lang"].notna().all()
    rows = spark.read.parquet(f"{at}/products_with_language1.parquet").toPandas()
    for field in ("ingredients_text", "product_name"):
        worded = {r.row_id for r in rows.itertuples() if langid.words(getattr(r, field) or "")}
        assert len(worded - set(got["row_id"][got["field"] == field])) <= 0.02 * len(worded)


RUSSIAN = "мука пшеничная, сахар, соль, молоко, масло, яйца, вода питьевая, дрожжи, сыр, мёд"
UKRAINIAN = "борошно пшеничне, цукор, сіль, молоко незбиране, олія, яйця, вода питна, дріжджі, сир кисломолочний, мед"


def test_languages_of_one_script_are_told_by_their_grams(spark):
    samples = spark.createDataFrame([("en", SAMPLES[0][1]), ("ru", RUSSIAN), ("uk", UKRAINIAN)], "lang string, text string")
    rows = spark.createDataFrame([(1, None, None)], "row_id long, t string, label string")
    reader = langid.Reader(langid.learn(rows, samples, (("t", "label"),)))
    assert reader.one("цукор та сіль, олія")[0] == "uk" and reader.one("сахар, мука пшеничная, масло")[0] == "ru"
    assert [(lang, n) for lang, _, n in reader.segments(*langid.parts(["sugar, whole milk, цукор, сіль, борошно пшеничне"])[0])] == [("en", 2), ("uk", 3)]
    assert reader.one("Γιαούρτι με μέλι")[0] == "el"  # no sample is Greek


@pytest.mark.parametrize("n", [16, 17, 40])
def test_many_languages_and_many_samples(spark, n):
    """No language is lost, wherever it stands in the alphabet and whatever number of samples stand before it."""
    rng = random.Random(n)
    word = lambda seed: "".join(random.Random(str(seed)).choices("abcdefghijklmnopqrstuvwxyz", k=8))
    samples = [(f"l{i:02d}", ", ".join(word((i, rng.randrange(30))) for _ in range(12))) for i in range(n) for _ in range(60 if i else 400)]
    rows = spark.createDataFrame([(1, None, None)], "row_id long, t string, label string")
    f = langid.learn(rows, spark.createDataFrame(samples, "lang string, text string"), (("t", "label"),), sample_rows=50)
    reader = langid.Reader(f)
    assert len(f.languages) == n and all(reader.one(", ".join(word((i, k)) for k in range(4)))[0] == f"l{i:02d}" for i in range(n))
    with pytest.raises(ValueError):
        langid.Lesson([str(i) for i in range(langid.MOST_LANGUAGES + 1)])


def test_tasks_learn_what_one_would(spark):
    samples = SAMPLES * 5
    rows = spark.createDataFrame([(1, None, None)], "row_id long, t string, label string")
    f, g = langid.learn(rows, spark.createDataFrame(samples, "lang string, text string").repartition(4), (("t", "label"),)), langid.Filters.learn(samples)
    assert f.languages == g.languages and (f.masks == g.masks).all() and f.scripts == g.scripts
    empty = langid.learn(rows, spark.createDataFrame([], "lang string, text string"), (("t", "label"),))
    assert langid.Reader(empty).one("sugar") == ("und", 0.0)


def calibration_error(told):
    """Mean distance between confidence and accuracy over ten bins of (confidence, right)."""
    bins = {}
    for c, ok in told:
        bins.setdefault(min(9, int(c * 10)), []).append((c, ok))
    return sum(abs(sum(c for c, _ in b) - sum(ok for _, ok in b)) for b in bins.values()) / len(told)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_confidence_is_calibrated_on_held_out_values(spark):
    from pyspark.sql import functions as F

    rows, samples = spark.read.parquet(f"{DATA}/products_with_language1.parquet"), spark.read.parquet(f"{DATA}/lang_samples.parquet")
    fields, told = (("ingredients_text", "lang_ingredients_text"), ("product_name", "lang_product_name")), []
    for half in (0, 1):
        reader = langid.Reader(langid.learn(rows, samples.where(F.col("sample_id") % 2 == half), fields))
        for r in samples.where(F.col("sample_id") % 2 != half).collect():
            for v in langid.parts([r.text])[0][0]:
                if (got := reader.one(v)) and got[0] != langid.UNKNOWN:
                    told.append((got[1], got[0] == r.lang))
    print("values", len(told), "accuracy", sum(ok for _, ok in told) / len(told), "calibration error", calibration_error(told))
    assert calibration_error(told) < 0.1


def test_long_captions():
    long = "ingredients of the creamy filling and of the crisp coating made in our own bakery"
    assert langid.parts([f"{long}: milk, salt"]) == [(["milk", "salt"], [long, ""])]
