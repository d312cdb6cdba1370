from pyspark.sql import functions as F

from larder.functions import lexical as L


def test_grams(spark):
    df = spark.createDataFrame([("Rapsöl", "rapsÖL"), ("ab", "b"), ("", "x"), (None, "x"), ("abab", "ba"), ("a" * 50_000, "aa")], "a string, b string")
    got = [(r.j2, r.j3) for r in df.select(L.gram_jaccard(F.col("a"), F.col("b"), 2).alias("j2"), L.gram_jaccard(F.col("a"), F.col("b"), 3).alias("j3")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    for n in (1, 2, 3):
        sets = df.select(L.jaccard(L.char_grams(F.col("a"), n), L.char_grams(F.col("b"), n)).alias("j"), L.gram_jaccard(F.col("a"), F.col("b"), n).alias("k")).collect()
        assert all(r.j == r.k for r in sets)
