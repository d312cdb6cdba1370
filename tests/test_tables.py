from pyspark.sql import functions as F

from larder.operators import reports as R
from larder.operators import scoring as P
from larder.session import materialise, shared_dir
from larder.sources import files as S


def test_reader_skips_bad_rows(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('a\tb\tc\n1\t2\t3\n1\t2\n"q\tr"\t5\t6\n')
    got = S.read_delimited(spark, str(tmp_path / "x.tsv"), ["a", "c"]).collect()
    assert sorted((r.a, r.c) for r in got) == [("1", "3"), ("q\tr", "6")]
    (tmp_path / "t.txt").write_text("en:a\nfr:b\nen:c\n")
    assert [r.value for r in S.read_lines(spark, str(tmp_path / "t.txt"), "en:").orderBy("line_no").collect()] == ["en:a", "en:c"]


def test_materialise(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    got = materialise(df)
    assert got.schema == df.schema and got.count() == 2 and shared_dir(spark)


def test_update_takes_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    u = spark.createDataFrame([(1, None), (2, "B")], "k int, v string")
    assert {r.k: r.v for r in R.update_from(t, u, "k", ("v",)).collect()} == {1: None, 2: "B", 3: "c"}


def test_scores(spark):
    df = spark.createDataFrame([("p", "HIGH", 1.0), ("p", "MEDIUM", 0.5), ("p", "NO_MATCH", None)], "code string, confidence string, path_score double")
    assert P.strict_score(df, "code").head().score == round(0.4 * 0.5 + 0.3 / 3 + 0.2 * 2 / 3 + 0.1 / 3, 6)
    assert (P.pages(0, 20), P.pages(20, 20), P.pages(21, 20)) == (1, 1, 2)


def test_names_and_barcodes(spark):
    df = spark.createDataFrame([("123", "50% a_b", "t", "1"), ("123", "longer 50% a_b", "t", "2"), ("9", "50x ab", None, "3")], "code string, product_name string, ingredients_text string, loaded_at string")
    assert [r.product_name for r in P.by_name(df, "50% A_B").collect()] == ["50% a_b", "longer 50% a_b"]
    assert P.by_name(df, "123").head().loaded_at == "1"


def test_allocation_takes_the_overage_from_the_largest(spark):
    df = spark.createDataFrame([("a",)] * 900 + [("b",)] * 95 + [("c",)] * 5, "k string")
    assert {r.k: r.want for r in R.allocation(df, "k", 200, 20).collect()} == {"a": 160, "b": 20, "c": 5}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "code string, ingredient string, matchable boolean, product_name string, confidence string, path_score double")
    assert P.scored_products(e, e).count() == 0 and R.share(e, ("code",)).count() == 0
    assert R.column_stats(e, "path_score").head().total_rows == 0
    assert R.group_sample(e.withColumn("x", F.lit(1)), "code", "ingredient", 3).count() == 0
