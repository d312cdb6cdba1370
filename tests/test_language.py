from larder.operators.language import detect_language


def test_the_whole_text_counts(spark):
    late = "x " * 500 + "der Zucker und das Mehl mit dem Salz von der Mühle ist auf den Tisch"
    blank = " " * 1000 + "the milk and the sugar of the farm"
    df = spark.createDataFrame([(1, late), (2, blank), (3, None), (4, " " * 50), (5, "of the")], "row_id int, t string")
    got = {r.row_id: r.lang for r in detect_language(df, "t", ("row_id",)).collect()}
    assert got == {1: "de", 2: "en", 3: None, 4: None, 5: None}
    cut = {r.row_id: r.lang for r in detect_language(df, "t", ("row_id",), most=1000).collect()}
    assert cut == {**got, 1: None}
