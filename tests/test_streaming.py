from larder.operators import tags
from larder.streaming import ingest


def test_ingredient_stream(spark, tmp_path):
    schema = "code string, lang_product_name string, product_name string, ingredients_tags string"
    one = spark.createDataFrame([("1", "en", "Soup", "en:salt,fr:farine"), ("2", None, None, None)], schema)
    one.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart repeats nothing
        s = ingest.read_stream(spark, str(tmp_path / "in"), one.schema)
        ingest.write_stream(ingest.ingredient_stream(s), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
        assert tags.ingredient_rows(one).count() == 2
    spark.createDataFrame([("3", "en", "Bread", "en:yeast")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.write_stream(ingest.ingredient_stream(ingest.read_stream(spark, str(tmp_path / "in"), one.schema)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_state_and_repeats(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, 1.0), (1, "2024-01-01 00:00:00", 7, 1.0), (2, "2024-01-01 00:10:00", 7, 2.0), (3, "2024-01-01 09:00:00", 8, 5.0)], "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), e.schema)
    seen = []
    q = ingest.running_totals(stream).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.n, r.total) for r in seen} == {(7, 3, 4.0), (8, 1, 5.0)}
    ingest.write_stream(ingest.without_repeats(ingest.read_stream(spark, str(tmp_path / "in"), e.schema), ["event_id"]), str(tmp_path / "out"), str(tmp_path / "s2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert ingest.sessions(e).count() == 2
