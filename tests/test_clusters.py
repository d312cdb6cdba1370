"""The registered cluster queries do the whole sweep and all starts."""

from pathlib import Path

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from larder.operators import clustering as K
from larder.queries import QUERIES

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_elbow_has_every_k(spark, monkeypatch):
    asked, real = [], K._cheapest
    monkeypatch.setattr(K, "_cheapest", lambda f, k, seed, starts: asked.append((k, starts)) or real(f, k, seed, 1))  # one start, for time
    got = QUERIES["C5_elbow"](spark, str(DATA)).collect()
    assert [r.k for r in got] == list(range(2, 21)) and asked == [(k, 10) for k in range(2, 21)]


def test_elbow_takes_the_cheapest_of_ten(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    f = e.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("f")).cache()
    least = min(KMeans(featuresCol="f", k=5, seed=42 + i).fit(f).summary.trainingCost for i in range(10))
    assert K.elbow(e, "embedding", range(5, 6)).first().inertia == pytest.approx(least)


def test_kmeans_is_the_cheapest_of_ten(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("f")).cache()
    models = [KMeans(featuresCol="f", predictionCol="c", k=12, seed=42 + i).fit(e) for i in range(10)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    want = {(r.vec_id, r.c) for r in best.transform(e).collect()}
    assert {tuple(r) for r in QUERIES["C4_kmeans"](spark, str(DATA)).select("vec_id", "cluster").collect()} == want
