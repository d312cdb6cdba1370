"""Clusters of vectors: k-means, elbow, silhouettes, projection, profiles."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.reports import pct
from larder.session import materialise


def _features(df: DataFrame, v: str) -> DataFrame:
    return df.withColumn("__f", array_to_vector(F.col(v).cast("array<double>")))


def _cheapest(f: DataFrame, k: int, seed: int, starts: int) -> KMeansModel:
    models = (KMeans(featuresCol="__f", predictionCol="cluster", k=k, seed=seed + i).fit(f) for i in range(starts))
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans(df: DataFrame, key: str, v: str, k: int = 12, seed: int = 42, starts: int = 10) -> DataFrame:
    """C4: key, cluster of the cheapest of `starts` runs."""
    f = _features(df.select(key, v), v).cache()
    out = materialise(_cheapest(f, k, seed, starts).transform(f).select(key, "cluster"))  # written while the rows are cached
    f.unpersist()
    return out


def elbow(df: DataFrame, v: str, ks: range = range(2, 21), seed: int = 42, starts: int = 10, at_once: int = 8) -> DataFrame:
    """K, inertia, silhouette (by squared Euclidean distance) of the cheapest of `starts` runs for each k; `at_once` ks are fitted side by side."""
    f = _features(df.select(v), v).cache()
    f.count()  # cached before the fits share it

    def one(k: int) -> tuple[int, float, float]:
        m = _cheapest(f, k, seed, starts)
        return k, float(m.summary.trainingCost), float(ClusteringEvaluator(featuresCol="__f", predictionCol="cluster").evaluate(m.transform(f)))

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(one, ks))
    f.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def project(df: DataFrame, key: str, v: str, k: int = 2) -> DataFrame:
    """Key, x, y by principal components; Spark has no neighbour-graph projection."""
    f = _features(df.select(key, v), v)
    p = PCA(k=k, inputCol="__f", outputCol="__p").fit(f).transform(f).withColumn("__a", vector_to_array("__p"))
    return p.select(key, F.get("__a", F.lit(0)).alias("x"), F.get("__a", F.lit(1)).alias("y"))


def distribution(df: DataFrame, cluster: str) -> DataFrame:
    """C7."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


def profile(df: DataFrame, cluster: str, lang: str, score: Column, text: str) -> DataFrame:
    """A row for each cluster: size, share, commonest language (ties by name), number of languages, score and text length."""
    langs = df.groupBy(cluster, lang).agg(F.count(F.lit(1)).alias("k"))
    top = langs.where(F.col(lang).isNotNull()).groupBy(F.col(cluster).alias("__c")).agg(F.min_by(lang, F.struct(-F.col("k"), lang)).alias("dominant"), F.count(F.lit(1)).alias("n_languages"))
    n = F.length(text)
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.round(F.stddev_samp(score), 4).alias("std_score"), F.round(F.avg(n), 4).alias("mean_len"), F.round(F.median(n), 4).alias("median_len"))
    return g.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy()))).join(top, F.col(cluster).eqNullSafe(F.col("__c")), "left").drop("__c")


def examples(df: DataFrame, cluster: str, order: str, n: int = 3) -> DataFrame:
    """The first n rows of each cluster."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(order))).where(F.col("rank") <= n)
