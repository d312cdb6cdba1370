"""How far a score follows the letters: correlations, group differences, bins, trend, suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.reports import pct


def correlations(df: DataFrame, metrics: tuple[str, ...], score: str) -> DataFrame:
    """Metric, r, verdict (0.5, 0.3, 0.1); all correlations in one pass, then turned round."""
    one = df.agg(*(F.round(F.corr(F.col(m).cast("double"), score), 6).alias(m) for m in metrics)).unpivot([], list(metrics), "metric", "r")
    a = F.abs("r")
    return one.withColumn("verdict", F.when(F.col("r").isNull(), "unknown").when(a >= 0.5, "strong").when(a >= 0.3, "moderate").when(a >= 0.1, "weak").otherwise("none"))


def mean_difference(df: DataFrame, score: str, flag: Column) -> DataFrame:
    """Counts, means with and without the flag, their difference, and t of the two-sample test with a pooled variance."""
    x, y = F.when(flag, F.col(score)), F.when(~flag, F.col(score))
    a = df.agg(F.count(x).alias("n_with"), F.count(y).alias("n_without"), F.avg(x).alias("a"), F.avg(y).alias("b"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"))
    n, m = F.col("n_with"), F.col("n_without")
    pooled = ((n - 1) * F.col("va") + (m - 1) * F.col("vb")) / F.nullif(n + m - 2, F.lit(0))
    t = (F.col("a") - F.col("b")) / F.nullif(F.sqrt(pooled * (1 / F.nullif(n, F.lit(0)) + 1 / F.nullif(m, F.lit(0)))), F.lit(0.0))
    return a.select("n_with", "n_without", F.round("a", 6).alias("mean_with"), F.round("b", 6).alias("mean_without"), F.round(F.col("a") - F.col("b"), 6).alias("diff"), F.round(t, 4).alias("t"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the least squares line."""
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


def suspects(df: DataFrame, overlap: str, score: str, by: str, low: float = 0.4, high: float = 0.7) -> DataFrame:
    """By class, rows whose overlap and score are both large, and their share."""
    hit = F.count_if((F.col(overlap) > low) & (F.col(score) > high))
    return df.groupBy(by).agg(hit.alias("n"), pct(hit, F.count(F.lit(1))).alias("pct"))


def low_scores(df: DataFrame, code: str, score: str, below: float) -> DataFrame:
    """Code, n, the share of low scores and the smallest example."""
    low = F.col(score) < below
    return df.groupBy(code).agg(F.count(F.lit(1)).alias("n"), pct(F.count_if(low), F.count(F.lit(1))).alias("pct_low"), F.min(F.when(low, F.col("ingredient"))).alias("example"))
