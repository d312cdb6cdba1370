"""Fuzzy candidates against the scorer run on every variant."""

import pytest
from pyspark.sql import functions as F

from larder.functions import fuzzy
from larder.functions import text as T
from larder.operators.matching import MatchParams, fuzzy_candidates

NAMES = ["onion", "lemon", "apple", "mango", "apple juice", "sea salt", "salt salt", "red onion", "whole milk powder", "oat"]
QUERIES = ["onon", "leon", "aptle", "oinon", "leomn", "magno", "slat", "onion red", "salt", "milk milk", "dried apple juice", "xq", "", None]


def brute(k, params):
    hits = sorted((-s, v) for v in NAMES if (s := fuzzy.weighted(k, v)) >= params.cutoff)[: params.top_variants]
    return {v: -s for s, v in hits[: params.top_terms]}


@pytest.mark.parametrize("params", [MatchParams(), MatchParams(cutoff=40.0, top_variants=4, top_terms=3), MatchParams(cutoff=0.0, top_variants=5)])
def test_every_variant_that_reaches_the_cutoff(spark, params):
    var = spark.createDataFrame([(v, v, v) for v in NAMES], "term string, name string, variant string")
    queries = spark.createDataFrame([(q,) for q in QUERIES], "ingredient string")
    keys = {r.ingredient: r.k for r in queries.select("ingredient", T.lookup_key(F.col("ingredient")).alias("k")).collect()}
    got: dict = {q: {} for q in QUERIES if q is not None}
    for r in fuzzy_candidates(queries, var, params).collect():
        got[r.ingredient][r.term] = r.score
    assert got == {q: brute(keys[q], params) for q in got}
    if params == MatchParams():
        assert [round(got[q][t], 1) for q, t in (("onon", "onion"), ("aptle", "apple"), ("magno", "mango"))] == [88.9, 80.0, 80.0]
