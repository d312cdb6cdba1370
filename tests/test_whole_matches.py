"""Matches over all items and all ingredients, and the live match of what the cache lacks."""

from pathlib import Path

import numpy as np
import pytest

from larder.operators import matching as M
from larder.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_top3_over_all_items(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(e["embedding"].tolist(), float), e["vec_id"].to_numpy()
    want = {i: list(ids[np.lexsort((ids, -np.round(s, 12)))[:3]]) for i, s in zip(ids, x @ x.T)}
    got = {r.query_id: [r.top1_code, r.top2_code, r.top3_code] for r in QUERIES["M17_top3_all"](spark, str(DATA)).collect()}
    assert got == want


def test_misses_are_matched(spark):
    terms = [("A01", "Fruit", "Z0001.0001", 2), ("A02", "Apple fruit", "Z0001.0001.0001", 3), ("A03", "Milk", "Z0001.0002", 2)]
    terms = spark.createDataFrame(terms, "termCode string, termExtendedName string, reportHierarchyCode string, reportHierarchyLevel int")
    results = spark.createDataFrame([("Apple", "A02", 0.9, "HIGH")], "ingredient string, term string, score double, confidence string")
    queries = spark.createDataFrame([("Apple",), ("apple",), ("milk",), ("zzzz",), (None,)], "ingredient string")
    got = {r.ingredient: (r.hit, r.term, r.confidence) for r in M.match_cached(queries, results, terms).collect()}
    assert got["Apple"] == ("exact", "A02", "HIGH") and got["apple"] == ("lower", "A02", "HIGH")
    assert got["milk"] == ("live", "A03", "LOW") and got["zzzz"][::2] == ("live", "NO_MATCH") and got[None][::2] == ("live", "NO_MATCH")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_ingredient_is_answered(spark):
    rows = spark.read.parquet(f"{DATA}/products_ingredients.parquet")
    got, strict = QUERIES["M21_cached_match"](spark, str(DATA)).toPandas(), {r[0] for r in M.matchable(rows, strict=True).collect()}
    assert sorted(map(str, got["ingredient"])) == sorted(str(r[0]) for r in rows.select("ingredient").distinct().collect())
    assert set(got["ingredient"][got["hit"] == "exact"]) == strict and got["confidence"].notna().all()
