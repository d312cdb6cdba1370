"""The batch pipeline as one plan for each table that it leaves: products to ingredient rows, terms with text, matches, and products with their matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import hierarchy as H
from larder.operators import matching as M
from larder.operators import tags


@dataclass
class Coded:
    ingredients: DataFrame
    terms: DataFrame
    matches: DataFrame
    products: DataFrame


def term_table(raw: DataFrame) -> DataFrame:
    """Terms in use (not deprecated, no feed), with their level and a text (T21 where none is given)."""
    kept = H.without_feed(raw.where(~F.col("status").eqNullSafe("DEPRECATED")))
    built = T.term_text(F.col("termExtendedName"), F.col("commonNames"), F.col("scientificNames"))
    return kept.withColumn("reportHierarchyLevel", H.depth(F.col("reportHierarchyCode"))).withColumn("nlp_text", F.coalesce("nlp_text", F.nullif(built, F.lit("")), "termExtendedName"))


def code_products(products: DataFrame, raw_terms: DataFrame, params: M.MatchParams = M.RUNS["small"], taxonomy: DataFrame | None = None, language: str = "en") -> Coded:
    """Every table is lazy; distinct ingredients are matched once and joined back."""
    rows = tags.ingredient_rows(tags.food_products(products, language), taxonomy)
    terms = term_table(raw_terms)
    matches = M.match_names(M.matchable(rows, strict=True), terms, params)
    p, m = rows.alias("p"), matches.alias("m")
    on = (F.col("p.ingredient") == F.col("m.ingredient")) & F.col("p.matchable") & (F.col("p.tag_lang") == "en") & ~F.coalesce(F.col("p.is_additive"), F.lit(False))
    out = p.join(m, on, "left").select("p.*", "m.term", "m.mode", "m.score", "m.confidence")
    return Coded(rows, terms, matches, out)
