"""Queries of relational reports (R), product scoring (P) and table operations (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import reports as R
from larder.operators import scoring as P
from larder.operators import vectors as V
from larder.plans.registry import Tables, query
from larder.session import shared_dir
from larder.sources import files as S

C = F.col
CLASSES = ("HIGH", "MEDIUM", "LOW", "NO_MATCH")

#: A relation of match results, by expressions that both engines read: the scores follow from the first row of an ingredient.
_COLUMNS = {
    "ingredient": "ingredient", "r": "r", "path_score": "CAST((r * 37) % 997 AS DOUBLE) / 997",
    "confidence": "CASE WHEN (r * 37) % 997 >= 800 THEN 'HIGH' WHEN (r * 37) % 997 >= 500 THEN 'MEDIUM' WHEN (r * 37) % 997 >= 150 THEN 'LOW' ELSE 'NO_MATCH' END",
    "final_level": "CAST(CASE WHEN r % 13 = 0 THEN -1 ELSE 2 + r % 5 END AS INT)", "matching_mode": "CASE r % 10 WHEN 0 THEN 'rf_exact' WHEN 9 THEN 'beam' ELSE 'rf_reranked' END",
    "rf_used": "r % 10 < 9", "rf_score": "CAST(65 + (r * 7) % 36 AS DOUBLE)", "bge_score": "CAST((r * 53) % 997 AS DOUBLE) / 997", "lexical_score": "CAST((r * 11) % 101 AS DOUBLE) / 101",
    "branch_prior": "CAST((r * 29) % 499 AS DOUBLE) / 997", "exact_variant": "r % 10 = 0", "level2_code": "concat('L', CAST(r % 7 AS STRING))", "level2_score": "CAST((r * 17) % 997 AS DOUBLE) / 997",
    "level3_score": "CAST((r * 19) % 997 AS DOUBLE) / 997", "specific_code": "CASE WHEN r % 4 = 0 THEN NULL ELSE concat('A', CAST(r % 97 AS STRING)) END", "specific_score": "CAST((r * 23) % 997 AS DOUBLE) / 997",
    "top1_code": "concat('A', CAST(r % 97 AS STRING))", "top2_code": "concat('A', CAST(r % 89 AS STRING))", "top1_score": "CAST((r * 37) % 997 AS DOUBLE) / 997",
    "top2_score": "CASE WHEN r % 11 = 0 THEN NULL ELSE CAST((r * 37) % 997 AS DOUBLE) / 997 - CAST(r % 20 AS DOUBLE) / 103 END", "top3_score": "CASE WHEN r % 6 = 0 THEN NULL ELSE CAST((r * 31) % 293 AS DOUBLE) / 997 END",
    "verdict": "CASE r % 5 WHEN 0 THEN 'Y' WHEN 1 THEN ' y ' WHEN 2 THEN 'n' WHEN 3 THEN '?' END",
}
_BASE = "(SELECT ingredient, min(row_id) AS r FROM products_ingredients WHERE matchable GROUP BY ingredient)"
RES = "(SELECT " + ", ".join(f"{e} AS {k}" for k, e in _COLUMNS.items()) + f" FROM {_BASE})"


def results(t: Tables) -> DataFrame:
    base = t.products_ingredients.where("matchable").groupBy("ingredient").agg(F.min("row_id").alias("r"))
    return base.selectExpr(*(f"{e} AS {k}" for k, e in _COLUMNS.items()))


# Products


_P1 = f"""WITH listed AS (SELECT code, lower(ingredient) AS word, max(product_name) AS title FROM products_ingredients WHERE matchable GROUP BY ALL),
judged AS (SELECT lower(ingredient) AS word, arg_max({{'c': confidence, 's': path_score}}, {{'s': path_score, 'i': ingredient}}) AS best FROM {RES} GROUP BY 1),
seen AS (SELECT code, title, best.c AS c, best.s AS s, judged.word IS NULL AS lost FROM listed LEFT JOIN judged USING (word)),
counts AS (SELECT code, max(title) AS title, count(*) AS n, count_if(c = 'HIGH') AS h, count_if(c = 'MEDIUM') AS d, count_if(c <> 'NO_MATCH') AS k, count_if(lost) AS lost, coalesce(avg(s), 0) AS a FROM seen GROUP BY code)
SELECT code, coalesce(title, 'Sin nombre') AS product_name, n AS total_ingredients, h::BIGINT AS high_count, d::BIGINT AS medium_count, k::BIGINT AS matched_count, lost::BIGINT AS no_match_count,
  round(0.4::DOUBLE * a + (0.3::DOUBLE * h + 0.2::DOUBLE * k + 0.1::DOUBLE * d) / n, 4) AS confidence_score FROM counts ORDER BY confidence_score DESC, code LIMIT 5000"""


@query(_P1)
def P1_scored_products(t: Tables) -> DataFrame:
    """The flagship."""
    return P.scored_products(t.products_ingredients, results(t))


@query("SELECT row_id, ingredient FROM products_ingredients WHERE code = '2000000490489' AND matchable")
def P2_product_ingredients(t: Tables) -> DataFrame:
    return t.products_ingredients.where("code = '2000000490489' AND matchable").select("row_id", "ingredient")


@query("SELECT code, product_name, ingredients_text, allergens, traces FROM products WHERE code = '2000000490489' AND ingredients_text IS NOT NULL ORDER BY loaded_at LIMIT 1")
def P3_barcode(t: Tables) -> DataFrame:
    return P.by_barcode(t.products, "2000000490489 ").select("code", "product_name", "ingredients_text", "allergens", "traces")


@query("SELECT code, product_name, ingredients_text, allergens, traces FROM products WHERE lower(product_name) LIKE '%so_p%with%' AND ingredients_text IS NOT NULL ORDER BY length(product_name), product_name, code LIMIT 15")
def P4_name_search(t: Tables) -> DataFrame:
    return P.by_name(t.products, "So_p%with").select("code", "product_name", "ingredients_text", "allergens", "traces")


_PM = f"(SELECT p.row_id, p.code, p.ingredient, coalesce(r.confidence, 'NO_MATCH') AS confidence, r.path_score, r.top1_score, r.top2_score, r.specific_code FROM products_ingredients p LEFT JOIN {RES} r ON r.ingredient = p.ingredient)"


def _joined(t: Tables) -> DataFrame:
    r = results(t).select("ingredient", C("confidence").alias("c"), "path_score", "top1_score", "top2_score", "specific_code")
    return t.products_ingredients.select("row_id", "code", "ingredient").join(r, "ingredient", "left").withColumn("confidence", F.coalesce("c", F.lit("NO_MATCH"))).drop("c")


@query(f"SELECT code, round(0.4::DOUBLE * avg(coalesce(path_score, 0)) + 0.3::DOUBLE * avg((confidence = 'HIGH')::INT) + 0.2::DOUBLE * avg((confidence <> 'NO_MATCH')::INT) + 0.1::DOUBLE * avg((confidence = 'MEDIUM')::INT), 6) AS score FROM {_PM} GROUP BY code")
def P5_strict_score(t: Tables) -> DataFrame:
    return P.strict_score(_joined(t), "code")


_FLAGS = "list_filter([CASE WHEN confidence = 'NO_MATCH' THEN 'UNKNOWN_INGREDIENT' END, CASE WHEN confidence = 'LOW' THEN 'LOW_CONFIDENCE' END, CASE WHEN top2_score > 0 AND top1_score - top2_score < 0.05 THEN 'MULTIPLE_CANDIDATES' END], lambda x: x IS NOT NULL)"


@query(f"SELECT row_id, array_to_string({_FLAGS}, ',') AS flags FROM {_PM}")
def P6_flags(t: Tables) -> DataFrame:
    return _joined(t).select("row_id", F.array_join(P.flags(C("confidence"), C("top1_score"), C("top2_score")), ",").alias("flags"))


@query(f"SELECT code, string_agg(f, ',' ORDER BY o, i) AS flags FROM (SELECT code, f, min(row_id) AS o, arg_min(i, row_id) AS i FROM (SELECT code, row_id, unnest(f) AS f, generate_subscripts(f, 1) AS i FROM (SELECT code, row_id, {_FLAGS} AS f FROM {_PM})) GROUP BY 1, 2) GROUP BY 1")
def P8_product_flags(t: Tables) -> DataFrame:
    df = _joined(t).select("code", "row_id", P.flags(C("confidence"), C("top1_score"), C("top2_score")).alias("f"))
    return P.ordered_union(df, "code", "row_id", "f", "flags").select("code", F.array_join("flags", ",").alias("flags"))


_MAP = "(SELECT CASE WHEN i % 9 = 0 THEN NULL WHEN i % 9 = 1 THEN '# A' || i ELSE 'A' || (i % 97) END AS foodex2_code, ['milk', 'gluten', 'soy', 'eggs'][1 + i % 4] AS allergen, CASE WHEN i % 3 = 0 THEN 'CERTAIN' ELSE 'POSSIBLE' END AS certainty FROM range(0, 150) t(i))"


def _allergen_map(t: Tables) -> DataFrame:
    i = C("id")
    code = F.when(i % 9 == 0, None).when(i % 9 == 1, F.concat(F.lit("# A"), i)).otherwise(F.concat(F.lit("A"), i % 97))
    return t.spark.range(150).select(code.alias("foodex2_code"), F.element_at(F.array(*map(F.lit, ("milk", "gluten", "soy", "eggs"))), (i % 4 + 1).cast("int")).alias("allergen"), F.when(i % 3 == 0, "CERTAIN").otherwise("POSSIBLE").alias("certainty"))


@query(f"""SELECT p.row_id, coalesce(string_agg(DISTINCT a.allergen || ':' || a.certainty, ',' ORDER BY a.allergen || ':' || a.certainty), '') AS allergens FROM {_PM} p LEFT JOIN {_MAP} a ON a.foodex2_code = p.specific_code AND NOT starts_with(a.foodex2_code, '#') GROUP BY 1""")
def P9_allergens_by_code(t: Tables) -> DataFrame:
    got = P.allergens_of(_joined(t), "specific_code", _allergen_map(t))
    return got.select("row_id", F.coalesce(F.array_join(F.transform("allergens", lambda x: F.concat_ws(":", x["allergen"], x["certainty"])), ","), F.lit("")).alias("allergens"))


#: Allergen, certainty and pattern of words that don't tell for sure.
_PATTERNS = (
    ("milk", "POSSIBLE", "milk|whey|cream"), ("gluten", "CERTAIN", "wheat|rye|barley"), ("gluten", "POSSIBLE", "starch|malt"), ("fish", "POSSIBLE", "tuna|salmon"), ("soy", "POSSIBLE", "lecithin|protein"), ("eggs", "POSSIBLE", "albumin"),
)


def _hits(text: str, shown: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{shown.format(a, c)}' END" for a, c, p in _PATTERNS)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(f"""WITH m AS (SELECT p.row_id, any_value(p.ingredient) AS ingredient, CASE WHEN any_value(p.confidence) <> 'NO_MATCH'
    THEN coalesce(list_sort(list_distinct(list(a.allergen || ':' || a.certainty) FILTER (a.allergen IS NOT NULL))), []) ELSE [] END AS mapped
  FROM {_PM} p LEFT JOIN {_MAP} a ON a.foodex2_code = p.specific_code AND NOT starts_with(a.foodex2_code, '#') GROUP BY 1),
h AS (SELECT *, coalesce({_hits("lower(ingredient)", "{}:{}")}, []) AS hits FROM m)
SELECT row_id, array_to_string(list_concat(mapped, list_filter(hits, lambda x: NOT list_contains(mapped, x))), ',') AS allergens, len(hits) > 0 AS ambiguous FROM h""")
def P10_enriched_allergens(t: Tables) -> DataFrame:
    got = P.enriched(_joined(t), "specific_code", "confidence", "ingredient", _allergen_map(t), _PATTERNS)
    return got.select("row_id", F.array_join(F.transform("allergens", lambda x: F.concat_ws(":", x["allergen"], x["certainty"])), ",").alias("allergens"), "ambiguous")


_SAID = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(allergens, '') || ',' || coalesce(traces, ''), ','), lambda x: map {" + ", ".join(f"'{k}': '{v}'" for k, v in P.ALLERGEN_TAGS.items()) + "}[lower(trim(x))]), lambda x: x IS NOT NULL)))"
_SEEN = _hits("coalesce(ingredients_text, '')", "{0}").replace("list_filter(", "list_distinct(list_filter(", 1) + ")"
_IN_ORDER = "array_to_string(list_filter(['milk', 'gluten', 'fish', 'soy', 'eggs'], lambda s: list_contains({0}, s) AND NOT list_contains({1}, s)), ',')"


@query(f"SELECT code, CAST(loaded_at AS VARCHAR) AS loaded, array_to_string({_SAID}, ',') AS declared, CASE WHEN len({_SAID}) > 0 THEN {_IN_ORDER.format(_SEEN, _SAID)} ELSE '' END AS undeclared FROM products")
def P11_P12_declared_and_undeclared(t: Tables) -> DataFrame:
    said = P.declared(C("allergens"), C("traces"))
    seen = P.named_in(F.coalesce("ingredients_text", F.lit("")), _PATTERNS)
    return t.products.select("code", C("loaded_at").cast("string").alias("loaded"), F.array_join(said, ",").alias("declared"), F.array_join(P.undeclared(seen, said), ",").alias("undeclared"))


@query(f"""WITH f AS (SELECT code, row_id, {_hits("ingredient", "{0}")} AS f FROM products_ingredients), e AS (SELECT code, row_id, unnest(f) AS a, generate_subscripts(f, 1) AS i FROM f),
g AS (SELECT code, a, min(row_id) AS o, min(row_id * 100 + i) AS i FROM e GROUP BY 1, 2)
SELECT code, string_agg(a, ',' ORDER BY i) AS allergens FROM g GROUP BY 1""")
def P13_unique_allergens(t: Tables) -> DataFrame:
    df = t.products_ingredients.select("code", "row_id", P.named_in(C("ingredient"), _PATTERNS).alias("f"))
    return P.ordered_union(df, "code", "row_id", "f", "allergens").select("code", F.array_join("allergens", ",").alias("allergens"))


@query(f"SELECT * FROM ({_P1}) WHERE confidence_score >= 0.3 AND total_ingredients >= 5 ORDER BY total_ingredients DESC, code LIMIT 20 OFFSET 20")
def P15_page(t: Tables) -> DataFrame:
    scored = P.scored_products(t.products_ingredients, results(t)).where("confidence_score >= 0.3 AND total_ingredients >= 5")
    return P.page(scored, "code", "total_ingredients", number=2)


@query("""SELECT code, product_name, generic_name, _source FROM (SELECT code, product_name, generic_name, 'products_with_language1' AS _source, 0 AS p FROM products_with_language1 UNION ALL SELECT code, product_name, generic_name, 'products', 1 FROM products)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY p, product_name NULLS LAST, generic_name NULLS LAST) = 1""")
def P16_provenance(t: Tables) -> DataFrame:
    return P.with_provenance([("products_with_language1", t.products_with_language1), ("products", t.products)], "code", ("product_name", "generic_name"))


# Filters, joins, counts


@query("SELECT termCode FROM foodex2_terms WHERE status IS DISTINCT FROM 'DEPRECATED'")
def R2_keeps_nulls(t: Tables) -> DataFrame:
    return t.foodex2_terms.where(~C("status").eqNullSafe("DEPRECATED")).select("termCode")


@query("SELECT row_id, coalesce(substr(product_name, 1, 40), '') AS a, coalesce(substr(ingredients_text, 1, 1000), '') AS b FROM products_with_language1 WHERE length(trim(coalesce(ingredients_text, product_name))) >= 20 AND (lang_ingredients_text IS NOT NULL OR lang_product_name IS NOT NULL)")
def R3_R4_long_enough(t: Tables) -> DataFrame:
    df = t.products_with_language1.where((F.length(F.trim(F.coalesce("ingredients_text", "product_name"))) >= 20) & (C("lang_ingredients_text").isNotNull() | C("lang_product_name").isNotNull()))
    return df.select("row_id", F.coalesce(F.substring("product_name", 1, 40), F.lit("")).alias("a"), F.coalesce(F.substring("ingredients_text", 1, 1000), F.lit("")).alias("b"))


@query(f"SELECT p.row_id, p.code, r.confidence, r.path_score FROM products_ingredients p LEFT JOIN {RES} r ON r.ingredient = p.ingredient")
def R5_results_join(t: Tables) -> DataFrame:
    r = results(t).select("ingredient", "confidence", "path_score")
    return t.products_ingredients.join(r, "ingredient", "left").select("row_id", "code", "confidence", "path_score")


@query(f"SELECT p.row_id, p.matchable, r.confidence, r.path_score FROM products_ingredients p LEFT JOIN {RES} r ON r.ingredient = p.ingredient AND p.matchable AND p.tag_lang = 'en' AND coalesce(p.is_additive, false) = false")
def R6_conditional_join(t: Tables) -> DataFrame:
    p, r = t.products_ingredients.alias("p"), results(t).alias("r")
    on = (C("p.ingredient") == C("r.ingredient")) & C("p.matchable") & (C("p.tag_lang") == "en") & ~F.coalesce(C("p.is_additive"), F.lit(False))
    return p.join(r, on, "left").select("p.row_id", "p.matchable", "r.confidence", "r.path_score")


@query("SELECT d.doc_id, d.source, w.target_share, s.n FROM documents d LEFT JOIN source_weights w ON w.source = d.source LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON s.source IS NOT DISTINCT FROM d.source")
def R7_null_keys_join(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source")
    n = t.documents.groupBy(C("source").alias("s2")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(t.source_weights.select("source", "target_share"), "source", "left").join(n, C("source").eqNullSafe(C("s2")), "left").select("doc_id", "source", "target_share", "n")


@query("SELECT DISTINCT ingredient FROM products_ingredients WHERE is_context_term ORDER BY ingredient LIMIT 50")
def R8_distinct_values(t: Tables) -> DataFrame:
    return t.products_ingredients.where("is_context_term").select("ingredient").distinct().orderBy("ingredient").limit(50)


@query("SELECT count(*) AS n, count(DISTINCT ingredient) AS different, count(*) FILTER (matchable) AS m FROM products_ingredients")
def R9_counts(t: Tables) -> DataFrame:
    return t.products_ingredients.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ingredient").alias("different"), F.count_if("matchable").alias("m"))


_PC = ", ".join(f"round(quantile_cont(x, {p}), 6) AS {k}" for k, p in {"p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}.items())


@query(f"SELECT count(*) AS total_rows, count(x) AS non_null, count(*) - count(x) AS null_count, round(100.0 * count(x) / count(*), 2)::DOUBLE AS pct_non_null, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std, {_PC} FROM (SELECT completeness AS x FROM products)")
def R10_column_stats(t: Tables) -> DataFrame:
    return R.column_stats(t.products, "completeness")


@query("SELECT floor(completeness * 10) / 10 AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM products WHERE completeness IS NOT NULL GROUP BY 1")
def R11_bucket_shares(t: Tables) -> DataFrame:
    return R.share(t.products.where("completeness is not null").withColumn("bucket", F.floor(C("completeness") * 10) / 10), ("bucket",))


_FILL = ("generic_name", "quantity", "brands", "labels", "packaging", "origins", "traces", "additives", "allergens")


@query("SELECT floor(completeness * 10) / 10 AS bucket, count(*) AS n, " + ", ".join(f"round(100.0 * count({c}) / count(*), 2)::DOUBLE AS {c}" for c in _FILL) + " FROM products WHERE completeness IS NOT NULL GROUP BY 1")
def R12_fill_by_bucket(t: Tables) -> DataFrame:
    return R.fill_by_bucket(t.products, "completeness", _FILL)


@query("SELECT round(corr(x, y), 6) AS pearson_r, round(avg(x), 6) AS mean_value, round(avg(y), 6) AS mean_fill_rate, CASE WHEN corr(x, y) IS NULL THEN 'unknown' WHEN round(corr(x, y), 6) >= 0.7 THEN 'strong' WHEN round(corr(x, y), 6) >= 0.5 THEN 'moderate' ELSE 'weak' END AS verdict FROM (SELECT completeness AS x, (" + " + ".join(f"CASE WHEN {c} IS NOT NULL AND trim({c}) <> '' THEN 1.0::DOUBLE ELSE 0 END" for c in _FILL) + f") / {len(_FILL)} AS y FROM products WHERE completeness IS NOT NULL)")
def R13_R14_fill_correlation(t: Tables) -> DataFrame:
    return R.fill_correlation(t.products, "completeness", _FILL)


@query("(SELECT 'low' AS side, code, completeness FROM products WHERE completeness IS NOT NULL ORDER BY completeness, code, loaded_at LIMIT 5) UNION ALL (SELECT 'high', code, completeness FROM products WHERE completeness IS NOT NULL ORDER BY completeness DESC, code, loaded_at LIMIT 5)")
def R15_extremes(t: Tables) -> DataFrame:
    p = t.products.where("completeness is not null").select("code", "loaded_at", "completeness")
    low = R.first_rows(p, [F.asc("completeness"), C("code"), C("loaded_at")], 5).select(F.lit("low").alias("side"), "*")
    return low.unionByName(R.first_rows(p, [F.desc("completeness"), C("code"), C("loaded_at")], 5).select(F.lit("high").alias("side"), "*")).drop("loaded_at")


@query("SELECT sum(matchable::INT)::BIGINT AS matchable, sum(is_context_term::INT)::BIGINT AS context_term, sum(is_noise_phrase::INT)::BIGINT AS noise, coalesce(sum(is_additive::INT), 0)::BIGINT AS additive, count(*) FILTER (tag_lang <> 'en') AS non_english, count(DISTINCT ingredient) AS different, count(DISTINCT CASE WHEN matchable THEN ingredient END) AS different_matchable FROM products_ingredients")
def R16_conditional_counts(t: Tables) -> DataFrame:
    return t.products_ingredients.agg(
        F.count_if("matchable").alias("matchable"), F.count_if("is_context_term").alias("context_term"), F.count_if("is_noise_phrase").alias("noise"), F.count_if("is_additive").alias("additive"),
        F.count_if(C("tag_lang") != "en").alias("non_english"), F.count_distinct("ingredient").alias("different"), F.count_distinct(F.when(C("matchable"), C("ingredient"))).alias("different_matchable"),
    )


def _share_sql(key: str, extra: str = "", where: str = "") -> str:
    return f"SELECT {key}, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct{extra} FROM {RES} {where} GROUP BY {key}"


@query(_share_sql("confidence", ", round(avg(path_score), 4) AS avg_path_score, round(avg(final_level), 4) AS avg_final_level"))
def R17_class_shares(t: Tables) -> DataFrame:
    return R.share(results(t), ("confidence",), avg_path_score=F.round(F.avg("path_score"), 4), avg_final_level=F.round(F.avg("final_level"), 4))


@query(_share_sql("final_level"))
def R18_level_shares(t: Tables) -> DataFrame:
    return R.share(results(t), ("final_level",))


@query(f"SELECT ingredient, confidence FROM {RES} QUALIFY row_number() OVER (PARTITION BY confidence ORDER BY md5(ingredient), ingredient) <= 5")
def R19_group_sample(t: Tables) -> DataFrame:
    return R.group_sample(results(t).select("ingredient", "confidence"), "confidence", "ingredient", 5)


@query(f"SELECT p.probe, coalesce(r.confidence, 'not found') AS confidence, r.ingredient IS NOT NULL AS found FROM (SELECT unnest(['salt', 'whey', 'unobtainium', 'mango']) AS probe) p LEFT JOIN {RES} r ON r.ingredient = p.probe")
def R20_probes(t: Tables) -> DataFrame:
    return R.probe(results(t), "ingredient", ["salt", "whey", "unobtainium", "mango"], "confidence").withColumn("confidence", F.coalesce("confidence", F.lit("not found")))


@query(_share_sql("matching_mode", ", " + ", ".join(f"round(avg({c}), 4) AS avg_{c}" for c in ("rf_score", "bge_score", "lexical_score", "branch_prior")) + ", sum(exact_variant::INT)::BIGINT AS n_exact"))
def R21_mode_shares(t: Tables) -> DataFrame:
    return R.share(results(t), ("matching_mode",), **{f"avg_{c}": F.round(F.avg(c), 4) for c in ("rf_score", "bge_score", "lexical_score", "branch_prior")}, n_exact=F.count_if("exact_variant"))


@query(f"SELECT confidence, count(*) AS n, round(avg(rf_score), 4) AS avg_rf, min(rf_score) AS min_rf, max(rf_score) AS max_rf, round(avg(bge_score), 4) AS avg_bge FROM {RES} WHERE rf_used GROUP BY 1")
def R22_filtered_shares(t: Tables) -> DataFrame:
    return results(t).where("rf_used").groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rf_score"), 4).alias("avg_rf"), F.min("rf_score").alias("min_rf"), F.max("rf_score").alias("max_rf"), F.round(F.avg("bge_score"), 4).alias("avg_bge"))


@query(_share_sql("confidence", ", round(avg(level2_score), 4) AS avg_l2, round(avg(level3_score), 4) AS avg_l3, round(avg(specific_score), 4) AS avg_specific, round(avg(path_score), 4) AS avg_path, min(path_score) AS min_path, max(path_score) AS max_path"))
def R23_score_summary(t: Tables) -> DataFrame:
    a = {f"avg_{k}": F.round(F.avg(c), 4) for k, c in (("l2", "level2_score"), ("l3", "level3_score"), ("specific", "specific_score"), ("path", "path_score"))}
    return R.share(results(t), ("confidence",), **a, min_path=F.min("path_score"), max_path=F.max("path_score"))


@query(f"SELECT ingredient, path_score FROM {RES} WHERE confidence = 'HIGH' ORDER BY path_score DESC, ingredient LIMIT 50")
def R24_top_of_class(t: Tables) -> DataFrame:
    return R.first_rows(results(t).where("confidence = 'HIGH'").select("ingredient", "path_score"), [F.desc("path_score"), C("ingredient")], 50)


@query(f"SELECT ingredient, confidence FROM {RES} WHERE confidence IN ('LOW', 'NO_MATCH') ORDER BY md5(ingredient), ingredient LIMIT 50")
def R25_in_list_sample(t: Tables) -> DataFrame:
    return R.first_rows(results(t).where(C("confidence").isin("LOW", "NO_MATCH")).select("ingredient", "confidence"), [F.md5("ingredient"), C("ingredient")], 50)


_SUFFIX = ("milk", "oil", "flour", "juice")


@query(f"SELECT ingredient FROM {RES} WHERE " + " OR ".join(f"ingredient LIKE '% {s}'" for s in _SUFFIX))
def R26_suffixes(t: Tables) -> DataFrame:
    return results(t).where(C("ingredient").rlike(f" (?:{'|'.join(_SUFFIX)})$")).select("ingredient")


@query("SELECT reportHierarchyLevel AS level, count(*) AS n FROM foodex2_terms GROUP BY 1")
def R27_level_counts(t: Tables) -> DataFrame:
    return t.foodex2_terms.groupBy(C("reportHierarchyLevel").alias("level")).agg(F.count(F.lit(1)).alias("n"))


_TERM_COLUMNS = ("termCode", "termExtendedName", "termShortName", "termScopeNote", "scientificNames", "commonNames", "allFacets", "facets_resolved", "reportHierarchyCode", "reportHierarchyLevel", "nlp_text", "status")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS n_null, round(100.0 * count({c}) / count(*), 2)::DOUBLE AS pct FROM foodex2_terms" for c in _TERM_COLUMNS))
def R28_R29_null_profile(t: Tables) -> DataFrame:
    return R.null_profile(t.foodex2_terms)


@query("(SELECT termCode, length(termExtendedName) AS name_len FROM foodex2_terms ORDER BY 2, 1 LIMIT 10) UNION ALL (SELECT termCode, length(termExtendedName) FROM foodex2_terms ORDER BY 2 DESC, 1 LIMIT 10)")
def R30_shortest_and_longest(t: Tables) -> DataFrame:
    d = t.foodex2_terms.select("termCode", F.length("termExtendedName").cast("long").alias("name_len"))
    return R.first_rows(d, [C("name_len"), C("termCode")], 10).unionByName(R.first_rows(d, [F.desc("name_len"), C("termCode")], 10))


@query("SELECT row_id, code, count(*) OVER (PARTITION BY code) AS dup_count FROM products_with_language1 WHERE code IS NOT NULL QUALIFY count(*) OVER (PARTITION BY code) > 1")
def R31_duplicates(t: Tables) -> DataFrame:
    return R.duplicates(t.products_with_language1.select("row_id", "code"), "code").select("row_id", "code", "dup_count")


def _keywords(words: tuple[str, ...]) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{k}'" for k in words) + "]) AS keyword)"


@query(f"SELECT keyword, count(*) FILTER (contains(lower(termExtendedName), keyword)) AS n FROM {_keywords(P.TERM_KEYWORDS)}, foodex2_terms GROUP BY 1")
def R32_keyword_counts(t: Tables) -> DataFrame:
    return R.keyword_counts(t.foodex2_terms, "termExtendedName", P.TERM_KEYWORDS)


_HITS = "SELECT keyword, termCode, termExtendedName, reportHierarchyLevel FROM foodex2_terms t JOIN {} k ON contains(lower(termExtendedName), keyword)"


@query(_HITS.format(_keywords(P.TERM_KEYWORDS)) + " QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY termCode) <= 20")
def R32_keyword_rows(t: Tables) -> DataFrame:
    return R.keyword_rows(t.foodex2_terms, "termExtendedName", P.TERM_KEYWORDS, 20, [C("termCode")], "termCode", "reportHierarchyLevel")


@query(_HITS.format(_keywords(P.ALLERGEN_KEYWORDS)))
def R33_allergen_keywords(t: Tables) -> DataFrame:
    """All 57 keywords, every row, with its level."""
    return R.keyword_rows(t.foodex2_terms, "termExtendedName", P.ALLERGEN_KEYWORDS, None, [C("termCode")], "termCode", "reportHierarchyLevel")


@query("SELECT value, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(labels_tags, ',')))) AS value FROM products_with_language1) WHERE value <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def R34_value_counts(t: Tables) -> DataFrame:
    return R.value_counts(t.products_with_language1, "labels_tags", 20)


_TAG_COLUMNS = ("labels_tags", "additives_tags", "brands_tags", "countries_tags", "packaging_tags", "traces_tags")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100.0 * count(k) / count(*), 2)::DOUBLE AS coverage, round(avg(k), 2) AS avg_tags, max(k)::BIGINT AS max_tags FROM (SELECT CASE WHEN trim({c}) <> '' THEN len(string_split({c}, ',')) END AS k FROM products_with_language1)" for c in _TAG_COLUMNS))
def R35_tag_stats(t: Tables) -> DataFrame:
    return R.tag_stats(t.products_with_language1, _TAG_COLUMNS)


@query("SELECT count(*) AS n, count(*) FILTER (lang_product_name = lang_ingredients_text) AS same, round(100.0 * count(*) FILTER (lang_product_name = lang_ingredients_text) / count(*), 2)::DOUBLE AS pct FROM products_with_language1 WHERE lang_product_name IS NOT NULL AND lang_ingredients_text IS NOT NULL")
def R36_agreement(t: Tables) -> DataFrame:
    return R.agreement(t.products_with_language1, "lang_product_name", "lang_ingredients_text")


@query("SELECT lang_product_name AS lang, count(*) AS n_products, round(100.0 * count(generic_name) / count(*), 1)::DOUBLE AS pct_generic, round(100.0 * count(ingredients_text) / count(*), 1)::DOUBLE AS pct_ingredients, round(100.0 * count(categories_tags) / count(*), 1)::DOUBLE AS pct_categories, round(avg(length(product_name)), 1) AS avg_len FROM products_with_language1 GROUP BY 1")
def R37_quality_by_language(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.products_with_language1.groupBy(C("lang_product_name").alias("lang")).agg(
        n.alias("n_products"), R.pct(F.count("generic_name"), n, 1).alias("pct_generic"), R.pct(F.count("ingredients_text"), n, 1).alias("pct_ingredients"), R.pct(F.count("categories_tags"), n, 1).alias("pct_categories"),
        F.round(F.avg(F.length("product_name")), 1).alias("avg_len"),
    )


@query("SELECT count(*) FILTER (text IS NULL OR trim(text) = '') AS n_empty, round(100.0 * count(*) FILTER (text IS NULL OR trim(text) = '') / count(*), 4)::DOUBLE AS pct FROM documents")
def R38_empty_texts(t: Tables) -> DataFrame:
    empty = F.count_if(C("text").isNull() | (F.trim("text") == ""))
    return t.documents.agg(empty.alias("n_empty"), R.pct(empty, F.count(F.lit(1)), 4).alias("pct"))


def _describe_sql(by: str = "") -> str:
    parts = [f"SELECT {by}'{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + f", max({c}) AS max FROM {RES} " + ("GROUP BY 1" if by else "") for c in ("path_score", "rf_score", "top2_score")]
    return " UNION ALL ".join(parts)


@query(_describe_sql())
def R39_describe(t: Tables) -> DataFrame:
    return R.describe(results(t), ("path_score", "rf_score", "top2_score"))


@query(_describe_sql("confidence, "))
def R39_describe_by_class(t: Tables) -> DataFrame:
    return R.describe(results(t), ("path_score", "rf_score", "top2_score"), "confidence")


@query("SELECT matching_mode, " + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}" for c in CLASSES) + f" FROM {RES} GROUP BY 1")
def R40_contingency(t: Tables) -> DataFrame:
    return R.contingency(results(t), "matching_mode", "confidence", CLASSES)


@query("SELECT matching_mode, " + ", ".join(f"round(100.0 * count(*) FILTER (confidence = '{c}') / count(*), 2)::DOUBLE AS {c}" for c in CLASSES) + f" FROM {RES} GROUP BY 1")
def R41_contingency_share(t: Tables) -> DataFrame:
    return R.contingency(results(t), "matching_mode", "confidence", CLASSES, percent=True)


@query(f"""SELECT confidence, coalesce(max(n) FILTER (run = 'a'), 0) AS n_a, coalesce(max(pct) FILTER (run = 'a'), 0) AS pct_a, coalesce(max(n) FILTER (run = 'b'), 0) AS n_b, coalesce(max(pct) FILTER (run = 'b'), 0) AS pct_b
FROM (SELECT *, 'a' AS run FROM ({_share_sql("confidence")}) UNION ALL SELECT *, 'b' FROM ({_share_sql("confidence", where="WHERE rf_used AND path_score > 0.2")})) GROUP BY 1""")
def R42_compare_runs(t: Tables) -> DataFrame:
    r = results(t)
    return R.compare_runs(r, r.where("rf_used AND path_score > 0.2"), "confidence")


@query(f"SELECT (SELECT count(DISTINCT ingredient) FROM products_ingredients) AS source, count(*) AS processed, round(100.0 * count(*) / (SELECT count(DISTINCT ingredient) FROM products_ingredients), 2)::DOUBLE AS pct, " + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}" for c in CLASSES) + f" FROM {RES}")
def R43_coverage(t: Tables) -> DataFrame:
    done = results(t).agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(C("confidence") == c).alias(c) for c in CLASSES))
    whole = t.products_ingredients.agg(F.count_distinct("ingredient").alias("source"))
    both = whole.unionByName(done, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns)).withColumn("pct", R.pct(C("processed"), C("source")))


@query(f"SELECT code, ['HIGH', 'MEDIUM', 'LOW', 'NO_MATCH'][min(CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END)] AS confidence FROM {_PM} GROUP BY 1")
def R44_best_class(t: Tables) -> DataFrame:
    return R.best_class(_joined(t), "code", "confidence", CLASSES)


@query(f"SELECT code FROM {_PM} GROUP BY 1 HAVING bool_and(confidence <> 'NO_MATCH')")
def R45_all_satisfy(t: Tables) -> DataFrame:
    return R.all_satisfy(_joined(t), "code", C("confidence") != "NO_MATCH")


@query(f"SELECT code, count(*) AS n_ingredients, round(avg(path_score), 4) AS avg_path, min(path_score) AS min_path, max(path_score) AS max_path, count(*) FILTER (confidence = 'HIGH') AS n_high, count(*) FILTER (confidence = 'LOW') AS n_low FROM {_PM} GROUP BY 1")
def R46_product_aggregate(t: Tables) -> DataFrame:
    return _joined(t).groupBy("code").agg(
        F.count(F.lit(1)).alias("n_ingredients"), F.round(F.avg("path_score"), 4).alias("avg_path"), F.min("path_score").alias("min_path"), F.max("path_score").alias("max_path"),
        F.count_if(C("confidence") == "HIGH").alias("n_high"), F.count_if(C("confidence") == "LOW").alias("n_low"),
    )


@query(f"SELECT confidence, n, round(p, 4) AS pct, round(sum(p) OVER (ORDER BY k), 4) AS cum_pct, CAST(k AS INTEGER) AS rank FROM (SELECT confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS p, list_position(['HIGH', 'MEDIUM', 'LOW', 'NO_MATCH'], confidence) - 1 AS k FROM {RES} GROUP BY 1)")
def R47_cumulative(t: Tables) -> DataFrame:
    return R.cumulative(results(t), "confidence", CLASSES)


@query(f"SELECT confidence, round(avg(level2_score), 6) AS a, round(avg(level3_score), 6) AS b, round(avg(specific_score), 6) AS c FROM {RES} GROUP BY 1")
def R48_group_means(t: Tables) -> DataFrame:
    return results(t).groupBy("confidence").agg(F.round(F.avg("level2_score"), 6).alias("a"), F.round(F.avg("level3_score"), 6).alias("b"), F.round(F.avg("specific_score"), 6).alias("c"))


@query(f"SELECT ingredient, path_score FROM {RES} ORDER BY path_score DESC, ingredient LIMIT 20")
def R49_largest(t: Tables) -> DataFrame:
    return R.first_rows(results(t).select("ingredient", "path_score"), [F.desc("path_score"), C("ingredient")], 20)


_ALLOC = f"""(SELECT confidence, n, least(n, CASE WHEN row_number() OVER (ORDER BY w DESC, confidence) = 1 AND sum(w) OVER () > 200 THEN w - (sum(w) OVER () - 200) ELSE w END) AS want FROM (
  SELECT confidence, count(*) AS n, greatest(20, CAST(round_even(count(*) * 200.0::DOUBLE / sum(count(*)) OVER (), 0) AS BIGINT)) AS w FROM {RES} GROUP BY 1))"""


@query(f"SELECT confidence, n, want::BIGINT AS want FROM {_ALLOC}")
def R50_allocation(t: Tables) -> DataFrame:
    return R.allocation(results(t), "confidence", 200, 20)


@query(f"SELECT r.confidence, r.ingredient, '' AS evaluator_correct, '' AS evaluator_notes FROM (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY md5(ingredient), ingredient) AS k FROM {RES}) r JOIN {_ALLOC} a USING (confidence) WHERE k <= want")
def R50_stratified(t: Tables) -> DataFrame:
    return R.stratified(results(t).select("confidence", "ingredient"), "confidence", "ingredient", 200, 20, ("evaluator_correct", "evaluator_notes"))


_ACC = f"(SELECT confidence, count(*) FILTER (upper(trim(verdict)) = 'Y') AS correct, count(*) AS total FROM {RES} WHERE upper(trim(verdict)) IN ('Y', 'N') GROUP BY 1)"


@query(f"SELECT confidence, correct, total, total - correct AS incorrect, round(correct / total, 6) AS accuracy FROM {_ACC}")
def R51_accuracy(t: Tables) -> DataFrame:
    return R.accuracy(results(t), "confidence", "verdict")


@query(f"SELECT round(sum(n / s * correct / total), 6) AS weighted_accuracy FROM (SELECT confidence, count(*) AS n, sum(count(*)) OVER () AS s FROM {RES} GROUP BY 1) w JOIN {_ACC} a USING (confidence)")
def R52_weighted_accuracy(t: Tables) -> DataFrame:
    r = results(t)
    return R.weighted_accuracy(r, r, "confidence", "verdict")


@query(f"SELECT specific_code, level2_code, count(*) AS n FROM {RES} GROUP BY 1, 2 ORDER BY n DESC, specific_code NULLS FIRST, level2_code NULLS FIRST LIMIT 15")
def R53_top_groups(t: Tables) -> DataFrame:
    return R.top_groups(results(t), ("specific_code", "level2_code"), 15, nulls=True)


@query(f"SELECT specific_code, level2_code, count(*) AS n FROM {RES} WHERE specific_code IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, specific_code, level2_code LIMIT 15")
def R53_top_groups_without_null(t: Tables) -> DataFrame:
    return R.top_groups(results(t), ("specific_code", "level2_code"), 15, nulls=False)


_STEPS = [round(0.30 + 0.02 * i, 2) for i in range(30)]


@query(f"SELECT s.threshold, count(*) FILTER (path_score >= threshold) AS n, round(100.0 * count(*) FILTER (path_score >= threshold) / count(*), 2)::DOUBLE AS pct, " + ", ".join(f"count(*) FILTER (path_score >= threshold AND confidence = '{c}') AS {c}" for c in CLASSES[:3]) + f" FROM {RES}, (SELECT unnest({_STEPS}::DOUBLE[]) AS threshold) s GROUP BY 1")
def R54_threshold_sweep(t: Tables) -> DataFrame:
    return R.threshold_sweep(results(t), "path_score", "confidence", CLASSES[:3], _STEPS)


@query(f"SELECT ingredient, round(coalesce(top1_score, 0) - coalesce(top2_score, 0), 6) AS gap_1_2, round(coalesce(top2_score, 0) - coalesce(top3_score, 0), 6) AS gap_2_3 FROM {RES} WHERE round(coalesce(top1_score, 0) - coalesce(top2_score, 0), 6) < 0.05")
def R55_gaps(t: Tables) -> DataFrame:
    return R.gaps(results(t).select("ingredient", "top1_score", "top2_score", "top3_score"), "top1_score", "top2_score", "top3_score").where("gap_1_2 < 0.05").select("ingredient", "gap_1_2", "gap_2_3")


@query(f"SELECT confidence, count(*) FILTER (substr(top1_code, 1, 2) = substr(top2_code, 1, 2)) AS agree, count(*) AS total, round(100.0 * count(*) FILTER (substr(top1_code, 1, 2) = substr(top2_code, 1, 2)) / count(*), 2)::DOUBLE AS agree_pct FROM {RES} GROUP BY 1")
def R56_prefix_agreement(t: Tables) -> DataFrame:
    same = F.count_if(F.substring("top1_code", 1, 2) == F.substring("top2_code", 1, 2))
    return results(t).groupBy("confidence").agg(same.alias("agree"), F.count(F.lit(1)).alias("total"), R.pct(same, F.count(F.lit(1))).alias("agree_pct"))


@query(f"SELECT least(CAST(floor(path_score * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n FROM {RES} WHERE path_score BETWEEN 0 AND 1 GROUP BY 1")
def R57_histogram(t: Tables) -> DataFrame:
    return R.histogram(results(t), "path_score", 0, 1, 30)


@query("SELECT event_type, count(*) FILTER (value >= 75) AS certain, count(*) FILTER (value >= 25 AND value < 75) AS possible, count(*) FILTER (value < 25) AS clean FROM events GROUP BY 1")
def R57_status_split(t: Tables) -> DataFrame:
    s = F.when(C("value") >= 75, "certain").when(C("value") >= 25, "possible").otherwise("clean")
    return R.contingency(t.events.select("event_type", s.alias("s")), "event_type", "s", ("certain", "possible", "clean"))


# Sources, sinks and table operations


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/larder-{uuid.uuid4().hex}"


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def S1_S19_delimited_round_trip(t: Tables) -> DataFrame:
    at = _folder(t)
    S.write_delimited(t.nation, at)
    return S.read_delimited(t.spark, at, t.nation.columns)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def S2_inferred_csv(t: Tables) -> DataFrame:
    at = _folder(t)
    S.write_delimited(t.customer, at, separator=",")
    return S.read_csv(t.spark, at, ("c_custkey", "c_name", "c_acctbal")).withColumn("c_custkey", C("c_custkey").cast("long"))


@query("SELECT r_regionkey, r_name FROM region")
def S4_S18_parquet_round_trip(t: Tables) -> DataFrame:
    at = _folder(t)
    t.region.write.parquet(at)
    return t.spark.sql(f"SELECT r_regionkey, r_name FROM parquet.`{at}`")


@query("SELECT DISTINCT source, lang FROM documents")
def S6_projection(t: Tables) -> DataFrame:
    return t.documents.select("source", "lang").distinct()


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def S7_chunks(t: Tables) -> DataFrame:
    return S.in_chunks(t.documents.select("source"), lambda b: b.groupby("source", dropna=False).size().reset_index(name="n"), "source string, n long").groupBy("source").agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500")
def S8_key_page(t: Tables) -> DataFrame:
    return S.key_page(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 100, 500)


@query("SELECT row_id FROM products_ingredients WHERE substr(md5(row_id::VARCHAR), 1, 2) < '1a'")
def S9_hash_sample(t: Tables) -> DataFrame:
    return S.hash_sample(t.products_ingredients.select("row_id"), "row_id", 26)


@query()
def S9_S10_bernoulli_sample(t: Tables) -> DataFrame:
    return t.products_ingredients.sample(False, 0.1, 7).select("row_id")


@query("SELECT row_id FROM products_ingredients ORDER BY md5(row_id::VARCHAR), row_id LIMIT 20")
def S11_ordered_sample(t: Tables) -> DataFrame:
    return R.first_rows(t.products_ingredients.select("row_id"), [F.md5(C("row_id").cast("string")), C("row_id")], 20)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def S12_S13_create_and_append(t: Tables) -> DataFrame:
    at = _folder(t)
    S.create_empty(t.spark, at, t.nation.schema)
    for r in (0, 1):
        t.nation.where(C("n_regionkey") % 2 == r).write.mode("append").parquet(at)
    return t.spark.read.parquet(at).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, code, product_name, COLUMNS('.*_tags$') FROM products_with_language1")
def S14_regex_columns(t: Tables) -> DataFrame:
    return S.columns_like(t.products_with_language1, r".*_tags$", ("row_id", "code", "product_name"))


@query("SELECT r_regionkey, CAST(NULL AS VARCHAR) AS note FROM region")
def S15_add_and_drop(t: Tables) -> DataFrame:
    return S.drop_columns(S.add_column(S.add_column(t.region, "note", "string"), "note", "string"), "r_name", "not_there")


@query("SELECT c.c_custkey, CASE WHEN u.c_custkey IS NOT NULL THEN u.c_name ELSE c.c_name END AS c_name, CASE WHEN u.c_custkey IS NOT NULL THEN u.c_acctbal ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE upper(c_name) || '!' END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) u ON u.c_custkey = c.c_custkey")
def S16_update_from(t: Tables) -> DataFrame:
    u = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.when(C("c_custkey") % 4 != 0, F.concat(F.upper("c_name"), F.lit("!"))).alias("c_name"), (C("c_acctbal") + 1).alias("c_acctbal"))
    return R.update_from(t.customer.select("c_custkey", "c_name", "c_acctbal"), u, "c_custkey", ("c_name", "c_acctbal"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NINETY' UNION ALL SELECT 91, NULL")
def S17_insert_rows(t: Tables) -> DataFrame:
    return S.insert_rows(t.region, [(90, "NINETY"), (91, None)])


@query("SELECT lower(column_name) AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS type FROM (DESCRIBE SELECT * FROM customer)")
def S20_catalog(t: Tables) -> DataFrame:
    return S.describe(t.customer).select(F.lower("name").alias("name"), F.when(C("type") == "int", "integer").otherwise(C("type")).alias("type"))
