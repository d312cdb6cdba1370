"""Queries of hierarchies and facets (H), and of matching (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import fuzzy
from larder.functions import text as T
from larder.operators import hierarchy as H
from larder.operators import matching as M
from larder.operators import vectors as V
from larder.plans import duck as D
from larder.plans.registry import Tables, query
from larder.session import materialise

C = F.col
_IX = "(SELECT termCode AS term, termExtendedName AS name, reportHierarchyCode AS path, reportHierarchyLevel AS level FROM foodex2_terms WHERE reportHierarchyCode LIKE 'Z0001%')"


def _up(n: int) -> str:
    return f"array_to_string(string_split(path, '.')[1:{n}], '.')"


@query("SELECT termCode, CAST(len(string_split(reportHierarchyCode, '.')) AS INTEGER) AS depth FROM foodex2_terms")
def H1_depth(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", H.depth(C("reportHierarchyCode")).alias("depth"))


@query(f"SELECT term, level, CASE WHEN level = 2 THEN 'level_2' WHEN level = 3 THEN 'level_3' WHEN level >= 4 THEN 'level_specific' END AS bucket FROM {_IX}")
def H2_H3_scope_and_buckets(t: Tables) -> DataFrame:
    return H.index(t.foodex2_terms).select("term", "level", "bucket")


_PARENTS = f"""(SELECT c.term AS child, max(p.term) AS parent FROM {_IX} c JOIN {_IX} p ON (c.level = 3 AND p.level = 2 AND p.path = {_up(2).replace("path", "c.path")}) OR (c.level >= 4 AND p.level = 3 AND p.path = {_up(3).replace("path", "c.path")}) GROUP BY 1)"""


@query(f"SELECT child, parent FROM {_PARENTS}")
def H4_parents(t: Tables) -> DataFrame:
    return H.parents(H.index(t.foodex2_terms))


@query(f"SELECT parent, string_agg(child, ',' ORDER BY child) AS children, count(*) AS n FROM {_PARENTS} GROUP BY 1")
def H5_children(t: Tables) -> DataFrame:
    return H.children(H.index(t.foodex2_terms)).select("parent", F.array_join("children", ",").alias("children"), F.size("children").cast("long").alias("n"))


@query(f"""SELECT t.term, CASE WHEN t.level = 2 THEN t.term ELSE a.term END AS level2_code, CASE WHEN t.level = 2 THEN t.name ELSE a.name END AS level2_name,
  CASE WHEN t.level = 3 THEN t.term ELSE b.term END AS level3_code, CASE WHEN t.level = 3 THEN t.name ELSE b.name END AS level3_name,
  CASE WHEN t.level >= 4 THEN t.term END AS specific_code, CASE WHEN t.level >= 4 THEN t.name END AS specific_name, t.level AS final_level
FROM {_IX} t LEFT JOIN {_IX} a ON a.level = 2 AND a.path = {_up(2).replace("path", "t.path")} LEFT JOIN {_IX} b ON b.level = 3 AND t.level >= 4 AND b.path = {_up(3).replace("path", "t.path")} WHERE t.level >= 2""")
def H6_resolve(t: Tables) -> DataFrame:
    return H.resolve(H.index(t.foodex2_terms))


@query(f"SELECT t.term, a.term AS ancestor, a.level FROM {_IX} t JOIN {_IX} a ON t.path = a.path OR starts_with(t.path, a.path || '.')")
def H7_ancestors(t: Tables) -> DataFrame:
    return H.ancestors(H.index(t.foodex2_terms))


@query(f"SELECT p.term AS parent, c.term AS child FROM {_IX} c JOIN {_IX} p ON starts_with(c.path, p.path || '.') AND c.level = p.level + 1 AND length(replace(c.path, '.', '')) < length(c.path) AND NOT contains(substr(c.path, length(p.path) + 2), '.') AND len(string_split(c.path, '.')) = c.level")
def H8_direct_children(t: Tables) -> DataFrame:
    return H.direct_children(H.index(t.foodex2_terms))


_LABELS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in H.FACET_LABELS.items()) + "}"


@query(f"""WITH f AS (SELECT termCode, unnest(regexp_extract_all(allFacets, '{H.FACET}')) AS f, CAST(generate_subscripts(regexp_extract_all(allFacets, '{H.FACET}'), 1) - 1 AS INTEGER) AS pos FROM foodex2_terms)
SELECT f.termCode, pos, split_part(f, '.', 1) AS facet_cat, coalesce({_LABELS}[split_part(f, '.', 1)], split_part(f, '.', 1)) AS facet_label, split_part(f, '.', 2) AS code, n.termExtendedName AS name
FROM f LEFT JOIN foodex2_terms n ON n.termCode = split_part(f, '.', 2)""")
def H9_facets(t: Tables) -> DataFrame:
    names = H.names_by_code(t.foodex2_terms, "termCode", "termExtendedName", "termCode")
    return H.facets(t.foodex2_terms, "allFacets", "termCode", names)


@query(f"""WITH c AS (SELECT termCode, CASE WHEN json_valid(facets_resolved) AND json_array_length(facets_resolved) > 0 THEN CAST(facets_resolved AS JSON)::VARCHAR[] WHEN contains(allFacets, '#') THEN string_split(substr(allFacets, instr(allFacets, '#') + 1), '$') END AS f FROM foodex2_terms)
SELECT termCode, split_part(x, '.', 1) AS cat, split_part(x, '.', 2) AS code FROM (SELECT termCode, unnest(f) AS x FROM c) WHERE regexp_full_match(x, '{H.FACET}')""")
def H10_resolved_facets(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", F.explode(H.resolved_facets(C("facets_resolved"), C("allFacets"))).alias("f")).select("termCode", "f.cat", "f.code")


@query("SELECT split_part(f, '.', 1) AS facet_cat, count(*) AS n FROM (SELECT unnest(string_split(string_split(allFacets, '#')[2], '$')) AS f FROM foodex2_terms WHERE contains(allFacets, '#')) GROUP BY 1")
def H11_facet_counts(t: Tables) -> DataFrame:
    return H.facet_counts(t.foodex2_terms)


@query("SELECT code, product_name AS name FROM products WHERE product_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY loaded_at) = 1")
def H12_names_by_code(t: Tables) -> DataFrame:
    return H.names_by_code(t.products, "code", "product_name", "loaded_at")


@query("SELECT termCode FROM foodex2_terms WHERE NOT coalesce(regexp_matches(termExtendedName, '(?i)\\(feed\\)'), false)")
def H12_without_feed(t: Tables) -> DataFrame:
    return H.without_feed(t.foodex2_terms).select("termCode")


_TERM_KEY = D.strip(D.collapse(f"translate({D.key('termExtendedName')}, '()/', '   ')"))


@query(f"SELECT termCode, {_TERM_KEY} AS k FROM foodex2_terms")
def M1_term_key(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", T.term_key(C("termExtendedName")).alias("k"))


@query(f"SELECT termCode, array_to_string(list_sort({D.spellings('k')}), '|') AS v FROM (SELECT termCode, {_TERM_KEY} AS k FROM foodex2_terms)")
def M2_spelling_variants(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", F.array_join(F.array_sort(T.spelling_variants(T.term_key(C("termExtendedName")))), "|").alias("v"))


_FORMS = f"""(SELECT termCode, termExtendedName, unnest(list_distinct(CASE WHEN contains(termExtendedName, ',') AND len(ps) >= 2 THEN [k, array_to_string(list_reverse(ps), ' '), array_to_string(list_concat([ps[2], ps[1]], ps[3:]), ' ')] ELSE [k] END)) AS form FROM (
  SELECT termCode, termExtendedName, {_TERM_KEY} AS k, list_filter(list_transform(string_split({D.key("termExtendedName")}, ','), lambda x: {D.strip(D.collapse("translate(x, '()/', '   ')"))}), lambda x: x <> '') AS ps FROM foodex2_terms))"""
_VARIANTS = f"(SELECT DISTINCT termCode AS term, termExtendedName AS name, unnest({D.spellings('form')}) AS variant FROM {_FORMS})"


@query(f"SELECT term AS termCode, variant FROM {_VARIANTS}")
def M3_comma_variants(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", F.explode(T.comma_variants(C("termExtendedName"))).alias("variant"))


@query()
def M4_encode(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", V.encoder(64)(C("termExtendedName")).alias("vec"))


def _centroid(keys: str) -> str:
    """Normalised mean vectors in DuckDB."""
    return f"""(SELECT {keys}, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM (SELECT {keys}, list(x ORDER BY i) AS m FROM (
      SELECT {keys}, i, avg(x) AS x FROM (SELECT label, vec_id % 3 AS third, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY {keys}, i) GROUP BY {keys}))"""


@query(f"SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {_centroid('label')})")
def M5_mean_vectors(t: Tables) -> DataFrame:
    return V.mean_vector(t.embeddings, ("label",), "embedding").select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x, generate_subscripts(v, 1) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def M6_normalize(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(V.normalize(C("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


_PAIRS = "(SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)"


def _queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vec"))


def _items(t: Tables) -> DataFrame:
    return t.embeddings.select(C("vec_id").alias("item_id"), C("embedding").alias("vec"))


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS rank FROM {_PAIRS}) WHERE rank <= 100")
def M7_similarities(t: Tables) -> DataFrame:
    return V.top_k(_queries(t), _items(t), 100).withColumn("score", F.round("score", 6)).select("query_id", "rank", "item_id", "score")


@query(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, round(s, 4) AS score, s >= 0.3 AS above FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS rank FROM {_PAIRS}) WHERE rank <= 5")
def M23_top_k_long(t: Tables) -> DataFrame:
    return V.top_k(_queries(t), _items(t), 5).select("query_id", "rank", "item_id", F.round("score", 4).alias("score"), (C("score") >= 0.3).alias("above"))


@query("SELECT query_id, " + ", ".join(f"max(item_id) FILTER (rank = {i}) AS top{i}_code, round(max(s) FILTER (rank = {i}), 4) AS top{i}_score" for i in range(1, 6)) + f" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS rank FROM {_PAIRS}) GROUP BY 1")
def M23_top_k_wide(t: Tables) -> DataFrame:
    top = V.top_k(_queries(t), _items(t), 5)
    return top.groupBy("query_id").agg(*(x for i in range(1, 6) for x in (F.max(F.when(C("rank") == i, C("item_id"))).alias(f"top{i}_code"), F.round(F.max(F.when(C("rank") == i, C("score"))), 4).alias(f"top{i}_score"))))


_PI = f"(SELECT row_id, {D.key('ingredient')} AS a, {D.key('product_name')} AS b FROM products_ingredients)"


@query(f"""SELECT row_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS j FROM (
  SELECT row_id, {D.token_set("a")} AS x, {D.token_set("b")} AS y FROM {_PI})""")
def M8_token_jaccard(t: Tables) -> DataFrame:
    return t.products_ingredients.select("row_id", F.round(T.token_jaccard(C("ingredient"), C("product_name")), 6).alias("j"))


@query()
def M9_fuzzy_candidates(t: Tables) -> DataFrame:
    q = M.matchable(t.products_ingredients)
    return M.fuzzy_candidates(q, M.variants(H.index(t.foodex2_terms)), M.RUNS["small"]).withColumn("score", F.round("score", 6))


#: Scored candidates: a query, a term, one of its variants, a score.
_CANDIDATES = "(SELECT l_partkey AS q, l_suppkey AS term, l_orderkey * 10 + l_linenumber AS variant, l_quantity AS score FROM lineitem)"


@query(f"SELECT q, term, variant, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, term) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q, term ORDER BY score DESC, variant) AS w FROM {_CANDIDATES}) WHERE w = 1) WHERE r <= 30")
def M10_best_variant(t: Tables) -> DataFrame:
    c = t.lineitem.selectExpr("l_partkey AS q", "l_suppkey AS term", "l_orderkey * 10 + l_linenumber AS variant", "l_quantity AS score")
    return M.best_variants(c, "q", 30)


@query(f"""WITH v AS (SELECT v.* FROM {_VARIANTS} v JOIN {_IX} i ON i.term = v.term AND i.level >= 2), q AS (SELECT DISTINCT ingredient, {D.key("ingredient")} AS k FROM products_ingredients WHERE matchable)
SELECT q.ingredient, q.k AS variant, min(v.term) AS term FROM q JOIN v ON v.variant = q.k GROUP BY 1, 2""")
def M11_exact(t: Tables) -> DataFrame:
    return M.exact(M.matchable(t.products_ingredients), M.variants(H.index(t.foodex2_terms))).select("ingredient", "variant", "term")


_SCORES = "(SELECT l_orderkey, l_linenumber, l_discount * 10 AS emb, l_quantity * 2 AS rf, l_tax * 12 AS lex, l_discount * 9 AS prior FROM lineitem)"


def _scores(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_discount * 10 as emb", "l_quantity * 2 as rf", "l_tax * 12 as lex", "l_discount * 9 as prior")


_M12 = f"(SELECT *, 0.5::DOUBLE * emb + 0.28::DOUBLE * (rf / 100) + 0.1::DOUBLE * lex + 0.12::DOUBLE * prior AS s FROM {_SCORES})"


@query(f"SELECT l_orderkey, l_linenumber, round(s, 6) AS score, CASE WHEN round(s, 6) >= 0.75 AND lex >= 0.30 THEN 'HIGH' WHEN round(s, 6) >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM {_M12} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(s, 6) DESC, l_linenumber) = 1")
def M12_M13_rerank(t: Tables) -> DataFrame:
    s = _scores(t).withColumn("score", F.round(M.rerank_score(C("emb"), C("rf"), C("lex"), C("prior")), 6))
    best = s.groupBy("l_orderkey").agg(F.min_by(F.struct("l_linenumber", "score", "lex"), F.struct(-C("score"), "l_linenumber")).alias("b")).select("l_orderkey", "b.*")
    return best.select("l_orderkey", "l_linenumber", "score", M.fuzzy_confidence(C("score"), C("lex")).alias("confidence"))


def _nodes(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("third", C("vec_id") % 3)
    l2 = V.mean_vector(e, ("label",), "embedding", "vec").select(F.concat(F.lit("L"), "label").alias("node"), F.lit("").alias("name"), F.lit(2).alias("level"), F.lit("").alias("parent"), "vec")
    l3 = V.mean_vector(e, ("label", "third"), "embedding", "vec").select(F.concat_ws(".", F.concat(F.lit("L"), "label"), "third").alias("node"), F.lit("").alias("name"), F.lit(3).alias("level"), F.concat(F.lit("L"), "label").alias("parent"), "vec")
    l4 = e.select(C("vec_id").cast("string").alias("node"), F.concat(F.lit("item "), C("vec_id") % 5).alias("name"), F.lit(4).alias("level"), F.concat_ws(".", F.concat(F.lit("L"), "label"), "third").alias("parent"), V.as_double(C("embedding")).alias("vec"))
    return l2.unionByName(l3).unionByName(l4)


def _beam_queries(t: Tables) -> DataFrame:
    return t.embeddings.select(C("vec_id").alias("query_id"), F.concat(F.lit("item "), C("vec_id") % 7).alias("name"), V.as_double(C("embedding")).alias("vec"))


def _beam_sql(t2: float, t3: float, ts: float, k2: int, k3: int, ks: int) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, 'item ' || (vec_id % 7) AS name, vec_id % 7 AS n7, embedding::DOUBLE[] AS v FROM embeddings),
l2 AS (SELECT 'L' || label AS node, v FROM {_centroid("label")}), l3 AS (SELECT 'L' || label || '.' || third AS node, 'L' || label AS parent, v FROM {_centroid("label, third")}),
l4 AS (SELECT vec_id::VARCHAR AS node, vec_id % 5 AS n5, 'L' || label || '.' || (vec_id % 3) AS parent, embedding::DOUBLE[] AS v FROM embeddings),
s2 AS (SELECT query_id, node, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, node) AS r FROM (SELECT query_id, node, list_dot_product(q.v, l2.v) AS s FROM q, l2)),
b2 AS (SELECT * FROM s2 WHERE r <= {k2} AND s >= {t2}),
s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY round(s, 12) DESC, node) AS r FROM (SELECT q.query_id, l3.node, l3.parent, list_dot_product(q.v, l3.v) AS s FROM q JOIN b2 USING (query_id) JOIN l3 ON l3.parent = b2.node)),
b3 AS (SELECT * FROM s3 WHERE r <= {k3} AND s >= {t3}),
s4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY round(s, 12) DESC, node) AS r FROM (SELECT q.query_id, l4.node, l4.parent, n5 = n7 AS same, list_dot_product(q.v, l4.v) AS s FROM q JOIN b3 USING (query_id) JOIN l4 ON l4.parent = b3.node)),
b4 AS (SELECT *, CASE WHEN same THEN greatest(0.75::DOUBLE * s + 0.25::DOUBLE, 0.98::DOUBLE) ELSE 0.75::DOUBLE * s + 0.25::DOUBLE / 3 END AS cs FROM s4 WHERE r <= {ks} AND s >= {ts}),
p AS (
  SELECT query_id, NULL AS c2, 0.0 AS x2, NULL AS c3, 0.0 AS x3, NULL AS c4, 0.0 AS x4, 1 AS stop, 0.0 AS ps FROM q WHERE query_id NOT IN (SELECT query_id FROM b2)
  UNION ALL SELECT b2.query_id, b2.node, b2.s, f.node, f.s, NULL, 0.0, 2, 0.40::DOUBLE * b2.s FROM b2 LEFT JOIN s3 f ON f.query_id = b2.query_id AND f.parent = b2.node AND f.r = 1 WHERE NOT EXISTS (SELECT 1 FROM b3 WHERE b3.query_id = b2.query_id AND b3.parent = b2.node)
  UNION ALL SELECT b2.query_id, b2.node, b2.s, b3.node, b3.s, f.node, f.s, 3, 0.40::DOUBLE * b2.s + 0.60::DOUBLE * b3.s FROM b2 JOIN b3 ON b3.query_id = b2.query_id AND b3.parent = b2.node LEFT JOIN s4 f ON f.query_id = b2.query_id AND f.parent = b3.node AND f.r = 1 WHERE NOT EXISTS (SELECT 1 FROM b4 WHERE b4.query_id = b3.query_id AND b4.parent = b3.node)
  UNION ALL SELECT b2.query_id, b2.node, b2.s, b3.node, b3.s, b4.node, b4.cs, 4, 0.20::DOUBLE * b2.s + 0.30::DOUBLE * b3.s + 0.50::DOUBLE * b4.cs FROM b2 JOIN b3 ON b3.query_id = b2.query_id AND b3.parent = b2.node JOIN b4 ON b4.query_id = b3.query_id AND b4.parent = b3.node),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ps DESC, x2 DESC, x3 DESC, c2, c3, c4) = 1)
SELECT b.query_id, coalesce(b.c2, t.node) AS level2_code, round(CASE WHEN b.c2 IS NULL THEN t.s ELSE b.x2 END, 6) AS level2_score, b.c3 AS level3_code, round(coalesce(b.x3, 0), 6) AS level3_score, b.c4 AS specific_code, round(coalesce(b.x4, 0), 6) AS specific_score,
  CASE WHEN stop <= 2 THEN 2 ELSE stop END AS final_level, ['NO_MATCH', 'LOW', 'MEDIUM', 'HIGH'][stop] AS confidence, round(ps, 6) AS path_score,
  CASE WHEN stop <= 2 THEN t.node WHEN stop = 3 THEN u.node ELSE w.node END AS top1_code, round(coalesce(CASE WHEN stop <= 2 THEN t2.s WHEN stop = 3 THEN u2.s ELSE w2.s END, 0), 6) AS top2_score
FROM best b LEFT JOIN s2 t ON t.query_id = b.query_id AND t.r = 1 LEFT JOIN s2 t2 ON t2.query_id = b.query_id AND t2.r = 2
  LEFT JOIN s3 u ON u.query_id = b.query_id AND u.parent = b.c2 AND u.r = 1 LEFT JOIN s3 u2 ON u2.query_id = b.query_id AND u2.parent = b.c2 AND u2.r = 2
  LEFT JOIN s4 w ON w.query_id = b.query_id AND w.parent = b.c3 AND w.r = 1 LEFT JOIN s4 w2 ON w2.query_id = b.query_id AND w2.parent = b.c3 AND w2.r = 2"""


def _beam(t: Tables, thresholds: tuple[float, float, float], widths: tuple[int, int, int]) -> DataFrame:
    got = M.beam(_beam_queries(t), _nodes(t), M.MatchParams(thresholds, widths))
    scores = ("level2_score", "level3_score", "specific_score", "path_score", "top2_score")
    return got.select("query_id", "level2_code", "level3_code", "specific_code", "final_level", "confidence", "top1_code", *(F.round(s, 6).alias(s) for s in scores))


@query(_beam_sql(0.15, 0.20, 0.55, 3, 2, 4))
def M14_beam(t: Tables) -> DataFrame:
    return _beam(t, (0.15, 0.20, 0.55), (3, 2, 4))


@query(_beam_sql(0.05, 0.30, 0.35, 2, 2, 3))
def M14_M18_beam_fallbacks(t: Tables) -> DataFrame:
    return _beam(t, (0.05, 0.30, 0.35), (2, 2, 3))


@query(f"""WITH j AS (SELECT row_id, a, b, {D.token_set("a")} AS x, {D.token_set("b")} AS y FROM {_PI}),
k AS (SELECT row_id, a, b, 0.75::DOUBLE * ((row_id % 100) / 100) + 0.25::DOUBLE * (CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END) AS s FROM j)
SELECT row_id, round(CASE WHEN a = b THEN greatest(s, 0.98) ELSE s END, 6) AS s FROM k""")
def M15_specific_score(t: Tables) -> DataFrame:
    emb = (C("row_id") % 100) / 100
    return t.products_ingredients.select("row_id", F.round(M.specific_score(emb, C("product_name"), C("ingredient"), normal=False), 6).alias("s"))


@query("SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN 0.20::DOUBLE * l_tax + 0.30::DOUBLE * l_discount + 0.50::DOUBLE * l_quantity / 50 WHEN 3 THEN 0.40::DOUBLE * l_tax + 0.60::DOUBLE * l_discount WHEN 2 THEN 0.40::DOUBLE * l_tax ELSE 0 END, 6) AS s FROM lineitem")
def M16_path_score(t: Tables) -> DataFrame:
    stop = F.when(C("l_linenumber") % 4 == 0, 4).otherwise(C("l_linenumber") % 4)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(M.path_score(stop, C("l_tax"), C("l_discount"), C("l_quantity") / 50), 6).alias("s"))


@query("SELECT query_id, " + ", ".join(f"max(item_id) FILTER (rank = {i}) AS top{i}_code, round(max(s) FILTER (rank = {i}), 6) AS top{i}_score" for i in (1, 2, 3)) + " FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings i)) GROUP BY 1")
def M17_top3_all(t: Tables) -> DataFrame:
    top = V.top_k(t.embeddings.select(C("vec_id").alias("query_id"), C("embedding").alias("vec")), _items(t), 3)
    return top.groupBy("query_id").agg(*(x for i in (1, 2, 3) for x in (F.max(F.when(C("rank") == i, C("item_id"))).alias(f"top{i}_code"), F.round(F.max(F.when(C("rank") == i, C("score"))), 6).alias(f"top{i}_score"))))


@query()
def M19_match_names(t: Tables) -> DataFrame:
    """The whole record of each match."""
    got = M.match_names(M.matchable(t.products_ingredients), t.foodex2_terms, M.RUNS["small"])
    return got.select("ingredient", *(F.round(c, 4).alias(c) if c.endswith("score") or c == "branch_prior" else C(c) for c in M.RECORD))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings), l2 AS (SELECT 'L' || label AS node, v FROM {_centroid("label")}), l3 AS (SELECT 'L' || label || '.' || third AS node, 'L' || label AS parent, v FROM {_centroid("label, third")}),
l4 AS (SELECT vec_id::VARCHAR AS node, 'L' || label || '.' || (vec_id % 3) AS parent, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT query_id, node, list_dot_product(q.v, l2.v) AS s FROM q, l2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, node) = 1),
b AS (SELECT a.query_id, l3.node, list_dot_product(q.v, l3.v) AS s FROM a JOIN q USING (query_id) JOIN l3 ON l3.parent = a.node QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_dot_product(q.v, l3.v), 12) DESC, l3.node) = 1),
c AS (SELECT b.query_id, l4.node, list_dot_product(q.v, l4.v) AS s FROM b JOIN q USING (query_id) JOIN l4 ON l4.parent = b.node QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY round(list_dot_product(q.v, l4.v), 12) DESC, l4.node) = 1)
SELECT a.query_id, CASE WHEN a.s < 0.25 OR b.s < 0.3 THEN a.node WHEN c.s < 0.9 THEN b.node ELSE c.node END AS code, round(CASE WHEN a.s < 0.25 OR b.s < 0.3 THEN a.s WHEN c.s < 0.9 THEN b.s ELSE c.s END, 6) AS score,
  CASE WHEN a.s < 0.25 OR b.s < 0.3 THEN 2 WHEN c.s < 0.9 THEN 3 ELSE 5 END AS level, CASE WHEN a.s < 0.25 THEN 'NO_MATCH' WHEN b.s < 0.3 THEN 'LOW' WHEN c.s < 0.9 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
FROM a JOIN b USING (query_id) JOIN c USING (query_id)""")
def M20_greedy(t: Tables) -> DataFrame:
    return M.greedy(_beam_queries(t), _nodes(t), M.MatchParams((0.25, 0.3, 0.9))).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT ingredient, min(row_id) AS r FROM products_ingredients WHERE matchable AND tag_lang = 'en' AND NOT coalesce(is_additive, false) GROUP BY 1), low AS (SELECT lower(ingredient) AS k, arg_min(r, ingredient) AS r FROM r GROUP BY 1),
q AS (SELECT DISTINCT ingredient FROM products_ingredients)
SELECT q.ingredient, CASE WHEN a.r IS NOT NULL THEN 'exact' WHEN b.r IS NOT NULL THEN 'lower' END AS hit, CAST(coalesce(a.r, b.r, -1) AS BIGINT) AS r FROM q LEFT JOIN r a USING (ingredient) LEFT JOIN low b ON b.k = lower(q.ingredient)""")
def M21_cache(t: Tables) -> DataFrame:
    """All ingredients against results of those that are strictly matchable."""
    rows = t.products_ingredients
    r = rows.where("matchable and tag_lang = 'en' and not coalesce(is_additive, false)").groupBy("ingredient").agg(F.min("row_id").alias("r"))
    return M.cached(rows.select("ingredient").distinct(), r).withColumn("r", F.coalesce("r", F.lit(-1)))


@query()
def M21_cached_match(t: Tables) -> DataFrame:
    """M21 whole: every ingredient, from the results of all that are to be matched, else live."""
    results = materialise(M.match_names(M.matchable(t.products_ingredients, strict=True), t.foodex2_terms, M.RUNS["small"]))
    got = M.match_cached(t.products_ingredients.select("ingredient").distinct(), results, t.foodex2_terms, M.RUNS["small"])
    return got.withColumn("score", F.round("score", 4))


@query(f"""WITH best AS (SELECT query_id, item_id AS chosen FROM {_PAIRS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) = 1)
SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS alternative FROM (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY round(s, 12) DESC, item_id) AS rank FROM {_PAIRS} p) p JOIN best USING (query_id) WHERE rank <= 4 AND item_id <> chosen""")
def M22_alternatives(t: Tables) -> DataFrame:
    top = V.top_k(_queries(t), _items(t), 4)
    best = top.where("rank = 1").select("query_id", C("item_id").alias("chosen"))
    other = top.join(best, "query_id").where("item_id <> chosen")
    return V.ranked(other.withColumnRenamed("rank", "r0"), ("query_id",), [C("r0")], 3, "alternative").select("query_id", "item_id", "alternative")


_PROBES = ("apple juice", "Salt", "garlic powder", "sea water", "Juice, Carrot", "whey")


@query("SELECT p.probe, t.termCode FROM (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PROBES) + "]) AS probe) p LEFT JOIN foodex2_terms t ON lower(t.termExtendedName) = lower(p.probe)")
def M24_literal_probe(t: Tables) -> DataFrame:
    p = t.spark.createDataFrame([(x,) for x in _PROBES], "probe string")
    return p.join(t.foodex2_terms.select("termCode", "termExtendedName"), F.lower("probe") == F.lower("termExtendedName"), "left").select("probe", "termCode")


@query()
def M24_fuzzy_probe(t: Tables) -> DataFrame:
    p = t.spark.createDataFrame([(x,) for x in _PROBES], "ingredient string")
    got = M.fuzzy_candidates(p, M.variants(H.index(t.foodex2_terms)), M.MatchParams(cutoff=0, top_variants=15, top_terms=5))
    return got.withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT ingredient FROM products_ingredients WHERE matchable")
def M25_matchable(t: Tables) -> DataFrame:
    return M.matchable(t.products_ingredients)


@query("SELECT DISTINCT ingredient FROM products_ingredients WHERE matchable AND tag_lang = 'en' AND coalesce(is_additive, false) = false")
def M25_matchable_strict(t: Tables) -> DataFrame:
    return M.matchable(t.products_ingredients, strict=True)


@query()
def M9_scorers(t: Tables) -> DataFrame:
    a, b = C("ingredient"), C("product_name")
    return t.products_ingredients.select("row_id", F.round(fuzzy.weighted_ratio(a, b), 6).alias("weighted"), F.round(fuzzy.indel_ratio(a, b), 6).alias("indel"))
