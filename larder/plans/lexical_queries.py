"""Queries of lexical metrics (L) and clusters (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import lexical as L
from larder.operators import bias as B
from larder.operators import clustering as K
from larder.operators import reports as R
from larder.operators import vectors as V
from larder.plans import duck as D
from larder.plans.registry import Tables, query

C = F.col
#: Pairs of an ingredient and its product, with a score between them.
_P = "(SELECT row_id, ingredient AS a, coalesce(product_name, '') AS b, CAST((row_id * 37) % 997 AS DOUBLE) / 997 AS s, code FROM products_ingredients)"
# The other engine counts edits in bytes. Of texts beyond ASCII it counts them row by row of the edit table over code
# points: t holds the cheapest ways from the row before, and a running minimum over it adds the insertions.
_CODES = "list_transform(range(1, length({0}) + 1), lambda i: unicode(substr({0}, i, 1))::BIGINT)"
_STEP = """list_transform([list_transform(range(1, len(r) + 1), lambda k: CASE WHEN k = 1 THEN r[1] + 1 ELSE least(r[k] + 1, r[k - 1] + CASE WHEN bc[k - 1] = x[1] THEN 0 ELSE 1 END) END)],
  lambda t: list_transform(range(1, len(t) + 1), lambda k: k + list_min(list_transform(t[1:k], lambda v, j: v - j))))[1]"""
_EDITS = f"list_reduce(list_concat([range(0, length(b) + 1)], list_transform({_CODES.format('a')}, lambda c: [c])), lambda r, x: {_STEP})[-1]"
_LEV = f"(CASE WHEN strlen(a) = length(a) AND strlen(b) = length(b) THEN levenshtein(a, b) ELSE {_EDITS} END)"
_P = f"(SELECT *, {_CODES.format('b')} AS bc FROM {_P})"


def _pairs(t: Tables) -> DataFrame:
    return t.products_ingredients.select("row_id", C("ingredient").alias("a"), F.coalesce("product_name", F.lit("")).alias("b"), (((C("row_id") * 37) % 997).cast("double") / 997).alias("s"), "code").withColumn("ingredient", C("a"))


def _set(x: str) -> str:
    return f"list_distinct({D.words(f'lower({x})')})"


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END"


_BLANK = "(trim(a) = '' OR trim(b) = '')"
_SIM = f"CASE WHEN {_BLANK} THEN 0.0 ELSE 1 - {_LEV} / greatest(length(a), length(b), 1) END"


@query(f"SELECT row_id, {_LEV}::INTEGER AS d, round({_SIM}, 6) AS sim FROM {_P}")
def L1_L2_levenshtein(t: Tables) -> DataFrame:
    return _pairs(t).select("row_id", F.levenshtein("a", "b").alias("d"), F.round(L.similarity(C("a"), C("b")), 6).alias("sim"))


@query(f"SELECT row_id, round({_jac(_set('a'), _set('b'))}, 6) AS j FROM {_P}")
def L3_token_jaccard(t: Tables) -> DataFrame:
    return _pairs(t).select("row_id", F.round(L.token_jaccard(C("a"), C("b")), 6).alias("j"))


@query(f"SELECT row_id, array_to_string(list_sort(list_intersect({_set('a')}, {_set('b')})), ' ') AS shared, len(list_intersect({_set('a')}, {_set('b')}))::INTEGER AS n FROM {_P}")
def L4_shared_tokens(t: Tables) -> DataFrame:
    s = L.shared_tokens(C("a"), C("b"))
    return _pairs(t).select("row_id", F.array_join(s, " ").alias("shared"), F.size(s).alias("n"))


_LCS = "coalesce(list_max(list_transform(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: substr(lower(a), i, n)))), lambda g: CASE WHEN contains(lower(b), g) THEN length(g) ELSE 0 END)), 0)"


@query(f"SELECT row_id, round(CASE WHEN {_BLANK} THEN 0.0 ELSE {_LCS} / greatest(least(length(a), length(b)), 1) END, 6) AS ratio FROM {_P}")
def L5_L6_common_substring(t: Tables) -> DataFrame:
    return _pairs(t).select("row_id", F.round(L.common_substring_ratio(C("a"), C("b")), 6).alias("ratio"))


def _ends(start: str, end: str) -> str:
    return f"len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(lower(a), {start.format('a')}, {end}) = substr(lower(b), {start.format('b')}, {end})))::INTEGER"


@query(f"SELECT row_id, {_ends('1', 'i')} AS prefix, {_ends('length({0}) - i + 1', 'i')} AS suffix FROM {_P}")
def L7_L8_prefix_and_suffix(t: Tables) -> DataFrame:
    return _pairs(t).select("row_id", L.shared_prefix(C("a"), C("b")).alias("prefix"), L.shared_suffix(C("a"), C("b")).alias("suffix"))


def _grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr(lower({x}), i, {n})))"


@query(f"SELECT row_id, round({_jac(_grams('a', 2), _grams('b', 2))}, 6) AS j2, round({_jac(_grams('a', 3), _grams('b', 3))}, 6) AS j3 FROM {_P}")
def L9_gram_jaccard(t: Tables) -> DataFrame:
    return _pairs(t).select("row_id", *(F.round(L.gram_jaccard(C("a"), C("b"), n), 6).alias(f"j{n}") for n in (2, 3)))


@query(f"SELECT row_id, contains(lower(b), lower(a)) AS a_in_b, contains(lower(a), lower(b)) AS b_in_a, round(coalesce(least(length(a), length(b)) / nullif(greatest(length(a), length(b)), 0), 0), 6) AS len_ratio, len(list_intersect({_set('a')}, {_set('b')})) > 0 AS exact_token FROM {_P}")
def L10_containment(t: Tables) -> DataFrame:
    a, b = C("a"), C("b")
    return _pairs(t).select("row_id", L.contains(b, a).alias("a_in_b"), L.contains(a, b).alias("b_in_a"), F.round(L.length_ratio(a, b), 6).alias("len_ratio"), F.arrays_overlap(L.token_set(a), L.token_set(b)).alias("exact_token"))


@query()
def L11_phonetic(t: Tables) -> DataFrame:
    return _pairs(t).select("row_id", L.sounds_alike(C("a"), C("b")).alias("soundex"), F.round(L.phonetic_similarity(C("a"), C("b")), 6).alias("phonetic"))


_M = f"(SELECT row_id, a AS ingredient, code, s, {_SIM} AS sim, {_jac(_set('a'), _set('b'))} AS jac, least(length(a), length(b)) / nullif(greatest(length(a), length(b)), 0) AS len_ratio, {_LCS} / greatest(least(length(a), length(b)), 1) AS lcs FROM {_P})"
_METRICS = ("sim", "jac", "len_ratio", "lcs")


def _metrics(t: Tables) -> DataFrame:
    a, b = C("a"), C("b")
    ratio = F.length(L.fuzzy.longest_common_substring(F.lower("a"), F.lower("b"))) / F.greatest(F.least(F.length("a"), F.length("b")), F.lit(1))
    return _pairs(t).select("row_id", "ingredient", "code", "s", L.similarity(a, b).alias("sim"), L.token_jaccard(a, b).alias("jac"), (F.least(F.length("a"), F.length("b")) / F.nullif(F.greatest(F.length("a"), F.length("b")), F.lit(0))).alias("len_ratio"), ratio.alias("lcs"))


def _corr(m: str) -> str:
    r = f"round(corr({m}, s), 6)"
    return f"SELECT '{m}' AS metric, {r} AS r, CASE WHEN {r} IS NULL THEN 'unknown' WHEN abs({r}) >= 0.5 THEN 'strong' WHEN abs({r}) >= 0.3 THEN 'moderate' WHEN abs({r}) >= 0.1 THEN 'weak' ELSE 'none' END AS verdict FROM m"


@query(f"WITH m AS {_M} " + " UNION ALL ".join(_corr(m) for m in _METRICS))
def L12_correlations(t: Tables) -> DataFrame:
    return B.correlations(_metrics(t), _METRICS, "s")


@query(f"""WITH g AS (SELECT count(s) FILTER (jac > 0) AS n, count(s) FILTER (jac <= 0) AS k, avg(s) FILTER (jac > 0) AS a, avg(s) FILTER (jac <= 0) AS b, var_samp(s) FILTER (jac > 0) AS va, var_samp(s) FILTER (jac <= 0) AS vb FROM {_M})
SELECT n AS n_with, k AS n_without, round(a, 6) AS mean_with, round(b, 6) AS mean_without, round(a - b, 6) AS diff, round((a - b) / sqrt(((n - 1) * va + (k - 1) * vb) / (n + k - 2) * (1 / n + 1 / k)), 4) AS t FROM g""")
def L13_mean_difference(t: Tables) -> DataFrame:
    return B.mean_difference(_metrics(t), "s", C("jac") > 0)


_EDGES = [-0.01, 0.0, 0.2, 0.4, 0.6, 1.0]


@query(f"WITH m AS MATERIALIZED {_M} " + "SELECT bin, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(100.0 * count(*) FILTER (s >= 0.7) / count(*), 2)::DOUBLE AS pct_high FROM (SELECT s, CASE " + " ".join(f"WHEN sim > {a} AND sim <= {b} THEN '({a:g}, {b:g}]'" for a, b in zip(_EDGES, _EDGES[1:])) + f" END AS bin FROM m) WHERE bin IS NOT NULL GROUP BY 1")
def L14_binned(t: Tables) -> DataFrame:
    return R.binned(_metrics(t), "sim", _EDGES, "s", C("s") >= 0.7)


@query(f"SELECT k, count(*) FILTER (lcs > 0.4 AND s > 0.7) AS n, round(100.0 * count(*) FILTER (lcs > 0.4 AND s > 0.7) / count(*), 2)::DOUBLE AS pct FROM (SELECT *, row_id % 4 AS k FROM {_M}) GROUP BY 1")
def L15_suspects(t: Tables) -> DataFrame:
    return B.suspects(_metrics(t).withColumn("k", C("row_id") % 4), "lcs", "s", "k")


@query(f"SELECT round(regr_slope(s, sim), 6) AS slope, round(regr_intercept(s, sim), 6) AS intercept FROM {_M}")
def L16_trend(t: Tables) -> DataFrame:
    return B.trend(_metrics(t), "sim", "s")


@query(f"SELECT code, count(*) AS n, round(100.0 * count(*) FILTER (s < 0.3) / count(*), 2)::DOUBLE AS pct_low, min(ingredient) FILTER (s < 0.3) AS example FROM {_M} GROUP BY 1")
def L17_low_scores(t: Tables) -> DataFrame:
    return B.low_scores(_metrics(t), "code", "s", 0.3)


@query(f"SELECT lang, count(*) AS n, round(avg(w), 4) AS mean_words, max(w)::INTEGER AS max_words FROM (SELECT lang, len({D.words('text')}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1 ORDER BY n DESC, lang NULLS FIRST LIMIT 10")
def C1_word_counts(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").select("lang", F.size(L.words(C("text"))).alias("w"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 4).alias("mean_words"), F.max("w").alias("max_words")).orderBy(F.desc("n"), F.asc_nulls_first("lang")).limit(10)


@query()
def C2_text_vectors(t: Tables) -> DataFrame:
    return t.products_with_language1.select("row_id", V.encoder(64)(F.coalesce("product_name", F.lit(""))).alias("vec"))


@query()
def C3_projection(t: Tables) -> DataFrame:
    return K.project(t.embeddings, "vec_id", "embedding")


@query()
def C4_kmeans(t: Tables) -> DataFrame:
    return K.kmeans(t.embeddings, "vec_id", "embedding")


@query()
def C5_elbow(t: Tables) -> DataFrame:
    return K.elbow(t.embeddings, "embedding")


_SIL = """WITH d AS (SELECT a.vec_id, a.label, b.label AS other, avg(x) AS mean_all, sum(x) AS total, count(*) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id AS v2, label, embedding::DOUBLE[] AS f FROM embeddings) b, LATERAL (SELECT list_distance(a.e, b.f) AS x) GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(total / greatest(n - 1, 1)) FILTER (other = label) AS a, max(n) FILTER (other = label) AS n, min(mean_all) FILTER (other <> label) AS b FROM d GROUP BY 1, 2)
"""


@query(_SIL + "SELECT vec_id, label, round(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM s")
def C6_silhouettes(t: Tables) -> DataFrame:
    return V.silhouettes(t.embeddings, "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


@query("SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM embeddings GROUP BY 1")
def C7_distribution(t: Tables) -> DataFrame:
    return K.distribution(t.embeddings, "label")


@query("""SELECT g.source, g.n, g.mean_score, g.std_score, g.mean_len, g.median_len, round(100.0 * g.n / sum(g.n) OVER (), 2)::DOUBLE AS pct, l.dominant, l.n_languages FROM (
  SELECT source, count(*) AS n, round(avg(doc_id % 97), 4) AS mean_score, round(stddev_samp(doc_id % 97), 4) AS std_score, round(avg(length(text)), 4) AS mean_len, round(median(length(text)), 4) AS median_len FROM documents GROUP BY 1) g
LEFT JOIN (SELECT source, arg_min(lang, (-k) * 1000 + r) AS dominant, count(*) AS n_languages FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) AS r FROM (SELECT source, lang, count(*) AS k FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)) GROUP BY 1) l ON l.source IS NOT DISTINCT FROM g.source""")
def C8_profiles(t: Tables) -> DataFrame:
    return K.profile(t.documents, "source", "lang", (C("doc_id") % 97).cast("double"), "text")


@query("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 3")
def C9_examples(t: Tables) -> DataFrame:
    return K.examples(t.documents.select("source", "doc_id"), "source", "doc_id")
