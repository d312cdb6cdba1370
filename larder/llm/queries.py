"""Queries of the text-corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import bpe, canonical, copies, langid, lookalike, mixing, spans
from larder.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "products_ingredients").where("matchable")
    return canonical.map_to_list(rows, table(spark, d, "foodex2_terms")).select("row_id", "term_code")


@query
def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that are not in the list, and how often they come."""
    rows = table(spark, d, "products_ingredients").where("matchable")
    got = canonical.map_to_list(rows, table(spark, d, "foodex2_terms"), keys=("row_id", "ingredient"))
    return got.where(F.col("term_code") == canonical.NONE).groupBy("ingredient").agg(F.count(F.lit(1)).alias("n"))


_FIELDS = (("ingredients_text", "lang_ingredients_text"), ("product_name", "lang_product_name"))


def _language_filters(spark: SparkSession, d: str) -> langid.Filters:
    return langid.learn(table(spark, d, "products_with_language1"), table(spark, d, "lang_samples"), _FIELDS)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, filters = table(spark, d, "products_with_language1"), _language_filters(spark, d)
    a = langid.label_cases(rows, "ingredients_text", "lang_ingredients_text", filters)
    b = langid.label_cases(rows, "product_name", "lang_product_name", filters, mixed=False)
    return a.select(F.lit("ingredients_text").alias("field"), "row_id", "seg_no", "lang").unionByName(b.select(F.lit("product_name").alias("field"), "row_id", "seg_no", "lang"))


@query
def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and size of each segment of each label text, and of each product name as one."""
    rows, filters = table(spark, d, "products_with_language1"), _language_filters(spark, d)
    a = langid.identify(rows, "ingredients_text", filters).withColumn("field", F.lit("ingredients_text"))
    b = langid.identify(rows, "product_name", filters, mixed=False).withColumn("field", F.lit("product_name"))
    return a.unionByName(b).withColumn("confidence", F.round("confidence", 6))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "products_ingredients"))


ORACLES["p4_found"] = r"""
WITH k AS (
  SELECT row_id, code, list_sort(regexp_extract_all(lower(ingredient), '[\p{L}\p{Nd}]+')) AS words
  FROM products_ingredients WHERE code IS NOT NULL AND ingredient IS NOT NULL),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY code, words) AS keep_row_id FROM k)
SELECT keep_row_id, row_id AS copy_row_id FROM g WHERE row_id <> keep_row_id
"""


@query
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """One record of each and its number of copies."""
    return copies.count_copies(table(spark, d, "products_ingredients")).select(F.col("keep").alias("row_id"), "copies")


ORACLES["p4_counts"] = r"""
WITH k AS (
  SELECT row_id, code, list_sort(regexp_extract_all(lower(ingredient), '[\p{L}\p{Nd}]+')) AS words
  FROM products_ingredients WHERE code IS NOT NULL AND ingredient IS NOT NULL)
SELECT min(row_id) AS row_id, count(*) AS copies FROM k GROUP BY code, words
"""


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "products_ingredients").select(F.lit("ingredient").alias("field"), "row_id", F.col("ingredient").alias("value"))
    b = table(spark, d, "products_with_language1").select(F.lit("product_name").alias("field"), "row_id", F.col("product_name").alias("value"))
    return lookalike.plain_values(a.unionByName(b), "value", ("field", "row_id"))


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


@query
def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ids = bpe.encode_corpus(docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), keys=("doc_id", "sha"))
    return bpe.decode_corpus(ids, keys=("doc_id", "sha")).select("doc_id", (F.sha2("text", 256) == F.col("sha")).alias("same"))


ORACLES["p7_roundtrip"] = "SELECT doc_id, true AS same FROM documents"


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights")).slots


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights")).shares


@query
def p8_reached(spark: SparkSession, d: str) -> DataFrame:
    """Of each listed source its share of the mix as wanted, once sources without tokens are left out, whether its tokens
    are within half a block of that share of the largest mix, and whether the cap on repeats is kept."""
    got = mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights")).shares
    every = Window.partitionBy()
    got = got.withColumn("live", F.col("available_tokens") > 0)
    want = F.when(F.col("live"), F.col("target_share") / F.sum(F.when(F.col("live"), F.col("target_share"))).over(every)).otherwise(0.0)
    got = got.withColumn("want", want).withColumn("most", F.min(F.when(F.col("live"), F.col("available_tokens") * F.col("max_repeats") / F.col("want"))).over(every))
    near = F.abs(F.col("mixed_tokens") - F.col("want") * F.coalesce("most", F.lit(0.0))) <= mixing.BLOCK // 2 + 1
    return got.select("source", F.round("want", 9).alias("wanted_share"), near.alias("reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("cap_kept"))


ORACLES["p8_reached"] = """
WITH s AS (SELECT w.source, w.target_share, w.source IN (SELECT source FROM documents WHERE text <> '') AS live FROM source_weights w)
SELECT source, round(CASE WHEN live THEN target_share / sum(target_share) FILTER (live) OVER () ELSE 0 END, 9) AS wanted_share, true AS reached, true AS cap_kept FROM s
"""


@query
def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: token ids of every slot."""
    docs = table(spark, d, "documents")
    return mixing.with_tokens(mixing.mix_sources(docs, table(spark, d, "source_weights")).slots, docs)


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


ORACLES["p9_found"] = """
WITH w AS (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, i FROM w SEMI JOIN s USING (h))
SELECT doc_id, CAST(sum(least(200, coalesce(nxt - i, 200))) AS BIGINT) AS shared_chars
FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM m) GROUP BY 1
"""


@query
def p9_units(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_units(table(spark, d, "documents"))


_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORACLES["p9_units"] = f"""
WITH u AS (SELECT doc_id, string_split_regex(text, '\\n+') AS p, regexp_extract_all(text, '\\n+') AS g FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, p, g, unnest(p) AS unit, generate_subscripts(p, 1) - 1 AS k FROM u),
n AS (SELECT doc_id, k, length(unit) AS n_chars, trim(regexp_replace(lower(unit), '{_WS}+', ' ', 'g')) AS norm,
  coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) AS start FROM e),
d AS (SELECT *, sha256(norm) AS digest FROM n WHERE length(norm) >= 40)
SELECT doc_id, CAST(k AS INTEGER) AS unit_no, CAST(start AS BIGINT) AS start, CAST(n_chars AS INTEGER) AS n_chars, digest, count(*) OVER (PARTITION BY digest) AS copies,
  row_number() OVER (PARTITION BY digest ORDER BY doc_id, k) = 1 AS keep
FROM d QUALIFY count(*) OVER (PARTITION BY digest) > 1
"""


def _plain_sql(x: str) -> str:
    """Plain form for values as they occur here: all look-alike letters become Latin where the value has a Latin letter."""
    wide, narrow = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
    seen = f"regexp_replace(translate({x}, '{wide.replace("'", "''")}', '{narrow.replace("'", "''")}'), '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    seen = f"replace(replace(translate(regexp_replace({seen}, '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), '‐‑', '--'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    other = {**lookalike.CYRILLIC, **lookalike.GREEK}
    latin = f"translate({seen}, '{''.join(other)}', '{''.join(v[0] for v in other.values())}')"
    return f"nfc_normalize(CASE WHEN regexp_matches({seen}, '[A-Za-z]') THEN {latin} ELSE {seen} END)"


ORACLES["p6_found"] = f"""
SELECT field, row_id, plain FROM (
  SELECT 'ingredient' AS field, row_id, ingredient AS v, {_plain_sql("ingredient")} AS plain FROM products_ingredients
  UNION ALL SELECT 'product_name', row_id, product_name, {_plain_sql("product_name")} FROM products_with_language1)
WHERE plain <> v
"""
