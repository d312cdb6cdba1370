"""Products to ingredient rows, and the taxonomy that names them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T

#: Categories whose products are no food.
NON_FOOD = (
    "en:beauty-products", "en:cosmetics", "en:hygiene-products", "en:pet-food", "en:cat-food", "en:dog-food", "en:animal-food", "en:bird-food",
    "en:cleaning-products", "en:detergents", "en:non-food-products",
)
INGREDIENT_COLUMNS = (
    "code", "lang_product_name", "product_name", "product_context", "original_tag", "tag_lang", "ingredient", "nlp_text",
    "is_additive", "is_noise_phrase", "is_context_term", "matchable",
)


def food_products(products: DataFrame, language: str = "en") -> DataFrame:
    """Labelled in `language`, with tags and food groups, and of no non-food category (a null category may pass)."""
    other = F.coalesce("categories_tags", F.lit("")).rlike("|".join(NON_FOOD))
    return products.where((F.col("lang_ingredients_text") == language) & F.col("ingredients_tags").isNotNull() & ~other & F.col("food_groups_tags").isNotNull())


def parse_tags(df: DataFrame, column: str = "ingredients_tags", keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Keys, pos (int, from 0), original_tag, tag_lang, ingredient, is_valid, is_additive, is_noise_phrase, is_context_term; one row a tag.

    Tags are split at commas and trimmed; those that are empty before or after cleaning are dropped. The language
    prefix counts in either case; a tag without one has language ''. Null and blank cells give no rows.
    """
    tag = df.select(*keys, F.posexplode(F.transform(F.split(column, ","), T.strip)).alias("pos", "original_tag")).where("original_tag <> ''")
    prefix = r"(?is)^([a-z]{2}):(.*)$"
    bare = F.when(F.col("original_tag").rlike(prefix), F.regexp_extract("original_tag", prefix, 2)).otherwise(F.col("original_tag"))
    tag = tag.select("*", F.lower(F.regexp_extract("original_tag", prefix, 1)).alias("tag_lang"), T.nfkc(bare).alias("__n"))
    tag = tag.withColumn("ingredient", T.token(F.col("__n"), normal=True)).where("ingredient <> ''").withColumn("__k", T.lookup_key(F.col("ingredient"), normal=True))
    return tag.select(
        *keys, "pos", "original_tag", "tag_lang", "ingredient", T.valid_ingredient(F.col("ingredient")).alias("is_valid"), T.is_additive(F.col("__k")).alias("is_additive"),
        T.is_noise(F.col("__k")).alias("is_noise_phrase"), T.is_context(F.col("__k")).alias("is_context_term"),
    )


def ingredient_rows(products: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Valid tags of products as rows of INGREDIENT_COLUMNS; English ones that are neither noise nor context are matchable."""
    few = products.select("code", "lang_product_name", "product_name", T.clean_text(F.col("product_name")).alias("product_context"), "ingredients_tags")
    rows = parse_tags(few, keys=("code", "lang_product_name", "product_name", "product_context")).where("is_valid")
    rows = rows.withColumn("matchable", (F.col("tag_lang") == "en") & ~F.col("is_noise_phrase") & ~F.col("is_context_term"))
    rows = with_taxonomy(rows, taxonomy) if taxonomy is not None else rows.withColumn("nlp_text", F.col("ingredient"))
    return rows.select(*INGREDIENT_COLUMNS)


def english_tags(df: DataFrame, column: str = "ingredients_tags", keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Keys, pos, ingredient of tags that begin with `en:` in lower case, cleaned, without a check of validity."""
    tag = df.select(*keys, F.posexplode(F.transform(F.split(column, ","), T.strip)).alias("pos", "t")).where(F.col("t").startswith("en:"))
    return tag.select(*keys, "pos", T.token(F.expr("substring(t, 4)")).alias("ingredient")).where("ingredient <> ''")


def legacy_tags(df: DataFrame, column: str = "ingredients_tags", keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Keys, pos, ingredient of tags of any language, cleaned and valid by the older rules."""
    tag = df.select(*keys, F.posexplode(F.transform(F.split(column, ","), T.strip)).alias("pos", "t")).where("t <> ''")
    tag = tag.select(*keys, "pos", T.clean_token(T.clean_text(F.regexp_replace("t", "^[a-z]{2}:", ""))).alias("ingredient"))
    return tag.where((F.col("ingredient") != "") & T.valid_ingredient(F.col("ingredient"), 8, False, True))


def label_tokens(df: DataFrame, column: str = "ingredients_text", keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Keys, pos, ingredient of the parts of a label between commas, semicolons and line feeds, without bracketed
    parts; invalid parts, noise and context terms are dropped, order and repeats stay."""
    part = df.select(*keys, F.posexplode(F.split(column, r"[,;\n]+")).alias("pos", "p"))
    part = part.select(*keys, "pos", T.nfkc(F.regexp_replace("p", r"\([^)]*\)", "")).alias("__n"))
    part = part.select(*keys, "pos", T.token(F.col("__n"), normal=True).alias("ingredient")).withColumn("__k", T.lookup_key(F.col("ingredient"), normal=True))
    return part.where((F.col("ingredient") != "") & T.valid_ingredient(F.col("ingredient")) & ~T.is_noise(F.col("__k")) & ~T.is_context(F.col("__k"))).drop("__k")


def build_taxonomy(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """Key, canonical of `en:` lines; the first name, in lower case, is canonical, and later lines win."""
    rest = lines.where(F.col(line).startswith("en:")).select(F.col(order).alias("__no"), F.transform(F.split(F.expr(f"substring({line}, 4)"), ","), T.strip).alias("names"))
    rest = rest.where(F.get("names", F.lit(0)) != "").select("__no", F.lower(F.get("names", F.lit(0))).alias("canonical"), F.posexplode("names").alias("__i", "name")).where("name <> ''")
    rest = rest.select(T.lookup_key(F.col("name")).alias("key"), F.struct("__no", "__i").alias("__at"), "canonical")
    return rest.groupBy("key").agg(F.max_by("canonical", "__at").alias("canonical"))


def with_taxonomy(rows: DataFrame, taxonomy: DataFrame, column: str = "ingredient", out: str = "nlp_text") -> DataFrame:
    """Canonical name of the key, else of its E-code, else the text itself. The planner broadcasts the taxonomy if it is small."""
    keyed = rows.withColumn("__k", T.lookup_key(F.col(column))).withColumn("__e", T.normalize_e_code(F.col("__k")))
    first = taxonomy.select(F.col("key").alias("__k"), F.col("canonical").alias("__a"))
    second = taxonomy.select(F.col("key").alias("__e"), F.col("canonical").alias("__b"))
    return keyed.join(first, "__k", "left").join(second, "__e", "left").withColumn(out, F.coalesce("__a", "__b", column)).drop("__k", "__e", "__a", "__b")


def tag_languages(df: DataFrame, column: str = "ingredients_tags") -> DataFrame:
    """Lang, n: tags by language prefix ('' without one)."""
    tag = df.select(F.explode(F.transform(F.split(column, ","), T.strip)).alias("t")).where("t <> ''")
    return tag.groupBy(F.regexp_extract("t", "^([a-z]{2}):", 1).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
