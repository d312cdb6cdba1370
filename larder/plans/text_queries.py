"""Queries of the text and tag layer (T), of the readers and table operations (S), and of the two core data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import packed, rejects, tags
from larder.plans import duck as D
from larder.plans.registry import ORACLES, Tables, query

C = F.col


_QUOTED = '"[^"]*(?:""[^"]*)*"'
_CELL = f'(?:{_QUOTED}|[^"\\t][^\\t]*|)'
_BAD = r"\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{FFFD}"
_CLEAN = f'(?:"[^"{_BAD}]*(?:""[^"{_BAD}]*)*"|[^"\\t{_BAD}][^\\t{_BAD}]*|)'
_NUMBER = r"(?:0*1(?:\.(?:0[0-9]*|10*))?|0+(?:\.[0-9]+)?)?"
_TYPED = ["(?:\"[0-9]{8,14}\"|[0-9]{8,14})", _CLEAN, _CELL, _CELL, _CLEAN, *[_CELL] * 9, f'(?:"{_NUMBER}"|{_NUMBER})']


@query(f"""SELECT line_id, reason FROM (SELECT line_id, CASE WHEN raw_line IS NULL THEN 'columns' WHEN regexp_full_match(raw_line, '{r"\t".join(_TYPED)}', 's') THEN NULL
  WHEN regexp_matches(raw_line, '^(?:{_CELL}\\t)*"[^"]*(?:""[^"]*)*(?:$|"[^"\\t])', 's') THEN 'quoting' WHEN regexp_full_match(raw_line, '{r"\t".join([_CELL] * 15)}', 's') THEN 'value' ELSE 'columns' END AS reason FROM product_lines) WHERE reason IS NOT NULL""")
def p1_found(t: Tables) -> DataFrame:
    return rejects.rejected(t.product_lines).select("line_id", "reason")


_NAMES_OF = [f.name for f in rejects.PRODUCT_LINE]


def _first_missed(cells: list[str]) -> str:
    """Name of the first field whose prefix of cells a line doesn't hold."""
    tests = (f"WHEN NOT regexp_matches(raw_line, '^{r'\t'.join(cells[: i + 1])}(?:\t|$)', 's') THEN '{name}'" for i, name in enumerate(_NAMES_OF))
    return f"CASE {' '.join(tests)} END"


@query(f"""SELECT line_id, reason, CASE WHEN raw_line IS NULL THEN 'code' WHEN reason = 'quoting' THEN {_first_missed([_CELL] * 15)} ELSE {_first_missed(_TYPED)} END AS bad_field
FROM ({ORACLES["p1_found"]}) JOIN product_lines USING (line_id)""")
def p1_reasons(t: Tables) -> DataFrame:
    """Reason and first broken field of every line that can't be loaded."""
    return rejects.rejected(t.product_lines).select("line_id", "reason", "bad_field")


def _cell_sql(name: str) -> str:
    bare = f"nullif(CASE WHEN r.{name} LIKE '\"%' THEN replace(substr(r.{name}, 2, length(r.{name}) - 2), '\"\"', '\"') ELSE r.{name} END, '')"
    return f"CAST({bare} AS DOUBLE) AS {name}" if name == "completeness" else f"{bare} AS {name}"


@query(f"""SELECT line_id, {", ".join(map(_cell_sql, _NAMES_OF))} FROM (
  SELECT line_id, regexp_extract(raw_line, '^{r"\t".join(f"({_CELL})" for _ in _NAMES_OF)}$', {_NAMES_OF}, 's') AS r FROM product_lines WHERE regexp_full_match(raw_line, '{r"\t".join(_TYPED)}', 's'))""")
def p1_loaded(t: Tables) -> DataFrame:
    return rejects.loaded(t.product_lines, keep=("line_id",))


_CAPTION = r"(?:^|\.\s+|[,;|/\n•·])\s*\p{L}[\p{L} ]*\s*:"
_VALUE = r'(?:"[^"]*"|\([^)]*\)|\[[^\]]*\]|[0-9](?:,[0-9])+|[^,;|/\n•·"])+'
_TRIM = "trim(x, E' \\t\\n\\r')"


@query(f"""WITH c AS (
  SELECT 'ingredients_text' AS field, CAST(row_id AS VARCHAR) AS rec_key, regexp_extract_all(regexp_replace(regexp_replace(ingredients_text, '\\.\\s*$', ''), '{_CAPTION}', '|', 'g'), '{_VALUE}') AS v FROM products_with_language1
  UNION ALL SELECT 'categories_tags', CAST(row_id AS VARCHAR), regexp_extract_all(categories_tags, '(?:"[^"]*"|[^",;|])+') FROM products_with_language1
  UNION ALL SELECT 'commonNames', termCode, regexp_extract_all(commonNames, '(?:"[^"]*"|[^"$;|])+') FROM foodex2_terms),
u AS (SELECT field, rec_key, list_filter(list_transform(v, lambda x: CASE WHEN regexp_full_match({_TRIM}, '"[^"]*"') THEN trim({_TRIM}, '"') ELSE {_TRIM} END), lambda x: trim(x) <> '') AS v FROM c)
SELECT field, rec_key, CAST(generate_subscripts(v, 1) AS INTEGER) AS pos, unnest(v) AS value FROM u""")
def p5_found(t: Tables) -> DataFrame:
    def part(df: DataFrame, column: str, key: str, style: packed.Style) -> DataFrame:
        return packed.split_cells(df, column, (key,), style).select(F.lit(column).alias("field"), C(key).cast("string").alias("rec_key"), "pos", "value")

    labels = part(t.products_with_language1, "ingredients_text", "row_id", packed.LABEL_TEXT)
    categories = part(t.products_with_language1, "categories_tags", "row_id", packed.TAGS)
    return labels.unionByName(categories).unionByName(part(t.foodex2_terms, "commonNames", "termCode", packed.NAMES))


@query(f"SELECT row_id, {D.key('ingredient')} AS k FROM products_ingredients")
def T1_lookup_key(t: Tables) -> DataFrame:
    return t.products_ingredients.select("row_id", T.lookup_key(C("ingredient")).alias("k"))


@query(f"SELECT row_id, {D.clean('ingredient')} AS k FROM products_ingredients")
def T2_clean_text(t: Tables) -> DataFrame:
    return t.products_ingredients.select("row_id", T.clean_text(C("ingredient")).alias("k"))


@query(f"SELECT doc_id, {D.printable('text')} AS k, {D.printable('text', 200)} AS k200 FROM documents")
def T3_printable_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.printable_text(C("text")).alias("k"), T.printable_text(C("text"), 200).alias("k200"))


_PARTS = f"(SELECT row_id, pos, {D.strip('p')} AS p FROM (SELECT row_id, unnest(string_split_regex(ingredients_text, '[,;|\\n]')) AS p, CAST(generate_subscripts(string_split_regex(ingredients_text, '[,;|\\n]'), 1) AS INTEGER) AS pos FROM products_with_language1))"


def _parts(t: Tables) -> DataFrame:
    return t.products_with_language1.select("row_id", F.posexplode(F.split("ingredients_text", r"[,;|\n]")).alias("pos", "p")).select("row_id", (C("pos") + 1).alias("pos"), T.strip(C("p")).alias("p"))


@query(f"SELECT row_id, pos, {D.clean_token('p')} AS k FROM {_PARTS}")
def T4_clean_token(t: Tables) -> DataFrame:
    return _parts(t).select("row_id", "pos", T.clean_token(C("p")).alias("k"))


@query(f"SELECT row_id, pos, {D.valid('p')} AS ok FROM {_PARTS}")
def T5_valid_ingredient(t: Tables) -> DataFrame:
    return _parts(t).select("row_id", "pos", T.valid_ingredient(C("p")).alias("ok"))


@query(f"SELECT row_id, pos, {D.valid('p', 8, False, True)} AS ok FROM {_PARTS}")
def T6_valid_ingredient_older(t: Tables) -> DataFrame:
    return _parts(t).select("row_id", "pos", T.valid_ingredient(C("p"), 8, False, True).alias("ok"))


@query(f"SELECT row_id, coalesce({D.additive('k')}, false) AS additive, coalesce({D.noise('k')}, false) AS noise, coalesce({D.context('k')}, false) AS context FROM (SELECT row_id, {D.key('ingredient')} AS k FROM products_ingredients)")
def T7_T8_T9_token_classes(t: Tables) -> DataFrame:
    k = t.products_ingredients.select("row_id", T.lookup_key(C("ingredient")).alias("k"))
    return k.select("row_id", T.is_additive(C("k")).alias("additive"), T.is_noise(C("k")).alias("noise"), T.is_context(C("k")).alias("context"))


@query(f"SELECT row_id, pos, {D.e_code('p')} AS k FROM {_PARTS}")
def T10_e_codes(t: Tables) -> DataFrame:
    return _parts(t).select("row_id", "pos", T.normalize_e_code(C("p")).alias("k"))


_TAXONOMY_LINES = "(SELECT row_number() OVER (ORDER BY termCode) AS line_no, (CASE WHEN termCode < 'A80000' THEN 'en:' ELSE 'fr:' END) || replace(termExtendedName, ', ', ' ') || coalesce(', ' || replace(replace(commonNames, ',', ' '), '$', ', '), '') AS value FROM foodex2_terms)"
_TAXONOMY = f"""(SELECT k AS key, arg_max(canonical, line_no * 1000 + i) AS canonical FROM (
    SELECT line_no, canonical, i, {D.key("n")} AS k FROM (
      SELECT line_no, lower(names[1]) AS canonical, unnest(names) AS n, generate_subscripts(names, 1) AS i FROM (
        SELECT line_no, list_transform(string_split(substr(value, 4), ','), lambda x: {D.strip("x")}) AS names FROM {_TAXONOMY_LINES} WHERE value LIKE 'en:%')
      WHERE names[1] <> '') WHERE n <> '') GROUP BY k)"""


def _taxonomy_lines(t: Tables) -> DataFrame:
    name = F.concat(
        F.when(C("termCode") < "A80000", "en:").otherwise("fr:"), F.replace("termExtendedName", F.lit(", "), F.lit(" ")),
        F.coalesce(F.concat(F.lit(", "), F.replace(F.replace("commonNames", F.lit(","), F.lit(" ")), F.lit("$"), F.lit(", "))), F.lit("")),
    )
    return t.foodex2_terms.select("termCode", name.alias("value")).withColumn("line_no", C("termCode"))


@query(f"SELECT key, canonical FROM {_TAXONOMY}")
def S5_T11_taxonomy(t: Tables) -> DataFrame:
    return tags.build_taxonomy(_taxonomy_lines(t))


@query(f"""WITH tax AS {_TAXONOMY}, r AS (SELECT row_id, ingredient, {D.key("ingredient")} AS k FROM products_ingredients)
SELECT row_id, coalesce(a.canonical, b.canonical, ingredient) AS named FROM r LEFT JOIN tax a ON a.key = r.k LEFT JOIN tax b ON b.key = {D.e_code("r.k")}""")
def T12_taxonomy_lookup(t: Tables) -> DataFrame:
    return tags.with_taxonomy(t.products_ingredients.select("row_id", "ingredient"), tags.build_taxonomy(_taxonomy_lines(t)), out="named").select("row_id", "named")


@query(f"""SELECT row_id, CASE WHEN {D.blank("ingredients_tags")} THEN false ELSE (
  SELECT count(*) FILTER (regexp_matches(regexp_replace(g, '^[a-z]{{2}}:', ''), '{T.UNIT_TOKEN}')) / greatest(count(*), 1) < 0.4 AND count(*) > 0
  FROM (SELECT {D.strip("x")} AS g FROM (SELECT unnest(string_split(ingredients_tags, ',')) AS x)) WHERE g <> '') END AS ok FROM products_with_language1""")
def T13_low_unit_share(t: Tables) -> DataFrame:
    return t.products_with_language1.select("row_id", T.low_unit_share(C("ingredients_tags")).alias("ok"))


_LABEL = r"(SELECT row_id, pos, regexp_replace(p, '\([^)]*\)', '', 'g') AS p FROM (SELECT row_id, unnest(string_split_regex(ingredients_text, '[,;\n]+')) AS p, CAST(generate_subscripts(string_split_regex(ingredients_text, '[,;\n]+'), 1) - 1 AS INTEGER) AS pos FROM products_with_language1))"


@query(f"""SELECT row_id, pos, token AS ingredient FROM (SELECT row_id, pos, token, {D.key("token")} AS k FROM {D.token_from(_LABEL, "p", "row_id, pos")})
WHERE token <> '' AND {D.valid("token")} AND NOT {D.noise("k")} AND NOT {D.context("k")}""")
def T14_label_tokens(t: Tables) -> DataFrame:
    return tags.label_tokens(t.products_with_language1)


_TAGS = f"(SELECT row_id, code, lang_product_name, product_name, pos, {D.strip('g')} AS original_tag FROM (SELECT *, unnest(string_split(ingredients_tags, ',')) AS g, CAST(generate_subscripts(string_split(ingredients_tags, ','), 1) - 1 AS INTEGER) AS pos FROM products_with_language1))"


@query(f"SELECT row_id, pos, token AS ingredient FROM {D.token_from(f'''(SELECT row_id, pos, substr(original_tag, 4) AS g FROM {_TAGS} WHERE original_tag LIKE 'en:%')''', 'g', 'row_id, pos')} WHERE token <> ''")
def T15_english_tags(t: Tables) -> DataFrame:
    return tags.english_tags(t.products_with_language1)


_BARE = f"(SELECT row_id, code, lang_product_name, product_name, pos, original_tag, lower(regexp_extract(original_tag, '(?i)^([a-z]{{2}}):', 1)) AS tag_lang, regexp_replace(original_tag, '(?i)^[a-z]{{2}}:', '') AS g FROM {_TAGS} WHERE original_tag <> '')"
_RICH = f"""(SELECT row_id, code, lang_product_name, product_name, pos, original_tag, tag_lang, token AS ingredient, {D.valid("token")} AS is_valid, {D.additive("k")} AS is_additive, {D.noise("k")} AS is_noise_phrase, {D.context("k")} AS is_context_term
  FROM (SELECT *, {D.key("token")} AS k FROM {D.token_from(_BARE, "g", "row_id, code, lang_product_name, product_name, pos, original_tag, tag_lang")}) WHERE token <> '')"""


@query(f"SELECT row_id, pos, original_tag, tag_lang, ingredient, is_valid, is_additive, is_noise_phrase, is_context_term FROM {_RICH}")
def T16_rich_tags(t: Tables) -> DataFrame:
    return tags.parse_tags(t.products_with_language1)


@query(f"""SELECT code, lang_product_name, product_name, {D.clean("product_name")} AS product_context, original_tag, tag_lang, ingredient, ingredient AS nlp_text, is_additive, is_noise_phrase, is_context_term,
  tag_lang = 'en' AND NOT is_noise_phrase AND NOT is_context_term AS matchable FROM {_RICH} WHERE is_valid""")
def T17_ingredient_rows(t: Tables) -> DataFrame:
    return tags.ingredient_rows(t.products_with_language1)


_OLD = f"(SELECT row_id, pos, {D.clean_token('t1')} AS token FROM (SELECT row_id, pos, {D.clean('g')} AS t1 FROM (SELECT row_id, pos, regexp_replace(original_tag, '^[a-z]{{2}}:', '') AS g FROM {_TAGS} WHERE original_tag <> '')))"


@query(f"SELECT row_id, pos, token AS ingredient FROM {_OLD} WHERE token <> '' AND {D.valid('token', 8, False, True)}")
def T18_legacy_tags(t: Tables) -> DataFrame:
    return tags.legacy_tags(t.products_with_language1)


@query(f"SELECT row_id, {D.tags_text('categories_tags')} AS a, {D.tags_text('food_groups_tags')} AS b FROM products_with_language1")
def T19_tags_to_text(t: Tables) -> DataFrame:
    return t.products_with_language1.select("row_id", T.tags_to_text(C("categories_tags")).alias("a"), T.tags_to_text(C("food_groups_tags")).alias("b"))


_RICH_TEXT = f"""(SELECT *, concat_ws(' ', {D.closed("n")}, {D.closed("CASE WHEN lower(g) <> lower(n) THEN g END")}, {D.closed("c")}, {D.closed("fg")}, {D.closed("i")}) AS nlp_text FROM (
  SELECT *, {D.printable("product_name")} AS n, {D.printable("generic_name")} AS g, {D.tags_text("categories_tags")} AS c, {D.tags_text("food_groups_tags")} AS fg, {D.printable("ingredients_text", 500)} AS i FROM products_with_language1))"""


def _rich(t: Tables) -> DataFrame:
    text = T.product_text(C("product_name"), C("generic_name"), C("categories_tags"), C("food_groups_tags"), C("ingredients_text"))
    return t.products_with_language1.withColumn("nlp_text", text)


@query(f"SELECT row_id, nlp_text FROM {_RICH_TEXT}")
def T20_product_text(t: Tables) -> DataFrame:
    return _rich(t).select("row_id", "nlp_text")


@query(f"""SELECT code, lang_product_name, lang_ingredients_text, n AS product_name_clean, g AS generic_name_clean, c AS categories_clean, fg AS food_groups_clean, i AS ingredients_text_clean, nlp_text,
  CAST(len({D.words("nlp_text")}) AS INTEGER) AS nlp_word_count, CAST(round_even(len({D.words("nlp_text")}) * 1.3, 0) AS INTEGER) AS approx_tokens, "nutrition-score-fr_100g", created_datetime FROM {_RICH_TEXT}""")
def T26_products_nlp(t: Tables) -> DataFrame:
    p = _rich(t)
    return p.select(
        "code", "lang_product_name", "lang_ingredients_text", T.printable_text(C("product_name")).alias("product_name_clean"), T.printable_text(C("generic_name")).alias("generic_name_clean"),
        T.tags_to_text(C("categories_tags")).alias("categories_clean"), T.tags_to_text(C("food_groups_tags")).alias("food_groups_clean"), T.printable_text(C("ingredients_text"), 500).alias("ingredients_text_clean"),
        "nlp_text", T.word_count(C("nlp_text")).alias("nlp_word_count"), T.approx_tokens(C("nlp_text")).alias("approx_tokens"), "`nutrition-score-fr_100g`", "created_datetime",
    )


@query(f"SELECT termCode, concat_ws('. ', CASE WHEN NOT {D.blank('termExtendedName')} THEN {D.strip('termExtendedName')} END, CASE WHEN NOT {D.blank('commonNames')} THEN {D.strip('commonNames')} END, CASE WHEN NOT {D.blank('scientificNames')} THEN {D.strip('scientificNames')} END) AS txt FROM foodex2_terms")
def T21_term_text(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", T.term_text(C("termExtendedName"), C("commonNames"), C("scientificNames")).alias("txt"))


_NOTE = f"coalesce({D.strip(D.collapse("split_part(termScopeNote, '£', 1)"))}, '')"
_NAMES = f"list_filter(list_transform(string_split(coalesce(commonNames, ''), '$'), lambda x: {D.strip('x')}), lambda x: x <> '')"


@query(f"""SELECT termCode, concat_ws(' ', {D.closed(D.strip("termExtendedName"))}, {D.closed(D.strip("termShortName"))}, nullif(array_to_string(list_transform({_NAMES}, lambda x: regexp_replace(x, '\\.+$', '') || '.'), ' '), ''),
  {D.closed(D.strip("scientificNames"))}, {D.closed(_NOTE)}) AS txt FROM foodex2_terms""")
def T22_term_full_text(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", T.term_full_text(C("termExtendedName"), C("termShortName"), C("commonNames"), C("scientificNames"), C("termScopeNote")).alias("txt"))


@query("SELECT a.termCode, coalesce(b.nlp_text, a.termExtendedName) AS txt FROM foodex2_terms a LEFT JOIN (SELECT termCode, nlp_text FROM foodex2_terms WHERE status = 'APPROVED') b ON a.termCode = b.termCode")
def T23_text_fallback(t: Tables) -> DataFrame:
    b = t.foodex2_terms.where("status = 'APPROVED'").select("termCode", "nlp_text")
    return t.foodex2_terms.select("termCode", "termExtendedName").join(b, "termCode", "left").select("termCode", F.coalesce("nlp_text", "termExtendedName").alias("txt"))


@query(f"SELECT termCode, {_NOTE} AS note FROM foodex2_terms")
def T24_scope_note(t: Tables) -> DataFrame:
    return t.foodex2_terms.select("termCode", T.scope_note(C("termScopeNote")).alias("note"))


@query(f"SELECT termCode, array_to_string({_NAMES}, '|') AS names, CAST(len({_NAMES}) AS INTEGER) AS n FROM foodex2_terms")
def T25_name_list(t: Tables) -> DataFrame:
    names = T.name_list(C("commonNames"))
    return t.foodex2_terms.select("termCode", F.array_join(names, "|").alias("names"), F.size(names).alias("n"))


@query(f"SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(length(text) > 1500, false) AS long_text, coalesce(round_even(len({D.words('text')}) * 1.3, 0) > 512, false) AS many_tokens FROM documents")
def T27_budget_flags(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.length("text") > 1500, F.lit(False)).alias("long_text"), F.coalesce(T.approx_tokens(C("text")) > 512, F.lit(False)).alias("many_tokens")
    )


@query(f"SELECT row_id, CAST(CASE WHEN {D.blank('labels_tags')} THEN 0 ELSE len(string_split(labels_tags, ',')) END AS INTEGER) AS n FROM products_with_language1")
def T28_tag_count(t: Tables) -> DataFrame:
    return t.products_with_language1.select("row_id", T.tag_count(C("labels_tags")).alias("n"))


@query(f"SELECT regexp_extract(original_tag, '^([a-z]{{2}}):', 1) AS lang, count(*) AS n FROM {_TAGS} WHERE original_tag <> '' GROUP BY 1")
def T29_tag_languages(t: Tables) -> DataFrame:
    return tags.tag_languages(t.products_with_language1)


@query(f"SELECT row_id, length(ingredient) < 3 OR len({D.words('ingredient')}) > 10 OR length(regexp_replace(ingredient, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(ingredient), 1) > 0.3 OR length(ingredient) - length(replace(ingredient, ' ', '')) > 8 AS noisy FROM products_ingredients")
def T31_noisy(t: Tables) -> DataFrame:
    return t.products_ingredients.select("row_id", T.noisy(C("ingredient")).alias("noisy"))


@query(f"SELECT row_id, lower({D.clean('ingredient')}) AS k FROM products_ingredients")
def T32_cache_key(t: Tables) -> DataFrame:
    return t.products_ingredients.select("row_id", T.cache_key(C("ingredient")).alias("k"))


@query("SELECT row_id, CASE WHEN i > 0 AND length(brand) > 0 THEN substr(s, 1, i - 1) || '<mark>' || substr(s, i, length(brand)) || '</mark>' || substr(s, i + length(brand)) ELSE s END AS k FROM (SELECT row_id, ingredients_text AS s, 'OIL' AS brand, instr(lower(ingredients_text), 'oil') AS i FROM products_with_language1)")
def T33_highlight(t: Tables) -> DataFrame:
    return t.products_with_language1.select("row_id", T.highlight(C("ingredients_text"), F.lit("OIL")).alias("k"))


@query("SELECT code, product_name, ingredients_tags, categories_tags FROM products_with_language1 WHERE lang_ingredients_text = 'en' AND ingredients_tags IS NOT NULL AND food_groups_tags IS NOT NULL AND NOT regexp_matches(coalesce(categories_tags, ''), '" + "|".join(tags.NON_FOOD) + "')")
def R1_food_products(t: Tables) -> DataFrame:
    return tags.food_products(t.products_with_language1).select("code", "product_name", "ingredients_tags", "categories_tags")
