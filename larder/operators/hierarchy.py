"""Term hierarchies with dotted paths, and facets. Parents and ancestors are equi-joins on path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of the facet categories.
FACET_LABELS = {
    "F01": "source", "F02": "part-nature", "F03": "process", "F04": "packaging", "F05": "cooking", "F06": "production", "F07": "target-consumer", "F08": "qualification",
    "F09": "component", "F10": "contact-material", "F11": "additive", "F12": "pesticide", "F13": "veterinary-drug", "F14": "flavouring", "F15": "fortification",
    "F16": "genetically-modified", "F17": "allergen", "F18": "contaminant", "F19": "brand", "F20": "physical-state", "F21": "colour", "F22": "shape", "F23": "fat-content",
    "F24": "caffeine-content", "F25": "species", "F26": "maturity", "F27": "geographical-origin", "F28": "use", "F29": "storage", "F30": "organic",
    "F31": "vitamin-mineral-enrichment", "F32": "labelling", "F33": "flavour", "F34": "ingredient",
}
FACET = r"(F\d{2})\.([A-Z0-9]{4,6})"


def depth(path: Column) -> Column:
    """H1: segments of a dotted path; null stays null."""
    return F.when(path.isNotNull(), F.size(F.split(path, r"\.")))


def prefix(path: Column, n: int) -> Column:
    return F.substring_index(path, ".", n)


def in_scope(terms: DataFrame, root: str = "Z0001", path: str = "reportHierarchyCode") -> DataFrame:
    """H2: terms whose path begins with the root."""
    return terms.where(F.col(path).startswith(root))


def bucket(level: Column) -> Column:
    """H3: level_2, level_3, level_specific from 4 on, null above."""
    return F.when(level == 2, "level_2").when(level == 3, "level_3").when(level >= 4, "level_specific")


def index(terms: DataFrame, root: str = "Z0001") -> DataFrame:
    """H2, H3: term, name, path, level, bucket of the terms in scope."""
    t = in_scope(terms, root).select(F.col("termCode").alias("term"), F.col("termExtendedName").alias("name"), F.col("reportHierarchyCode").alias("path"), F.col("reportHierarchyLevel").alias("level"))
    return t.withColumn("bucket", bucket(F.col("level")))


def _by_path(ix: DataFrame, level: int, prefix_name: str) -> DataFrame:
    """Terms of a level by path; of equal paths the last term code stands."""
    t = ix.where(F.col("level") == level).groupBy("path").agg(F.max(F.struct("term", "name")).alias("t"))
    return t.select(F.col("path").alias(f"{prefix_name}_path"), F.col("t.term").alias(f"{prefix_name}_code"), F.col("t.name").alias(f"{prefix_name}_name"))


def parents(ix: DataFrame) -> DataFrame:
    """H4: child, parent. Level 3 belongs to the term two segments deep, all deeper levels to the one three segments
    deep; children whose parent isn't there are left out."""
    child = ix.where("level >= 3").select(F.col("term").alias("child"), F.when(F.col("level") == 3, prefix(F.col("path"), 2)).otherwise(prefix(F.col("path"), 3)).alias("up"), (F.col("level") == 3).alias("three"))
    l2, l3 = _by_path(ix, 2, "p"), _by_path(ix, 3, "p")
    up = l2.select("p_path", "p_code", F.lit(True).alias("three")).unionByName(l3.select("p_path", "p_code", F.lit(False).alias("three")))
    return child.join(up.withColumnRenamed("p_path", "up"), ["up", "three"]).select("child", F.col("p_code").alias("parent"))


def children(ix: DataFrame) -> DataFrame:
    """H5: parent and its children, in order of their codes."""
    return parents(ix).groupBy("parent").agg(F.sort_array(F.collect_list("child")).alias("children"))


def resolve(ix: DataFrame) -> DataFrame:
    """H6: term, level2_code, level2_name, level3_code, level3_name, specific_code, specific_name, final_level of every term from level 2 on."""
    t = ix.where("level >= 2").withColumn("up2", prefix(F.col("path"), 2)).withColumn("up3", prefix(F.col("path"), 3))
    t = t.join(_by_path(ix, 2, "l2").withColumnRenamed("l2_path", "up2"), "up2", "left").join(_by_path(ix, 3, "l3").withColumnRenamed("l3_path", "up3"), "up3", "left")
    own2, own3, deep = F.col("level") == 2, F.col("level") == 3, F.col("level") >= 4
    return t.select(
        "term", F.when(own2, F.col("term")).otherwise(F.col("l2_code")).alias("level2_code"), F.when(own2, F.col("name")).otherwise(F.col("l2_name")).alias("level2_name"),
        F.when(own3, F.col("term")).when(deep, F.col("l3_code")).alias("level3_code"), F.when(own3, F.col("name")).when(deep, F.col("l3_name")).alias("level3_name"),
        F.when(deep, F.col("term")).alias("specific_code"), F.when(deep, F.col("name")).alias("specific_name"), F.col("level").alias("final_level"),
    )


def ancestors(ix: DataFrame) -> DataFrame:
    """H7: term, level, ancestor: every prefix of a term's path that is a term, itself included."""
    up = ix.select("term", F.explode(F.expr("transform(sequence(1, size(split(path, '[.]'))), i -> substring_index(path, '.', i))")).alias("up"))
    return up.join(ix.select(F.col("path").alias("up"), F.col("term").alias("ancestor"), "level"), "up").select("term", "level", "ancestor")


def direct_children(ix: DataFrame) -> DataFrame:
    """H8: parent, child: terms one segment below another, by an equi-join on the path without its last segment."""
    down = ix.where(F.col("path").contains(".")).select(F.col("term").alias("child"), F.regexp_replace("path", r"\.[^.]*$", "").alias("up"), depth(F.col("path")).alias("n"), "level")
    return down.where("n = level").join(ix.select(F.col("path").alias("up"), F.col("term").alias("parent"), F.col("level").alias("pl")), "up").where("level = pl + 1").select("parent", "child")


def facets(df: DataFrame, column: str, key: str, names: DataFrame) -> DataFrame:
    """H9: key, pos (int, from 0), facet_cat, facet_label, code, name of every facet anywhere in the text; names: code, name, joined left."""
    both = F.arrays_zip(F.regexp_extract_all(column, F.lit(FACET), F.lit(1)).alias("a"), F.regexp_extract_all(column, F.lit(FACET), F.lit(2)).alias("b"))
    label = F.create_map(*(F.lit(x) for kv in FACET_LABELS.items() for x in kv))
    out = df.select(key, F.posexplode(both).alias("pos", "f")).select(key, "pos", F.col("f.a").alias("facet_cat"), F.col("f.b").alias("code"))
    out = out.withColumn("facet_label", F.coalesce(F.try_element_at(label, F.col("facet_cat")), F.col("facet_cat")))
    return out.join(names.select("code", "name"), "code", "left").select(key, "pos", "facet_cat", "facet_label", "code", "name")


def resolved_facets(resolved: Column, raw: Column) -> Column:
    """Facets of the JSON array; where it is null, broken or empty, those of the raw text behind its first `#`
    that are facets as a whole. An array of struct<cat, code>."""
    listed = F.from_json(resolved, "array<string>")
    behind = F.when(raw.contains("#"), F.split(F.regexp_replace(raw, "(?s)^[^#]*#", ""), r"\$"))
    chosen = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(behind)
    sound = F.filter(F.coalesce(chosen, F.array().cast("array<string>")), lambda x: x.rlike(f"^{FACET}$"))
    return F.transform(sound, lambda x: F.struct(F.substring_index(x, ".", 1).alias("cat"), F.substring_index(x, ".", -1).alias("code")))


def facet_counts(df: DataFrame, column: str = "allFacets") -> DataFrame:
    """facet_cat, n over the part behind `#`."""
    part = df.where(F.col(column).contains("#")).select(F.explode(F.split(F.get(F.split(column, "#"), F.lit(1)), r"\$")).alias("f"))
    return part.select(F.substring_index("f", ".", 1).alias("facet_cat")).groupBy("facet_cat").agg(F.count(F.lit(1)).alias("n"))


def names_by_code(df: DataFrame, code: str, name: str, order: str) -> DataFrame:
    """The first name of each code in the given order; null codes and names are dropped."""
    w = Window.partitionBy(code).orderBy(order)
    return df.where(F.col(code).isNotNull() & F.col(name).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").select(F.col(code).alias("code"), F.col(name).alias("name"))


def without_feed(df: DataFrame, name: str = "termExtendedName") -> DataFrame:
    """Rows whose name doesn't say `(feed)`; a null name stays."""
    return df.where(~F.coalesce(F.col(name).rlike(r"(?i)\(feed\)"), F.lit(False)))
