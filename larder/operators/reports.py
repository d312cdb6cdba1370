"""Relational reports: profiles, distributions, samples, comparisons. Each is a DataFrame; column lists come from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def rows() -> Column:
    return F.count(F.lit(1))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def filled(c: str) -> Column:
    """Neither null nor blank after a cast to text."""
    return F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "")


def share(df: DataFrame, keys: tuple[str, ...], digits: int = 2, **aggs: Column) -> DataFrame:
    """Keys (null is a group), n, pct of all rows, and further aggregates. The total is a window over the few groups."""
    g = df.groupBy(*keys).agg(rows().alias("n"), *(a.alias(k) for k, a in aggs.items()))
    return g.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy()), digits))


def column_stats(df: DataFrame, c: str) -> DataFrame:
    """One row: counts, share of values, extremes, mean, median, deviation and exact percentiles."""
    x = F.col(c)
    at = {"p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    return df.agg(
        rows().alias("total_rows"), F.count(x).alias("non_null"), (rows() - F.count(x)).alias("null_count"), pct(F.count(x), rows()).alias("pct_non_null"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("median"), F.round(F.stddev_samp(x), 6).alias("std"), *(F.round(F.percentile(x, p), 6).alias(k) for k, p in at.items()),
    )


def describe(df: DataFrame, columns: tuple[str, ...], by: str | None = None) -> DataFrame:
    """[by,] column, count, mean, std, min, quartiles, max; long form by one unpivot."""
    keys = [by] if by else []
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, list(columns), "column", "x")
    return long.groupBy(*keys, "column").agg(
        F.count("x").alias("count"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"),
        *(F.round(F.percentile("x", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)), F.max("x").alias("max"),
    )


def fill_by_bucket(df: DataFrame, c: str, columns: tuple[str, ...]) -> DataFrame:
    """Bucket (floor(10 c) / 10), n, and the share of non-null values of each column."""
    return df.where(F.col(c).isNotNull()).groupBy((F.floor(F.col(c) * 10) / 10).alias("bucket")).agg(rows().alias("n"), *(pct(F.count(f"`{x}`"), rows()).alias(x) for x in columns))


def fill_correlation(df: DataFrame, c: str, columns: tuple[str, ...]) -> DataFrame:
    """Pearson correlation of c with the share of filled columns of its row, both means, and a verdict (0.7, 0.5)."""
    rate = sum((F.when(filled(x), 1.0).otherwise(0.0) for x in columns), F.lit(0.0)) / len(columns)
    r = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), rate.alias("y")).agg(F.round(F.corr("x", "y"), 6).alias("pearson_r"), F.round(F.avg("x"), 6).alias("mean_value"), F.round(F.avg("y"), 6).alias("mean_fill_rate"))
    return r.withColumn("verdict", F.when(F.col("pearson_r").isNull(), "unknown").when(F.col("pearson_r") >= 0.7, "strong").when(F.col("pearson_r") >= 0.5, "moderate").otherwise("weak"))


def null_profile(df: DataFrame) -> DataFrame:
    """Column, non_null, n_null, pct; one pass of counts, then turned round."""
    names = df.columns
    counts = df.agg(rows().alias("__n"), *(F.count(f"`{c}`").alias(c) for c in names)).unpivot(["__n"], names, "column", "non_null")
    return counts.select("column", "non_null", (F.col("__n") - F.col("non_null")).alias("n_null"), pct(F.col("non_null"), F.col("__n")).alias("pct"))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by a total order, without a full sort."""
    return df.orderBy(*order).limit(n)


def group_sample(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """N rows of each group in the order of a hash of the key, so it repeats."""
    w = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), F.col(key))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def probe(df: DataFrame, key: str, probes: list[str], *columns: str) -> DataFrame:
    """One row for each hit of a probe, and one with found = false for a probe without."""
    p = df.sparkSession.createDataFrame([(x,) for x in probes], "probe string")
    hit = df.select(F.col(key).alias("probe"), *columns, F.lit(True).alias("found"))
    return p.join(hit, "probe", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def duplicates(df: DataFrame, by: str) -> DataFrame:
    """Rows whose value of `by` comes more than once, with dup_count. Counts are joined back, so no group is gathered."""
    d = df.where(F.col(by).isNotNull()).groupBy(by).agg(rows().alias("dup_count")).where("dup_count > 1")
    return df.join(d, by)


def keyword_counts(df: DataFrame, c: str, keywords: tuple[str, ...]) -> DataFrame:
    """Keyword, n of the rows that contain it, whatever the case; one pass, a counter for each keyword."""
    low = F.lower(c)
    one = df.agg(*(F.count_if(low.contains(k.lower())).alias(k) for k in keywords))
    return one.unpivot([], list(keywords), "keyword", "n")


def keyword_rows(df: DataFrame, c: str, keywords: tuple[str, ...], n: int | None, order: list[Column], *columns: str) -> DataFrame:
    """Up to n rows for each keyword, None gives all."""
    low = F.lower(c)
    hit = df.select(*columns, c, F.explode(F.filter(F.array(*(F.when(low.contains(k.lower()), F.lit(k)) for k in keywords)), lambda x: x.isNotNull())).alias("keyword"))
    return hit if n is None else hit.withColumn("__r", F.row_number().over(Window.partitionBy("keyword").orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def value_counts(df: DataFrame, c: str, n: int, separator: str = ",") -> DataFrame:
    """Value, n of the n commonest separated values, trimmed and in lower case; ties by value."""
    v = df.select(F.explode(F.split(c, separator)).alias("v")).select(F.lower(F.trim("v")).alias("value")).where("value <> ''")
    return v.groupBy("value").agg(rows().alias("n")).orderBy(F.desc("n"), "value").limit(n)


def tag_stats(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Column, coverage, avg_tags, max_tags over filled cells."""
    size = lambda c: F.when(filled(c), F.size(F.split(F.col(f"`{c}`"), ",")))
    long = df.select(*(size(c).alias(c) for c in columns)).unpivot([], list(columns), "column", "k")
    return long.groupBy("column").agg(pct(F.count("k"), rows()).alias("coverage"), F.round(F.avg("k"), 2).alias("avg_tags"), F.max("k").cast("long").alias("max_tags"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """N where both are filled, same, pct."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(rows().alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same")).withColumn("pct", pct(F.col("same"), F.col("n")))


def contingency(df: DataFrame, a: str, b: str, classes: tuple[str, ...], percent: bool = False) -> DataFrame:
    """A, and the count (or the share of the row) of each class of b, 0 where none."""
    t = df.groupBy(a).pivot(b, list(classes)).count()
    t = t.select(a, *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in classes))
    if percent:
        total = sum((F.col(f"`{c}`") for c in classes), F.lit(0))
        t = t.select(a, *(pct(F.col(f"`{c}`"), total).alias(c) for c in classes))
    return t


def compare_runs(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """By, count and share in two runs side by side, 0 where a run has none."""
    runs = share(a, (by,)).withColumn("run", F.lit("a")).unionByName(share(b, (by,)).withColumn("run", F.lit("b")))
    one = lambda r, c: F.coalesce(F.max(F.when(F.col("run") == r, F.col(c))), F.lit(0))
    return runs.groupBy(by).agg(*(one(r, c).alias(f"{c}_{r}") for r in "ab" for c in ("n", "pct")))


def class_rank(c: Column, classes: tuple[str, ...]) -> Column:
    """Position of a class, the best first; classes that aren't listed come last."""
    out = F.lit(len(classes))
    for i, x in reversed(list(enumerate(classes))):
        out = F.when(c == x, i).otherwise(out)
    return out


def best_class(df: DataFrame, key: str, c: str, classes: tuple[str, ...]) -> DataFrame:
    """The best class of each key."""
    return df.groupBy(key).agg(F.min_by(c, class_rank(F.col(c), classes)).alias(c))


def all_satisfy(df: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Keys all of whose rows satisfy the predicate; null counts as not."""
    return df.groupBy(key).agg(F.bool_and(F.coalesce(predicate, F.lit(False))).alias("ok")).where("ok").select(key)


def cumulative(df: DataFrame, by: str, classes: tuple[str, ...]) -> DataFrame:
    """By, n, pct, cum_pct in the order of the classes. The window runs over as many rows as there are classes."""
    s = share(df, (by,), digits=6).where(F.col(by).isin(*classes)).withColumn("rank", class_rank(F.col(by), classes))
    return s.withColumn("cum_pct", F.round(F.sum("pct").over(Window.partitionBy().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)), 4)).withColumn("pct", F.round("pct", 4))


def allocation(df: DataFrame, by: str, total: int, floor: int) -> DataFrame:
    """Rows that a stratified sample takes from each class: its share of `total`, rounded half to even, at least `floor`, the overage taken from the largest class."""
    a = df.where(F.col(by).isNotNull()).groupBy(by).agg(rows().alias("n")).withColumn("want", F.greatest(F.bround(F.col("n") * F.lit(float(total)) / F.sum("n").over(Window.partitionBy()), 0).cast("long"), F.lit(floor)))
    big = F.row_number().over(Window.partitionBy().orderBy(F.desc("want"), by)) == 1
    over = F.sum("want").over(Window.partitionBy()) - total
    return a.select(by, "n", F.least(F.col("n"), F.when(big & (over > 0), F.col("want") - over).otherwise(F.col("want"))).alias("want"))


def stratified(df: DataFrame, by: str, key: str, total: int, floor: int, blanks: tuple[str, ...] = ()) -> DataFrame:
    """The sample, by a hash of the key, with empty columns for a reviewer."""
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), F.col(key))))
    r = r.where(F.col("__r") <= max(total, floor))  # a constant lets each task drop rows before the shuffle
    got = r.join(allocation(df, by, total, floor).select(by, "want"), by).where("__r <= want").drop("__r", "want")
    return got.select("*", *(F.lit("").alias(b) for b in blanks))


def accuracy(df: DataFrame, by: str, verdict: str) -> DataFrame:
    """By, correct, total, incorrect, accuracy over verdicts Y and rows(), whatever the case and white space; others are dropped."""
    v = df.withColumn("__v", F.upper(F.trim(F.col(verdict)))).where(F.col("__v").isin("Y", "N"))
    a = v.groupBy(by).agg(F.count_if(F.col("__v") == "Y").alias("correct"), rows().alias("total"))
    return a.withColumn("incorrect", F.col("total") - F.col("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def weighted_accuracy(df: DataFrame, labelled: DataFrame, by: str, verdict: str) -> DataFrame:
    """Accuracy of classes, weighted by their share of df."""
    w = df.groupBy(by).agg(rows().alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return w.join(accuracy(labelled, by, verdict), by).agg(F.round(F.sum(F.col("p") * F.col("correct") / F.col("total")), 6).alias("weighted_accuracy"))


def top_groups(df: DataFrame, keys: tuple[str, ...], n: int, nulls: bool) -> DataFrame:
    """The n largest groups; with nulls a null key is a group, else its rows are dropped. Ties by the keys."""
    d = df if nulls else df.dropna(subset=list(keys))
    return d.groupBy(*keys).agg(rows().alias("n")).orderBy(F.desc("n"), *(F.asc_nulls_first(k) for k in keys)).limit(n)


def threshold_sweep(df: DataFrame, score: str, by: str, classes: tuple[str, ...], steps: list[float]) -> DataFrame:
    """Threshold, n, pct, and the count of each class at or above it. Rows are first counted by the number of steps
    that they reach, so no row meets each threshold."""
    reach = sum((F.when(F.col(score) >= s, 1).otherwise(0) for s in steps), F.lit(0))
    small = df.groupBy(reach.alias("reach"), by).agg(rows().alias("k"))
    cols = [F.sum(F.when(F.col("reach") > i, F.col("k")).otherwise(0)).alias(f"a{i}") for i in range(len(steps))]
    cols += [F.sum(F.when((F.col("reach") > i) & (F.col(by) == c), F.col("k")).otherwise(0)).alias(f"a{i}_{c}") for i in range(len(steps)) for c in classes]
    one = small.agg(F.sum("k").alias("all"), *cols)
    table = F.array(*(F.struct(F.lit(s).alias("threshold"), F.col(f"a{i}").alias("n"), *(F.col(f"a{i}_{c}").alias(c) for c in classes)) for i, s in enumerate(steps)))
    return one.select("all", F.explode(table).alias("r")).select("r.*", pct(F.col("r.n"), F.col("all")).alias("pct"))


def gaps(df: DataFrame, *scores: str) -> DataFrame:
    """Df with gap_1_2, gap_2_3, ...; null counts as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.select("*", *(F.round(z(a) - z(b), 6).alias(f"gap_{i}_{i + 1}") for i, (a, b) in enumerate(zip(scores, scores[1:]), 1)))


def histogram(df: DataFrame, c: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Bin (1 to bins), n; the upper edge belongs to the last bin, values outside to none."""
    b = F.least(F.width_bucket(F.col(c), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.where((F.col(c) >= lo) & (F.col(c) <= hi)).groupBy(b.alias("bin")).agg(rows().alias("n"))


def binned(df: DataFrame, c: str, edges: list[float], y: str, high: Column) -> DataFrame:
    """Right-closed bins (edges[i], edges[i+1]]: bin, n, mean, std of y, and the share of `high`."""
    b = F.lit(None).cast(StringType())
    for lo, hi in zip(edges, edges[1:]):
        b = F.when((F.col(c) > lo) & (F.col(c) <= hi), F.lit(f"({lo:g}, {hi:g}]")).otherwise(b)
    return df.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(rows().alias("n"), F.round(F.avg(y), 6).alias("mean"), F.round(F.stddev_samp(y), 6).alias("std"), pct(F.count_if(high), rows()).alias("pct_high"))


def update_from(target: DataFrame, updates: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """A keyed bulk update: matched rows take the update's values, null ones too. Keys of updates are unique."""
    u = updates.select(F.col(key), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    j = target.join(u, key, "left")
    return j.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(f"`{c}`") for c in target.columns))
