"""Duplicates hidden by formatting: one record each, with its number of copies.

The canonical bytes of a record are its code and its words, lower-cased and sorted. Copies are summed by them before
anything else, so the records that get buckets are all different, however many copies one has. Buckets are byte
prefixes: a bucket with too many records is split behind the prefix that its records share, by more and more bytes,
until each fits, and the copies of each bucket are counted in a trie with counters at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import materialise

#: Records of a bucket, and characters by which the first prefixes exceed what all records share; each round doubles them.
FITS, STEP = 200_000, 2


def canonical(code: Column, text: Column) -> Column:
    """Code and sorted words (runs of letters and digits, lower case); null if either is null. A text without words has only its code."""
    words = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    return F.when(code.isNotNull() & text.isNotNull(), F.concat(code, F.lit("\x1f"), F.array_join(words, " ")))


def _trie():
    import ahocorasick

    return ahocorasick.Automaton(ahocorasick.STORE_ANY)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(canon, copies, keep) of each record; a new trie for each bucket."""
    trie, held = _trie(), None

    def flush():
        rows = list(trie.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64())], names=["canon", "copies", "keep"]
        )

    for b in batches:
        for c, n, keep, bucket in zip(*(b.column(i).to_pylist() for i in range(4))):
            if bucket != held:
                if len(trie):
                    yield flush()
                trie, held = _trie(), bucket
            end = trie.get(c, None)
            if end is None:
                trie.add_word(c, [n, keep])
            else:
                end[0] += n
                end[1] = min(end[1], keep)
    if len(trie):
        yield flush()


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    unlike = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(unlike, F.lit(True)), F.lit(0)) - 1, F.length(a).cast("long")).cast("int")


def _buckets(keys: DataFrame, fits: int) -> DataFrame:
    """keys (all different) with `bucket`, a prefix that not more than `fits` of them share. If all fit into one bucket,
    the first prefixes spread them over the tasks. The rounds grow with the logarithm of the longest key at most."""
    ends = keys.agg(F.min("canon").alias("a"), F.max("canon").alias("b"), F.count(F.lit(1)).alias("all")).select("all", _common(F.col("a"), F.col("b")).alias("same")).head()
    if not ends["all"]:
        return keys.withColumn("bucket", F.lit(""))
    if ends["all"] <= fits:
        return keys.withColumn("bucket", F.substring("canon", 1, ends["same"] + 2 * STEP))
    step, labelled = STEP, keys.withColumn("bucket", F.substring("canon", 1, ends["same"] + STEP))
    while True:
        # Buckets that are too full: fewer than records / fits, so their list has that bound.
        full = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("a"), F.max("canon").alias("b")).where(F.col("n") > fits)
        full = materialise(full.select("bucket", (_common(F.col("a"), F.col("b")) + 2 * step).alias("size")))
        if full.isEmpty():
            return labelled
        step *= 2
        split = labelled.join(full, "bucket", "left")
        labelled = split.select(*keys.columns, F.coalesce(F.substring("canon", F.lit(1), F.col("size")), F.col("bucket")).alias("bucket"))


_COUNTED = "canon string, copies long, keep long"


def count_copies(df: DataFrame, code: str = "code", text: str = "ingredient", key: str = "row_id", fits: int = FITS) -> DataFrame:
    """canon, copies (long), keep (the smallest `key`): one row for each different record.

    Records are copies if they have the same code and the same words, each as often, whatever the letter case, white
    space, punctuation and order. Rows with a null code, text or key are no records. However many copies a record has,
    a task sends one row for it, and it takes one place in its bucket.
    """
    rows = df.select(canonical(F.col(code), F.col(text)).alias("canon"), F.lit(1).cast("long").alias("copies"), F.col(key).cast("long").alias("keep")).where("canon is not null and keep is not null")
    keys = materialise(rows.groupBy("canon").agg(F.sum("copies").alias("copies"), F.min("keep").alias("keep")))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _buckets(keys, fits).repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, _COUNTED)


def copies(df: DataFrame, code: str = "code", text: str = "ingredient", key: str = "row_id", fits: int = FITS) -> DataFrame:
    """keep_<key>, copy_<key>: each copy but the one with the smallest key, which is kept."""
    groups = count_copies(df, code, text, key, fits).where("copies > 1").select("canon", "keep")
    rows = df.select(F.col(key).cast("long").alias("copy"), canonical(F.col(code), F.col(text)).alias("canon"))
    return rows.join(groups, "canon").where("copy <> keep").select(F.col("keep").alias(f"keep_{key}"), F.col("copy").alias(f"copy_{key}"))
