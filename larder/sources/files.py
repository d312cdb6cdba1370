"""Readers, writers and table operations. Excel files are read by a library that isn't here; export them to CSV or Parquet."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators import rejects
from larder.session import materialise


def read_delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text values of tab-separated files with a header, projected to `columns`; rows of another width or with broken quotes are skipped.

    Files are split over tasks and parsed line by line with the patterns of operators.rejects. Only if a scan finds a
    line that ends inside quotes are records taken to span lines; then each file is read by one task.
    """
    names = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"').columns
    lines = spark.read.text(path)
    if not lines.where(rejects.quote_left_open(F.col("value"))).isEmpty():
        schema = ", ".join(f"`{c}` string" for c in names)
        return spark.read.schema(schema).csv(path, sep="\t", header=True, mode="DROPMALFORMED", quote='"', escape='"', multiLine=True).select(*(f"`{c}`" for c in columns))
    fields = tuple(rejects.Field(c) for c in names)
    rows = rejects.loaded(lines, "value", fields)
    header = reduce(and_, (F.col(f"`{c}`").eqNullSafe(c) for c in names))
    return rows.where(~header).select(*(f"`{c}`" for c in columns))


def load_lines(spark: SparkSession, path: str, schema: tuple[rejects.Field, ...] = rejects.PRODUCT_LINE) -> tuple[DataFrame, DataFrame]:
    """p1 for raw files of one record a line, without a header: rows that load, and raw_line, batch_file, reason and bad_field of the others. Files are split over tasks."""
    lines = spark.read.text(path).select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("batch_file"))
    return rejects.loaded(lines, schema=schema), rejects.rejected(lines, schema=schema)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV file with inferred types, optionally projected."""
    df = spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, path: str, start: str = "") -> DataFrame:
    """Lines of text files that begin with `start`, with an ascending line_no inside each file."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).where(F.col("value").startswith(start))


def write_delimited(df: DataFrame, path: str, separator: str = "\t") -> None:
    """A delimited file with a header; quotes inside values are doubled."""
    df.write.mode("overwrite").csv(path, sep=separator, header=True, quote='"', escape='"')


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of Parquet files for each table of a report."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_text_report(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of text for each table of a report: tab-separated lines behind a line of column names, null as an empty field."""
    for name, df in tables.items():
        write_delimited(df.select(*(F.col(f"`{c}`").cast("string") for c in df.columns)), f"{path}/{name}")


def write_vectors(df: DataFrame, key: str, v: str, path: str) -> DataFrame:
    """NPY files of the vectors, one for each task, in a folder that all executors share; file and row of each key.

    Every executor writes under a name of its own and then renames, so a task that runs again replaces its file. Null
    vectors are left out. Vectors of one task must have one length.
    """
    Path(path).mkdir(parents=True, exist_ok=True)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({key: [], v: []}), *batches])
        if len(got):
            name = f"part-{TaskContext.get().partitionId():05d}.npy"
            at = Path(path) / f"{uuid.uuid4().hex}.tmp"
            with open(at, "wb") as f:
                np.save(f, np.array(got[v].tolist()))
            at.rename(Path(path) / name)
            yield pd.DataFrame({key: got[key], "file": name, "row": np.arange(len(got))})

    return materialise(df.where(F.col(v).isNotNull()).select(key, v).mapInPandas(run, f"`{key}` {kind}, file string, row long"))


def in_chunks(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """F over Arrow batches of df, each of spark.sql.execution.arrow.maxRecordsPerBatch rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return df.mapInPandas(run, schema)


def key_page(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The n rows that follow a key."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def hash_sample(df: DataFrame, key: str, of_256: int) -> DataFrame:
    """Rows whose key's hash begins with a byte below of_256; the same rows in every run."""
    return df.where(F.substring(F.md5(F.col(key).cast("string")), 1, 2) < f"{of_256:02x}")


def columns_like(df: DataFrame, pattern: str, first: tuple[str, ...] = ()) -> DataFrame:
    """Named columns, then all whose name matches a pattern."""
    return df.select(*first, *(f"`{c}`" for c in df.columns if re.search(pattern, c) and c not in first))


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Df with a null column of that name, or as it is if it has one."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def insert_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Df and further rows in the order of its columns."""
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))


def create_empty(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty Parquet table of that schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def describe(df: DataFrame) -> DataFrame:
    """Name and type of the columns."""
    return df.sparkSession.createDataFrame(df.dtypes, "name string, type string")
