"""Beyond the batch operators: the same transformations over streams, and event-time aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from larder.operators import tags


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingredient_stream(products: DataFrame) -> DataFrame:
    """T17 over a stream; no state is kept."""
    return tags.ingredient_rows(products)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write what has arrived, then stop; a restart goes on from the checkpoint without repeating rows."""
    if mode == "append":
        return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return df.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """by, start, n, total of event-time windows; rows later than the watermark are dropped from a stream."""
    w = _timed(events, ts).withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.window(ts, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", by: str = "user_id", late: str = "2 hours") -> DataFrame:
    """by, start, end, n of sessions that a pause of `gap` ends."""
    w = _timed(events, ts).withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; over a batch, one row of each key."""
    return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def running_totals(events: DataFrame, by: str = "user_id", value: str = "value") -> DataFrame:
    """by, n, total so far, by a state of two numbers for each key; one row for each key of a batch."""
    kind = events.schema[by].dataType.simpleString()

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p[value].sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    return events.groupBy(by).applyInPandasWithState(add, f"`{by}` {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
