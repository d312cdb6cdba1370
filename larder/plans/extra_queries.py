"""Queries of language labels, of the whole pipeline, and of what goes beyond the batch operators (X: streams, more joins and aggregates)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.language import COMMON, detect_language
from larder.plans import pipeline
from larder.plans.registry import ORACLES, Tables, query
from larder.session import shared_dir
from larder.streaming import ingest

C = F.col


_COUNTED = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in dict.fromkeys(words.split()))}))) AS {lang}" for lang, words in COMMON.items())
_TOP = f"greatest({', '.join(COMMON)})"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS s FROM documents), c AS (SELECT doc_id, s, regexp_extract_all(lower(s), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w FROM t), n AS (SELECT doc_id, s, {_COUNTED} FROM c)
SELECT doc_id, CASE WHEN length(s) < 10 OR {_TOP} = 0 THEN NULL {" ".join(f"WHEN {lang} = {_TOP} THEN '{lang}'" for lang in sorted(COMMON))} END AS lang FROM n""")
def T30_language(t: Tables) -> DataFrame:
    return detect_language(t.documents, "text", ("doc_id",))


@query()
def A_pipeline(t: Tables) -> DataFrame:
    got = pipeline.code_products(t.products_with_language1, t.foodex2_terms).products
    return got.select("code", "original_tag", "ingredient", "matchable", "term", "mode", "confidence", F.round("score", 4).alias("score"))


def _stream(t: Tables, name: str, make, mode: str) -> DataFrame:
    at = f"{shared_dir(t.spark).rstrip('/')}/larder-{uuid.uuid4().hex}"
    source = getattr(t, name)
    files = f"{t.at}/{name}.parquet"
    stream = ingest.read_stream(t.spark, files if not files.endswith(".parquet") else f"{files}*", source.schema)
    ingest.write_stream(make(stream), f"{at}/out", f"{at}/state", mode).awaitTermination()
    return t.spark.read.parquet(f"{at}/out")


@query(ORACLES["T17_ingredient_rows"])
def X1_ingredient_stream(t: Tables) -> DataFrame:
    return _stream(t, "products_with_language1", ingest.ingredient_stream, "append")


_WINDOWS = "SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_WINDOWS)
def X2_event_windows(t: Tables) -> DataFrame:
    return ingest.window_counts(t.events).select("event_type", C("start").cast("string").alias("start"), "n", F.round("total", 4).alias("total"))


@query(_WINDOWS)
def X3_event_window_stream(t: Tables) -> DataFrame:
    got = _stream(t, "events", ingest.window_counts, "complete")
    return got.select("event_type", C("start").cast("string").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def X4_sessions(t: Tables) -> DataFrame:
    return ingest.sessions(t.events).select("user_id", C("start").cast("string").alias("start"), "n")


@query("SELECT event_type, coalesce(user_id % 3, -1) AS g, count(*) AS n, grouping(event_type) + 2 * grouping(user_id % 3) AS lvl FROM events GROUP BY CUBE (event_type, user_id % 3)")
def X5_cube(t: Tables) -> DataFrame:
    e = t.events.withColumn("g", C("user_id") % 3)
    return e.cube("event_type", "g").agg(F.count(F.lit(1)).alias("n"), (F.grouping("event_type") + 2 * F.grouping("g")).cast("long").alias("lvl")).withColumn("g", F.coalesce("g", F.lit(-1)))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def X6_anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT e.event_id, coalesce(p.event_id, -1) AS purchase FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def X7_as_of_join(t: Tables) -> DataFrame:
    """The last purchase of the same user up to each event: one pass over each user's events, no pairs."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bought = F.when(C("event_type") == "purchase", C("event_id"))
    return t.events.select("event_id", F.coalesce(F.last(bought, ignorenulls=True).over(w), F.lit(-1)).alias("purchase"))


@query("SELECT event_id, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS before, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)")
def X8_window_functions(t: Tables) -> DataFrame:
    w, v = Window.partitionBy("user_id").orderBy("event_type"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.coalesce(F.lag("value").over(v), F.lit(-1.0)).alias("before"), F.ntile(4).over(v).alias("q"))


