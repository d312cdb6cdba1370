"""Matching of names to a term hierarchy: exact and fuzzy retrieval with re-ranking, beam search and greedy descent, cache and fallback."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fuzzy
from larder.functions import text as T
from larder.operators import hierarchy as H
from larder.operators import vectors as V
from larder.session import materialise

#: Rows that a list of variants may have: it goes to every executor.
MOST_VARIANTS = 2_000_000


@dataclass(frozen=True)
class MatchParams:
    """Thresholds of levels 2, 3 and below, beam widths, and the limits of fuzzy retrieval."""

    thresholds: tuple[float, float, float] = (0.45, 0.65, 0.75)
    widths: tuple[int, int, int] = (3, 5, 10)
    cutoff: float = 65.0
    top_variants: int = 100
    top_terms: int = 30


#: Parameter sets of the recorded runs.
RUNS = {
    "default": MatchParams(), "mpnet": MatchParams((0.45, 0.55, 0.75)), "base": MatchParams((0.40, 0.50, 0.70)),
    "small": MatchParams((0.55, 0.70, 0.85), (3, 4, 6)),
}


def variants(ix: DataFrame) -> DataFrame:
    """M3 for an index: term, name, variant; one row for each different variant of a term."""
    return ix.where("level >= 2").select("term", "name", F.explode(T.comma_variants(F.col("name"))).alias("variant"))


def exact(queries: DataFrame, var: DataFrame, query: str = "ingredient") -> DataFrame:
    """Queries whose key is a variant, with the smallest such term."""
    q = queries.select(query, T.lookup_key(F.col(query)).alias("variant"))
    return q.join(var, "variant").groupBy(query, "variant").agg(F.min(F.struct("term", "name")).alias("t")).select(query, "variant", "t.term", "t.name")


def _held_variants(var: DataFrame) -> list[tuple[str, str, str]]:
    """(term, name, variant) in the order in which ties are broken, at most MOST_VARIANTS."""
    n = var.count()
    if n > MOST_VARIANTS:
        raise ValueError(f"{n} variants; {MOST_VARIANTS} can be held")
    return list(var.select("term", "name", "variant").orderBy("variant", "term").toPandas().itertuples(index=False, name=None))


_made: dict[str, object] = {}


def _once(token: str, make):
    """One index for all tasks of a worker that run one plan."""
    if token not in _made:
        _made.clear()
        _made[token] = make()
    return _made[token]


def _best(score, rows: list[tuple[str, str, str]], k: str, params: MatchParams) -> list[tuple[int, float]]:
    """M9, M10 for one key: place and score of the best variant of each term."""
    at, s = score(k, params.cutoff)
    seen: dict[str, tuple[int, float]] = {}
    for i in np.lexsort((at, -s))[: params.top_variants].tolist():
        seen.setdefault(rows[at[i]][0], (int(at[i]), float(s[i])))
    return list(seen.values())[: params.top_terms]


def _scorer(rows: list[tuple[str, str, str]], scorer):
    """scorer(key, variant) as a function of a key and a cutoff over all variants; the standard one runs over all at once."""
    strings = [v for _, _, v in rows]
    if scorer is fuzzy.weighted:
        return fuzzy.Weighted(strings)

    def each(k: str, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        s = np.array([scorer(k, v) for v in strings], float)
        at = np.flatnonzero(s >= cutoff)
        return at, s[at]

    return each


def fuzzy_candidates(queries: DataFrame, var: DataFrame, params: MatchParams = MatchParams(), query: str = "ingredient", scorer=fuzzy.weighted) -> DataFrame:
    """Query, term, name, variant, score (0 to 100): of the best `top_variants` variants at or above the
    cutoff the best one of each term, at most `top_terms` terms; ties by variant, then term.

    Every variant is scored; those whose bound is below the cutoff are left out without loss. Give distinct queries: a
    query is scored as often as it comes. Null queries give nothing. More than MOST_VARIANTS variants are refused.
    """
    shared, token = queries.sparkSession.sparkContext.broadcast(_held_variants(var)), uuid.uuid4().hex
    few = queries.select(F.col(query).alias("q"), T.lookup_key(F.col(query)).alias("k")).where("q is not null")
    # Few bytes but much work a row: spread before scoring, as the planner would put them into one task; equal keys are scored once.
    few = few.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        score = _once(token, lambda: _scorer(rows, scorer))
        last, best = None, []
        for b in batches:
            out = []
            for q, k in zip(b["q"], b["k"]):
                if k != last:
                    last, best = k, _best(score, rows, k, params)
                out += [(q, *rows[i], s) for i, s in best]
            yield pd.DataFrame(out, columns=["q", "term", "name", "variant", "score"])

    return few.mapInPandas(run, "q string, term string, name string, variant string, score double").withColumnRenamed("q", query)


def best_variants(candidates: DataFrame, query: str, most: int) -> DataFrame:
    """Of each query and term the variant with the largest score, of each query at most `most` terms; ties by variant, then term."""
    one = candidates.groupBy(query, "term").agg(F.min_by(F.struct("variant", "score"), F.struct(-F.col("score"), "variant")).alias("b")).select(query, "term", "b.*")
    return V.ranked(one, (query,), [F.desc("score"), F.col("term")], most).drop("rank")


def rerank_score(embedding: Column, score: Column, lexical: Column, prior: Column) -> Column:
    """M12, with the fixed weights 0.50, 0.28, 0.10 and 0.12; score from 0 to 100."""
    return 0.50 * embedding + 0.28 * (score / 100) + 0.10 * lexical + 0.12 * prior


def fuzzy_confidence(score: Column, lexical: Column, params: MatchParams = MatchParams()) -> Column:
    """Never NO_MATCH."""
    return F.when((score >= params.thresholds[2]) & (lexical >= 0.30), "HIGH").when(score >= params.thresholds[1], "MEDIUM").otherwise("LOW")


def specific_score(embedding: Column, name: Column, query: Column, normal: bool = True) -> Column:
    """0.75 embedding and 0.25 shared words, at least 0.98 for equal keys."""
    mixed = 0.75 * embedding + 0.25 * T.token_jaccard(query, name, normal)
    return F.when(T.lookup_key(query, normal) == T.lookup_key(name, normal), F.greatest(mixed, F.lit(0.98))).otherwise(mixed)


def path_score(stop: Column, l2: Column, l3: Column, specific: Column) -> Column:
    """Score of a path that stops at level 2, 3 or below (stop 4); other stops give 0."""
    return F.when(stop == 4, 0.20 * l2 + 0.30 * l3 + 0.50 * specific).when(stop == 3, 0.40 * l2 + 0.60 * l3).when(stop == 2, 0.40 * l2).otherwise(0.0)


_RESULT = (
    "level2_code", "level2_name", "level2_score", "level3_code", "level3_name", "level3_score", "specific_code", "specific_name", "specific_score", "final_level", "confidence", "path_score",
    *(f"top{i}_{x}" for i in (1, 2, 3) for x in ("code", "name", "score")),
)


def beam(queries: DataFrame, nodes: DataFrame, params: MatchParams = MatchParams(), query: str = "query_id") -> DataFrame:
    """The best path of each query (query, name, vec) through nodes (node, name, level, parent, vec).

    Of the paths that the beam opens the one with the largest path score stands; ties go to the larger level 2 and 3
    scores, then the smaller codes. No level 2 node at its threshold gives NO_MATCH at level 2, a null vector NO_MATCH
    at level 0. top1 to top3 are the best nodes at the level where the path stops, null and 0 where there are fewer.
    """
    (t2, t3, ts), (k2, k3, ks) = params.thresholds, params.widths
    level = lambda n: nodes.where(F.col("level") == n if n < 4 else F.col("level") >= 4)
    q = V.top_children(queries.select(query, "name", "vec"), level(2), max(k2, 3), "c2")
    q = q.withColumn("up2", F.transform(F.filter(F.slice("c2", 1, k2), lambda x: x["score"] >= t2), lambda x: x["node"]))
    q = V.top_children(q, level(3), max(k3, 3), "c3", "up2")
    heads = F.flatten(F.transform("up2", lambda p: F.filter(F.slice(F.filter("c3", lambda x: x["parent"] == p), 1, k3), lambda x: x["score"] >= t3)))
    q = V.top_children(q.withColumn("up3", F.transform(heads, lambda x: x["node"])), level(4), max(ks, 3), "c4", "up3").drop("vec", "up3")

    p2 = q.select("*", F.explode_outer(F.filter(F.slice("c2", 1, k2), lambda x: x["score"] >= t2)).alias("n2")).withColumn("own3", F.filter("c3", lambda x: x["parent"] == F.col("n2")["node"]))
    p3 = p2.select("*", F.explode_outer(F.filter(F.slice("own3", 1, k3), lambda x: x["score"] >= t3)).alias("n3")).withColumn("own4", F.filter("c4", lambda x: x["parent"] == F.col("n3")["node"]))
    p4 = p3.select("*", F.explode_outer(F.filter(F.slice("own4", 1, ks), lambda x: x["score"] >= ts)).alias("n4"))
    combined = F.when(F.col("n4").isNotNull(), specific_score(F.col("n4")["score"], F.col("n4")["name"], F.col("name")))
    stop = F.when(F.size("c2") == 0, 0).when(F.col("n2").isNull(), 1).when(F.col("n3").isNull(), 2).when(F.col("n4").isNull(), 3).otherwise(4)
    p = p4.withColumn("combined", combined).withColumn("stop", stop)
    tops = F.when(F.col("stop") <= 2, F.col("c2")).when(F.col("stop") == 3, F.col("own3")).otherwise(F.col("own4"))
    first = lambda c: F.get(F.col(c), F.lit(0))
    p = p.select(
        query, "stop",
        *(F.when(F.col("stop") == k - 1, first(c)[f]).otherwise(F.col(n)[f]).alias(f"{to}_{x}") for k, c, n, to in ((2, "c2", "n2", "level2"), (3, "own3", "n3", "level3"), (4, "own4", "n4", "specific")) for f, x in (("node", "code"), ("name", "name"))),
        F.coalesce(F.when(F.col("stop") == 1, first("c2")["score"]).otherwise(F.col("n2")["score"]), F.lit(0.0)).alias("level2_score"),
        F.coalesce(F.when(F.col("stop") == 2, first("own3")["score"]).otherwise(F.col("n3")["score"]), F.lit(0.0)).alias("level3_score"),
        F.coalesce(F.when(F.col("stop") == 3, first("own4")["score"]).otherwise(F.col("combined")), F.lit(0.0)).alias("specific_score"),
        F.when(F.col("stop") == 0, 0).when(F.col("stop") <= 2, 2).otherwise(F.col("stop")).alias("final_level"),
        F.element_at(F.array(*map(F.lit, ("NO_MATCH", "NO_MATCH", "LOW", "MEDIUM", "HIGH"))), F.col("stop") + 1).alias("confidence"),
        path_score(F.col("stop"), F.col("n2")["score"], F.col("n3")["score"], F.col("combined")).alias("path_score"), tops.alias("tops"),
    )
    for i in (1, 2, 3):
        p = p.withColumn(f"top{i}_code", F.get("tops", F.lit(i - 1))["node"]).withColumn(f"top{i}_name", F.get("tops", F.lit(i - 1))["name"]).withColumn(f"top{i}_score", F.coalesce(F.get("tops", F.lit(i - 1))["score"], F.lit(0.0)))
    order = F.struct(-F.col("path_score"), -F.col("level2_score"), -F.col("level3_score"), "level2_code", "level3_code", "specific_code")
    return p.groupBy(query).agg(F.min_by(F.struct(*_RESULT), order).alias("r")).select(query, "r.*")


def greedy(queries: DataFrame, nodes: DataFrame, params: MatchParams = MatchParams(), query: str = "query_id") -> DataFrame:
    """The best node of each level only: query, code, score, level (2, 3 or 5), confidence.

    Below the first threshold NO_MATCH, with the best level 2 node. A level 3 node below its threshold leaves level 2
    with LOW, a specific one level 3 with MEDIUM.
    """
    t2, t3, ts = params.thresholds
    level = lambda n: nodes.where(F.col("level") == n if n < 4 else F.col("level") >= 4)
    q = V.top_children(queries.select(query, "vec"), level(2), 1, "c2")
    q = V.top_children(q.withColumn("u", F.transform("c2", lambda x: x["node"])), level(3), 1, "c3", "u")
    q = V.top_children(q.withColumn("u", F.transform("c3", lambda x: x["node"])), level(4), 1, "c4", "u")
    a, b, c = (F.get(x, F.lit(0)) for x in ("c2", "c3", "c4"))
    none, low = ~F.coalesce(a["score"] >= t2, F.lit(False)), ~F.coalesce(b["score"] >= t3, F.lit(False))
    mid = ~F.coalesce(c["score"] >= ts, F.lit(False))
    pick = lambda f: F.when(none | low, a[f]).when(mid, b[f]).otherwise(c[f])
    return q.select(
        query, pick("node").alias("code"), pick("score").alias("score"), F.when(none | low, 2).when(mid, 3).otherwise(5).alias("level"),
        F.when(none, "NO_MATCH").when(low, "LOW").when(mid, "MEDIUM").otherwise("HIGH").alias("confidence"),
    )


def term_vectors(ix: DataFrame, encode) -> DataFrame:
    """M5 for an index: term, vec: the normalised mean of the vectors of a term's different variants."""
    return V.mean_vector(variants(ix).select("term", encode(F.col("variant")).alias("v")), ("term",), "v", "vec")


def term_nodes(ix: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes of an index for beam() and greedy(), with the vectors (term, vec) of its terms."""
    up = H.parents(ix).select(F.col("child").alias("term"), "parent")
    nodes = ix.where("level >= 2").join(up, "term", "left").join(vectors, "term")
    return nodes.select(F.col("term").alias("node"), "name", F.col("level").cast("int").alias("level"), F.coalesce("parent", F.lit("")).alias("parent"), "vec")


#: Columns of a whole match record behind its query; term, mode, score and confidence sum it up.
RECORD = ("term", "mode", "score", *_RESULT, "rf_used", "rf_score", "rf_variant", "emb_score", "lexical_score", "branch_prior", "exact_variant")


def match_names(queries: DataFrame, terms: DataFrame, params: MatchParams = MatchParams(), encode=None, query: str = "ingredient") -> DataFrame:
    """M9 to M19 in one plan: distinct queries with RECORD, the record of each match.

    A query that is a variant is settled by it (mode rf_exact); else its fuzzy candidates are re-ranked by M12
    (rf_reranked), and a query without candidates goes to the beam. In the first two modes the scores of levels 2 and 3
    are the vector score, the specific score is the final one, and top2 and top3 are empty. Give distinct queries; null
    gives nothing.
    """
    encode = encode or V.encoder()
    ix = H.index(terms)
    # The terms are few (MOST_VARIANTS); their vectors are read by three plans, so they are made once.
    vectors = materialise(term_vectors(ix, encode))
    path = H.resolve(ix).select("term", "level2_code", "level2_name", "level3_code", "level3_name", "specific_code", "specific_name", F.col("final_level").cast("int").alias("final_level"))
    q = queries.select(query, T.lookup_key(F.col(query)).alias("__key")).where(F.col(query).isNotNull()).withColumn("__vec", encode(F.col("__key"))).withColumn("__words", T.token_set(F.col(query)))
    tops = path.select("term", "level2_code").join(ix.select("term", T.token_set(F.col("name")).alias("words")), "term")
    both = _with_vectors(q, variants(ix), vectors, tops, params, query).withColumn("exact_variant", F.col("rf_score") == 100.0)
    settled = 0.50 * F.col("emb_score") + 0.28 + 0.10 * F.col("lexical_score")
    both = both.withColumn("score", F.when(F.col("exact_variant"), settled).otherwise(rerank_score(F.col("emb_score"), F.col("rf_score"), F.col("lexical_score"), F.col("branch_prior"))))
    kept = ("term", "name", "variant", "score", "rf_score", "emb_score", "lexical_score", "branch_prior", "exact_variant")
    # Read for the results and for what is left to the beam, so that candidates are scored once: one row a query.
    best = materialise(both.groupBy(query).agg(F.min_by(F.struct(*kept), F.struct(-F.col("score"), "term")).alias("r")).select(query, "r.*").join(path, "term", "left"))
    has = lambda c, x: F.when(F.col(c).isNotNull(), F.col(x)).otherwise(0.0)
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    exact_ = F.col("exact_variant")
    first = best.select(
        query, "term", F.when(exact_, "rf_exact").otherwise("rf_reranked").alias("mode"), "score", "level2_code", "level2_name", has("level2_code", "emb_score").alias("level2_score"),
        "level3_code", "level3_name", has("level3_code", "emb_score").alias("level3_score"), "specific_code", "specific_name", has("specific_code", "score").alias("specific_score"), "final_level",
        F.when(exact_, "HIGH").otherwise(fuzzy_confidence(F.col("score"), F.col("lexical_score"), params)).alias("confidence"), F.col("score").alias("path_score"),
        F.col("term").alias("top1_code"), F.col("name").alias("top1_name"), F.col("score").alias("top1_score"),
        *(x for i in (2, 3) for x in (none.alias(f"top{i}_code"), none.alias(f"top{i}_name"), zero.alias(f"top{i}_score"))),
        F.lit(True).alias("rf_used"), "rf_score", F.col("variant").alias("rf_variant"), "emb_score", "lexical_score", F.when(exact_, 0.0).otherwise(F.col("branch_prior")).alias("branch_prior"), "exact_variant",
    )
    left = q.join(best.select(query), query, "left_anti").select(F.col(query).alias("query_id"), F.col("__key").alias("name"), F.col("__vec").alias("vec"))
    fell = beam(left, materialise(term_nodes(ix, vectors)), params).select(
        F.col("query_id").alias(query), F.coalesce("specific_code", "level3_code", "level2_code").alias("term"), F.lit("beam").alias("mode"), F.col("path_score").alias("score"), *_RESULT,
        F.lit(False).alias("rf_used"), zero.alias("rf_score"), none.alias("rf_variant"), zero.alias("emb_score"), zero.alias("lexical_score"), zero.alias("branch_prior"), F.lit(False).alias("exact_variant"),
    )
    return first.select(query, *RECORD).unionByName(fell.select(query, *RECORD))


def _with_vectors(q: DataFrame, var: DataFrame, vectors: DataFrame, tops: DataFrame, params: MatchParams, query: str) -> DataFrame:
    """Fuzzy candidates of queries (query, __key, __vec, __words) with emb_score and branch_prior, the inner products with
    the vectors of the term and of its level 2 term, and lexical_score (M8 with the name). tops: term, level2_code, words.
    Of a query that is a variant the first such term alone."""
    rows = _held_variants(var)
    known = vectors.join(tops, "term", "left").orderBy("term").select("term", "level2_code", "vec", "words").toPandas()
    place = {t: i for i, t in enumerate(known["term"])}
    matrix = np.array(known["vec"].tolist(), np.float32).reshape(len(known), -1)
    top = np.array([place.get(c, -1) for c in known["level2_code"]], int)
    said = [frozenset(() if w is None else w) for w in known["words"]]
    shared, token = q.sparkSession.sparkContext.broadcast((rows, place, matrix, top, said)), uuid.uuid4().hex
    kind = q.schema[query].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, place, matrix, top, said = shared.value
        score, first = _once(token, lambda: (_scorer(rows, fuzzy.weighted), {v: i for i, (_, _, v) in reversed(list(enumerate(rows)))}))
        last, found = None, []
        for b in batches:
            out = []
            for name, k, vec, own in zip(b["q"], b["__key"], b["__vec"], map(set, b["__words"])):
                if k != last:
                    last, found = k, [(first[k], 100.0)] if k in first else _best(score, rows, k, params)
                if found:
                    near = matrix @ np.asarray(vec, np.float32)
                    for i, s in found:
                        t = place[rows[i][0]]
                        both = len(own & said[t])
                        lexical = both / (len(own) + len(said[t]) - both) if both else 0.0
                        out.append((name, *rows[i], s, float(near[t]), float(near[top[t]]) if top[t] >= 0 else 0.0, lexical))
            yield pd.DataFrame(out, columns=["q", "term", "name", "variant", "rf_score", "emb_score", "branch_prior", "lexical_score"])

    few = q.select(F.col(query).alias("q"), "__key", "__vec", "__words").repartition(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key").sortWithinPartitions("__key")
    return few.mapInPandas(run, f"q {kind}, term string, name string, variant string, rf_score double, emb_score double, branch_prior double, lexical_score double").withColumnRenamed("q", query)


def cached(queries: DataFrame, results: DataFrame, query: str = "ingredient", order: str | None = None) -> DataFrame:
    """Queries with the columns of results: by the same name, else by the same name in lower case (the first by `order`); hit is exact, lower or null."""
    cols = [c for c in results.columns if c != query]
    a = results.groupBy(query).agg(F.min_by(F.struct(*cols), F.col(order or query)).alias("a"))
    b = results.groupBy(F.lower(query).alias("__low")).agg(F.min_by(F.struct(*cols), F.struct(order or query, query)).alias("b"))
    j = queries.join(a, query, "left").withColumn("__low", F.lower(query)).join(b, "__low", "left")
    return j.select(*queries.columns, F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "lower").alias("hit"), *(F.coalesce(F.col("a")[c], F.col("b")[c]).alias(c) for c in cols))


def match_cached(queries: DataFrame, results: DataFrame, terms: DataFrame, params: MatchParams = MatchParams(), encode=None, query: str = "ingredient") -> DataFrame:
    """M21 whole: hit, term, score, confidence of each query: from results by cached(), else `live` by greedy(). Give distinct queries."""
    encode = encode or V.encoder()
    seen = cached(queries.select(query), results.select(query, "term", "score", "confidence"), query)
    missed = seen.where("hit is null").select(query, encode(T.lookup_key(F.col(query))).alias("vec"))
    ix = H.index(terms)
    live = greedy(missed, materialise(term_nodes(ix, term_vectors(ix, encode))), params, query)
    return seen.where("hit is not null").unionByName(live.select(query, F.lit("live").alias("hit"), F.col("code").alias("term"), "score", "confidence"))


def matchable(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct ingredients of matchable rows; strict: English ones that are no additives (null counts as none)."""
    keep = F.col("matchable")
    if strict:
        keep = keep & (F.col("tag_lang") == "en") & ~F.coalesce("is_additive", F.lit(False))
    return rows.where(keep).select("ingredient").distinct()
