"""Vectors: normalise, average, compare, search. Scores of many pairs are matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Numbers that a side held in memory may have (rows x dimension): 128 MB of doubles; and labels of clusters.
MOST_NUMBERS, MOST_LABELS = 1 << 24, 10_000


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """M7 for a pair, in doubles."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """M6: v over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    # Repeated beside the vector, as a lambda would compute the length anew for every number.
    return F.zip_with(as_double(v), F.array_repeat(F.when(n == 0, F.lit(1.0)).otherwise(n), F.size(v)), lambda x, y: x / y)


def mean_vector(df: DataFrame, keys: tuple[str, ...], v: str, out: str = "centroid", unit: bool = True) -> DataFrame:
    """M5: keys and the mean of each group's vectors, normalised; sums are formed before the shuffle, place by place."""
    each = df.select(*keys, F.posexplode(as_double(F.col(v))).alias("__i", "__x"))
    mean = each.groupBy(*keys, "__i").agg(F.avg("__x").alias("__x"))
    whole = mean.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias(out))
    return whole.withColumn(out, normalize(F.col(out))) if unit else whole


def _numbers(df: DataFrame, v: str) -> int:
    return df.agg(F.coalesce(F.sum(F.size(v)), F.lit(0))).head()[0]


def _rows(column) -> np.ndarray:
    """An Arrow column of lists of one length, none null, as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def _held(df: DataFrame, v: str, *columns: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Matrix of the vectors and Arrow arrays of other columns, of a side whose size was checked."""
    t = df.select(v, *columns).toArrow()
    return _rows(t.column(0)), [t.column(i + 1).combine_chunks() for i in range(len(columns))]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, the first of equal ones first."""
    return np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]


def _ranked(x: np.ndarray, keys: pa.Array, m: np.ndarray, names: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """Key, name, rank and score of the k rows of m with the largest inner product with each row of x."""
    for lo in range(0, len(x) if len(m) else 0, 256):
        s = x[lo : lo + 256] @ m.T
        best = _best(s, k)
        n = best.shape[1]
        yield pa.RecordBatch.from_arrays([
            keys.slice(lo, 256).take(pa.array(np.repeat(np.arange(len(s)), n))), names.take(pa.array(best.ravel())), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(s))), pa.array(np.take_along_axis(s, best, 1).ravel()),
        ], names=["q", "i", "rank", "score"])


def _one(t: pa.Table, i: int) -> pa.Array:
    c = t.column(i)
    return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _tiles(left: DataFrame, right: DataFrame, n_left: int, n_right: int):
    """Both sides cut into parts of some MOST_NUMBERS numbers by hash, every part of one beside every part of the other: a
    grid whose tiles are tasks. A row is sent once for each part of the other side."""
    p, q = (max(1, -(-n // MOST_NUMBERS)) for n in (n_left, n_right))
    a = left.withColumn("__p", F.pmod(F.xxhash64(left.columns[0]), F.lit(p)).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    b = right.withColumn("__q", F.pmod(F.xxhash64(right.columns[0]), F.lit(q)).cast("int")).withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    return a.groupBy("__p", "__q").cogroup(b.groupBy("__p", "__q"))


def top_k(queries: DataFrame, items: DataFrame, k: int, query_key: str = "query_id", item_key: str = "item_id", v: str = "vec") -> DataFrame:
    """query_key, rank (int, from 1), item_key, score: the k items with the largest inner product, ties by item key.

    Items of at most MOST_NUMBERS numbers are held by every executor. Beyond that both sides meet in blocks, and the
    best of each block are ranked anew. Null vectors match nothing.
    """
    q, it = (d.where(F.col(v).isNotNull()).select(F.col(key).alias(x), as_double(F.col(v)).alias("v")) for d, key, x in ((queries, query_key, "q"), (items, item_key, "i")))
    kinds = f"q {q.schema['q'].dataType.simpleString()}, i {it.schema['i'].dataType.simpleString()}, rank int, score double"
    n = _numbers(it, "v")
    if n <= MOST_NUMBERS:
        m, (names,) = _held(it.orderBy("i"), "v", "i")
        shared = queries.sparkSession.sparkContext.broadcast((m, names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _ranked(_rows(b.column(1)), b.column(0), *shared.value, k)

        out = q.mapInArrow(run, kinds)
    else:

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            b = b.sort_by("i")
            got = list(_ranked(_rows(a.column("v")), _one(a, 0), _rows(b.column("v")), _one(b, 0), k))
            return pa.Table.from_batches(got) if got else pa.table({"q": _one(a, 0).slice(0, 0), "i": _one(b, 0).slice(0, 0), "rank": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})

        parts = _tiles(q, it, _numbers(q, "v"), n).applyInArrow(block, kinds)
        out = ranked(parts.drop("rank"), ("q",), [F.desc(F.round("score", 12)), F.col("i")], k)
    return out.select(F.col("q").alias(query_key), F.col("i").alias(item_key), F.col("rank").cast("int").alias("rank"), "score")


def top_children(queries: DataFrame, nodes: DataFrame, k: int, out: str, parents: str | None = None, v: str = "vec") -> DataFrame:
    """queries with `out`: for each parent named in the array column `parents` (or for all nodes as one family) the k
    nodes with the largest inner product, as array<struct<parent, node, name, score>>. nodes: node, name, parent, vec,
    of at most MOST_NUMBERS numbers; a hierarchy beyond that is refused. Of a batch all queries of one parent are
    compared at once."""
    nodes = nodes.where(F.col("vec").isNotNull())
    if (n := _numbers(nodes, "vec")) > MOST_NUMBERS:
        raise ValueError(f"nodes of {n} numbers; {MOST_NUMBERS} can be held")
    family = F.col("parent") if parents else F.lit("")
    m, (node, name, parent) = _held(nodes.select(as_double(F.col("vec")).alias("vec"), "node", "name", family.alias("parent")).orderBy("parent", "node"), "vec", "node", "name", "parent")
    shared = queries.sparkSession.sparkContext.broadcast((m, node.cast(pa.string()), name.cast(pa.string()), parent.cast(pa.string())))
    at = queries.columns.index(v), queries.columns.index(parents) if parents else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + f", `{out}` array<struct<parent:string,node:string,name:string,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, node, name, parent = shared.value
        heads = parent.to_pylist()
        first = [i for i, p in enumerate(heads) if not i or p != heads[i - 1]]
        span = {heads[i]: (i, j) for i, j in zip(first, [*first[1:], len(heads)])}
        for b in batches:
            has = b.column(at[0]).is_valid().to_numpy(zero_copy_only=False)
            x = np.zeros((len(b), m.shape[1] if len(m) else 0))
            if has.any() and len(m):
                x[has] = _rows(b.column(at[0]).filter(pa.array(has)))
            up = [[""]] * len(b) if at[1] is None else b.column(at[1]).to_pylist()
            rows_of: dict[str, list[tuple[int, int]]] = {}  # parent -> row, place among all pairs of the batch
            size = np.zeros(len(b), np.int64)
            pairs = 0
            for i, named in enumerate(up):
                for p in named or [] if has[i] else []:
                    if p in span:
                        rows_of.setdefault(p, []).append((i, pairs))
                        size[i] += min(k, span[p][1] - span[p][0])
                        pairs += 1
            picked: list[np.ndarray] = [np.zeros(0, np.int64)] * pairs
            worth: list[np.ndarray] = [np.zeros(0)] * pairs
            for p, mine in rows_of.items():
                lo, hi = span[p]
                s = x[[i for i, _ in mine]] @ m[lo:hi].T
                best = _best(s, k)
                score = np.take_along_axis(s, best, 1)
                for (_, place), w, c in zip(mine, best, score):
                    picked[place], worth[place] = w + lo, c
            flat = pa.array(np.concatenate(picked) if picked else np.zeros(0, np.int64))
            found = pa.StructArray.from_arrays([parent.take(flat), node.take(flat), name.take(flat), pa.array(np.concatenate(worth) if worth else np.zeros(0))], ["parent", "node", "name", "score"])
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), found)], names=[*b.schema.names, out])

    return queries.mapInArrow(run, schema)


def encoder(dimension: int = 256):
    """M4: a column function that gives unit vectors of hashed letter n-grams; a stand-in for a language model, and replaceable by one."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            v = np.zeros(dimension, np.float32)
            for w in (x or "").lower().split():
                w = f" {w} "
                for n in (2, 3, 4):
                    for i in range(len(w) - n + 1):
                        h = xxhash.xxh32_intdigest(w[i : i + n])
                        v[h % dimension] += 1 if h >> 31 else -1
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return encode


def _distances(x: np.ndarray, m: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the Euclidean distances of each row of x to the rows of m, by the n labels `at` of these."""
    out, one = np.zeros((len(x), n)), np.eye(n)[at]
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        out[lo : lo + 256] = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * part @ m.T)) @ one
    return out


def silhouettes(df: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """Key, label, silhouette by Euclidean distance: exact, from the sums of distances of each row to each cluster.

    Vectors of at most MOST_NUMBERS numbers are held by every executor; beyond that rows meet rows in blocks, whose sums
    are added up. At most MOST_LABELS labels. A row alone in its cluster has 0. Null vectors and labels are left out.
    """
    rows = df.where(F.col(v).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), as_double(F.col(v)).alias("v"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = sorted(counts)
    place = {x: i for i, x in enumerate(labels)}
    n = _numbers(rows, "v")
    kinds = f"k {rows.schema['k'].dataType.simpleString()}, l {rows.schema['l'].dataType.simpleString()}, sums array<double>"

    def summed(a, b) -> pa.RecordBatch:
        at = np.array([place[x] for x in b[1].to_pylist()], int)
        got = _distances(_rows(a[2]), _rows(b[2]), at, len(labels)) if len(a[2]) and len(b[2]) else np.zeros((len(a[2]), len(labels)))
        ends = np.arange(len(got) + 1, dtype=np.int32) * len(labels)
        return pa.RecordBatch.from_arrays([a[0], a[1], pa.ListArray.from_arrays(pa.array(ends), pa.array(got.ravel()))], names=["k", "l", "sums"])

    if n <= MOST_NUMBERS:
        shared = df.sparkSession.sparkContext.broadcast(rows.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for b in batches:
                yield summed(b.columns, [_one(t, i) for i in range(3)])

        sums = rows.mapInArrow(run, kinds)
    else:

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            return pa.Table.from_batches([summed([_one(a, i) for i in range(3)], [_one(b, i) for i in range(3)])])

        parts = _tiles(rows, rows, n, n).applyInArrow(block, kinds).select("k", "l", F.posexplode("sums").alias("i", "s"))
        each = parts.groupBy("k", "l", "i").agg(F.sum("s").alias("s"))
        sums = each.groupBy("k", "l").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"))
    sizes = F.array(*(F.lit(float(counts[x])) for x in labels))
    own = F.array_position(F.array(*map(F.lit, labels)), F.col("l")).cast("int") - 1
    mean = F.transform(F.arrays_zip(F.col("sums").alias("s"), sizes.alias("n")), lambda x, i: F.when(i != own, x["s"] / x["n"]))
    inside = F.get("sums", own) / F.greatest(F.get(sizes, own) - 1, F.lit(1.0))
    near = F.array_min(mean)
    value = F.when((F.get(sizes, own) > 1) & near.isNotNull(), (near - inside) / F.greatest(F.greatest(inside, near), F.lit(1e-300))).otherwise(0.0)
    return sums.select(F.col("k").alias(key), F.col("l").alias(label), value.alias("silhouette"))


def ranked(df: DataFrame, by: tuple[str, ...], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, by a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
