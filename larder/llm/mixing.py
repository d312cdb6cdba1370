"""Mixing sources to target weights.

The tokens of each source are laid end to end and packed into blocks of fixed length. The blocks that each source
gives follow from its target share, its cap on repeats and the true sizes of the blocks that it would give. A
multinomial draw spreads them over the output shards: down a binary tree of the shards every node divides what it has
between its halves, so any task can draw the shards that it holds. The j-th block that a source gives is block j mod n
of the epoch's pseudorandom permutation of its n blocks, so no block comes again before all others came, and slots find
their blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from larder.llm.bpe import VOCABULARY, count_tokens, encode_corpus
from larder.session import materialise

#: Tokens of a block, and blocks of a shard.
BLOCK, SHARD_BLOCKS = 512, 2048
#: Documents of a bucket, the unit in which offsets are summed, and the most sources that a table of weights may list.
BUCKET, MOST_SOURCES = 20_000, 10_000


@dataclass
class Mix:
    """slots: one row per block of the mix; shares: one row per source of the weights."""

    slots: DataFrame
    shares: DataFrame


def allot(tokens: np.ndarray, share: np.ndarray, repeats: np.ndarray, total: float | None) -> np.ndarray:
    """Tokens that each source gives. Without `total` the largest amount at which every source that has tokens can
    keep its share; with it, sources that reach their cap give that, and the rest is shared out anew among the others."""
    cap = tokens * repeats
    live = (cap > 0) & (share > 0)
    given = np.zeros(len(tokens))
    if not live.any():
        return given
    weight = np.where(live, share, 0) / share[live].sum()
    if total is None:
        with np.errstate(over="ignore", divide="ignore"):  # a share of almost nothing sets no limit
            return weight * (cap[live] / weight[live]).min()
    left, open_ = min(float(total), cap[live].sum()), live.copy()
    while open_.any() and left > 1e-9:
        want = left * np.where(open_, share, 0) / share[open_].sum()
        full = open_ & (given + want >= cap)
        if not full.any():
            given += want
            break
        left -= (cap - given)[full].sum()
        given[full] = cap[full]
        open_ &= ~full
    return given


def whole_blocks(given: np.ndarray, tokens: np.ndarray, repeats: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that each source gives, and the tokens in them: of the numbers of blocks within the cap the one whose tokens
    are nearest to `given`, the smaller of two. The last block of a source is short, so its turn in the epoch counts."""
    blocks, quota, mixed = -(-tokens // block), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero(tokens):
        t, n = int(tokens[i]), int(blocks[i])
        rounds = min(int(repeats[i]), int((given[i] + 1e-6) // t))
        rest = given[i] - rounds * t
        if rounds == repeats[i] or rest <= 0:
            quota[i], mixed[i] = rounds * n, rounds * t
            continue
        turn = int(permute(np.array([n - 1]), np.array([n]), block_key(seed, np.array([i]), np.array([rounds])), back=True)[0])
        few = int(rest // block)
        size = {k: k * block - (block * n - t if k > turn else 0) for k in range(max(0, few - 1), min(n, few + 2) + 1)}
        k = min(size, key=lambda k: (abs(size[k] - rest), k))
        quota[i], mixed[i] = rounds * n + k, rounds * t + size[k]
    return quota, mixed


def _divide(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A random part of `size` blocks of `left` (blocks of each source): each block goes by the toss of a coin, and
    multinomial draws, renewed over what is left, make up the size."""
    got = rng.binomial(left, size / max(1, int(left.sum())))
    while (off := size - int(got.sum())) != 0:
        from_ = left - got if off > 0 else got
        more = np.minimum(rng.multinomial(abs(off), from_ / from_.sum()), from_)
        got = got + more if off > 0 else got - more
    return got


def draw_shards(blocks: np.ndarray, shards: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source in it, blocks of each source in the shards before it) of the shards first .. last - 1.

    The totals over all shards are met, shards differ by one block at most, and any range gives what the whole gives.
    """
    last, total = shards if last is None else min(last, shards), int(blocks.sum())

    def walk(lo: int, hi: int, have: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, have, before
            return
        mid = (lo + hi) // 2
        size = mid * total // shards - lo * total // shards
        part = _divide(have, size, np.random.default_rng((seed, lo, hi)))
        yield from walk(lo, mid, part, before)
        yield from walk(mid, hi, have - part, before + part)

    if shards > 0:
        yield from walk(0, shards, blocks.astype(np.int64), np.zeros(len(blocks), np.int64))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def block_key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    """Key of the permutation of a source's blocks in an epoch; source -1 and a shard as epoch: of the slots of a shard."""
    h = _stir(np.uint64(seed & (1 << 63) - 1) + source.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _stir(h + epoch.astype(np.int64).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Image (back: origin) of x under a pseudorandom permutation of 0 .. n-1 chosen by key: four Feistel rounds, walked on until inside."""
    bits = np.frexp(np.maximum(1, n - 1).astype(float))[1].astype(np.uint64)  # exact below 2**53
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    key, n = key.astype(np.uint64), n.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(3, -1, -1) if back else range(4):
            f = ((left if back else right) + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            f = (f ^ (f >> np.uint64(32))) & m
            left, right = (right ^ f, left) if back else (right, left ^ f)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _permuted(seed: int):
    @F.pandas_udf(LongType())
    def f(x: pd.Series, n: pd.Series, source: pd.Series, epoch: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(np.int64), n.to_numpy(np.int64), block_key(seed, source.to_numpy(np.int64), epoch.to_numpy(np.int64))))

    return f


def mix_sources(
    docs: DataFrame, weights: DataFrame, text: str = "text", key: str = "doc_id", total_tokens: int | None = None,
    block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, vocabulary: str = VOCABULARY, seed: int = 7,
) -> Mix:
    """Mix docs (key, source, text) to the shares of weights (source, target_share, max_repeats).

    slots: shard (int), slot (long, from 0 in each shard), source, epoch (int, 0 for the first use), block (long),
    n_tokens (long), parts (array of struct<key, from, to>: tokens from .. to - 1 of the document, in order). Every
    block has `block` tokens but for the last of each source. shares: source, target_share, max_repeats,
    available_tokens, mixed_tokens, actual_share, most_uses.

    Null and empty texts have no tokens; documents whose source is null or not listed stay out; a listed source
    without tokens gives nothing and its share goes to the others in proportion. Null, negative or repeated weights
    are an error of the caller: null counts as 0, and of equal sources the largest share is taken. Sizes are tokens
    of `vocabulary`. Each source gives its share to within half a block. Only sums by source reach the driver, at most
    MOST_SOURCES of them (more listed sources are refused); shards have no bound.
    """
    spark = docs.sparkSession
    listed = weights.where("source is not null").groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats")
    )
    few = listed.orderBy("source").limit(MOST_SOURCES + 1).toPandas()
    if len(few) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    named = F.col("source").isin(few["source"].tolist()) if len(few) else F.lit(False)
    kind = docs.schema[key].dataType.simpleString()
    sized = materialise(count_tokens(docs.where(named), text, (key, "source"), vocabulary).where("n_tokens > 0"))
    buckets = max(1, -(-sized.count() // BUCKET))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    have = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).toPandas().set_index("source")["tokens"]

    tokens = few["source"].map(have).fillna(0).to_numpy(np.int64)
    share, repeats = few["share"].clip(lower=0).to_numpy(float), few["repeats"].clip(lower=0).to_numpy(np.int64)
    quota, mixed = whole_blocks(allot(tokens.astype(float), share, repeats, total_tokens), tokens, repeats, block, seed)
    shards = int(max(1, quota.sum() // shard_blocks)) if quota.sum() else 0
    names, blocks = few["source"].tolist(), -(-tokens // block)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                ids = b["id"].iloc[lo : lo + 256]
                for k, n, before in draw_shards(quota, shards, seed, int(ids.iloc[0]), int(ids.iloc[-1]) + 1):
                    s = np.flatnonzero(n)
                    yield pd.DataFrame({"shard": np.full(len(s), k, np.int32), "source": [names[i] for i in s], "n": n[s], "before": before[s], "inside": (np.cumsum(n) - n)[s], "size": int(n.sum()), "blocks": blocks[s], "source_key": s})

    # Slots: every task draws the shards of its own range and unfolds them; a shard has at most twice shard_blocks slots.
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = spark.range(0, shards, 1, tasks).mapInPandas(plan, "shard int, source string, n long, before long, inside long, size long, blocks long, source_key long")
    slot = drawn.select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    slot = slot.withColumn("j", F.col("before") + F.col("i")).withColumn("epoch", F.expr("cast(j div blocks as int)"))
    permuted = _permuted(seed)
    slot = slot.select(
        "shard", "source", "epoch",
        permuted(F.col("inside") + F.col("i"), F.col("size"), F.lit(-1).cast("long"), F.col("shard").cast("long")).alias("slot"),
        permuted(F.expr("j % blocks"), F.col("blocks"), F.col("source_key"), F.col("epoch").cast("long")).alias("block"),
    )

    # Packing: the place of a document among its source's tokens is the bucket's offset plus the running sum inside the bucket.
    offsets = sums.select("source", "bucket", (F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")).alias("offset"))
    inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(key, F.lit(seed)), key)
    placed = sized.withColumn("end", F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, ["source", "bucket"])
    placed = placed.select(key, "source", "n_tokens", (F.col("offset") + F.col("end") - F.col("n_tokens")).alias("at"))
    cut = placed.select("*", F.explode(F.expr(f"sequence(at div {block}, (at + n_tokens - 1) div {block})")).alias("block"))
    part = cut.select("source", "block", F.struct(
        F.greatest(F.col("at"), F.col("block") * block).alias("place"), F.col(key),
        F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("at")).alias("from"),
        F.least(F.col("n_tokens").cast("long"), (F.col("block") + 1) * block - F.col("at")).alias("to"),
    ).alias("p"))
    packed = part.groupBy("source", "block").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a block holds at most `block` parts
    packed = packed.select("source", "block", F.expr(f"transform(p, x -> named_struct('{key}', x.`{key}`, 'from', x.from, 'to', x.to))").cast(f"array<struct<`{key}`:{kind},`from`:bigint,`to`:bigint>>").alias("parts"))
    packed = packed.withColumn("n_tokens", F.expr("aggregate(parts, 0L, (a, x) -> a + x.to - x.from)"))
    # Neither side has a bound, and the planner can't see how far the slots unfold: no broadcast.
    slots = slot.hint("merge").join(packed, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "parts")

    report = few.assign(available=tokens, mixed=mixed, actual=mixed / max(1, mixed.sum()), most=[-(-int(q) // int(b)) if b else 0 for q, b in zip(quota, blocks)])
    shares = spark.createDataFrame(
        report[["source", "share", "repeats", "available", "mixed", "actual", "most"]],
        "source string, target_share double, max_repeats int, available_tokens long, mixed_tokens long, actual_share double, most_uses int",
    )
    return Mix(slots, shares)


def with_tokens(slots: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """shard, slot, source, epoch, block, ids: the tokens of each slot of a mix, in the order of its parts.

    The documents that the mix uses are encoded once and cut; parts and slots meet in two equi-joins on keys without
    hot values, as a document has few parts and a slot at most `block`. The order of rows is left open.
    """
    place = ("source", "block")
    parts = slots.select(*place, "parts").dropDuplicates(list(place)).select(*place, F.posexplode("parts").alias("no", "p"))
    parts = parts.select(*place, "no", F.col(f"p.{key}").alias("__doc"), F.col("p.from").alias("lo"), F.col("p.to").alias("hi"))
    used = docs.join(parts.select(F.col("__doc").alias(key)).distinct().hint("shuffle_hash"), key, "left_semi")
    ids = encode_corpus(used, text, (key,), vocabulary).withColumnRenamed(key, "__doc")
    cut = parts.join(ids, "__doc").select(*place, F.struct("no", F.slice("ids", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("ids")).alias("c"))
    whole = cut.groupBy(*place).agg(F.flatten(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["ids"])).alias("ids"))
    return slots.select("shard", "slot", "epoch", *place).hint("merge").join(whole, list(place)).select("shard", "slot", "source", "epoch", "block", "ids")
