import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.integers(-(2**63), 2**63 - 1))
def test_permutation(n, key):
    x = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(x.tolist()) == list(range(n))
    assert mixing.permute(x, np.full(n, n), np.full(n, key), back=True).tolist() == list(range(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0, 1), st.integers(0, 4)), min_size=1, max_size=8), st.none() | st.integers(1, 5000))
def test_allotment(sources, total):
    tokens, share, repeats = (np.array(x, float) for x in zip(*sources))
    got = mixing.allot(tokens, share, repeats, total)
    assert (got <= tokens * repeats + 1e-6).all() and (got >= 0).all()
    live = (tokens * repeats > 0) & (share > 0)
    if live.any():
        if total is None:
            assert np.allclose(got[live] / got[live].sum(), share[live] / share[live].sum())
        else:
            assert np.isclose(got.sum(), min(total, (tokens * repeats)[live].sum()))


def test_shards_meet_the_totals():
    blocks = np.array([500, 0, 33, 1200])
    drawn = list(mixing.draw_shards(blocks, 7, 1))
    got = np.array([n for _, n, _ in drawn])
    assert [k for k, _, _ in drawn] == list(range(7)) and (got.sum(axis=0) == blocks).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1 and len({tuple(r) for r in got.tolist()}) > 1
    assert (np.array([b for _, _, b in drawn]) == np.cumsum(got, axis=0) - got).all()
    for lo, hi in ((0, 3), (3, 4), (5, 9)):
        part = list(mixing.draw_shards(blocks, 7, 1, lo, hi))
        assert [(k, n.tolist(), b.tolist()) for k, n, b in part] == [(k, n.tolist(), b.tolist()) for k, n, b in drawn[lo:hi]]
    assert not list(mixing.draw_shards(blocks * 0, 0, 1))


def test_shards_are_a_fair_draw():
    """A shard's counts vary as those of a random part of all blocks (hypergeometric)."""
    blocks = np.array([3000, 1000])
    got = np.array([[n[0] for _, n, _ in mixing.draw_shards(blocks, 16, seed)] for seed in range(200)])
    assert abs(got.mean() - 187.5) < 0.5 and 0.8 < got.var() / (250 * 0.75 * 0.25 * 15 / 16) < 1.25


def test_ten_billion_blocks_and_more_shards_than_could_be_held():
    tokens, repeats = np.array([512 * 10**10 - 100, 512 * 10**9 + 7, 5000], np.int64), np.array([1, 3, 40])
    given = mixing.allot(tokens.astype(float), np.array([0.9, 0.0999, 0.0001]), repeats, None)
    quota, mixed = mixing.whole_blocks(given, tokens, repeats, 512, 7)
    assert (abs(mixed - given) <= 256).all() and (mixed <= tokens * repeats).all()
    quota = np.array([9 * 10**9, 10**9, 100], np.int64)
    shards = 65_536 * 75
    some = list(mixing.draw_shards(quota, shards, 7, shards - 3, shards))
    assert [k for k, _, _ in some] == [shards - 3, shards - 2, shards - 1] and (some[-1][1] + some[-1][2] == quota).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 3), st.floats(0, 1)), min_size=1, max_size=5), st.integers(1, 64), st.integers(0, 9))
def test_quotas_are_the_nearest(sources, block, seed):
    tokens, repeats = np.array([t for t, _, _ in sources]), np.array([r for _, r, _ in sources])
    given = np.array([t * r * x for t, r, x in sources])
    quota, mixed = mixing.whole_blocks(given, tokens, repeats, block, seed)
    for i, (t, r, _) in enumerate(sources):
        n = -(-t // block)
        sizes = [0]
        for e in range(r):
            for x in mixing.permute(np.arange(n), np.full(n, n), mixing.block_key(seed, np.full(n, i), np.full(n, e))).tolist():
                sizes.append(sizes[-1] + (block if x < n - 1 else t - (n - 1) * block))
        assert mixed[i] == sizes[quota[i]]
        assert abs(mixed[i] - given[i]) <= min(abs(s - given[i]) for s in sizes) + 1e-6


DOCS = "doc_id long, source string, text string, slot long, block string"
WEIGHTS = "source string, target_share double, max_repeats int, n_tokens int"


def mix(spark, docs, weights, **kw):
    return mixing.mix_sources(spark.createDataFrame([(*d, 0, "x") for d in docs], DOCS), spark.createDataFrame([(*w, 0) for w in weights], WEIGHTS), block=16, shard_blocks=20, **kw)


def test_mix(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "abc"[min(2, i % 7)], " ".join(rng.choice(["oat", "milk", "salt", "wheat"], rng.integers(1, 90)))) for i in range(300)]
    docs += [(900, None, "null source"), (901, "unlisted", "x"), (902, "a", None), (903, "b", "")]
    got = mix(spark, docs, [("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.1, 1), ("empty", 0.1, 5)])
    slots, shares = got.slots.collect(), {r.source: r for r in got.shares.collect()}
    assert shares["empty"].mixed_tokens == 0
    used, at = {}, {}
    for s in slots:
        assert s.n_tokens == sum(p["to"] - p["from"] for p in s.parts) <= 16
        used.setdefault((s.source, s.block), []).append(s.epoch)
        at.setdefault(s.shard, []).append(s.slot)
        for p in s.parts:
            assert docs[p["doc_id"]][1] == s.source
    for slots_of in at.values():
        assert sorted(slots_of) == list(range(len(slots_of)))
    for (source, _), epochs in used.items():
        assert len(set(epochs)) == len(epochs) <= {"a": 3, "b": 2, "c": 1}[source]
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert shares[source].mixed_tokens == sum(s.n_tokens for s in slots if s.source == source)
        assert abs(shares[source].actual_share - share / 0.9) < 0.02
    # Every token of a source lies in exactly one block.
    blocks = {(s.source, s.block): s.parts for s in slots}
    seen = {}
    for parts in blocks.values():
        for p in parts:
            seen.setdefault(p["doc_id"], []).append((p["from"], p["to"]))
    for spans in seen.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_tokens(spark):
    from larder.llm import bpe

    texts = {i: " ".join(["oat", "milk", "salt", "wheat", "élan"][: 1 + i % 5] * (1 + i % 11)) for i in range(80)}
    docs = [(i, "ab"[i % 2], t) for i, t in texts.items()]
    got = mix(spark, docs, [("a", 0.5, 2), ("b", 0.5, 1)])
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], DOCS)
    rows = {(r.shard, r.slot): r for r in mixing.with_tokens(got.slots, df).collect()}
    encoder = bpe.Encoder(*bpe.read_vocabulary())
    slots = got.slots.collect()
    assert len(rows) == len(slots)
    for s in slots:
        want = [x for p in s.parts for x in encoder.encode(texts[p["doc_id"]])[p["from"] : p["to"]]]
        assert rows[s.shard, s.slot].ids == want and len(want) == s.n_tokens


def test_total_beyond_a_cap(spark):
    docs = [(i, "ab"[i % 2], "oat milk salt wheat " * 8) for i in range(40)]
    got = {r.source: r for r in mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 4)], total_tokens=10**6).shares.collect()}
    assert got["a"].mixed_tokens == got["a"].available_tokens and got["b"].mixed_tokens == 4 * got["b"].available_tokens and got["b"].most_uses == 4


@pytest.mark.parametrize("docs", [[], [(1, "a", None), (2, None, "x")]])
def test_nothing_to_mix(spark, docs):
    got = mix(spark, docs, [("a", 1.0, 1)])
    assert got.slots.count() == 0 and got.shares.head().actual_share == 0.0
    assert mix(spark, docs, []).slots.count() == 0


def test_same_seed_same_mix(spark):
    docs = [(i, "ab"[i % 2], "oat milk salt wheat " * (i % 9)) for i in range(60)]
    a, b, c = (sorted(map(str, mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], seed=s).slots.collect())) for s in (1, 1, 2))
    assert a == b != c
