import random

import pytest

from larder.llm import spans


def brute(texts, n):
    where = {}
    for k, t in texts.items():
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, t in texts.items():
        hit = set()
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                hit.update(range(i, i + n))
        if hit:
            out[k] = len(hit)
    return out


def run(spark, texts, n, **kw):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, anchor int, hash string").repartition(5)
    return {r.doc_id: r.shared_chars for r in spans.shared_spans(df, span=n, **kw).collect()}


@pytest.mark.parametrize(("n", "seed"), [(12, 1), (12, 2), (30, 3), (30, 4)])
def test_against_brute_force(spark, n, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdé 😀", k=k))
    passages = [word(rng.randint(n - 3, 4 * n)) for _ in range(6)]
    texts = {}
    for k in range(60):
        parts = [word(rng.randint(0, 2 * n))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, 5)
            parts += [p[lo : rng.randint(lo, len(p)) if rng.random() < 0.3 else None], word(rng.randint(0, n))]
        texts[k] = "".join(parts)
    texts |= {100: None, 101: "", 102: "a", 103: "a" * 200, 104: "b" * 150, 105: "b" * 130, 106: texts[0], 107: "ab" * 90, 108: "ba" * 70}
    assert run(spark, texts, n) == brute(texts, n)


def test_crowded_anchors(spark):
    """One stretch, shorter than a span, in hundreds of contexts, some of which come twice."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    stretch = word(28)
    texts = {k: word(40) + stretch + word(40) for k in range(150)}
    texts |= {1000 + k: word(9) + texts[k][20:80] + word(9) for k in range(0, 150, 5)}
    want = brute(texts, 36)
    assert len(want) >= 60 and run(spark, texts, 36, crowd=10) == run(spark, texts, 36) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 64)
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh", k=900))
    texts = {1: long, 2: "zz" + long[300:480] + "yy", 3: "".join(rng.choices("ijkl", k=500)), 4: long[-40:], 5: long[:200] + long[:200]}
    monkeypatch.setattr(spans, "_pieces", spans._pieces)
    assert run(spark, texts, 20) == brute(texts, 20)


def test_passage_in_a_third_of_all_texts(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    passage = word(70)
    texts = {k: word(50) + (passage if k % 3 == 0 else "") + word(50) for k in range(600)}
    assert run(spark, texts, 40) == brute(texts, 40)


def test_repeats_inside_one_text_and_empty_table(spark):
    p = "the same passage, word for word, again"
    assert run(spark, {1: p + "--" + p, 2: "nothing of the kind in here at all, no"}, 20) == {}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_spans(df).count() == 0 and spans.shared_units(df).count() == 0


def test_null_and_repeated_keys(spark):
    p = "the same passage, word for word, again"
    df = spark.createDataFrame([(1, p), (1, p), (None, "x" + p), (2, "nothing of the kind in here at all, no"), (None, None)], "doc_id long, text string")
    assert spans.shared_spans(df, span=20).count() == 0
    more = df.unionByName(spark.createDataFrame([(3, "--" + p)], "doc_id long, text string"))
    assert {r.doc_id: r.shared_chars for r in spans.shared_spans(more, span=20).collect()} == {1: len(p), 3: len(p)}


def test_units(spark):
    a, b = "A line of more than forty characters, in full", "a LINE of more  than forty characters, in full"
    data = [(2, f"x\n{a}"), (1, f"{b}\n\nshort\n{a}"), (3, None), (4, ""), (5, "short\nshort")]
    got = {(r.doc_id, r.unit_no): r for r in spans.shared_units(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 1)} and all(r.copies == 3 for r in got.values())
    assert [k for k, r in got.items() if r.keep] == [(1, 0)]
    texts = dict(data)
    for (doc, _), r in got.items():
        assert texts[doc][r.start : r.start + r.n_chars] in (a, b)
