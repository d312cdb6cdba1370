import numpy as np
import pytest

from larder.operators import vectors as V


def table(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    return x, spark.createDataFrame([(i, [float(z) for z in r], int(i % 3), "x") for i, r in enumerate(x)] + [(1000 + seed, None, 0, "x")], "id long, vec array<double>, label int, q string")


@pytest.mark.parametrize("most", [1 << 24, 60])
def test_top_k_held_and_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_NUMBERS", most)
    (x, a), (y, b) = table(spark, 40, 4, 1), table(spark, 70, 4, 2)
    got = {}
    for r in V.top_k(a.withColumnRenamed("id", "query_id"), b.withColumnRenamed("id", "item_id"), 3).collect():
        got[r.query_id, r["rank"]] = (r.item_id, round(r.score, 9))
    s = x @ y.T
    want = {(i, k + 1): (int(j), round(float(s[i, j]), 9)) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(70), -np.round(s[i], 12)))[:3])}
    assert got == want
    assert V.top_k(a.withColumnRenamed("id", "query_id"), b.limit(0).withColumnRenamed("id", "item_id"), 3).count() == 0


@pytest.mark.parametrize("most", [1 << 24, 50])
def test_silhouettes_held_and_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_NUMBERS", most)
    x, df = table(spark, 50, 3, 5)
    label = np.arange(50) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(50):
        a = d[i][label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(d[i][label == c].mean() for c in range(3) if c != label[i])
        want[i] = (b - a) / max(a, b)
    got = {r.id: r.silhouette for r in V.silhouettes(df, "id", "vec", "label").collect()}
    assert sorted(got) == sorted(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_children_beyond_the_bound_are_refused(spark, monkeypatch):
    _, df = table(spark, 10, 3, 5)
    nodes = df.selectExpr("cast(id as string) node", "'' name", "'' parent", "vec")
    assert V.top_children(df.selectExpr("id", "vec"), nodes.limit(0), 2, "c").where("size(c) > 0").count() == 0
    got = {r.id: [c.node for c in r.c] for r in V.top_children(df.selectExpr("id", "vec"), nodes, 2, "c").collect()}
    assert got[1005] == [] and len(got[0]) == 2
    monkeypatch.setattr(V, "MOST_NUMBERS", 20)
    with pytest.raises(ValueError):
        V.top_children(df.selectExpr("id", "vec"), nodes, 2, "c")
