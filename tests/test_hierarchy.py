import pytest
from pyspark.sql import functions as F

from larder.operators import hierarchy as H
from larder.operators import matching as M

TERMS = [
    ("R", "root", "Z0001", 1), ("A", "alpha", "Z0001.0001", 2), ("B", "lonely", "Z0001.0002", 2), ("A1", "one", "Z0001.0001.0001", 3), ("A2", "bare", "Z0001.0001.0002", 3),
    ("X", "deep", "Z0001.0001.0001.0001", 4), ("Y", "deeper", "Z0001.0001.0001.0001.0001", 5), ("O", "orphan", "Z0001.0009.0009.0001", 4), ("Z", "outside", "Z0002.0001", 2),
]


@pytest.fixture(scope="module")
def ix(spark):
    return H.index(spark.createDataFrame(TERMS, "termCode string, termExtendedName string, reportHierarchyCode string, reportHierarchyLevel int"))


def test_tree(ix):
    assert {r.child: r.parent for r in H.parents(ix).collect()} == {"A1": "A", "A2": "A", "X": "A1", "Y": "A1"}
    assert {r.parent: r.children for r in H.children(ix).collect()} == {"A": ["A1", "A2"], "A1": ["X", "Y"]}
    got = {r.term: (r.level2_code, r.level3_code, r.specific_code) for r in H.resolve(ix).collect()}
    assert got["Y"] == ("A", "A1", "Y") and got["O"] == (None, None, "O") and got["A"] == ("A", None, None)
    assert [r.ancestor for r in H.ancestors(ix).where("term = 'Y'").orderBy("level").collect()] == ["R", "A", "A1", "X", "Y"]
    assert {(r.parent, r.child) for r in H.direct_children(ix).collect()} == {("R", "A"), ("R", "B"), ("A", "A1"), ("A", "A2"), ("A1", "X"), ("X", "Y")}


def test_facets(spark):
    df = spark.createDataFrame([("a", "A000B#F01.A059N$F02.bad", '["F03.A1111"]'), ("b", "F01.A059N", None), ("c", "x#F01.A059N", "broken"), ("d", "x#F01.A059N", "[]"), ("e", None, None)], "k string, raw string, js string")
    got = {r.k: [(x.cat, x.code) for x in r.f] for r in df.select("k", H.resolved_facets(F.col("js"), F.col("raw")).alias("f")).collect()}
    assert got == {"a": [("F03", "A1111")], "b": [], "c": [("F01", "A059N")], "d": [("F01", "A059N")], "e": []}
    names = spark.createDataFrame([("A059N", "n")], "code string, name string")
    assert [(r.k, r.facet_label, r.name) for r in H.facets(df, "raw", "k", names).orderBy("k").collect()] == [("a", "source", "n"), ("b", "source", "n"), ("c", "source", "n"), ("d", "source", "n")]


def nodes(spark):
    data = [("L", "", 2, "", [1.0, 0.0]), ("M", "", 2, "", [0.0, 1.0]), ("L1", "", 3, "L", [1.0, 0.0]), ("L2", "", 3, "L", [0.8, 0.6]), ("s", "sweet thing", 4, "L1", [1.0, 0.0])]
    return spark.createDataFrame(data, "node string, name string, level int, parent string, vec array<double>")


def test_beam(spark):
    q = spark.createDataFrame([(1, "sweet thing", [1.0, 0.0]), (2, "x", [0.0, 1.0]), (3, "x", [-1.0, -1.0]), (4, "x", None)], "query_id int, name string, vec array<double>")
    got = {r.query_id: r for r in M.beam(q, nodes(spark), M.MatchParams((0.5, 0.5, 0.9))).collect()}
    assert (got[1].confidence, got[1].specific_code, round(got[1].path_score, 6)) == ("HIGH", "s", 1.0)
    assert (got[2].confidence, got[2].level2_code, got[2].level3_code) == ("LOW", "M", None)
    assert (got[3].confidence, got[3].final_level, got[3].path_score) == ("NO_MATCH", 2, 0.0)
    assert (got[4].confidence, got[4].final_level) == ("NO_MATCH", 0)
    greedy = {r.query_id: r.confidence for r in M.greedy(q.where("vec is not null"), nodes(spark), M.MatchParams((0.5, 0.5, 0.9))).collect()}
    narrow = {r.query_id: r.confidence for r in M.beam(q.where("vec is not null"), nodes(spark), M.MatchParams((0.5, 0.5, 0.9), (1, 1, 1))).collect()}
    assert greedy == narrow


def test_match_names(spark):
    terms = spark.createDataFrame([("A", "Foods", "Z0001.0001", 2), ("B", "Juices", "Z0001.0001.0001", 3), ("C", "Juice, apple", "Z0001.0001.0001.0001", 4)], "termCode string, termExtendedName string, reportHierarchyCode string, reportHierarchyLevel int")
    q = spark.createDataFrame([("Apple juice",), ("aple juice",), ("qqq",), (None,)], "ingredient string")
    got = {r.ingredient: (r.term, r.mode) for r in M.match_names(q, terms).collect()}
    assert got["Apple juice"] == ("C", "rf_exact") and got["aple juice"] == ("C", "rf_reranked") and got["qqq"][1] == "beam" and len(got) == 3
