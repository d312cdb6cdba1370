import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import canonical as cn

NAMES = [
    ("A1", "Juice, apple"), ("A1", "pressed apple"), ("A2", "Apple"), ("A3", "Flour, faba bean"), ("A3", "broad bean flour"), ("A4", "Citric acid (E330)"), ("A4", "e 330"), ("A5", "Molasses"), ("A6", "Cream cheese"), ("A7", "Cream"),
    ("A8", "Tomato in brine"), ("A9", "Salt"), ("B1", "Wheat flour"), ("B2", "Rye flour"), ("B3", "Oat flour"), ("B4", "Pear juice"), *((f"C{i}", f"Food{chr(97 + i) * 3} juice") for i in range(12)),
]
MODIFIERS = frozenset("organic certified first quality".split())
MATCH = cn.Matcher(NAMES, MODIFIERS)


@pytest.mark.parametrize(("value", "code"), [
    ("apple juice", "A1"), ("JUICE / APPLE", "A1"), ("apple juices", "A1"), ("organic apple juice", "A1"), ("apple juice (certified organic)", "A1"), ("first quality apple", "A2"), ("faba bean flour", "A3"), ("broad-bean flour", "A3"),
    ("E330", "A4"), ("e-330", "A4"), ("citric acid", "A4"), ("E331", "NONE"), ("molasses", "A5"), ("molsases", "A5"), ("cream cheese", "A6"), ("cream", "A7"), ("in brine, tomato", "A8"), ("aple juice", "A1"), ("applejuice", "A1"),
    ("appl ejuice", "A1"), ("аpple juiсe", "A1"), ("apple jce", "A1"), ("apple", "A2"), ("quince juice", "NONE"), ("apple infusion", "NONE"), ("juice", "NONE"), ("", "NONE"), ("   ", "NONE"), ("***", "NONE"), ("organic", "NONE"), (None, "NONE"),
    ("salt*", "A9"), ("sal", "A9"), ("wheat flr", "B1"), ("par juice", "B4"),
])
def test_cases(value, code):
    assert MATCH.match(value)[0] == code


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_one_edit(a, b):
    def near(a, b):
        if a == b:
            return True
        swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        losses = {a[:i] + a[i + 1 :] for i in range(len(a))}
        changes = {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"}
        gains = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"}
        return b in swaps | losses | changes | gains

    assert (cn.one_edit(a, b) < 9) == near(a, b)


def test_slips_are_found():
    rng = random.Random(2)
    for code, name in NAMES[:1] + NAMES[3:4] + NAMES[12:13]:
        words = cn.words_of(name)
        text = " ".join(words)
        for _ in range(100):
            i = rng.randrange(1, len(text) - 1)
            slip = rng.choice([text[:i] + text[i + 1 :], text[:i] + text[i] + text[i:], text[: i - 1] + text[i] + text[i - 1] + text[i + 1 :]])
            assert MATCH.match(slip)[0] == code, slip


def test_table(spark):
    terms = spark.createDataFrame([("A1", "Juice, apple", "pressed apple$x"), ("A2", None, "pome"), (None, "lost", None)], "termCode string, termExtendedName string, commonNames string")
    data = [(1, "apple juice", 1), (2, None, 1), (3, "", 1), (4, "pome", 1), (1, "apple juice", 1), (5, "lost", 1), (6, "x y " * 20_000, 1)]
    df = spark.createDataFrame(data, "row_id long, ingredient string, term_code int")
    got = sorted((r.row_id, r.term_code) for r in cn.map_to_list(df, terms).collect())
    assert got == [(1, "A1"), (1, "A1"), (2, "NONE"), (3, "NONE"), (4, "A2"), (5, "NONE"), (6, "NONE")]
    assert {r.term_code for r in cn.map_to_list(df, terms.limit(0)).collect()} == {"NONE"}
    assert cn.map_to_list(df.limit(0), terms).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0.0, 0.9, 1.0, 1.2, 9.0]), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_pairing_is_the_cheapest(cost):
    n = len(cost)
    want = min((sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)) if all(cost[i][p[i]] < cn.APART for i in range(n))), default=cn.APART)
    assert abs(cn.paired(cost) - want) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=3), max_size=4), st.lists(st.text(alphabet="ab", min_size=1, max_size=3), max_size=4))
def test_piles_run_together(left, right):
    want = bool({"".join(p) for p in permutations(left)} & {"".join(p) for p in permutations(right)})
    assert cn._same_run(tuple(left), tuple(right)) == want


LONG = "sun dried plum tomato paste with sweet basil oil"


def test_long_names_in_any_order_joined_and_with_slips():
    match = cn.Matcher([("L", LONG), ("S", "tomato paste")], MODIFIERS).match
    words = LONG.split()
    rng = random.Random(4)
    for _ in range(20):
        rng.shuffle(words)
        text = " ".join(words)
        assert match(text) == ("L", "mention") and match("organic " + text)[0] == "L"
        assert match(text.replace(" ", "", 3))[0] == "L" and match(text.replace(" ", ""))[0] == "L"
        assert match(text.replace("dried", "dreid").replace("tomato", "tomatto"))[0] == "L"
        assert match(text.replace("basil", "basl").replace(" ", ""))[0] == "L"


def held_out(spark):
    foods = [f"{a}{b}" for a in ("bra", "klo", "mur", "tes", "vin") for b in ("gat", "lep", "nost", "dim")]
    names = [(f"F{i}", f) for i, f in enumerate(foods)] + [("P", "powder")] + [(f"Q{i}", f"{f} powder") for i, f in enumerate(foods)]
    seen = [f"{m} {f}" for i, f in enumerate(foods) for j, m in enumerate(("artisan", "sun-ripened", "chopped")) if (i + j) % 2]
    return foods, names, spark.createDataFrame([(v,) for v in [*seen, "brown sugar", "zorn powder", "zorn", "bragat pwoder", *(f"{f} pwdr" for f in foods)]], "v string")


def test_modifiers_are_learned(spark):
    foods, names, values = held_out(spark)
    got = cn.learn_modifiers(values.union(values), "v", names)
    assert got == {"artisan", "sun", "ripened", "chopped"}
    match = cn.Matcher(names, got).match  # names and modifiers that have not met
    assert all(match(f"{m} {f}")[0] == f"F{i}" for i, f in enumerate(foods) for m in ("artisan", "sun-ripened", "chopped"))
    assert match("zorn powder")[0] == match("artisan zorn")[0] == match("brown sugar")[0] == cn.NONE
    assert match("artisan bragat powder")[0] == "Q0" and match("chopped bragat pwoder")[0] == "Q0"
    assert cn.learn_modifiers(values.limit(0), "v", names) == cn.learn_modifiers(values, "v", []) == frozenset()


def test_a_list_beyond_its_bound_is_refused(spark, monkeypatch):
    terms = spark.createDataFrame([("A1", "apple", None), ("A2", "pear", None)], "termCode string, termExtendedName string, commonNames string")
    monkeypatch.setattr(cn, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        cn.reference_names(terms, "termCode", "termExtendedName", "commonNames")
    monkeypatch.setattr(cn, "MOST_TERMS", 2)
    assert len(cn.reference_names(terms, "termCode", "termExtendedName", "commonNames")) == 2
    monkeypatch.setattr(cn, "MOST_LETTERS", 12)
    with pytest.raises(ValueError):
        cn.reference_names(terms, "termCode", "termExtendedName", "commonNames")
