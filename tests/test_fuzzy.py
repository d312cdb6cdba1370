from hypothesis import given, settings
from hypothesis import strategies as st

from larder.functions import fuzzy

WORD = st.text(alphabet="abc ", max_size=12)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(WORD, WORD)
def test_scores(a, b):
    assert fuzzy.lcs_length(a, b) == lcs(a, b)
    assert 0 <= fuzzy.weighted(a, b) <= 100 and fuzzy.ratio(a, a) == 100
    assert abs(fuzzy.ratio(a, b) - fuzzy.ratio(b, a)) < 1e-9 and 0 <= fuzzy.jaro_winkler(a, b) <= 1
    sub = fuzzy.common_substring(a, b)
    assert sub in a and sub in b and not any(a[i : i + len(sub) + 1] in b for i in range(len(a) - len(sub)))
    assert not any(a[i : i + len(sub)] in b for i in range(a.index(sub)))


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_partial_is_the_best_stretch(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    stretches = [long[i : i + n] for i in range(len(long) - n + 1)] + [x for k in range(1, n) for x in (long[:k], long[-k:])]
    want = max((fuzzy.ratio(short, x) for x in stretches), default=0.0)
    assert abs(fuzzy.partial(a, b) - (want if short else 0.0)) < 1e-9


def composite(a, b):
    """weighted() from its definition, without bounds."""
    if not a or not b:
        return 0.0
    longer, best = max(len(a), len(b)) / min(len(a), len(b)), fuzzy.ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * fuzzy.token_sort(a, b), 0.95 * fuzzy.token_set(a, b))
    scale, x, y = 0.9 if longer < 8 else 0.6, set(a.split()), set(b.split())
    flat = lambda w: " ".join(sorted(w))
    token = 100.0 if x & y else max(fuzzy.partial(flat(x), flat(y)), fuzzy.partial(flat(a.split()), flat(b.split())))
    return max(best, scale * fuzzy.partial(a, b), 0.95 * scale * token)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abc ", max_size=24), WORD, st.sampled_from([0.0, 50.0, 80.0]))
def test_bounds_lose_nothing(a, b, least):
    want = composite(a, b)
    assert abs(fuzzy.weighted(a, b) - want) < 1e-9
    assert abs(fuzzy.weighted(a, b, least) - want) < 1e-9 if want >= least else fuzzy.weighted(a, b, least) <= want + 1e-9


LIST = ["apple juice", "juice apple", "apple", "pear juice concentrate", "salt salt", "", " ", "a", "b" * 70, "juice " * 14, "sea  salt", "carrot", "apple juice from concentrate of apples", "ab ba", "cab"]


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, max_size=8), WORD | st.sampled_from([*LIST, "aple juice", "juice", "slat", "concentrate"]), st.sampled_from([0.0, 40.0, 65.0, 90.0]))
def test_the_whole_list_at_once(strings, text, cutoff):
    strings = [*strings, *LIST]
    at, score = fuzzy.Weighted(strings)(text, cutoff)
    want = {i: s for i, x in enumerate(strings) if (s := fuzzy.weighted(text, x)) >= cutoff}
    assert at.tolist() == sorted(want) and all(abs(want[i] - s) < 1e-9 for i, s in zip(at.tolist(), score.tolist()))


def test_phonetic():
    assert fuzzy.phonetic("phone") == fuzzy.phonetic("fone") and fuzzy.phonetic("knight") == fuzzy.phonetic("nite")
