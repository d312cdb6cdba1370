import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.operators import packed
from larder.operators.packed import LABEL_TEXT, NAMES, TAGS, split_array, split_cells


def split(text, style):
    return split_array(pa.array([text], pa.string()), style)[2].to_pylist()


def brute(text, marks, brackets, digits):
    """Character by character, for text with balanced quotes and without captions and full stops."""
    out, now, quoted, depth = [], "", False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and brackets and c in "([":
            depth += 1
        elif not quoted and brackets and c in ")]":
            depth = max(0, depth - 1)
        between = digits and c == "," and text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()
        if c in marks and not quoted and not depth and not between:
            out.append(now)
            now = ""
        else:
            now += c
    values = [v.strip() for v in [*out, now]]
    values = [v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' and '"' not in v[1:-1] else v for v in values]
    return [v for v in values if v.strip()]


def test_labels():
    assert split('Ingredients: water, "sugar, brown"; salt (sea, rock) 4,5 %.', LABEL_TEXT) == ["water", "sugar, brown", "salt (sea, rock) 4,5 %"]
    assert split("riz • sel · ail / eau | lait\nnoix", LABEL_TEXT) == ["riz", "sel", "ail", "eau", "lait", "noix"]
    assert split("a. Zutaten: b, c. Ingrédients : d.", LABEL_TEXT) == ["a", "b", "c", "d"]
    assert split("ratio 1:2, x", LABEL_TEXT) == ["ratio 1:2", "x"]
    assert split("a,, ,b,", LABEL_TEXT) == ["a", "b"]
    assert split('x"y, z', LABEL_TEXT) == ['x"y', "z"]


def test_long_captions():
    long = "ingredients of the creamy filling and of the crisp coating made in our own bakery"
    script = "Состав начинки и глазури этого замечательного продукта"
    assert len(long) > 61 and len(script.encode()) > 61
    assert split(f"{long}: milk, salt. {script}: соль", LABEL_TEXT) == ["milk", "salt", "соль"]


def test_other_styles():
    assert split('en:a, "en:b, c";fr:d|', TAGS) == ["en:a", "en:b, c", "fr:d"]
    assert split('pulp, apple$$ "Kind, sorted" | x;', NAMES) == ["pulp, apple", "Kind, sorted", "x"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab1 ,;|"()é•', max_size=30).filter(lambda t: t.count('"') % 2 == 0))
def test_against_brute_force(text):
    assert split(text, LABEL_TEXT) == brute(text, ",;|/\n•·", True, True)
    assert split(text, TAGS) == brute(text, ",;|", False, False)


def test_table(spark):
    long = ", ".join(f"v{i}" for i in range(50_000))
    data = [(1, "a, b", "x"), (2, None, "x"), (3, "", None), (4, "  ", "x"), (1, "a, b", "x"), (5, long, "x"), (6, '""', "x")]
    df = spark.createDataFrame(data, "row_id long, cell string, value string")
    got = split_cells(df, "cell", ("row_id",), LABEL_TEXT).collect()
    assert sorted((r.row_id, r.pos, r.value) for r in got if r.row_id < 5) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert [r.value for r in got if r.row_id == 5] == long.split(", ") and not [r for r in got if r.row_id == 6]
    assert split_cells(df.limit(0), "cell", ("row_id",), packed.TAGS).count() == 0
