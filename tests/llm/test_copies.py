import re
from collections import defaultdict

import pytest

from larder.llm import copies


def brute(data):
    groups = defaultdict(list)
    for row, code, text in data:
        if code is not None and text is not None and row is not None:
            groups[code, tuple(sorted(re.findall(r"[^\W_]+", text.lower())))].append(row)
    return sorted((min(g), r) for g in groups.values() for r in g if r != min(g))


def run(spark, data, **kw):
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "row_id long, code string, ingredient string, canon int, copies string").repartition(4)
    return sorted((r.keep_row_id, r.copy_row_id) for r in copies.copies(df, **kw).collect())


DATA = [(1, "a", "Oat Milk"), (2, "a", "milk, oat!"), (3, "a", "milk_oat"), (4, "b", "oat milk"), (5, "a", "oat milk milk"), (6, None, "oat milk"), (7, "a", None), (8, "a", ""), (9, "a", "***"), (10, "a", "ｏat"), (11, "b", "Oat  MILK")]


def test_cases(spark):
    assert run(spark, DATA) == brute(DATA) == [(1, 2), (1, 3), (4, 11), (8, 9)]


@pytest.mark.parametrize("fits", [1, 3, 1000])
def test_buckets_are_split(spark, fits):
    data = [(i, f"20000{i % 50:03d}", f"word{i % 7} salt" if i % 2 else f"salt, Word{i % 7}") for i in range(700)]
    assert run(spark, data, fits=fits) == brute(data)


def test_one_group_holds_a_third(spark):
    data = [(i, "x" if i % 3 == 0 else str(i), "Salt" if i % 2 else " salt ") for i in range(1500)]
    assert run(spark, data, fits=100) == brute(data)


def rounds(spark, data, fits, monkeypatch):
    made = []
    monkeypatch.setattr(copies, "materialise", lambda df: made.append(1) or df)
    assert run(spark, data, fits=fits) == brute(data)
    return len(made)


def test_a_hot_record_takes_no_further_rounds(spark, monkeypatch):
    few = [(i, "7", f"oat milk salt rice flour bean{i}") for i in range(150)]
    hot = [(1000 + i, "7", "Oat milk, salt rice flour bean7") for i in range(300)]
    assert rounds(spark, few + hot, 20, monkeypatch) <= rounds(spark, few, 20, monkeypatch) + 1


def test_rounds_grow_with_the_logarithm_of_the_length(spark, monkeypatch):
    data = [(i, "7", "a" * (3 * i + 1)) for i in range(120)]  # each the prefix of the next
    assert rounds(spark, data, 2, monkeypatch) <= 9


def test_buckets_fit(spark):
    keys = spark.createDataFrame([(f"{i % 3}{i:04d}" if i % 2 else f"same long beginning {i:03d}", 1, i) for i in range(400)], "canon string, copies long, keep long")
    got = copies._buckets(keys, 30).collect()
    assert len(got) == 400 and all(r.canon.startswith(r.bucket) for r in got)
    sizes = {}
    for r in got:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
    assert max(sizes.values()) <= 30


def test_long_texts_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    data = [(1, "a", long), (2, "a", long.upper()), (3, "a", long[:-1])]
    assert run(spark, data) == brute(data)
    assert run(spark, []) == []


def test_counts(spark):
    df = spark.createDataFrame(DATA, "row_id long, code string, ingredient string")
    assert {r.keep: r.copies for r in copies.count_copies(df).collect()}[1] == 3
