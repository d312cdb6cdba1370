import re
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larder.operators import rejects

N = len(rejects.PRODUCT_LINE)


def brute(line):
    """The dialect, character by character: reason, fields."""
    if line is None:
        return "columns", None
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            value, i = "", i + 1
            while True:
                end = line.find('"', i)
                if end < 0:
                    return "quoting", None
                value += line[i:end]
                if line[end + 1 : end + 2] != '"':
                    i = end + 1
                    break
                value, i = value + '"', end + 2
            if i < len(line) and line[i] != "\t":
                return "quoting", None
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            value, i = line[i:end], end
        fields.append(value)
        if i >= len(line):
            break
        i += 1
    if len(fields) != N:
        return "columns", None
    sound = re.fullmatch("[0-9]{8,14}", fields[0]) and (fields[14] == "" or re.fullmatch(r"[0-9]+(\.[0-9]+)?", fields[14]) and float(fields[14]) <= 1.1)
    if not sound or any(re.search("[\x00-\x08\x0b-\x1f\x7f-\x9f�]", fields[k]) for k in (1, 4)):
        return "value", None
    return None, fields


def check(spark, lines):
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(lines)], "line_id long, raw_line string, reason int")
    got = {r.line_id: r.reason for r in rejects.with_reason(df).collect()}
    want = {i: brute(x)[0] for i, x in enumerate(lines)}
    assert got == want
    good = {r.line_id: r for r in rejects.loaded(df, keep=("line_id",)).collect()}
    assert set(good) == {i for i, w in want.items() if w is None}
    for i, r in good.items():
        fields = brute(lines[i])[1]
        assert [r[f.name] for f in rejects.PRODUCT_LINE[:-1]] == [f or None for f in fields[:-1]]
        assert r.completeness == (float(fields[-1]) if fields[-1] else None)


def test_cases(spark):
    good = ["12345678", "name", "", "1 l", "a, b", "", "", "", "", "", "", "", "", "", "0.5"]
    change = lambda i, x: "\t".join([*good[:i], x, *good[i + 1 :]])
    lines = [None, "", "\t" * 14, "\t".join(good), "\t".join(good[:-1]), "\t".join([*good, "x"]), change(1, '"tab\tand\nline"'), change(1, '"a ""b"" c"'), change(1, '"open'), change(1, '"a"b'), change(1, 'a"b'), change(1, '""')]
    lines += [change(14, x) for x in ("", "1", "1.1", "1.10", "01.1", "1.11", "1.", ".5", "-1", "2", "1e0", '"0.3"', "0.999999")]
    lines += [change(0, x) for x in ("1234567", "123456789012345", "12345678a", '"12345678"', "１２３４５６７８", "")]
    lines += [change(4, x) for x in ("a\x7fb", "a�", "a\rb", "a\nb", '"a\x00b"', "a\u0085")] + [change(2, "\x00"), change(3, "x" * 200_000), change(4, '"' + '""' * 50_000 + '"')]
    check(spark, lines + lines[3:6])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["", "12345678", "a", '"', '""', '"a"', '"a\t', "1.1", "\x01", '"x""y"']), min_size=12, max_size=17).map("\t".join), min_size=1, max_size=40))
def test_random(spark, lines):
    check(spark, lines)


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string")
    assert rejects.rejected(df).count() == 0 and rejects.loaded(df).count() == 0


def test_bad_field(spark):
    good = ["12345678", "a", "", "", "x", *[""] * 9, "1"]
    change = lambda i, x: "\t".join([*good[:i], x, *good[i + 1 :]])
    lines = {
        1: change(4, "x\x01"), 2: change(1, '"a'), 3: "x", 4: "\t".join(good[:9]), 5: "\t".join([*good, "more"]), 6: "\t".join([*good, '"more']), 7: None, 8: "", 9: change(14, "9"), 10: change(0, ""),
        11: "\t".join([*good[:4], "x\x01"]), 12: "\t".join(good),
    }
    df = spark.createDataFrame(list(lines.items()), "line_id long, raw_line string")
    got = {r.line_id: (r.reason, r.bad_field) for r in rejects.rejected(df).collect()}
    assert got == {
        1: ("value", "ingredients_text"), 2: ("quoting", "product_name"), 3: ("columns", "code"), 4: ("columns", "origins"), 5: ("columns", None), 6: ("quoting", None), 7: ("columns", "code"), 8: ("columns", "code"),
        9: ("value", "completeness"), 10: ("value", "code"), 11: ("columns", "ingredients_text"),
    }


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_the_query_names_the_first_broken_field(spark):
    from larder.queries import QUERIES

    at = "/root/testdata/sf0.1"
    lines = {r.line_id: r.raw_line for r in spark.read.parquet(f"{at}/product_lines.parquet").collect()}
    plan = QUERIES["p1_found"](spark, at)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") >= 2  # both prefix patterns
    got = QUERIES["p1_reasons"](spark, at).collect()
    assert {(r.line_id, r.reason) for r in got} == {tuple(r) for r in plan.collect()}
    values = [r for r in got if r.reason == "value"]
    assert values
    for r in values:
        cells = re.findall(r'(?:^|\t)("(?:[^"]|"")*"|[^\t]*)', lines[r.line_id])
        fits = [re.fullmatch(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), f'"{f.quoted}"|{f.plain}'), c) is not None for f, c in zip(rejects.PRODUCT_LINE, cells)]
        assert rejects.PRODUCT_LINE[fits.index(False)].name == r.bad_field


def test_raw_files(spark, tmp_path):
    from larder.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.tsv").write_text("a\tb\n" + "".join(f"{i}\tx{i}\n" for i in range(5000)) + '"q ""u"""\t\nshort\nto\to\tlong\n"a"b\tx\n')
    (tmp_path / "a" / "two.tsv").write_text("a\tb\nlast\tend\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = files.read_delimited(spark, str(tmp_path / "a"), ["b", "a"])
        assert got.rdd.getNumPartitions() > 4
        rows = {(r.a, r.b) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows == {(str(i), f"x{i}") for i in range(5000)} | {('q "u"', None), ("last", "end")}
    (tmp_path / "b.tsv").write_text('a\tb\n"two\nlines"\tx\nshort\n')
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "b.tsv"), ["a", "b"]).collect()] == [("two\nlines", "x")]
    (tmp_path / "c.tsv").write_text("\n".join(["\t".join(["12345678", *[""] * 14]), "12\t" + "\t" * 13, "x"]) + "\n")
    loaded, rejected = files.load_lines(spark, str(tmp_path / "c.tsv"))
    assert [r.code for r in loaded.collect()] == ["12345678"] and sorted((r.reason, r.bad_field) for r in rejected.collect()) == [("columns", "code"), ("value", "code")]
