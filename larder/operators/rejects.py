"""Rows that fail to parse: one anchored pattern for whole rows, field-prefix patterns for the ones that miss it.

The patterns are generated from a schema and run as Java patterns inside the plan. The prefix patterns of 1, 2, .. fields
are nested into one, which takes in field after field in a single pass; how far it comes tells the first broken field.
Every repetition is possessive, so they neither backtrack nor recurse, whatever the length of a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a quoted value may hold, and a plain one (it doesn't begin with a quote).
_QUOTED, _PLAIN = r'"[^"]*+(?:""[^"]*+)*+"', r'(?:[^"\t][^\t]*+)?+'
_CELL = rf"(?:{_QUOTED}|{_PLAIN})(?=\t|\z)"
#: Control characters other than tab and line feed, and the replacement character.
_BAD = r"\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}\x{FFFD}"


@dataclass(frozen=True)
class Field:
    """A field of a tab-separated record. plain: pattern of its unquoted values; quoted: of the text between its quotes."""

    name: str
    plain: str = r'(?:[^"\t][^\t]*+)?+'
    quoted: str = r'[^"]*+(?:""[^"]*+)*+'
    type: str = "string"

    @property
    def cell(self) -> str:
        return rf'(?:"{self.quoted}"|{self.plain})(?=\t|\z)'


def code_field(name: str) -> Field:
    return Field(name, r"[0-9]{8,14}+", r"[0-9]{8,14}+")


def clean_field(name: str) -> Field:
    """Text without control characters (tab and line feed may stand) and without U+FFFD."""
    return Field(name, rf'(?:[^"\t{_BAD}][^\t{_BAD}]*+)?+', rf'[^"{_BAD}]*+(?:""[^"{_BAD}]*+)*+')


def share_field(name: str) -> Field:
    """Empty, or digits with an optional point and more digits, at most 1.1."""
    number = r"(?:0*+1(?:\.(?:0[0-9]*+|10*+))?+|0++(?:\.[0-9]++)?+)?+"
    return Field(name, number, number, "double")


PRODUCT_LINE = (
    code_field("code"), clean_field("product_name"), Field("generic_name"), Field("quantity"), clean_field("ingredients_text"), Field("categories"), Field("brands"),
    Field("labels"), Field("packaging"), Field("origins"), Field("manufacturing_places"), Field("traces"), Field("additives"), Field("allergens"), share_field("completeness"),
)


def row_pattern(schema: tuple[Field, ...]) -> str:
    return r"\A" + r"\t".join(f.cell for f in schema) + r"\z"


def prefix_pattern(cells: list[str]) -> str:
    """As many of the cells as fit, one after another, each behind a tab: the pattern of every prefix in one."""
    out = ""
    for cell in reversed(cells):
        out = rf"(?:\t{cell}{out})?+"
    return r"\A" + out


def _taken(line: Column, pattern: str) -> tuple[Column, Column]:
    """Fields that a prefix pattern takes in, and whether they are the whole row."""
    row = F.concat(F.lit("\t"), line)
    got = F.regexp_extract(row, pattern, 0)
    return F.regexp_count(got, F.lit(rf"\G\t{_CELL}")), F.length(got) == F.length(row)


def with_reason(lines: DataFrame, line: str = "raw_line", schema: tuple[Field, ...] = PRODUCT_LINE) -> DataFrame:
    """lines with `reason` (null for a row that loads) and `bad_field`, the first field that breaks.

    reason is the first that holds of `quoting`, `columns` (not as many fields as the schema) and `value`. bad_field is
    the field whose quotes are broken, else the first that the prefix patterns don't take in: it has a wrong value or is
    missing; null where all fields of the schema are sound and more follow. A null row has no fields, an empty one an
    empty field. All columns of lines are kept; columns named reason or bad_field are replaced. Repeated rows are
    judged alike. Only rows that miss the whole-row pattern meet the others.
    """
    c = F.coalesce(F.col(line), F.lit(""))
    cells, all_sound = _taken(c, rf"\A(?:\t{_CELL})*+")
    passed, _ = _taken(c, prefix_pattern([f.cell for f in schema]))
    fails = ~F.coalesce(F.col(line).rlike(row_pattern(schema)), F.lit(False))
    names = F.array(*(F.lit(f.name) for f in schema))
    told = F.when(~all_sound, F.struct(F.lit("quoting").alias("reason"), F.get(names, cells).alias("bad_field")))
    reason = F.when(cells != len(schema), "columns").when(passed < len(schema), "value")
    told = told.otherwise(F.struct(reason.alias("reason"), F.get(names, passed).alias("bad_field")))
    out = lines.withColumn("__told", F.when(fails, told))
    return out.withColumn("reason", F.col("__told.reason")).withColumn("bad_field", F.col("__told.bad_field")).drop("__told")


def quote_left_open(line: Column) -> Column:
    """Whether the row ends inside a quoted field, so that the record may go on behind a line feed."""
    return F.concat(F.lit("\t"), line).rlike(rf'\A(?:\t{_CELL})*+\t"[^"]*+(?:""[^"]*+)*+\z')


def rejected(lines: DataFrame, line: str = "raw_line", schema: tuple[Field, ...] = PRODUCT_LINE) -> DataFrame:
    return with_reason(lines, line, schema).where("reason is not null")


def loaded(lines: DataFrame, line: str = "raw_line", schema: tuple[Field, ...] = PRODUCT_LINE, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that load, as columns of the schema, after the columns named in keep. Empty fields become null."""
    good = lines.where(F.col(line).rlike(row_pattern(schema)))
    cells = F.regexp_extract_all(F.col(line), F.lit(rf"\G({_CELL})(?:\t|\z)"), F.lit(1))
    good = good.select(*keep, cells.alias("__cells"))
    cols = []
    for i, f in enumerate(schema):
        v = F.get("__cells", F.lit(i))
        v = F.when(v.startswith('"'), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)
        cols.append(F.nullif(v, F.lit("")).cast(f.type).alias(f.name))
    return good.select(*keep, *cols)
