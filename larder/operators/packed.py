"""Several values packed in one field: split, unquote and number them.

A batch's strings are one buffer of bytes. Running sums of its quote and bracket bytes tell for every byte whether
it is protected; unprotected marks cut the buffer, and the cuts are the offsets of the children. Only captions and
unbalanced cells are looked at one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Style:
    """marks: what separates. brackets: marks inside ( ) [ ] don't. prose: label text, in which a comma between two
    digits doesn't separate, nor a slash between two letters or digits; captions separate; the last full stop goes."""

    marks: tuple[str, ...]
    brackets: bool = False
    prose: bool = False


#: The separating marks of each kind of cell.
LABEL_TEXT = Style((",", ";", "|", "/", "\n", "•", "·"), brackets=True, prose=True)
TAGS = Style((",", ";", "|"))
NAMES = Style(("$", ";", "|"))

_CAPTION = re.compile(rb"(?:\A|(\.)\s+)\s*([A-Za-z\x80-\xff][A-Za-z \x80-\xff]*)\Z")


def _inside(buf: np.ndarray, cell: np.ndarray, first: np.ndarray, last: np.ndarray, brackets: bool) -> np.ndarray:
    """Whether each byte is protected by quotes or brackets of its cell. A quote without a partner is an ordinary character, a bracket that nothing opens too."""
    quote = buf == 34
    total = np.concatenate(([0], np.cumsum(quote)))
    odd = (total[last] - total[first]) % 2 == 1
    for i in np.flatnonzero(odd):
        quote[first[i] + np.flatnonzero(quote[first[i] : last[i]])[-1]] = False
    if odd.any():
        total = np.concatenate(([0], np.cumsum(quote)))
    shut = (total[:-1] - total[first[cell]]) % 2 == 1
    if not brackets:
        return shut | quote
    step = np.where(shut | quote, 0, ((buf == 40) | (buf == 91)).astype(np.int64) - ((buf == 41) | (buf == 93)))
    run = np.concatenate(([0], np.cumsum(step)))
    depth = run[1:] - run[first[cell]]
    for i in np.unique(cell[depth < 0]):  # brackets that nothing opens: the depth never falls below 0
        own = np.cumsum(step[first[i] : last[i]])
        depth[first[i] : last[i]] = own - np.minimum.accumulate(np.minimum(own, 0))
    return shut | quote | (depth > 0)


def split_array(cells: pa.Array, style: Style) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent of each value (index into cells), its position from 1, and the values of all cells in order."""
    cells = cells.cast(pa.large_string()).fill_null("")
    flat = pa.concat_arrays([cells]) if cells.offset == 0 else pa.array(cells.to_pylist(), pa.large_string())
    off = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    size = int(off[-1])
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    data = flat.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[:size]
    cell = np.repeat(np.arange(len(flat)), np.diff(off))
    first, last = off[:-1], off[1:]
    inside = _inside(buf, cell, first, last, style.brackets)
    raw = buf.tobytes()

    cuts: list[np.ndarray] = []  # from, to of each separator
    at_from, at_to = [], []
    for mark in style.marks:
        b = mark.encode()
        hit = (buf == b[0]) & ~inside
        for k in range(1, len(b)):
            hit[:-k] &= buf[k:] == b[k]
            hit[-k:] = False
        if style.prose and mark in ",/":
            before, after = np.concatenate(([32], buf[:-1])), np.concatenate((buf[1:], [32]))
            digit = lambda x: (x >= 48) & (x <= 57)
            word = lambda x: digit(x) | ((x | 32) >= 97) & ((x | 32) <= 122) | (x >= 128)
            kind = digit if mark == "," else word
            same = (cell == np.concatenate(([-1], cell[:-1]))) & (cell == np.concatenate((cell[1:], [-1])))
            hit &= ~(kind(before) & kind(after) & same)
        p = np.flatnonzero(hit)
        at_from.append(p), at_to.append(p + len(b))
    at_from.append(off), at_to.append(off)  # cells end values too
    lo, hi = np.concatenate(at_from), np.concatenate(at_to)
    if style.prose:
        edges = np.sort(hi)
        extra = []
        for c in np.flatnonzero((buf == 58) & ~inside).tolist():
            a = int(edges[np.searchsorted(edges, c, side="right") - 1])
            if m := _CAPTION.search(raw[a:c]):
                extra.append((a + (m.start(1) if m[1] else m.start()), c + 1))
        ends = last[last > first]
        tail = ends - 1  # the full stop that ends the text, behind it only white space
        blank = np.isin(buf[tail], (32, 9, 10, 13))
        while blank.any():
            tail = np.where(blank, tail - 1, tail)
            blank = blank & (tail >= 0) & np.isin(buf[np.maximum(tail, 0)], (32, 9, 10, 13)) & (tail >= first[last > first])
        stop = tail[(tail >= first[last > first]) & (buf[np.maximum(tail, 0)] == 46)]
        lo = np.concatenate((lo, stop, [x for x, _ in extra])).astype(np.int64)
        hi = np.concatenate((hi, stop + 1, [y for _, y in extra])).astype(np.int64)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start, end = hi[:-1], lo[1:]
    keep = end > start
    start, end = start[keep], end[keep]

    # The stretches between cuts, packed into one child array.
    n = end - start
    child = np.concatenate(([0], np.cumsum(n)))
    pick = np.repeat(start - child[:-1], n) + np.arange(child[-1])
    values = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(child.astype(np.int64)), pa.py_buffer(buf[pick].tobytes())) if len(n) else pa.array([], pa.large_string())
    values = pc.utf8_trim_whitespace(values)
    bare = pc.utf8_slice_codeunits(values, 1, -1)
    around = pc.and_(pc.and_(pc.starts_with(values, '"'), pc.ends_with(values, '"')), pc.and_(pc.greater(pc.binary_length(values), 1), pc.invert(pc.match_substring(bare, '"'))))
    values = pc.if_else(around, bare, values)
    parent = cell[start] if len(start) else np.zeros(0, np.int64)
    full = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(values)), 0).to_numpy(zero_copy_only=False)
    parent, values = parent[full], values.filter(pa.array(full))
    head = np.flatnonzero(np.diff(parent, prepend=-1)) if len(parent) else np.zeros(0, np.int64)
    pos = np.arange(len(parent)) - np.repeat(head, np.diff(np.append(head, len(parent)))) + 1
    return parent, pos, values


def split_cells(df: DataFrame, column: str, keys: tuple[str, ...], style: Style, pos: str = "pos", value: str = "value") -> DataFrame:
    """keys, pos (int, from 1, counting values that are not empty) and value, one row for each value of `column`.

    Null, empty and blank cells give no rows. Values are trimmed, lose the double quotes around them and are otherwise
    as written; marks inside double quotes never separate. Repeated rows are split each. Other columns are not read.
    One narrow pass.
    """
    few = df.select(*keys, df[column].alias("__cell")).where("__cell is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, at, values = split_array(b.column(len(keys)), style)
            up = pa.array(parent)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(up) for i in range(len(keys))), pa.array(at.astype(np.int32)), values.cast(pa.string())], names=[*keys, pos, value])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return few.mapInArrow(run, f"{kinds}, `{pos}` int, `{value}` string")
