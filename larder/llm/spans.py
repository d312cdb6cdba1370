"""Long exact spans shared between records.

Units are hashed, digests are grouped over the whole corpus, the earliest occurrence of a digest ranks first, and
every occurrence keeps its offset. Passages start and end anywhere, so lines and paragraphs alone miss most of them:
for spans the units are cut by content. Every window of `span` characters elects one anchor inside it, the smallest
hashed gram; equal windows elect equal anchors, wherever they stand. Anchors found in two records mark the only
windows that can be shared, and only those windows are hashed, grouped and marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialise

SPAN = 200
#: Characters hashed at once; longer texts are cut into pieces that overlap by span - 1. Below 2**24 (see _elect).
PIECE = 1 << 20
#: Different runs of windows around one anchor that a task compares at once.
CROWD = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grams(codes: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """A 64-bit hash of every run of each length, by doubling: one multiplication and sum per power of two."""
    level = _mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    have: dict[int, tuple[np.ndarray, int]] = {}
    n, size, power, mask = len(codes), 1, _ODD, (1 << 64) - 1
    parts: dict[int, tuple[np.ndarray, int]] = {}
    while size <= max(lengths):
        for k in lengths:
            if k & size:
                if k not in parts:
                    parts[k] = (level, size)
                else:
                    low, done = parts[k]
                    m = n - done - size + 1
                    parts[k] = (low[:m] * power + level[done : done + m], done + size)
        m = n - 2 * size + 1
        if m <= 0:
            break
        level = level[:m] * power + level[size : size + m]
        power = np.uint64(int(power) * int(power) & mask)
        size *= 2
    for k in lengths:
        have[k] = (_mix(parts[k][0][: n - k + 1]), k)
    return [have[k][0] for k in lengths]


def _elect(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams the position of the smallest, the last of equal ones."""
    low = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    size, n = 1, len(grams)
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    m = n - width + 1
    low = np.minimum(low[:m], low[width - size : width - size + m])
    return (_LOW - (low & _LOW)).astype(np.int64)


def _pieces(texts: list[str], span: int) -> Iterator[tuple[list[int], np.ndarray, list[int], list[int]]]:
    """Texts joined to pieces of some PIECE characters: indexes of the texts, code points, where each starts in the piece, and its offset in its text."""
    who: list[int] = []
    at: list[int] = []
    off: list[int] = []
    buf: list[str] = []
    size = 0

    def flush():
        return who, np.frombuffer("".join(buf).encode("utf-32-le", "surrogatepass"), np.uint32), at, off

    for i, t in enumerate(texts):
        if t is None or len(t) < span:
            continue
        for lo in range(0, len(t) - span + 1, PIECE):
            part = t[lo : lo + PIECE + span - 1]
            if size and size + len(part) > PIECE + span:
                yield flush()
                who, at, off, buf, size = [], [], [], [], 0
            who.append(i), at.append(size), off.append(lo), buf.append(part)
            size += len(part)
    if size:
        yield flush()


def _windows(codes: np.ndarray, at: list[int], span: int, gram: int, whole: bool):
    """Valid window starts of a piece (inside one text), the text of each, the anchor each elects, gram hashes and, if `whole`, window hashes."""
    got = _grams(codes, (gram, span) if whole else (gram,))
    elected = _elect(got[0], span - gram + 1)
    starts = np.arange(len(codes) - span + 1)
    owner = np.searchsorted(at, starts, side="right") - 1
    ends = np.append(at[1:], len(codes))
    valid = starts + span <= ends[owner]
    return starts[valid], owner[valid], elected[valid], got[0], got[1] if whole else None


def shared_spans(df: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """`key`, shared_chars (long): records with a character in a span of `span` or more code points that stands
    verbatim in another record, and the number of such characters.

    Null, empty and shorter texts have none; repeats inside one record alone don't count; two records with equal
    texts share all of them. Rows of one key are one record, rows with a null key are none. Any length of text, and any
    number of records that hold one passage, keeps its exact result: nothing is capped, and of equal runs of windows each
    task sends two. Anchors with more than `crowd` runs take a way of their own to the same result.
    """
    gram = max(1, span // 3)
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text") >= span)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each elected anchor of each text; news is 1 where the text has the anchor for the first time."""
        for b in batches:
            seen: dict[int, set[int]] = {}  # of texts that need several pieces
            for who, codes, at, off in _pieces(b.column(1).to_pylist(), span):
                _, owner, elected, grams, _ = _windows(codes, at, span, gram, whole=False)
                first = np.flatnonzero(np.diff(elected, prepend=-1) | np.diff(owner, prepend=-1))
                pos, own = elected[first], owner[first]
                got = grams[pos].view(np.int64)
                order = np.lexsort((got, own))
                news = np.ones(len(order), np.int64)
                news[order[1:]] = (np.diff(own[order]) != 0) | (np.diff(got[order]) != 0)
                if len(who) == 1 and (off[0] or len(codes) >= PIECE):
                    mine = seen.setdefault(who[0], set())
                    for i, g in enumerate(got.tolist()):
                        news[i] = news[i] and g not in mine
                    mine.update(got.tolist())
                place = pos - np.asarray(at)[own] + np.asarray(off)[own]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.asarray(who)[own])), pa.array(place), pa.array(got), pa.array(news)], names=["__key", "pos", "anchor", "news"])

    # Read twice, so written once: some 20 bytes for every (span - gram) / 2 characters.
    found = materialise(docs.mapInArrow(anchors, f"__key {kind}, pos long, anchor long, news long"))
    twice = found.groupBy("anchor").agg(F.sum("news").alias("n")).where("n > 1").select("anchor")
    marks = found.select("__key", "pos", "anchor").join(twice, "anchor", "left_semi").groupBy("__key").agg(F.collect_set("pos").alias("marks"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of windows that elect one marked anchor. Of the texts of a task that hold the same run,
        two send its hashes: they are enough to show that it is shared, also if a third of all texts hold it."""
        sent: dict[int, object] = {}
        for b in batches:
            marks_of = [np.unique(x) for x in b.column(2).to_pylist()]
            for who, codes, at, off in _pieces(b.column(1).to_pylist(), span):
                starts, owner, elected, grams, whole = _windows(codes, at, span, gram, whole=True)
                at_, off_, who_ = np.asarray(at), np.asarray(off), np.asarray(who)
                hit = np.zeros(len(codes), bool)
                for j, w in enumerate(who):
                    m = marks_of[w] - off[j]
                    end = (at[j + 1] if j + 1 < len(at) else len(codes)) - at[j]
                    hit[at[j] + m[(m >= 0) & (m < end)]] = True
                take = np.flatnonzero(hit[elected])
                if not len(take):
                    continue
                own, pos, start = owner[take], elected[take], starts[take]
                cut = np.flatnonzero(np.diff(pos, prepend=-1) | np.diff(own, prepend=-1) | (np.diff(start, prepend=-2) != 1))
                ends = np.append(cut[1:], len(take))
                hashes = whole[start]
                place = (np.arange(len(hashes)) - np.repeat(cut, ends - cut)).astype(np.uint64)
                run = _mix(np.add.reduceat(_mix(hashes + place * _ODD), cut)).view(np.int64)
                keys = b.column(0).take(pa.array(who_[own[cut]]))
                listed: list[np.ndarray | None] = []
                for r, k, lo, hi in zip(run.tolist(), keys.to_pylist(), cut.tolist(), ends.tolist()):
                    show = r not in sent or sent[r] is not sent and sent[r] != k
                    if show:
                        sent[r] = sent if r in sent else k
                    listed.append(hashes[lo:hi].view(np.int64) if show else None)
                o = own[cut]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(grams[pos[cut]].view(np.int64)), pa.array(start[cut] - at_[o] + off_[o]), pa.array(run), pa.array(listed, pa.list_(pa.int64()))],
                    names=["__key", "anchor", "start", "run", "hashes"],
                )

    runs = materialise(docs.join(marks, "__key").mapInArrow(candidates, f"__key {kind}, anchor long, start long, run long, hashes array<long>"))
    listed = runs.where("hashes is not null").select("__key", "anchor", "run", "hashes")
    # An anchor that stands in very many different contexts would gather all their windows in one task. Such anchors are
    # fewer than runs / CROWD; their windows are spread by their own hashes, of which each task sends one row.
    crowded = materialise(listed.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"))
    if crowded.isEmpty():
        masks = _masks_by_anchor(listed)
    else:
        masks = _masks_by_anchor(listed.join(crowded, "anchor", "left_anti")).unionByName(_masks_by_hash(listed.join(crowded, "anchor", "left_semi")))
    starts = runs.select("__key", "start", "anchor", "run").join(masks, ["anchor", "run"]).groupBy("__key").agg(F.collect_list(F.struct("start", "hits")).alias("r"))
    starts = starts.select("__key", F.expr("sort_array(array_distinct(flatten(transform(r, x -> transform(x.hits, i -> x.start + i)))))").alias("s"))
    # Each start adds the characters up to the next start, at most `span`.
    gaps = f"aggregate(zip_with(s, slice(s, 2, size(s)), (a, b) -> least(b - a, {span}L)), 0L, (t, g) -> t + g)"
    return starts.select(F.col("__key").alias(key), F.expr(gaps).alias("shared_chars"))


def _masks_by_anchor(listed: DataFrame) -> DataFrame:
    """anchor, run, hits: places in the run whose windows stand in two records. Windows with equal text elect one anchor,
    so one exchange by anchor brings them together; the window and the grouping need no other."""
    partitions = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy("anchor", "hash")
    each = listed.repartition(partitions, "anchor").select("__key", "anchor", "run", F.posexplode("hashes").alias("i", "hash"))
    each = each.select("anchor", "run", "i", (F.min("__key").over(same) < F.max("__key").over(same)).alias("shared"))
    return each.where("shared").groupBy("anchor", "run").agg(F.collect_set("i").alias("hits"))


def _masks_by_hash(listed: DataFrame) -> DataFrame:
    """The same for crowded anchors: windows are summed up by their hashes first, and runs meet the shared ones."""
    each = listed.select("__key", "anchor", "run", F.posexplode("hashes").alias("i", "hash"))
    twice = each.groupBy("hash").agg(F.min("__key").alias("a"), F.max("__key").alias("b")).where("a < b").select("hash")
    return each.join(twice, "hash", "left_semi").groupBy("anchor", "run").agg(F.collect_set("i").alias("hits"))


def shared_units(df: DataFrame, text: str = "text", key: str = "doc_id", separator: str = r"\n+", least: int = 40) -> DataFrame:
    """Lines or paragraphs that stand in several places: `key`, unit_no (int, from 0), start (long, code points
    before the unit), n_chars (int), digest, copies (long), keep (boolean).

    Units are cut at `separator` (a Java pattern), trimmed, lower-cased and freed of repeated white space before
    hashing; units shorter than `least` after that are left out. keep is true for the occurrence with the smallest
    (key, unit_no); the rest can be removed by start and n_chars. Null and empty texts have no units.
    """
    sep = separator.replace("\\", "\\\\").replace("'", "\\'")
    parts = df.select(F.col(key), F.col(text).alias("__t")).where("__t is not null")
    cut = parts.select(key, F.expr(f"split(__t, '{sep}')").alias("u"), F.expr(f"regexp_extract_all(__t, '({sep})', 1)").alias("gap"))
    size = cut.select(key, "u", F.expr("transform(u, (x, i) -> length(x) + coalesce(length(try_element_at(gap, i + 1)), 0))").alias("n"))
    unit = size.select(key, F.posexplode("u").alias("unit_no", "unit"), "n").select(
        key, "unit_no", F.expr("aggregate(slice(n, 1, unit_no), 0L, (a, b) -> a + b)").alias("start"), F.length("unit").alias("n_chars"),
        F.trim(F.regexp_replace(F.lower("unit"), r"(?U)\s+", " ")).alias("norm"),
    )
    unit = unit.where(F.length("norm") >= least).withColumn("digest", F.sha2("norm", 256)).drop("norm")
    # Counted with a map-side part first; the join back reads each unit once more but never gathers a group.
    rank = unit.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(key, "unit_no")).alias("first")).where("copies > 1")
    return unit.join(rank, "digest").select(
        key, "unit_no", "start", "n_chars", "digest", "copies", ((F.col(key) == F.col(f"first.{key}")) & (F.col("unit_no") == F.col("first.unit_no"))).alias("keep")
    )
