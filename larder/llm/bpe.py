"""Byte-pair encoding of a corpus with a public byte-level vocabulary.

Texts are cut into pieces by the vocabulary's pattern. A piece that a worker has not met is encoded by
backtracking: an Aho-Corasick automaton over all tokens gives the longest token at every byte, and a token is
kept only if it can stand behind its neighbour, which a table of checked pairs answers. That gives the result of
the merges in time linear in the piece. Decoding cuts one byte string by a table of offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps in its table of pieces, and of pairs, before it starts a new one.
KEEP_PIECES, KEEP_PAIRS = 150_000, 400_000


def _byte_of_symbol() -> dict[str, int]:
    """The visible symbol that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Bytes of each id in the order of the merges, and for each id the two ids that merge into it (itself twice for a
    single byte). Files with a normaliser or another way to cut texts into pieces are refused."""
    whole = json.load(open(path, encoding="utf-8"))
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or whole.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level vocabulary whose pieces PATTERN cuts")
    byte, vocab = _byte_of_symbol(), model["vocab"]
    halves = {}
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        halves[vocab[left + right]] = (vocab[left], vocab[right])
    tokens = {i: bytes(byte[c] for c in s) for s, i in vocab.items() if i in halves or len(s) == 1}
    n = len(tokens)
    if sorted(tokens) != list(range(n)):
        raise ValueError("ids are not dense")
    return [tokens[i] for i in range(n)], [halves.get(i, (i, i)) for i in range(n)]


class Encoder:
    """encode() gives the ids of one text; count() their number. One per Python worker."""

    def __init__(self, tokens: list[bytes], halves: list[tuple[int, int]], pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.tokens, self.halves = tokens, halves
        self.size = [len(t) for t in tokens]
        self.id = {t: i for i, t in enumerate(tokens)}
        self.merged = {h: i for i, h in enumerate(halves) if h[0] != i}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        self.cut = regex.compile(pattern).findall
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                if len(self) >= KEEP_PIECES:
                    self.clear()
                ids = tuple(encoder.backtrack(piece.encode("utf-8")))
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.cut(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.cut(text))))

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for a single byte."""
        got = self.shorter.get(token)
        if got is None:
            b, got = self.tokens[token], -1
            for n in range(len(b) - 1, 0, -1):
                if (got := self.id.get(b[:n], -1)) >= 0:
                    break
            self.shorter[token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens standing side by side."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = self._fits(left, right)
        return got

    def _fits(self, left: int, right: int) -> bool:
        # Undo the later of the two last merges again and again. The tokens clash as soon as the halves that face
        # each other merge earlier than the merge that was undone.
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    return True
            else:
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    if self.halves[left][1] == left:
                        return True
                    limit, left = left, self.halves[left][1]
                else:
                    right = inner

    def backtrack(self, raw: bytes) -> list[int]:
        n, size, longest = len(raw), self.size, [-1] * len(raw)
        for end, token in self.find.iter(raw.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends only grow, so the longest is written last
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while token >= 0:
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + size[token]] or (last >= 0 and not self.fits(last, token))):
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out


class Decoder:
    """Token bytes in one string; token i stands between offset i and i + 1."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.blob = b"".join(tokens)
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).tolist()

    def decode(self, ids: list[int]) -> str:
        blob, at = self.blob, self.offset
        return b"".join(blob[at[i] : at[i + 1]] for i in ids).decode("utf-8", errors="replace")


_made: dict[tuple[str, str], object] = {}


def _once(kind: str, key: str, make):  # one encoder per worker and vocabulary, also over several tasks
    if (kind, key) not in _made:
        _made[kind, key] = make()
    return _made[kind, key]


def encode_corpus(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """Keys and `out`, the ids of `text` without special tokens (array of int).

    Null and empty texts give an empty list; text that spells a special token is ordinary text. One narrow pass,
    no shuffle; equal rows give equal rows. Other columns of df are not read.
    """
    return _apply(df, text, keys, vocabulary, out, count=False)


def count_tokens(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """Keys and `out`, the number of tokens of `text` (int; 0 for null and empty)."""
    return _apply(df, text, keys, vocabulary, out, count=True)


def _apply(df: DataFrame, text: str, keys: tuple[str, ...], vocabulary: str, out: str, count: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # about 1 MB, whatever the corpus
    few = df.select(*keys, df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: Encoder = _once("encoder", vocabulary, lambda: Encoder(*shared.value))
        for b in batches:
            texts = b.column(len(keys))
            for lo in range(0, len(b), 1024):
                part = texts.slice(lo, 1024).to_pylist()
                if count:
                    col = pa.array([enc.count(x) if x else 0 for x in part], pa.int32())
                else:
                    ids = [enc.encode(x) if x else [] for x in part]
                    ends = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum([len(x) for x in ids], out=ends[1:])
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                    col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, 1024) for i in range(len(keys))), col], names=[*keys, out])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return few.mapInArrow(run, f"{kinds}, `{out}` {'int' if count else 'array<int>'}")


def decode_corpus(df: DataFrame, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, out: str = "text") -> DataFrame:
    """Keys and `out`, the text of each list of ids; null gives null, an empty list the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary)[0])
    few = df.select(*keys, df[ids].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec: Decoder = _once("decoder", vocabulary, lambda: Decoder(shared.value))
        for b in batches:
            texts = [None if x is None else dec.decode(x) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(texts, pa.string())], names=[*keys, out])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return few.mapInArrow(run, f"{kinds}, `{out}` string")
