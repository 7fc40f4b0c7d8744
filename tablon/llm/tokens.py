"""Exact byte-pair encoding of whole texts in linear time, with a public vocabulary.

The vocabulary's tokens, as Latin-1 strings of their bytes, form one Aho-Corasick automaton.
A piece of text is encoded by taking the longest token at each place and stepping back
where two neighbours aren't what the merges would leave; which pairs of tokens can be
neighbours is worked out once for each pair. No merge loop runs over the text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files, unless TABLON_TOKENIZERS or a parameter names another.
TOKENIZERS = os.environ.get("TABLON_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pattern that splits text before the merges of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_KEPT = 200_000  # a worker's memo is emptied beyond, which costs time only
LONGEST_KEPT = 64  # longer pieces aren't memoised
ENDLESS = 1 << 60


class BytePairEncoder:
    """Encodes with a vocabulary of lines ``base64 rank``, ranks being ids."""

    def __init__(self, lines: bytes):
        import ahocorasick
        import regex

        self.text: dict[int, str] = {}
        self.ids: dict[str, int] = {}
        for token, rank in map(bytes.split, lines.splitlines()):
            t = base64.b64decode(token).decode("latin-1")
            self.ids[t] = int(rank)
            self.text[int(rank)] = t
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.prefix: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.text):
            self._learn_parts(i)

    def _learn_parts(self, i: int) -> None:
        """The two tokens whose merge makes token ``i``: the split whose halves the earlier merges
        leave beside each other. Single bytes are their own halves."""
        self.parts[i] = (i, i)
        t = self.text[i]
        for cut in range(len(t) - 1, 0, -1):
            a, b = self.ids.get(t[:cut], ENDLESS), self.ids.get(t[cut:], ENDLESS)
            if a < i and b < i and self._can_stand(a, b):
                self.parts[i] = (a, b)
                self.merged[a, b] = i
                return

    def _can_stand(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side. Goes back through the merges that made
        them, latest first: none may be later than one that would join across the border."""
        before = ENDLESS
        while True:
            if self.merged.get((a, b), ENDLESS) < before:
                return False
            left_whole, right_whole = self.parts[a][1] == a, self.parts[b][0] == b
            if left_whole and right_whole:
                return True
            if right_whole or (a > b and not left_whole):
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]

    def can_stand(self, a: int, b: int) -> bool:
        known = self.neighbours.get((a, b))
        if known is None:
            known = self.neighbours[a, b] = self._can_stand(a, b)
        return known

    def _shorter(self, i: int) -> int | None:
        """The longest token that is a proper prefix of token ``i``."""
        if i not in self.prefix:
            t = self.text[i]
            self.prefix[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None)
        return self.prefix[i]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece, given as Latin-1 string of its bytes."""
        n = len(piece)
        longest = [0] * (n + 1)
        for end, i in self.automaton.iter(piece):
            longest[end + 1 - len(self.text[i])] = i  # longer matches end later
        reachable = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, following = 0, longest[0]
        while at < n or not out:
            i, last = following, out[-1] if out else None
            while True:
                end = at + len(self.text[i])
                if reachable[end] and (last is None or self.can_stand(last, i)):
                    out.append(i)
                    at, following = end, longest[end] if end < n else 0
                    break
                less = self._shorter(i)
                if less is None:
                    if last is None:
                        raise ValueError("the vocabulary lacks a byte")
                    reachable[at] = 0
                    out.pop()
                    at -= len(self.text[last])
                    following = last
                    break
                i = less
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty and for a null one."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        if len(memo) > PIECES_KEPT:
            memo.clear()
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= LONGEST_KEPT:
                    memo[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, BytePairEncoder] = {}


def read_vocabulary(name: str, folder: str | None = None) -> bytes:
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _encoder(name: str, lines: bytes) -> BytePairEncoder:
    """One encoder for each vocabulary and Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = BytePairEncoder(lines)
    return _ENCODERS[name]


def _with(
    df: DataFrame, text: str, out_type: T.DataType, name: str, convert, vocabulary: str, folder: str | None
) -> DataFrame:
    lines = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, folder))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, lines.value)
        for batch in batches:
            made = convert(encoder, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*(f"c{i}" for i in range(batch.num_columns)), name])

    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*renamed.schema.fields, T.StructField(name, out_type)])
    done = renamed.mapInArrow(run, schema)
    return done.toDF(*df.columns, name)


def _lists(encoder: BytePairEncoder, column: pa.Array) -> pa.Array:
    flat: list[int] = []
    ends = np.zeros(len(column) + 1, np.int32)
    for i, text in enumerate(column):
        flat += encoder.encode(text.as_py())
        ends[i + 1] = len(flat)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, np.int32)))


def _counts(encoder: BytePairEncoder, column: pa.Array) -> pa.Array:
    return pa.array([len(encoder.encode(t.as_py())) for t in column], pa.int64())


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """All rows, with ``out`` (array<int>): the ids of the whole text, without special tokens; their
    strings are ordinary text. Empty and null texts give an empty list. ``out`` mustn't be a
    column already. Rows are neither shuffled nor held beyond their Arrow batch. The vocabulary
    (under 1 MB, read on the driver from ``folder``) is sent to each executor once."""
    return _with(df, text, T.ArrayType(T.IntegerType()), out, _lists, vocabulary, folder)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """As ``encode_texts``, but ``out`` (bigint) is the number of ids; 0 for empty and null texts."""
    return _with(df, text, T.LongType(), out, _counts, vocabulary, folder)
