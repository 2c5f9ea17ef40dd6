"""Byte-level BPE encoding and decoding as a monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import kept_columns, map_rows, quoted, slices

#: Pieces up to so many bytes are leaves of the tree; longer ones are halved. Short leaves recur
#: in many words, so that most are found among those kept.
LEAF = 6
#: Windows up to so many bytes are kept too, and merged by scanning; longer ones use a heap.
WINDOW = 64
#: Pieces and token pairs whose results a worker keeps; beyond, it forgets them all.
KEPT = 120_000
#: Tokens in a leaf of the decoding tree.
DECODED_AT_ONCE = 8192


class Encoder:
    """BPE over ``ranks`` (token bytes to id; a lower id merges earlier)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """:meth:`merge`, kept for short pieces."""
        known = self.leaves.get(piece)
        if known is None:
            known = self.merge(piece)
            if len(piece) <= WINDOW:
                if len(self.leaves) >= KEPT:
                    self.leaves.clear()
                self.leaves[piece] = known
        return known

    def merge(self, piece: bytes) -> list[int]:
        """By merging the pair of least rank, the leftmost first, until none is left."""
        ranks = self.ranks
        if len(piece) > WINDOW:
            return self._by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        best = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            least = min((r for r in best if r is not None), default=None)
            if least is None:
                return [ranks[p] for p in parts]
            i = best.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i:
                best[i - 1] = get(parts[i - 1] + parts[i])
            if i < len(best):
                best[i] = get(parts[i] + parts[i + 1])

    def _by_heap(self, piece: bytes) -> list[int]:
        """:meth:`leaf` in n log n steps, for long windows."""
        get, n = self.ranks.get, len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i, to = heappop(heap)
            if not alive[i] or (j := end[i]) >= n or not alive[j] or end[j] != to:
                continue
            alive[j], end[i] = False, to
            if to < n:
                prev[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    heappush(heap, (r, i, end[to]))
            if (p := prev[i]) >= 0 and (r := get(piece[p:to])) is not None:
                heappush(heap, (r, p, to))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens, next to each other, stay as they are.

        A sequence of tokens is the encoding of its bytes if each token and each two neighbours
        are that of theirs: then no merge crosses a border between them before those that made
        them.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.leaf(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, from theirs.

        The window about the boundary grows until the tokens outside are stable beside it.
        """
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.leaf(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            fits_left = i == len(left) or self.stable(left[-i - 1], window[0])
            fits_right = j == len(right) or self.stable(window[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + window + right[j:]
            i, j = i * (2 - fits_left), j * (2 - fits_right)

    def tree(self, piece: bytes) -> list[int]:
        """Halves are encoded and joined, down to leaves."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; one that is a token itself is that token."""
        known = self.ranks.get(piece)
        return [known] if known is not None else self.tree(piece) if piece else []

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``: those of its halves, concatenated up the tree."""
        if len(ids) <= DECODED_AT_ONCE:
            return b"".join(map(self.token.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def read_ranks(file: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


class TextEncoder:
    """Whole texts, split by ``pattern``; results for pieces are kept within bounds."""

    def __init__(self, file: bytes, pattern: str):
        self.encoder = Encoder(read_ranks(file))
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known.clear()
        self.encoder.leaves.clear()
        self.encoder.pairs.clear()

    def _packed(self, piece: str) -> bytes:
        if len(self.known) >= KEPT:
            self.known.clear()
        packed = self.known[piece] = np.array(self.encoder.encode(piece.encode()), "<u4").tobytes()
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, packed = self.known.get, self._packed
        return b"".join([get(p) or packed(p) for p in self.find(text)])


@lru_cache(maxsize=2)
def text_encoder(key: str, file: bytes, pattern: str) -> TextEncoder:
    """One for each vocabulary in a worker."""
    return TextEncoder(file, pattern)


def _vocabulary(df: DataFrame, path: str):
    """The file's bytes as a broadcast: a vocabulary is of a fixed size, whatever the corpus."""
    with open(path, "rb") as f:
        file = f.read()
    return hashlib.sha256(file).hexdigest(), df.sparkSession.sparkContext.broadcast(file)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids, then the columns ``keep``): the token ids of each row's whole text, packed as
    little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately, without special tokens. A null text counts
    as empty, an empty one has no ids. One row for each row, repeated ones too; no shuffle. An empty table
    gives none. A kept column called ``id`` or ``ids`` comes back as ``id_kept`` or ``ids_kept``.
    """
    key, held = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(key, held.value, pattern)
        for batch in slices(batches):
            packed = pa.array([own.encode(t.as_py()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], ["id", "ids", *batch.schema.names[2:]])
        own.forget()  # a worker may go on to other work

    kept = docs.select(*kept_columns(keep, ("id", "ids")))
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"), *kept_columns(keep, ("id", "ids")))
    fields = [StructField("id", own.schema[0].dataType), StructField("ids", BinaryType()), *kept.schema.fields]
    return map_rows(own, run, StructType(fields))


def decode_ids(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of :func:`encode_texts` with the text of their ids, as bytes, in ``decoded``.

    Null ids count as none; an empty table gives none.
    """
    key, held = _vocabulary(tokens, path)
    at = tokens.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = text_encoder(key, held.value, pattern).encoder.decode
        for batch in slices(batches):
            texts = [decode(array("I", t.as_py() or b"")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return map_rows(tokens, run, StructType([*tokens.schema.fields, StructField("decoded", BinaryType())]))
