"""Benchmark decontamination: benchmark suffixes searched in suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ceil_div, lean, quoted, with_fields
from .suffixes import suffix_array

#: Bytes of benchmark text that are held in memory, and broadcast, at a time, about; a larger benchmark
#: is searched in blocks, one after the other, each against all documents.
BLOCK_BYTES = 12_000_000

_BREAKS = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
_SPACED = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters of the text with A-Z in lower case."""
    return text.lower().translate(_SPACED).split()


class Needles:
    """A block of benchmark items as numbered words, and their suffixes.

    ``text`` has the items' words as numbers from 1, with a zero after each item.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        text, start, owner, need = [], [], [], []
        longest = 0
        for name, body in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(body)]
            if own:
                w = min(window, len(own))
                start += range(len(text), len(text) + len(own))
                owner += [number[name]] * len(own)
                need += [w if len(own) - i >= w else 0 for i in range(len(own))]  # zero: too short for a window
                text += [*own, 0]
                longest = max(longest, len(own))
        self.text = np.array([*text, *[0] * (longest + 1)], np.int32)
        self.start, self.owner, self.need = (np.array(x, np.int64) for x in (start, owner, need))
        self.longest, self.least = longest, min((n for n in need if n), default=1)


def narrow(text: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the part of each range [lo, hi) of the suffix array with ``want`` at depth d."""
    bounds = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while len(i := np.nonzero(a < b)[0]):
            mid = (a[i] + b[i]) >> 1
            here = text[array[mid] + d]
            low = here <= want[i] if right else here < want[i]
            a[i[low]] = mid[low] + 1
            b[i[~low]] = mid[~low]
        bounds.append(a)
    return bounds[0], bounds[1]


def search(needles: Needles, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[set[int]], np.ndarray]:
    """For each numbered document (0: a word that no item has): a flag for each word that a window
    hits, the items found, the longest verbatim match with any item in words."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    text = np.zeros(int((size + 1).sum()) + needles.longest + 1, np.int32)
    for b, ids in zip(begin.tolist(), docs):
        text[b : b + len(ids)] = ids
    gaps = np.nonzero(text == 0)[0]
    known = np.nonzero(text)[0]
    run = gaps[np.searchsorted(gaps, known)] - known
    array = suffix_array(text, known[run >= needles.least], needles.longest, len(needles.vocabulary))

    cover = np.zeros(len(text) + 1, np.int64)
    found: list[set[int]] = [set() for _ in docs]
    longest = np.zeros(len(docs), np.int64)
    q = np.arange(len(needles.start))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
    for d in range(needles.longest):
        want = needles.text[needles.start[q] + d]
        q, lo, hi, want = (x[want > 0] for x in (q, lo, hi, want))
        lo, hi = narrow(text, array, lo, hi, d, want)
        q, lo, hi = (x[lo < hi] for x in (q, lo, hi))
        if not len(q):
            break
        if d + 1 < needles.least:
            continue
        # Suffixes with the same next words share a range, which is looked at once.
        ranges, which = np.unique(lo, return_index=True)
        last: dict[int, np.ndarray] = {}
        for a, b in zip(ranges.tolist(), hi[which].tolist()):
            last[a] = np.unique(np.searchsorted(begin, array[a:b], side="right") - 1)
            if d + 1 >= needles.least:
                longest[last[a]] = np.maximum(longest[last[a]], d + 1)
        full = needles.need[q] == d + 1
        for a in np.unique(lo[full]).tolist():
            own = full & (lo == a)
            at = array[a : hi[own][0]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + d + 1, -1)
            items = set(needles.owner[q[own]].tolist())
            for doc in last[a].tolist():
                found[doc] |= items
    hit = np.cumsum(cover) > 0
    return [hit[b : b + n] for b, n in zip(begin.tolist(), size.tolist())], found, np.where([bool(f) for f in found], longest, 0) if docs else longest


def runs(flags: np.ndarray) -> list[int]:
    """start, end, start, end ... of the runs of true."""
    return np.nonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))[0].tolist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(id, n_words, spans, items, longest): one row for each row of ``docs``.

    ``spans`` are the runs [start, end) of words that occurrences of benchmark windows cover,
    ``items`` the ids, as text and sorted, of the items with a window that occurs, ``longest`` the
    longest verbatim match in words, zero if no window occurs. A window is ``window`` consecutive
    words of an item, or all of a shorter item. A null text has no words; an item without words or
    with a null id is left out; items with one id are one item. No shuffle: the documents of one
    Arrow batch are a shard with a suffix array of its own, and each shard sees each block of the
    benchmark.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), as_bytes(item_text_col).alias("t")).where("i is not null")
    # Rows of one id are in one block; the driver never has more than one block.
    blocks = ceil_div(items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0], BLOCK_BYTES)
    items = items.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)))

    def block(i: int) -> Needles:
        return Needles([(r.i, bytes(r.t)) for r in items.where(F.col("block") == i).select("i", "t").collect()], window)

    state = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"), F.expr("0L n_words"), F.expr("cast(array() as array<long>) hits"), F.expr("cast(array() as array<string>) items"), F.expr("0L longest"))

    def step(held, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            needles: Needles = held.value
            get = needles.vocabulary.get
            for batch in batches:
                ids = []
                for text in batch.column(1):
                    own = words(text.as_py())
                    ids.append(np.fromiter(map(get, own, repeat(0)), np.int32, len(own)))
                hit, found, longest = search(needles, ids)
                hits, names, most = [], [], []
                for k, (flags, items) in enumerate(zip(hit, found)):
                    before = batch.column(3)[k].as_py()
                    for a, b in zip(before[::2], before[1::2]):
                        flags[a:b] = True
                    hits.append(runs(flags))
                    names.append(sorted({*batch.column(4)[k].as_py(), *(needles.names[i] for i in items)}))
                    most.append(max(batch.column(5)[k].as_py(), int(longest[k])))
                text = pa.nulls(batch.num_rows, pa.binary()) if last else batch.column(1)  # the next block needs it
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array([len(x) for x in ids], pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(most, pa.int64())], ["id", "text", "n_words", "hits", "items", "longest"])

        return run

    schema = with_fields(state)
    for i in range(blocks):
        state = state.mapInArrow(lean(step(sc.broadcast(block(i)), i == blocks - 1)), schema)
    spans = F.transform(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1), lambda i: F.struct(F.get("hits", (2 * i).cast("int")).alias("start"), F.get("hits", (2 * i + 1).cast("int")).alias("end")))
    return state.select("id", "n_words", F.when(F.size("hits") > 0, spans).otherwise(F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), "items", "longest")



def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, but those that a benchmark window hits; no shuffle."""
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    found = find_contamination(whole, benchmark, "row", "text", **options)
    return found.where(F.size("spans") == 0).select("id.*")
