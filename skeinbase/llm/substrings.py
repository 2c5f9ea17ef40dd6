"""Exact substring dedup with suffix arrays built by two-stage sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. The
strings that can be equal are brought together first. In each, the run of GRAM bytes of least hash
is its anchor; equal strings have equal anchors, so only strings whose anchor occurs again need to
meet, dealt by the anchor's hash. There a suffix array of their text brings equal strings next to
each other, and adjacent common prefixes of LENGTH bytes or more tell which have an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ceil_div, checkpointed, lean, release
from .suffixes import two_stage

LENGTH, GRAM = 100, 24
#: Bits of the maps of anchors that recur, and that are hot: their size is fixed. Where more than one in
#: FULL would be set, too many unique anchors would pass as recurring: each document then gets its own
#: recurring anchors by a join, which shuffles anchors and texts once, but nothing that is unique.
MAP_BITS = 28
FULL = 16
#: Stretches of text that meet in one task, about: what it sorts takes some 100 bytes of memory for
#: each byte of text, and a stretch has 140.
STRETCHES = 25_000
#: Anchors that occur more often are hot: their strings are dealt one by one, by their content, so
#: that no task gets more of one anchor.
HOT = 50_000
#: Stretches that are packed together, by where they go.
PACKED = 200_000
#: Bytes of text that are looked at together.
AT_ONCE = 2_000_000
_MAX = 2**63 - 1
_HALF = (LENGTH - GRAM + 1) // 2
_SALT = 0x8F14E45FCEEA167A


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _words(data: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions, as a number."""
    return np.ndarray((n,), "<u8", data, 0, (1,))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    n = len(data) - GRAM + 1
    v = _words(data, n + GRAM - 8)
    h = _mix(v[:n] ^ np.uint64(_SALT))
    for i in range(8, GRAM, 8):
        h = _mix(h + v[i : i + n])
    return h


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes within the texts, by anchor.

    For each run of strings with one anchor: the number of the text, the first string's start in
    it, where in it the anchor is, the bytes from the first string's start to the last one's end,
    and the anchor's hash.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    none = tuple(np.empty(0, np.uint64 if i == 4 else np.int64) for i in range(5))
    data = b"".join(texts)
    if len(data) < LENGTH:
        return none
    begin = np.cumsum(size) - size
    h = gram_hashes(data)
    window = LENGTH - GRAM + 1
    # Hash above, position below: the least is the leftmost of those with the least hash.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = np.full(ceil_div(len(key), window) * window, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(key)] = key
    rows = rows.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    anchor = (np.minimum(back[:n], ahead[window - 1 : window - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    usable = size >= LENGTH
    inside[begin[usable]] += 1
    inside[(begin + size - LENGTH + 1)[usable]] -= 1
    start = np.nonzero(np.cumsum(inside[:-1]))[0]
    if not len(start):
        return none
    anchor = anchor[start]
    doc = np.searchsorted(begin, start, side="right") - 1
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(start)) - 1
    doc = doc[first]
    return doc, start[first] - begin[doc], anchor[first] - start[first], start[last] - start[first] + LENGTH, h[anchor[first]]


def _grouped(column) -> Iterator[tuple[int, list[bytes], int]]:
    """Number of the first text, texts, and where in it they begin: AT_ONCE bytes or so at a time.
    A longer text comes in parts, that share LENGTH - 1 bytes so that no string is lost or twice."""
    held, total, first = [], 0, 0
    for i, t in enumerate(column):
        text = t.as_py()
        if len(text) > AT_ONCE:
            if held:
                yield first, held, 0
            for at in range(0, len(text) - LENGTH + 1, AT_ONCE):
                yield i, [text[at : at + AT_ONCE + LENGTH - 1]], at
            held, total, first = [], 0, i + 1
            continue
        held.append(text)
        total += len(text)
        if total >= AT_ONCE:
            yield first, held, 0
            held, total, first = [], 0, i + 1
    if held:
        yield first, held, 0


def count_anchors(docs: DataFrame) -> DataFrame:
    """(h, n): how many stretches of the column ``text`` have an anchor of this hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(texts)[4] for _, texts, _ in _grouped(batch.column(0))]
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            for i in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["h", "n"])

    return docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of 2 ** MAP_BITS bits with those of the first bits of ``h`` set."""
    at = hashes.select(F.shiftrightunsigned("h", 64 - MAP_BITS).alias("at"))
    cells = at.select(F.shiftrightunsigned("at", 6).alias("cell"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    found = cells.toPandas()  # 2 ** (MAP_BITS - 6) rows at most
    out = np.zeros(1 << max(0, MAP_BITS - 6), np.int64)
    out[found.cell.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def in_map(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(held) * 64).bit_length() + 1)
    return (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def with_recurring(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows (id, tie, text) that have any of ``anchors`` (h, n), with ``known``, which of theirs these are
    and whether they are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts, _ in _grouped(batch.column(2)):
                doc, _, _, _, h = stretches(texts)
                own = np.unique(np.stack([doc.astype(np.uint64), h], 1), axis=0)
                at = first + own[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ties[at]), pa.array(np.ascontiguousarray(own[:, 1]).view(np.int64))], ["id", "tie", "h"])

    each = docs.mapInArrow(lean(run), "id long, tie long, h long").join(anchors.select("h", (F.col("n") > HOT).alias("hot")), "h")
    known = each.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "hot")).alias("known"))
    return docs.join(known, ["id", "tie"]).select("id", "tie", "text", "known")


def merged(ids: np.ndarray, ties: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges a to b of documents, those that touch or overlap made one."""
    by = np.lexsort((a, ties, ids))
    ids, ties, a, b = ids[by], ties[by], a[by], b[by]
    doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])])[: len(ids)]
    far = np.maximum.accumulate((np.cumsum(doc) << 40) + b)
    first = np.nonzero(doc | np.concatenate([[True], (a[1:] > (far & ((1 << 40) - 1))[:-1])])[: len(ids)])[0]
    return ids[first], ties[first], a[first], np.maximum.reduceat(far, first) & ((1 << 40) - 1) if len(first) else b


def leads(order: np.ndarray, texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Of equal texts the first in ``order``; and for each text that one."""
    number: dict[bytes, int] = {}
    lead = [0] * len(texts)
    for i in order.tolist():
        lead[i] = number.setdefault(texts[i], i)
    return list(number.values()), lead


def pack(part: list[tuple], deal: int) -> Iterator[tuple[int, bytes]]:
    """Stretches, as (ids, ties, starts, anchors' places, hashes, texts) of several lots, as one
    compressed block for each of ``deal`` places to go.

    Of equal stretches only the first has its text in the block; the others are ranges that go, as
    all their strings have an earlier one. So a text that repeats itself doesn't make many.
    """
    ids, ties, start, place, h = (np.concatenate(x) for x in list(zip(*part))[:5])
    text = [t for x in part for t in x[5]]
    to = (h % np.uint64(deal)).astype(np.int64)
    by = np.lexsort((start, ties, ids, to))
    edge = np.nonzero(np.concatenate([[True], to[by][1:] != to[by][:-1]]))[0].tolist() if len(by) else []
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for a, b in zip(edge, [*edge[1:], len(by)]):
        own = by[a:b]
        texts = [text[i] for i in own.tolist()]
        first, lead = leads(np.arange(len(own)), texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        i, t, s = ids[own], ties[own], start[own]
        again = np.nonzero((i != i[lead]) | (t != t[lead]) | (s != s[lead]))[0]
        gone = merged(i[again], t[again], s[again], (s + size)[again])
        fields = (i[first], t[first], s[first], place[own][first].astype(np.int64), size[first])
        yield int(to[own[0]]), squeeze(b"".join([len(first).to_bytes(8, "little"), len(gone[0]).to_bytes(8, "little"), *(f.tobytes() for f in (*fields, *gone)), *(texts[k] for k in first)]))


def unpack(block: bytes) -> tuple:
    """ids, ties, starts, hashes, :func:`sides` and texts of a block of :func:`pack`, and its ranges."""
    data = zstandard.ZstdDecompressor().decompress(block)
    n, m = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    ids, ties, start, place, size = np.frombuffer(data, np.int64, 5 * n, 16).reshape(5, n)
    gone = np.frombuffer(data, np.int64, 4 * m, 16 + 40 * n).reshape(4, m)
    end = np.cumsum(size) + 16 + 40 * n + 32 * m
    begin = end - size
    words = _words(data, len(data) - 7)
    h = _mix(words[begin + place] ^ np.uint64(_SALT))
    for i in range(8, GRAM, 8):
        h = _mix(h + words[begin + place + i])
    return ids, ties, start, h, sides(words, begin, end, begin + place, h), [data[a:b] for a, b in zip(begin.tolist(), end.tolist())], gone


def sides(words: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[2, n]: hashes of the anchor with the _HALF bytes left, and right, of it; 0 where the text ends
    before. Strings of LENGTH bytes that are equal, anchors included, are so on one side at least."""
    out = np.zeros((2, len(h)), np.uint64)
    for side, at in enumerate((anchor - _HALF, anchor + GRAM)):
        ok = (at >= begin) & (at + _HALF <= end)
        x = h[ok] + np.uint64(side)
        for i in [*range(0, _HALF - 7, 8), _HALF - 8]:
            x = _mix(x + words[at[ok] + i])
        out[side, ok] = x | np.uint64(1)
    return out


def _again(x: np.ndarray) -> np.ndarray:
    """Which values are there more than once; 0 never is."""
    _, own, n = np.unique(x, return_inverse=True, return_counts=True)
    return (n[own] > 1) & (x != 0)


def _spans(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes: the run of each item, and its place in the run."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


def later_copies(rank: np.ndarray, start: np.ndarray, text: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of stretches that strings with an earlier equal one cover: number of the stretch,
    and the range in its document.

    ``rank`` orders the documents of the stretches, ``start`` is where a stretch starts, ``h`` its
    anchor's hash: strings of different anchors are never equal.
    """
    # Equal stretches: all strings of all but the first have an earlier one.
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(t, len(number)) for t in text), np.int64, len(text))
    size = np.fromiter(map(len, text), np.int64, len(text))
    by = np.lexsort((start, rank, kind))
    head = np.concatenate([[True], kind[by][1:] != kind[by][:-1]])
    lead = by[head]  # the first of each kind, by kind
    own = lead[kind]
    copies = np.nonzero((rank != rank[own]) | (start != start[own]))[0]
    out = [(copies, start[copies], start[copies] + size[copies])]

    # One suffix array over the different stretches, of anchors with more than one.
    lead = lead[_again(h[lead] | np.uint64(1))]
    if not len(lead):
        return out[0]
    different = [text[i] for i in lead.tolist()]
    size = size[lead]
    joined = b"\0".join([*different, b""])
    numbers = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    begin = np.cumsum(size + 1) - (size + 1)
    numbers[begin + size] = 0
    array = two_stage(numbers, LENGTH, 256)
    which = np.searchsorted(begin, array, side="right") - 1
    fits = array + LENGTH <= begin[which] + size[which]
    array, which = array[fits], which[fits]
    # Adjacent common prefixes, as far as LENGTH.
    words = _words(joined + bytes(8), len(joined) + 1)
    open_ = np.arange(len(array) - 1)
    for d in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        open_ = open_[words[array[open_] + d] == words[array[open_ + 1] + d]]
    new = np.ones(len(array), bool)
    new[open_ + 1] = False
    first = np.nonzero(new)[0]
    if len(first) < len(array):
        order, at = rank[lead][which], start[lead][which] + array - begin[which]
        run = np.cumsum(new) - 1
        by = np.lexsort((at, order, run))
        best = by[first]
        later = (order != order[best][run]) | (at != at[best][run])
        flags = np.zeros(len(joined) + 1, np.int8)
        flags[array[later]] = 1
        edge = np.diff(np.concatenate([[0], flags]))
        a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        stretch = np.searchsorted(begin, a, side="right") - 1
        shift = start[lead][stretch] - begin[stretch]
        out.append((lead[stretch], a + shift, b + shift + LENGTH - 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(id, tie, a, b): byte ranges that strings with an earlier equal one cover, for the rows
    (id long, tie long, text binary), id then tie their order. Ranges of a document may overlap."""
    sc = docs.sparkSession.sparkContext
    anchors = count_anchors(docs).where("n > 1").persist()
    recurring = heated = None
    try:
        total, n, hot = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") > HOT, 1))).first()
        if n * FULL > 1 << MAP_BITS:
            docs = checkpointed(with_recurring(docs, anchors))
        else:
            recurring = sc.broadcast(bit_map(anchors.where(F.col("n") <= HOT)))
            heated = sc.broadcast(bit_map(anchors.where(F.col("n") > HOT))) if hot else None
    finally:
        anchors.unpersist()
    del anchors
    release(docs.sparkSession)
    deal = ceil_div(total, STRETCHES)

    def ways(batch: pa.RecordBatch):
        """Tells of anchors whether they recur, and whether they are hot."""
        if recurring is None:
            flat = batch.column(3).flatten()
            known, is_hot = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False).astype(bool)
            return lambda h: (np.isin(h, known), np.isin(h, known[is_hot]))
        return lambda h: (in_map(recurring.value, h), in_map(heated.value, h) if heated else np.zeros(len(h), bool))

    def chosen(batch: pa.RecordBatch, want_hot: bool):
        """Of a batch's stretches those that go one way: ids, ties, starts, places of anchors, hashes, texts."""
        ids, ties, way = batch.column(0).to_numpy(), batch.column(1).to_numpy(), ways(batch)
        for first, texts, at in _grouped(batch.column(2)):
            doc, start, place, size, h = stretches(texts)
            recurs, is_hot = way(h)
            keep = np.nonzero(is_hot if want_hot else recurs & ~is_hot)[0]
            doc, start = doc[keep], start[keep]
            cut = [texts[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), size[keep].tolist())]
            yield ids[first + doc], ties[first + doc], start + at, place[keep], h[keep], cut

    def emit_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in chosen(batch, False):
                held.append(part)
                n += len(part[0])
                if n >= PACKED:
                    yield from packed(held)
                    held, n = [], 0
        yield from packed(held)

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for to, block in pack(held, deal) if held else ():
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([block], pa.binary())], ["to", "block"])

    def emit_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of equal strings that are seen together only the first is dealt; the others go at once.
        for batch in batches:
            for ids, ties, start, _, _, cut in chosen(batch, True):
                run, place = _spans(np.fromiter((len(c) - LENGTH + 1 for c in cut), np.int64, len(cut)))
                digest = [xxhash.xxh3_128_digest(cut[i][j : j + LENGTH]) for i, j in zip(run.tolist(), place.tolist())]
                i, t, s = ids[run], ties[run], start[run] + place
                first, lead = leads(np.lexsort((s, t, i)), digest)
                again = np.nonzero((i != i[lead]) | (t != t[lead]) | (s != s[lead]))[0]
                gone = merged(i[again], t[again], s[again], s[again] + LENGTH)
                w = pa.array([*(digest[k] for k in first), *[None] * len(gone[0])], pa.binary())
                yield pa.RecordBatch.from_arrays([w, *(pa.array(np.concatenate([x[first], y]), pa.int64()) for x, y in zip((i, t, s, s + LENGTH), gone))], ["w", "id", "tie", "a", "b"])

    def ranges_of(arrays) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in arrays], ["id", "tie", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by where they go: one group is in memory at a time.
        blocks = ((to.as_py(), x.as_py()) for batch in batches for to, x in zip(batch.column(0), batch.column(1)))
        for _, group in groupby(blocks, key=itemgetter(0)):
            parts = [unpack(x) for _, x in group]
            ids, ties, start, h = (np.concatenate(x) for x in list(zip(*parts))[:4])
            left, right = np.concatenate([p[4] for p in parts], axis=1)
            gone = np.concatenate([p[6] for p in parts], axis=1)
            yield ranges_of(merged(*gone))
            keep = np.nonzero(_again(left) | _again(right))[0]
            if not len(keep):
                continue
            text = [t for p in parts for t in p[5]]
            del parts
            ids, ties, start = ids[keep], ties[keep], start[keep]
            by = np.lexsort((ties, ids))
            new = np.concatenate([[True], (ids[by][1:] != ids[by][:-1]) | (ties[by][1:] != ties[by][:-1])])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(new)
            at, a, b = later_copies(rank, start, [text[i] for i in keep.tolist()], h[keep])
            yield ranges_of(merged(ids[at], ties[at], a, b))

    ranges = docs.mapInArrow(lean(emit_packed), "to long, block binary").repartition(deal, "to").sortWithinPartitions("to").mapInArrow(lean(meet), "id long, tie long, a long, b long")
    if hot:
        strings = checkpointed(docs.mapInArrow(lean(emit_strings), "w binary, id long, tie long, a long, b long"))
        least = strings.where("w is not null").groupBy("w").agg(F.min(F.struct("id", "tie", "a")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = strings.join(least, "w").where(F.struct("id", "tie", "a") > F.col("least"))
        ranges = ranges.unionByName(later.select("id", "tie", "a", "b")).unionByName(strings.where("w is null").select("id", "tie", "a", "b"))
    return ranges


def covered(n: int, ranges: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that the ranges (start, end in turn) cover of n bytes; touching ones join."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, ranges[::2], 1)
    np.add.at(edge, ranges[1::2], -1)
    at = np.nonzero(np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])))[0]
    return list(zip(at[::2].tolist(), at[1::2].tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept binary, spans array<struct<start, end>>): one row for each row of ``docs``.

    ``spans`` are the maximal runs of bytes removed, ``kept`` the bytes left. Ids are integers and
    order the documents; a null id comes last. Rows with one id but different texts are documents
    of their own, ordered by their texts' hash; rows that are equal are one document, so that each
    keeps the same. A null text counts as empty; texts under LENGTH bytes stay whole.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_MAX))
    own = docs.select(key.alias("id"), F.xxhash64(as_bytes(text_col)).alias("tie"), as_bytes(text_col).alias("text"))
    ranges = repeated_ranges(own).groupBy("id", "tie").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("ranges"))
    joined = docs.select(F.col(id_col).alias("own"), key.alias("id"), F.xxhash64(as_bytes(text_col)).alias("tie"), as_bytes(text_col).alias("text")).join(ranges, ["id", "tie"], "left").select("own", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                kept, spans, size = [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2)):
                    runs = covered(len(text), ranges.values.to_numpy()) if ranges.is_valid else []
                    size.append(len(text))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(lean(run), f"id {docs.select(id_col).dtypes[0][1]}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
