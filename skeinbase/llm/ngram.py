"""LM scoring by deleted interpolation of word n-grams.

A word's probability after the word before it mixes three maximum-likelihood estimates: that of the
pair, that of the word alone, and a uniform one. The weights depend on how often the word before was
seen (its context-frequency bucket) and are learned by expectation-maximisation on the pairs of
held-out rows. The counts of all pairs of all rows take part; no class, hash bin or cut stands in
for any. What every task has are the counts of the commonest words and pairs, tables of a fixed
size that only save shuffling. All other pairs meet in buckets: those of two common words by the
pair, those with a rare word by that word, whose count is then that of its pairs; those of two rare
words by both, and what the two buckets know is joined. A batch of texts sends each bucket one
sorted, compressed block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ceil_div, checkpointed, crc_mod_col, lean, release, slices

#: Words, and pairs of such words, whose counts every task has.
HEAD = 2**20
PAIRS = 2**20
#: A task hands on its counts of words when it has so many distinct ones.
COUNTED = 1_000_000
#: About so many pairs one task takes in at a time, in so many buckets.
PAIRS_PER_TASK = 3_000_000
BUCKETS = 4
#: Texts whose pairs are counted together.
TEXTS = 4096
END = b""  # no word is empty; the end of a text is also what comes before its first word
PASSES = 60
#: Estimates are told apart by an eighth of a power of two when weights are learned.
STEPS = 8
NONE = 1023

KEPT, HELD, OUT = 0, 1, 2
TAIL = np.int64(-(2**63))


def word_hash(word: bytes) -> int:
    """XXH64 as a signed long: words are told apart by it."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Vocabulary:
    """Counts of the head's words. A head word's id is its place here, another word's its hash with
    the sign bit set: 63 bits of it, so ids of both kinds never meet."""

    def __init__(self, h: np.ndarray, kept: np.ndarray, train: np.ndarray):
        order = np.argsort(h)
        self.h, self.kept, self.train = h[order], kept[order], train[order]

    def ids(self, words) -> np.ndarray:
        h = np.fromiter(map(word_hash, words), np.int64, len(words))
        if not len(self.h):
            return h | TAIL
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, h | TAIL)

    def count(self, ids: np.ndarray, which: str) -> np.ndarray:
        """The counts of head words, -1 for others."""
        own = getattr(self, which)
        return np.where(ids >= 0, own[np.maximum(ids, 0)], -1) if len(own) else np.full(len(ids), -1)


class Numbering(dict):
    """Words of a batch of texts, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts) -> tuple[Numbering, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts as numbers, each text followed by END; the word before each; sizes."""
    numbers = Numbering()
    numbers[END]
    parts, size = [], []
    end = np.zeros(1, np.int64)
    for t in texts:
        words = t.as_py().lower().split()
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), end]
        size.append(len(words) + 1)
    word = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return numbers, word, np.concatenate([end, word[:-1]])[: len(word)], np.array(size, np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(h, kept, train, every): how often each word, and END, occurs in the rows (text, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            h = [word_hash(w) for c in counts for w in c]
            part = np.repeat(np.arange(3, dtype=np.int32), [len(c) for c in counts])
            n = [x for c in counts for x in c.values()]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(part), pa.array(n, pa.int64())], ["h", "part", "n"])

        for batch in batches:
            for t, part in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[part].update(t.as_py().lower().split())
                counts[part][END] += 1
            if sum(map(len, counts)) >= COUNTED:
                yield flush()
        yield flush()

    def of(*parts: int):
        return F.sum(F.when(F.col("part").isin(*parts), F.col("n")).otherwise(0))

    return texts.select("text", "part").mapInArrow(lean(run), "h long, part int, n long").groupBy("h").agg(of(KEPT).alias("kept"), of(KEPT, HELD).alias("train"), F.sum("n").alias("every"))


def bucket(seen: np.ndarray) -> np.ndarray:
    """The context-frequency bucket: the bit length of the count."""
    return np.ceil(np.log2(np.maximum(seen, 0).astype(np.float64) + 1)).astype(np.int64)


def level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-STEPS * np.log2(p)), NONE - 1), NONE).astype(np.int64)


def cells(kept: np.ndarray, held: np.ndarray, before: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What expectation-maximisation needs of pairs: (cell, held-out count), a cell being the bucket of
    the word before, whose count is ``before``, and the levels of both estimates."""
    at = held > 0
    kept, held, before, word = kept[at], held[at], before[at], word[at]
    cell = bucket(before) << 20 | level(word / max(1, n)) << 10 | level(kept / np.maximum(before, 1))
    cell, inverse = np.unique(cell, return_inverse=True)
    return cell, np.bincount(inverse, held, len(cell)).astype(np.int64)


def mixture(cell: np.ndarray, held: np.ndarray, v: int, passes: int = PASSES) -> np.ndarray:
    """Weights [bucket, estimate] of the uniform, single and pair estimates. A bucket without held-out
    pairs has the weights of the nearest one with some, the lower of two."""

    def estimate(levels: np.ndarray) -> np.ndarray:
        return np.where(levels == NONE, 0.0, 2.0 ** (-levels / STEPS))

    lam = np.full((65, 3), 1 / 3)
    if len(cell):
        b = cell >> 20
        p = np.stack([np.full(len(cell), 1 / (v + 1)), estimate(cell >> 10 & NONE), estimate(cell & NONE)], 1)
        for _ in range(passes):
            share = lam[b] * p
            share *= (held / share.sum(1))[:, None]
            per = np.stack([np.bincount(b, share[:, o], 65) for o in range(3)], 1)
            seen = per.sum(1) > 0
            lam[seen] = per[seen] / per[seen].sum(1, keepdims=True)
        have = np.nonzero(seen)[0]
        lam = lam[have[np.argmin(np.abs(np.arange(65)[:, None] - have[None, :]), axis=1)]]
    lam[0] = [lam[0, 0], 1 - lam[0, 0], 0]  # after a word that was never seen there is no pair
    # The uniform estimate always has some weight: a word that was never seen has a probability.
    return 0.999 * lam + 0.001 * np.array([1.0, 0, 0])


class Model:
    """log10 probabilities from counts of the training rows."""

    def __init__(self, lam: np.ndarray, n: int, v: int):
        self.lam, self.n, self.v = lam, n, v

    def log10(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of words seen ``word`` times, after words seen ``before`` times, ``pair`` times after those."""
        lam = self.lam[bucket(before)]
        return np.log10(lam[:, 0] / (self.v + 1) + lam[:, 1] * word / max(1, self.n) + lam[:, 2] * pair / np.maximum(before, 1))

    def base(self, word: np.ndarray) -> np.ndarray:
        return np.log10((word + 0.5) / (self.n + 0.5 * (self.v + 1)))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of longs of one length, the first sorted: differences of that, the bytes of a place together."""
    n = len(columns[0])
    first = np.diff(columns[0], prepend=np.int64(0))
    planes = [np.ascontiguousarray(np.asarray(c, np.int64)).view(np.uint8).reshape(n, 8).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(raw[i].T).view(np.int64).ravel() for i in range(columns)]
    out[0] = np.cumsum(out[0])
    return out


#: How pairs meet: of two common words, by the word before, by the word itself.
BOTH, BEFORE, AFTER = 0, 1, 2


def dealt(u: np.ndarray, w: np.ndarray, buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, way of BOTH, BEFORE or AFTER, places): each pair of two common words in one bucket, each
    with a rare word before it in that one's, each whose word is rare in that one's."""

    def bucket_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y.view(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)

    for way, own, x, y in ((BOTH, (u >= 0) & (w >= 0), u, w), (BEFORE, u < 0, u, u), (AFTER, w < 0, w, w)):
        at = np.nonzero(own)[0]
        if not len(at):
            continue
        to = bucket_of(x[at], y[at])
        order = np.argsort(to, kind="stable")
        to, at = to[order], at[order]
        cuts = np.nonzero(np.diff(to, prepend=to[0]))[0]
        for group in np.split(at, cuts):
            yield int(bucket_of(x[group[:1]], y[group[:1]])[0]), way, group


def block(u: np.ndarray, w: np.ndarray, x: np.ndarray, way: int) -> bytes:
    """Pairs of one way with a value each, sorted by what they meet by."""
    if way == BOTH:
        key = u << 31 | w
        order = np.argsort(key, kind="stable")
        return pack(key[order], x[order])
    a, b = (u, w) if way == BEFORE else (w, u)
    order = np.lexsort((b, a))
    return pack(a[order], b[order], x[order])


def opened(way: int, blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, w, x) of all blocks, sorted by what they meet by, then the rest of the pair; where each pair
    starts, and of which pairs each word that they meet by has its first (each pair's own for BOTH)."""
    got = [np.concatenate(c) for c in zip(*(unpack(b, 2 if way == BOTH else 3) for b in blocks))]
    if way == BOTH:
        order = np.argsort(got[0], kind="stable")
        key, x = got[0][order], got[1][order]
        first = np.nonzero(np.diff(key, prepend=key[0] - 1))[0]
        return key >> 31, key & (2**31 - 1), x, first, np.arange(len(first))
    order = np.lexsort((got[1], got[0]))
    a, b, x = (c[order] for c in got)
    new = np.diff(a, prepend=a[0]) != 0
    new[0] = True
    pair = new | (np.diff(b, prepend=b[0]) != 0)
    first = np.nonzero(pair)[0]
    group = np.searchsorted(first, np.nonzero(new)[0])
    return (a, b, x, first, group) if way == BEFORE else (b, a, x, first, group)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    got: dict[int, list[bytes]] = {BOTH: [], BEFORE: [], AFTER: []}
    for b in batches:
        for way, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[way].append(data)
    for way in list(got):
        if data := got.pop(way):
            yield way, data


def of_group(per_pair: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The sum over each group, for each of its pairs."""
    return np.repeat(np.add.reduceat(per_pair, group), np.diff(np.append(group, len(per_pair))))


FOUND = "what int, u long, w long, a long, b long, c long"
CELL, COMMON, RARE_BEFORE, RARE_AFTER = 0, 1, 2, 3


def table(schema: str, *columns) -> pa.RecordBatch:
    """A batch of longs after its first, an int; columns left out are null."""
    n = len(columns[1])
    names = [c.split()[0] for c in schema.split(", ")]
    arrays = [pa.array(np.full(n, columns[0], np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in columns[1:])]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(n, pa.int64()) for _ in names[len(arrays) :])], names)


def count_pairs(texts: DataFrame, held, kept_words: int, tokens: int, pairs: int | None = None) -> DataFrame:
    """What the rows (text, part) have in pairs of words, as rows of FOUND.

    CELL: (u, a) a cell and its held-out count. COMMON: (u, w, a, b) common pairs of head words, with
    their count in all and in training rows. Of pairs of two rare words that held-out rows have,
    RARE_BEFORE: (u, w, a, b, c) the kept and held-out count, and the kept count of the word before;
    RARE_AFTER: (u, w, a) the kept count of the word.
    """
    tasks = ceil_div(int(0.75 * tokens), PAIRS_PER_TASK)
    share = ceil_div(PAIRS if pairs is None else pairs, tasks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            numbers, word, before, size = numbered(batch.column(0))
            part = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), size)
            at, n = np.unique((before * len(numbers) + word) * 4 + part, return_counts=True)
            ids = held.value.ids(numbers)
            u, w = (ids[i] for i in np.divmod(at >> 2, len(numbers)))
            x = n * 4 + (at & 3)
            rows = [(to, way, block(u[i], w[i], x[i], way)) for to, way, i in dealt(u, w, tasks * BUCKETS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["to", "way", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for way, data in blocks_of(batches):
            u, w, x, first, group = opened(way, data)
            n, part = x >> 2, x & 3
            kept, apart, every = (np.add.reduceat(y, first) for y in (np.where(part == KEPT, n, 0), np.where(part == HELD, n, 0), n))
            u, w = u[first], w[first]
            ku, kw = words.count(u, "kept"), words.count(w, "kept")
            if way == BOTH:
                top = np.lexsort((w, u, -every))[:share]
                yield table(FOUND, COMMON, u[top], w[top], every[top], (kept + apart)[top])
            if way == BEFORE:
                ku = of_group(kept, group)
            if way == AFTER:
                kw = of_group(kept, group)
            here = (ku >= 0) & (kw >= 0)
            cell, count = cells(*(y[here] for y in (kept, apart, ku, kw)), kept_words)
            yield table(FOUND, CELL, cell, np.zeros(len(cell)), count)
            late = ~here & (apart > 0)
            if way == BEFORE:
                yield table(FOUND, RARE_BEFORE, u[late], w[late], kept[late], apart[late], ku[late])
            if way == AFTER:
                yield table(FOUND, RARE_AFTER, u[late], w[late], kw[late])

    blocks = texts.select("text", "part").mapInArrow(lean(emit), "to int, way int, block binary").repartition(tasks, "to")
    return blocks.select("way", "block").mapInArrow(lean(meet), FOUND)


def score_texts(docs: DataFrame, training, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``.

    ``training`` and ``held_out`` are conditions on ``id``: the model is learned from the rows with
    ``training``, the mixture's weights on those of them with ``held_out``, against the counts of the
    others; scores use the counts of all training rows. A-Z are lower-cased, words are what ASCII
    white space leaves, one end follows each text's; null and empty texts have the end alone; repeated
    rows count each time. Without training rows N and V are 0 and all words are equally likely. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    parts = own.withColumn("part", F.when(training & held_out, HELD).when(training, KEPT).otherwise(OUT))
    counts = checkpointed(count_words(parts))
    n, v, kept_words, tokens = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("train", F.when(F.col("train") > 0, 1), "kept", "every"))).first()
    # The head is cut where a range of counts ends, so that no more than HEAD words are in it and no
    # task or driver sorts all words.
    by = F.floor(F.log2("every") * 64)
    sizes = counts.groupBy(by.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).toPandas()  # 4096 rows at most
    fits = sizes.level[sizes.words.cumsum() <= HEAD]
    least = int(fits.min()) if len(fits) else 64 * 64
    words = Vocabulary(*(c.to_numpy() for c in counts.where(by >= least).select("h", "kept", "train").toArrow().columns))  # HEAD rows at most
    held = spark.sparkContext.broadcast(words)
    release(spark)

    found = checkpointed(count_pairs(parts, held, kept_words, tokens))
    release(spark)

    def rare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, count = cells(*(c.to_numpy() for c in batch.columns), kept_words)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], ["cell", "n"])

    after = found.where(F.col("what") == RARE_AFTER).select("u", "w", F.col("a").alias("kw"))
    more = found.where(F.col("what") == RARE_BEFORE).join(after, ["u", "w"]).select("a", "b", "c", "kw").mapInArrow(lean(rare_cells), "cell long, n long")
    every = found.where(F.col("what") == CELL).select(F.col("u").alias("cell"), F.col("a").alias("n")).unionByName(more).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # as many as there are buckets and levels
    model = Model(mixture(every["cell"].to_numpy(), every["n"].to_numpy(), v), n, v)

    tasks = ceil_div(int(0.6 * tokens), PAIRS_PER_TASK)
    top = found.where(F.col("what") == COMMON).select("u", "w", "a", "b").orderBy(F.desc("a"), "u", "w").limit(PAIRS)
    u, w, _, pair = (c.to_numpy() for c in top.toArrow().columns)
    key = u << 31 | w
    order = np.argsort(key)
    known = model.log10(pair, words.train[u], words.train[w])[order] if len(u) else np.empty(0)
    common = spark.sparkContext.broadcast((key[order], known))
    del found, after, more, top
    release(spark)

    id_type = own.limit(0).select("id").toArrow().schema.field(0).type
    doc = f"id {own.dtypes[0][1]}, n_tokens long, n_known long, base double, score double"
    doc_names, doc_types = ["id", "n_tokens", "n_known", "base", "score"], [id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(to, way, block, row, then a text's own columns): a row for each text, with what is known of
        it here, and blocks of its other pairs; a pair's value is 2 * row + whether the text is trained on."""
        keys, values = common.value
        names = ["to", "way", "block", "row", *doc_names]
        for batch in slices(batches, TEXTS):
            if not batch.num_rows:
                continue
            row, train = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers, word, before, size = numbered(batch.column(1))
            ids = held.value.ids(numbers)
            at, inverse = np.unique(before * len(numbers) + word, return_inverse=True)
            pu, pw = (ids[x] for x in np.divmod(at, len(numbers)))
            key = np.where((pu >= 0) & (pw >= 0), pu << 31 | pw, -1)
            value, here = np.zeros(len(key)), np.zeros(len(key), bool)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                here = keys[place] == key
                value = np.where(here, values[place], 0.0)
            start = np.cumsum(size) - size
            c = held.value.count(ids, "train")
            base = np.where(c >= 0, model.base(np.maximum(c, 0)), 0.0)
            m = batch.num_rows
            sums = (size, np.add.reduceat((c > 0).astype(np.int64)[word], start), np.add.reduceat(base[word], start), np.add.reduceat(value[inverse], start))
            spread = pa.array((row % (tasks * BUCKETS)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([spread, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(row), batch.column(0), *map(pa.array, sums)], names)
            late = np.nonzero(~here[inverse])[0]
            u, w, x = pu[inverse[late]], pw[inverse[late]], np.repeat(row * 2 + train, size)[late]
            rows = [(to, way, block(u[i], w[i], x[i], way)) for to, way, i in dealt(u, w, tasks * BUCKETS)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), *(pa.nulls(len(rows), t) for t in doc_types)], names)

    rare = "what int, u long, w long, a long, b long, c long"
    names = [*(c.split()[0] for c in rare.split(", ")), "to", "block", "row", *doc_names]
    types = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.binary(), pa.int64(), *doc_types]

    def output(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, types)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as they come; blocks of (row, known, base score, score) summed over this task's pairs;
        rows of pairs of two rare words, RARE_BEFORE: (u, w, a, b, c) the counts of the pair and of the
        word before, and the text's row; RARE_AFTER: (u, w, a) the count of the word."""
        words = held.value
        got: dict[int, list[bytes]] = {BOTH: [], BEFORE: [], AFTER: []}
        for b in batches:
            whole = b.column(2).is_valid()
            texts_here = b.filter(whole)
            if texts_here.num_rows:
                yield output(texts_here.num_rows, **{k: texts_here.column(i) for i, k in enumerate(["row", *doc_names], 2)})
            b = b.filter(pa.compute.invert(whole))
            for way, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[way].append(data)
        rows, sums = [np.empty(0, np.int64)], [np.empty((3, 0))]
        for way in list(got):
            if not (data := got.pop(way)):
                continue
            u, w, x, first, group = opened(way, data)
            size = np.diff(np.append(first, len(u)))
            pair = np.add.reduceat(x & 1, first)
            pu, pw = u[first], w[first]
            tu, tw = words.count(pu, "train"), words.count(pw, "train")
            if way == BEFORE:
                tu = of_group(pair, group)
            if way == AFTER:
                tw = of_group(pair, group)
            here = (tu >= 0) & (tw >= 0)
            add = np.zeros((3, len(first)))
            if way == AFTER:  # counts that were not known where the text is
                add[0], add[1] = tw > 0, model.base(tw)
            add[2, here] = model.log10(pair[here], tu[here], tw[here])
            row, inverse = np.unique(x >> 1, return_inverse=True)
            each = np.repeat(np.arange(len(first)), size)
            rows.append(row)
            sums.append(np.stack([np.bincount(inverse, a[each], len(row)) for a in add]))
            if way == BEFORE:
                late = np.nonzero(~here[each])[0]
                p = each[late]
                yield output(len(late), what=np.full(len(late), RARE_BEFORE, np.int32), u=pu[p], w=pw[p], a=pair[p], b=tu[p], c=x[late] >> 1)
            if way == AFTER:
                late = np.nonzero(~here)[0]
                yield output(len(late), what=np.full(len(late), RARE_AFTER, np.int32), u=pu[late], w=pw[late], a=tw[late])
        row, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.stack([np.bincount(inverse, y, len(row)) for y in np.concatenate(sums, axis=1)])
        to = row % (last * BUCKETS)
        order = np.argsort(to, kind="stable")
        for group in np.split(order, np.nonzero(np.diff(to[order]))[0] + 1):
            if len(group):
                yield output(1, to=[int(to[group[0]])], block=[pack(row[group], *(y[group].view(np.int64) for y in total))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpack(data, 4) for b in batches for data in b.column(0).to_pylist()]
        if got:
            row, *sums = (np.concatenate(c) for c in zip(*got))
            row, inverse = np.unique(row, return_inverse=True)
            known, base, score = (np.bincount(inverse, c.view(np.float64), len(row)) for c in sums)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)], ["row", "n_known", "base", "score"])

    def rare_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pair, tu, tw = (c.to_numpy() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(model.log10(pair, tu, tw))], ["row", "score"])

    texts = own.select("id", "text", F.monotonically_increasing_id().alias("row"), training.alias("train"))  # the same in a task that runs again
    # Sums of about as many rows as there are texts in a task.
    last = ceil_div(tasks, 8)
    met = texts.mapInArrow(lean(emit), f"to int, way int, block binary, row long, {doc}").repartition(tasks, "to").drop("to")
    met = checkpointed(met.mapInArrow(lean(meet), f"{rare}, to int, block binary, row long, {doc}"))
    release(spark)
    summed = met.where("block is not null").select("to", "block").repartition(last, "to").select("block").mapInArrow(lean(add_up), "row long, n_known long, base double, score double")
    after = met.where(F.col("what") == RARE_AFTER).select("u", "w", F.col("a").alias("tw"))
    late = met.where(F.col("what") == RARE_BEFORE).join(after, ["u", "w"]).select(F.col("c").alias("row"), "a", "b", "tw").mapInArrow(lean(rare_scores), "row long, score double")
    whole = met.where("row is not null").select("row", *doc_names).unionByName(summed, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
    whole = whole.groupBy("row").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return whole.select("id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def by_crc(mod: int, out: int, held: int):
    """Conditions on ``id`` for :func:`score_texts`: all residues but ``out``, and ``held``."""
    return crc_mod_col("id", mod) != out, crc_mod_col("id", mod) == held
