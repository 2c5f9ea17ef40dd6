"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ceil_div, checkpointed, lean, quoted, release, slices
from .components import connected_components

SEED = 42
#: Rows of variants that one task takes in at a time: its memory, whatever the input's size.
VARIANTS_PER_TASK = 1_000_000
#: Up to so many fingerprints on one variant, all of their pairs are tested at once.
SMALL_RUN = 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of ``k`` words, joined by spaces; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[i:j], SEED) for i, j in zip(start, end[k - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have; zero if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = hashes[i : i + 65536].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each row's word shingles, as a signed long.

    A-Z are lower-cased, words are what ASCII white space leaves. A text without words (null and
    empty too) has the fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(shingle_hashes(t.as_py().lower().split(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    ids = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    return ids.mapInArrow(lean(run), f"id {ids.schema['id'].dataType.simpleString()}, fp long")


def variants(fp: np.ndarray, radius: int) -> np.ndarray:
    """Row i: the keys under which fingerprint i meets all within ``radius`` of it.

    Both sides flip up to half the radius. That reaches an even radius; for an odd one, one of
    three blocks of bits is left out at a time: two fingerprints that differ in an odd number of
    bits differ in some block, and without it the rest is met half way.
    """
    half, odd = divmod(radius, 2)
    at = np.arange(64)
    blocks = [(at * 3) // 64 == j for j in range(3)] if odd else [np.zeros(64, bool)]
    out = []
    for j, gone in enumerate(blocks):
        masks, last = {0}, {0}
        for _ in range(half):
            last = {m | 1 << int(b) for m in last for b in at[~gone] if not m >> int(b) & 1}
            masks |= last
        keep = sum(1 << int(b) for b in at[~gone])
        key = (fp[:, None] & np.uint64(keep)) ^ np.array(sorted(masks), np.uint64)[None, :]
        out.append((key + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(j << 61))
    return np.concatenate(out, axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what links of ``radius`` join in ``fp``; fewer edges than fingerprints."""
    parent = list(range(len(fp)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(fp)):
        for j in np.nonzero(apart(fp[i + 1 :], fp[i]) <= radius)[0].tolist():
            x, y = top(i), top(i + 1 + j)
            if x != y:
                parent[y] = x
                edges.append((i, i + 1 + j))
    return edges


def verified(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` among fingerprints with the same key.

    Of a long run of one key only a spanning forest of its links is returned: its components are
    the same.
    """
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    size = np.diff(np.append(first, len(key)))
    run = np.repeat(np.arange(len(first)), size)
    short = size[run] <= SMALL_RUN
    left, right = [], []
    for lag in range(1, min(SMALL_RUN, int(size.max(initial=0)))):
        ok = (run[lag:] == run[:-lag]) & short[lag:]
        i = np.nonzero(ok)[0]
        i = i[apart(fp[i], fp[i + lag]) <= radius]
        left.append(fp[i])
        right.append(fp[i + lag])
    for r in np.nonzero(size > SMALL_RUN)[0]:
        own = np.unique(fp[first[r] : first[r] + size[r]])
        if e := forest(own, radius):
            i, j = np.array(e).T
            left.append(own[i])
            right.append(own[j])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def ball_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of column ``fp``, enough to join all that are
    within ``radius`` bits, directly or through others.

    Every fingerprint emits its variants within half the radius; they are dealt by variant, and
    those that meet are compared. Equal fingerprints have been merged before, so that no key is
    hot for copies.
    """
    fps = checkpointed(fps.select("fp").where("fp is not null").distinct())
    per = variants(np.zeros(1, np.uint64), radius).shape[1]
    tasks = ceil_div(fps.count() * per, VARIANTS_PER_TASK)
    fps = fps.repartition(tasks)  # distinct leaves few partitions, and each row becomes many

    def emit(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                key = variants(part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, per).view(np.int64))], ["key", "fp"])

    def meet(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            key, fp = (np.concatenate(x) for x in zip(*got))
            a, b = verified(key.view(np.uint64), fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    met = fps.mapInArrow(lean(emit), "key long, fp long").repartition(tasks, "key").mapInArrow(lean(meet), "a long, b long")
    return met.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): one row for each row of ``docs``, whatever its other columns.

    ``component`` is the smallest id that links of at most ``radius`` differing bits reach, the
    row's own included. Rows with one id count as documents of their own; a null id takes part
    in links, but is never a component's name unless there is no other.
    """
    own = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    least = own.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(ball_links(own, radius))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = checkpointed(rooted.join(named, "root").select("fp", "component"))
    return own.join(of, "fp").select("id", "fp", "component")


#: One text in so many is looked at for common shingles, the commonest of which come last in every text.
SAMPLED = 16
COMMON = 2**17
#: About so many shingles of prefixes one task takes in at a time.
PREFIXES_PER_TASK = 1_000_000
#: Slack against rounding, on the side of comparing too many texts.
SLACK = 1e-9
#: Up to so many keys are sent to all tasks; beyond that texts are shuffled to meet them.
BROADCAST = 1_000_000


def parity(hashes: np.ndarray) -> np.ndarray:
    """Which remainders an odd number of the hashes have, as bits: twice as many as there are hashes, or
    more. Maps of two sets differ in no more bits than the sets do in elements."""
    size = max(256, 1 << int(2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8))


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two maps differ, the larger one folded to the size of the other."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(hashes: np.ndarray, common: np.ndarray, count: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a text's different shingles, rare ones first, that every text of ``similarity`` or more
    has one of them in its own prefix. Any order will do that all texts keep to."""
    if len(common):
        at = np.searchsorted(common, hashes).clip(max=len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, count[at], 0)))]
    return hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - SLACK)) + 1]


def may_reach(na: np.ndarray, place_a: np.ndarray, nb: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts of ``n`` shingles whose first common one is at place ``p`` can be so similar."""
    need = similarity / (1 + similarity) * (na + nb) - SLACK
    return (np.minimum(na - place_a, nb - place_b) >= need) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - SLACK)


def met(at: np.ndarray, key: np.ndarray, pos: np.ndarray, n: np.ndarray, root: np.ndarray | None, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare among texts with the same shingle, from rows sorted by shingle, place and key.

    Without ``root``, each with the first one there, whose rare shingles are fewest: of edited copies,
    mostly the original. With it, all pairs of the others whose roots differ, so that what is joined
    already makes no more pairs.
    """
    first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0] if len(at) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(at)))
    if root is None:
        lead = np.repeat(first, size)
        i = np.nonzero((lead != np.arange(len(at))) & may_reach(n[lead], pos[lead], n, pos, similarity))[0]
        yield key[lead[i]], key[i]
        return
    left, right, held = [], [], 0
    for f, k in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        if (root[f + 1 : f + k] == root[f + 1]).all():
            continue
        for i in range(f + 1, f + k - 1):
            rest = slice(i + 1, f + k)
            ok = (root[rest] != root[i]) & may_reach(n[i], pos[i], n[rest], pos[rest], similarity)
            if ok.any():
                right.append(key[rest][ok])
                left.append(np.full(len(right[-1]), key[i]))
                held += len(right[-1])
                if held > PREFIXES_PER_TASK:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def text_hash(text_col: str):
    return F.xxhash64(as_bytes(text_col))


def text_key(text_col: str, taken: list[int] | None = None):
    """A text's 64-bit hash, or for the hashes ``taken`` that several texts have, another one."""
    key = text_hash(text_col)
    return F.when(key.isin(taken), F.xxhash64(F.lit("other"), as_bytes(text_col))).otherwise(key) if taken else key


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> tuple[DataFrame, list[int]]:
    """(key, least): for each different text of ``docs``, by its :func:`text_key`, the smallest id of a row
    in its group of near copies; and the hashes that are taken.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is ``similarity``
    or more. Texts whose SimHashes are within ``radius`` meet by ball hashing; as similar texts may be
    further apart, all pairs that can be so similar also meet under the shingles of their prefixes:
    first each text with one under each shingle, then with all there that those links leave in other
    groups, so that a large group doesn't give as many comparisons as it has pairs. What meets is
    compared by parity maps, which never part similar texts, then verified by the whole sets.
    Equal texts are merged before; a null text counts as empty; texts of fewer words than a shingle are
    one shingle, and texts without words have none in common. An empty table gives an empty result.
    """
    spark = docs.sparkSession

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
        seen = set()  # equal texts that one task has
        for batch in slices(batches, 256):
            keys, every = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    every.append(shingle_hashes(t.as_py().lower().split(), shingle))
            yield keys, every, [np.unique(h) for h in every]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["at"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, sets in sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    names = ["at", "key", "pos", "n", "fp", "bits"]
    schema = "at long, key long, pos int, n int, fp long, bits binary"

    def rows_of(at, key, pos, n, fp=None, bits=None) -> pa.RecordBatch:
        none = (pa.nulls(len(at), t) for t in (pa.int64(), pa.binary()))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (at, key, pos, n)), *((pa.array(fp), pa.array(bits, pa.binary())) if fp is not None else none)], names)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, of place -1, with its SimHash and parity map, and one for each shingle of its prefix."""
        common, count = known.value
        for keys, every, sets in sets_of(batches):
            own = np.array(keys, np.int64)
            n = np.array([len(h) for h in sets], np.int32)
            fp = np.array([simhash(h) for h in every], np.uint64).view(np.int64)
            yield rows_of(own, own, np.full(len(own), -1, np.int32), n, fp, [parity(h).tobytes() for h in sets])
            found = [prefix(h, common, count, similarity) if len(h) else h for h in sets]
            size = np.array([len(f) for f in found], np.int64)
            at = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            pos = np.concatenate([np.empty(0, np.int32), *(np.arange(x, dtype=np.int32) for x in size)])
            yield rows_of(at, np.repeat(own, size), pos, np.repeat(n, size))

    def gathered(rows: list[np.ndarray]) -> list[np.ndarray]:
        """A task's rows without repeated ones, sorted, of the shingles that several texts have."""
        order = np.lexsort((rows[1], rows[2], rows[0]))
        rows = [x[order] for x in rows]
        at, key = rows[:2]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1])])[: len(at)]
        rows = [x[new] for x in rows]
        same = rows[0][1:] == rows[0][:-1]
        several = np.concatenate([same, [False]])[: len(rows[0])] | np.concatenate([[False], same])[: len(rows[0])]
        return [x[several] for x in rows]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, seen = [], set()
        for b in batches:
            text = pa.compute.less(b.column(2), 0)
            own = b.filter(text)
            new = []
            for i, k in enumerate(own.column(1).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            yield own.take(pa.array(new, pa.int64()))
            got.append([c.to_numpy() for c in b.filter(pa.compute.invert(text)).columns[:4]])
        if got:
            rows = [np.concatenate(x) for x in zip(*got)]
            del got
            yield rows_of(*gathered(rows))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if got:
            rows = gathered([np.concatenate(x) for x in zip(*got)])
            del got
            for a, b in met(*rows[:4], rows[4] if len(rows) > 4 else None, similarity):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def can_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (batch.column(2).to_numpy() + batch.column(3).to_numpy().astype(np.int64)) * (1 - similarity) / (1 + similarity) + SLACK
            maps = ([np.frombuffer(x, np.uint8) for x in batch.column(i).to_pylist()] for i in (4, 5))
            yield batch.filter(pa.array([differ(x, y) <= m for x, y, m in zip(*maps, size)], pa.bool_())).select(["a", "b"])

    def side(df: DataFrame, name: str, **columns: str) -> DataFrame:
        return df.select(F.col("key").alias(name), *(F.col(c).alias(n) for n, c in columns.items()))

    def verified_links(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(texts, "a", na="n", x="bits"), "a").join(side(texts, "b", nb="n", y="bits"), "b")
        pairs = checkpointed(both.select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(can_reach), "a long, b long"))
        compared = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        few = compared.count() <= BROADCAST
        sets = checkpointed(keyed.join(F.broadcast(compared) if few else compared, "key", "left_semi").select("key", "text").mapInArrow(lean(shingles), "key long, shingles array<long>").dropDuplicates(["key"]))
        both = pairs.join(side(sets, "a", x="shingles"), "a").join(side(sets, "b", y="shingles"), "b")
        common = F.size(F.array_intersect("x", "y"))
        links = checkpointed(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).where(common > 0).select("a", "b"))
        del compared, sets, both
        release(spark)
        return links

    # The first row of each different text stands for it.
    other = F.xxhash64(F.lit("other"), as_bytes(text_col))
    hashes = docs.select(text_hash(text_col).alias("key"), other.alias("more"))
    taken = [r.key for r in hashes.groupBy("key").agg(F.min("more").alias("x"), F.max("more").alias("y")).where("x <> y").select("key").collect()]  # of n texts some n * n / 2 ** 65
    keyed = docs.select(text_key(text_col, taken).alias("key"), F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    least = checkpointed(keyed.groupBy("key").agg(F.min("id").alias("least"), F.max(F.length("text")).alias("size")))
    size = least.agg(F.sum("size")).first()[0] or 0
    tasks = ceil_div(int(size * (1 - similarity)) // 5, PREFIXES_PER_TASK)
    least = least.select("key", "least")

    sample = keyed.where(F.pmod("key", F.lit(SAMPLED)) == 0).select("key", "text").mapInArrow(lean(each), "at long")
    often = sample.groupBy("at").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "at").limit(COMMON).toArrow()
    at, counts = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(at)
    known = spark.sparkContext.broadcast((at[order], counts[order]))

    index = checkpointed(keyed.select("key", "text").mapInArrow(lean(prefixes), schema).repartition(tasks, "at").mapInArrow(lean(shared), schema))
    release(spark)
    texts = index.where("pos < 0").select("key", "n", "fp", "bits")
    index = index.where("pos >= 0").select("at", "key", "pos", "n")
    # Of texts with one SimHash each meets the first, and the first ones of SimHashes within the radius meet.
    own = texts.where("n > 0").select("key", "fp")
    first = own.groupBy("fp").agg(F.min("key").alias("first"))
    near = ball_links(own, radius).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.select("x", "y").unionByName(own.join(first, "fp").select(F.col("first").alias("x"), F.col("key").alias("y")).where("x <> y"))
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = checkpointed(index.mapInArrow(lean(meet), "a long, b long").unionByName(near).distinct())
    del near, own, first
    release(spark)
    links = verified_links(pairs)
    del pairs
    roots = connected_components(links)
    rooted = index.join(roots, index.key == roots.node, "left").select("at", "key", "pos", "n", F.coalesce("root", "key").alias("root"))
    pairs = checkpointed(rooted.repartition(tasks, "at").mapInArrow(lean(meet), "a long, b long").distinct())
    del index, rooted
    release(spark)
    if pairs.limit(1).count():
        links = links.unionByName(verified_links(pairs))
        roots = connected_components(links)
    rooted = least.join(roots, least.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    return rooted.join(named, "root").select("key", F.col("kept").alias("least")), taken


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, whatever their names, but of each group of near copies
    only the one of smallest id; of rows with one id and text, one. If all ids of a group are null, one of
    them stays."""
    spark = docs.sparkSession
    kept, taken = near_copies(docs, id_col, text_col, **options)
    rows = docs.select(text_key(text_col, taken).alias("key"), F.col(quoted(id_col)).alias("id"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    first = rows.groupBy("key", "id").agg(F.count("*").alias("n"))
    release(spark)
    kept = kept.select(F.col("key").alias("k"), "least")
    first = checkpointed(first.join(kept, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("least"))).select("key", "id", "n"))
    del kept
    release(spark)

    def among(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select(F.col("key").alias("k"), F.col("id").alias("i"))
        return rows.join(chosen, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")

    found = among(first.where("n = 1"))
    if first.where("n > 1").limit(1).count():
        found = found.unionByName(among(first.where("n > 1")).dropDuplicates(["key", "id"]))
    return found.select("row.*")
