"""Copies among images, by local descriptors.

Corners at several scales, each with binary tests of the patch around it, turned by the patch's
orientation. Blocks of descriptors meet each other, all of them, and two images are linked if enough
of their matches agree on one move, turn and change of size; where their pixels agree under it as well,
they are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, checkpointed, lean
from .components import connected_components
from .images import decode

BITS = 128
PATCH = 13  # tests and orientation reach so far from a corner
SCALES = (1.0, 0.5)
#: A corner's response must be this share of the image's greatest, and the greatest in a 7 x 7 square.
RESPONSE = 0.02
#: Matches differ in so many bits at most.
HAMMING = 20
#: Matches of two images that must agree on where each image's pixels lie in the other, in pixels.
AGREE, WITHIN = 6, 3.0
#: Pixels of linked images correlate by so much where they lie over one another, in this share of the smaller one at least.
ALIKE, SHARED = 0.7, 0.125
#: Descriptors of a block, and how many of them are compared with as many others at a time.
BLOCK, STRIP = 65_536, 4_096
#: Rows of a strip that are multiplied at a time, so that their products stay in the cache.
TILE = 256
_TURNS = 32


def _tests() -> np.ndarray:
    """[turn, test, end, (y, x)]: pairs of places about a corner, drawn near its middle by rule."""
    r = np.random.RandomState(20_240_229)
    at = r.normal(0, PATCH / 2.2, (8 * BITS, 2, 2))
    at = at[(np.hypot(at[..., 0], at[..., 1]) < PATCH - 1).all(1)][:BITS]
    angle = np.arange(_TURNS) * 2 * np.pi / _TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], -1), np.stack([-np.sin(angle), np.cos(angle)], -1)], -2)
    return np.rint(np.einsum("aij,tej->atei", turn, at)).astype(np.int64)


TESTS = _tests()
_DISC = np.array([(y, x) for y in range(-PATCH, PATCH + 1) for x in range(-PATCH, PATCH + 1) if y * y + x * x <= PATCH * PATCH])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, edges repeated."""
    p = np.pad(np.pad(a, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    n = round(1 / scale)
    h, w = a.shape[0] // n * n, a.shape[1] // n * n
    return a[:h, :w].reshape(h // n, n, w // n, n).mean((1, 3))


def corners(a: np.ndarray) -> np.ndarray:
    """(y, x) of the corners whose patches lie within the image."""
    if min(a.shape) <= 2 * PATCH + 2:
        return np.empty((0, 2), np.int64)
    gy, gx = np.gradient(a)
    yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gx * gy, 2)
    response = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    least = RESPONSE * response.max()
    if least <= 0:
        return np.empty((0, 2), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(response, 3, constant_values=-np.inf), (7, 7))
    y, x = np.nonzero((response >= view.max((2, 3))) & (response > least))
    m = PATCH + 1
    inside = (y >= m) & (x >= m) & (y < a.shape[0] - m) & (x < a.shape[1] - m)
    return np.stack([y[inside], x[inside]], 1)


def describe(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places [n, 2] in the image's own pixels and descriptors [n, 2] of 64 bits each."""
    places, out = [], []
    for scale in SCALES:
        own = _resized(a, scale)
        at = corners(own)
        if not len(at):
            continue
        smooth = _box(own, 2)
        disc = smooth[at[:, None, 0] + _DISC[None, :, 0], at[:, None, 1] + _DISC[None, :, 1]]
        angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
        turn = np.rint(angle * _TURNS / (2 * np.pi)).astype(np.int64) % _TURNS
        ends = at[:, None, None, :] + TESTS[turn]
        value = smooth[ends[..., 0], ends[..., 1]]
        bits = value[..., 0] < value[..., 1]
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
        places.append((at + 0.5) / scale - 0.5)
    if not out:
        return np.empty((0, 2)), np.empty((0, 2), np.uint64)
    return np.concatenate(places), np.concatenate(out)


def fitted(left: np.ndarray, right: np.ndarray, enough: int | None = None) -> tuple[int, complex, complex]:
    """The most matches [n, 2] that one similarity (move, turn, change of size) maps within WITHIN
    pixels, each place on either side counted once, and the similarity: q = turn * p + move, fitted to
    them. Every two matches propose one; the first that ``enough`` agree on ends the search."""
    best, turned, moved = 0, 1 + 0j, 0j
    if len(left) < AGREE:
        return best, turned, moved
    p, q = left[:, 1] + 1j * left[:, 0], right[:, 1] + 1j * right[:, 0]
    enough = len(p) if enough is None else enough
    ways = [(np.argsort(x, kind="stable"), np.nonzero(np.diff(np.sort(x), prepend=np.nan) != 0)[0]) for x in (p, q)]
    step, block = max(1, 1_000_000 // len(p)), max(1, 50_000 // len(p) ** 2)
    for start in range(0, len(p), block):
        i, j = np.nonzero(np.arange(start, min(start + block, len(p)))[:, None] < np.arange(len(p)))
        i += start
        with np.errstate(divide="ignore", invalid="ignore"):
            d = p[j] - p[i]
            turn = (q[j] - q[i]) / d
            fit = np.nonzero((np.abs(d) > 2 * WITHIN) & (np.abs(turn) > 0.2) & (np.abs(turn) < 5))[0]
        for part in (fit[k : k + step] for k in range(0, len(fit), step)):
            off = q[i[part], None] + turn[part, None] * (p - p[i[part], None]) - q
            more = (off.real**2 + off.imag**2 <= WITHIN**2 + 1e-6).sum(1) > best  # no others can be better
            part, near = part[more], np.abs(off[more]) <= WITHIN
            most = near.sum(1)
            n = np.minimum(*(np.logical_or.reduceat(near[:, order], first, axis=1).sum(1) for order, first in ways))
            for own in np.split(np.arange(len(part)), np.nonzero(np.diff(i[part]))[0] + 1) if len(n) and n.max() > best else []:
                if n[own].max() <= best:
                    continue
                for k in own[np.argsort(-most[own], kind="stable")]:
                    if n[k] > best:
                        x, y = p[near[k]] - p[near[k]].mean(), q[near[k]] - q[near[k]].mean()
                        turned = (y * x.conj()).sum() / (x * x.conj()).sum()
                        best, moved = int(n[k]), q[near[k]].mean() - turned * p[near[k]].mean()
                if best >= enough:
                    return best, turned, moved
    return best, turned, moved


def agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """The most matches of :func:`fitted`."""
    return fitted(left, right)[0]


def alike(a: np.ndarray, b: np.ndarray, turn: complex, move: complex) -> bool:
    """Whether the pixels of ``a`` correlate with those of ``b`` that the similarity maps them to."""
    if abs(turn) > 1:  # the larger one is sampled, at places of the smaller
        a, b, turn, move = b, a, 1 / turn, -move / turn
    y, x = np.mgrid[: b.shape[0], : b.shape[1]]
    back = (x + 1j * y - move) / turn if turn else np.full(b.shape, np.inf + 0j)
    with np.errstate(invalid="ignore"):
        inside = (back.real >= -0.5) & (back.imag >= -0.5) & (back.real < a.shape[1] - 0.5) & (back.imag < a.shape[0] - 0.5)
    if inside.sum() < max(2, SHARED * min(b.size, a.size * abs(turn) ** 2)):
        return False
    u, v = b[inside].astype(np.float64), a[np.rint(back.imag[inside]).astype(int), np.rint(back.real[inside]).astype(int)].astype(np.float64)
    u, v = u - u.mean(), v - v.mean()
    spread = np.sqrt((u * u).sum() * (v * v).sum())
    return bool(spread > 0 and (u * v).sum() >= ALIKE * spread)


def promising(left: np.ndarray, right: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of many pairs of images, of as many matches each ([pair, match] as x + iy), :func:`fitted` may find AGREE in:
    what it leaves out has fewer. ``marks`` [side, pair, match] have the bit of a match's place on either side; places
    of one bit count once."""
    out = np.zeros(len(left), bool)
    i, j = np.triu_indices(left.shape[1], 1)
    step = max(1, 250_000 // (len(i) * left.shape[1]))
    for k in range(0, len(left), step):
        p, q = left[k : k + step], right[k : k + step]
        apart = p[:, j] - p[:, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = (q[:, j] - q[:, i]) / apart
            size = np.abs(turn)
            pair, move = np.nonzero((np.abs(apart) > 2 * WITHIN) & (size > 0.2) & (size < 5))
        turn, p, q = turn[pair, move], p[pair], q[pair]
        off = turn[:, None] * p - q
        off -= off[np.arange(len(off)), i[move]][:, None]
        near = off.real**2 + off.imag**2 <= WITHIN**2 + 1e-6
        enough = np.nonzero(near.sum(1) >= AGREE)[0]
        near, pair = near[enough], pair[enough]
        for side in marks:
            own = np.bitwise_count(np.bitwise_or.reduce(np.where(near, side[k + pair], np.uint64(0)), axis=1)) >= AGREE
            near, pair = near[own], pair[own]
        out[k + pair] = True
    return out


def strips(code: np.ndarray) -> Iterator[slice]:
    """Rows in order of ``code`` in runs of STRIP or so, no code parted."""
    starts = np.concatenate([[0], np.nonzero(np.diff(code))[0] + 1])
    at = 0
    while at < len(code):
        end = starts[np.searchsorted(starts, at + STRIP)] if at + STRIP <= starts[-1] else len(code)
        yield slice(at, end)
        at = end


def packed(bits: np.ndarray) -> np.ndarray:
    """[bit, column]: descriptors for :func:`near_pairs`, three to a column as digits of base 256, in order."""
    digits = np.zeros((ceil_div(len(bits), 3) * 3, BITS + 1), np.float32)
    digits[: len(bits), :BITS] = np.unpackbits(bits.view(np.uint8), axis=1)
    digits[: len(bits), BITS] = 1
    return np.ascontiguousarray((digits[0::3] + 256 * digits[1::3] + 65_536 * digits[2::3]).T)


def near_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all descriptors of ``left`` [n, 2] and of the :func:`packed` ``right`` that differ in HAMMING bits at most.

    One product has three distances: a digit is 128 + HAMMING less the distance, so that its highest bit says whether
    they are near. All sums are whole numbers below 2 ** 24, which floats hold exactly; digits without a descriptor are 0.
    """
    ones = np.unpackbits(left.view(np.uint8), axis=1)
    rows = np.concatenate([ones * np.float32(2) - 1, 128 + HAMMING - ones.sum(1, np.float32, keepdims=True)], 1)
    u, v = [], []
    for k in range(0, len(left), TILE):
        digits = (rows[k : k + TILE] @ right).astype(np.int32)
        digits &= 0x808080
        at = np.flatnonzero(digits != 0)
        digits = digits.ravel()[at]
        for n in range(3):
            row, column = np.divmod(at[digits & (128 << 8 * n) != 0], right.shape[1])
            u.append(row + k)
            v.append(3 * column + n)
    return np.concatenate(u), np.concatenate(v)


def linked(code: np.ndarray, at: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, complex, complex]]:
    """(a, b, turn, move) of the codes a < b that are linked, one of ``left`` and one of ``right``: rows in order of code. A strip of each
    meets at a time, so that only its own matches are held."""
    place = at[:, 1] + 1j * at[:, 0]
    mark = marks_of(code, place)
    other = [(right[t], packed(bits[right[t]])) for t in strips(code[right])]
    for s in strips(code[left]):
        own = left[s]
        for theirs, columns in other:
            if right is left and code[theirs[-1]] < code[own[0]]:
                continue
            u, v = near_pairs(bits[own], columns)
            if right is left:
                u, v = (x[code[own[u]] < code[theirs[v]]] for x in (u, v))
            for u, v in enough_matches(code[own], code[theirs], u, v):
                u, v = own[u], theirs[v]
                swapped = code[u[:, 0]] > code[v[:, 0]]
                u[swapped], v[swapped] = v[swapped], u[swapped]
                c = u.shape[1]
                if c <= 64:
                    keep = promising(place[u], place[v], np.stack([mark[u], mark[v]]))
                    u, v = u[keep], v[keep]
                for i, j in zip(u, v):
                    n, turn, move = fitted(at[i], at[j], max(AGREE, c // 2))
                    if n >= AGREE:
                        yield int(code[i[0]]), int(code[j[0]]), turn, move


def marks_of(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A bit for each different place of a code, rows in any order; all bits for the places of a code of more than 64."""
    order = np.lexsort((place.imag, place.real, code))
    own, place = code[order], place[order]
    first = np.diff(own, prepend=-1) != 0
    number = np.cumsum(np.diff(place, prepend=np.nan) != 0)
    number -= number[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
    out = np.empty(len(code), np.uint64)
    out[order] = np.uint64(1) << (number % 64).astype(np.uint64)
    many = np.unique(own[number > 63])
    out[np.isin(code, many)] = np.uint64(2**64 - 1)
    return out


def enough_matches(left: np.ndarray, right: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The matches (u, v) of those two codes of ``left`` and ``right`` (in order) that have AGREE descriptors on either side among
    them: [pair, match] for all pairs of as many matches."""
    start_l, start_r = (np.nonzero(np.diff(code, prepend=-1))[0] for code in (left, right))
    a, b = (np.cumsum(np.diff(code, prepend=-1) != 0) - 1 for code in (left, right))
    some_l, some_r = np.zeros((len(left), len(start_r)), bool), np.zeros((len(start_l), len(right)), bool)
    some_l[u, b[v]] = True
    some_r[a[u], v] = True
    enough = (np.add.reduceat(some_l, start_l, axis=0, dtype=np.int32) >= AGREE) & (np.add.reduceat(some_r, start_r, axis=1, dtype=np.int32) >= AGREE)
    keep = enough[a[u], b[v]]
    u, v = u[keep], v[keep]
    pair = a[u] * len(start_r) + b[v]
    order = np.lexsort((v, u, pair))
    u, v, pair = u[order], v[order], pair[order]
    first = np.nonzero(np.diff(pair, prepend=-1))[0]
    counts = np.diff(first, append=len(u))
    for c in np.unique(counts):
        rows = first[counts == c][:, None] + np.arange(c)
        yield u[rows], v[rows]


def descriptors(images: DataFrame) -> DataFrame:
    """(id, y, x, d0, d1) for each corner of the rows (id, image)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0), batch.column(1)):
                grey = decode(data.as_py())
                if grey is None:
                    continue
                places, bits = describe(grey)
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, batch.column(0).type), *(pa.array(places[:, k], pa.float64()) for k in (0, 1)), *(pa.array(bits[:, k].view(np.int64), pa.int64()) for k in (0, 1))], ["id", "y", "x", "d0", "d1"])

    return images.mapInArrow(lean(run), f"id {images.dtypes[0][1]}, y double, x double, d0 long, d1 long")


def links(found: DataFrame) -> DataFrame:
    """(a, b, turn and move as re_t, im_t, re_m, im_m): all pairs of images of :func:`descriptors` that AGREE matches link.

    Descriptors are dealt into blocks of like size, and every two blocks meet in one task: the work grows as the
    square of the descriptors, a task's memory does not grow. Any two images meet once.
    """
    spark, kind = found.sparkSession, found.dtypes[0][1]
    n = max(ceil_div(found.count(), BLOCK), ceil_div(spark.sparkContext.defaultParallelism, 2))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    dealt = found.select("id", "y", "x", "d0", "d1", block.alias("block")).select("*", other).select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "y", "x", "d0", "d1").repartition(n * (n + 1) // 2, "p", "q")

    def meet(rows: pa.Table) -> pa.Table:
        ids = pa.array(sorted(rows["id"].unique().to_pylist()), rows.schema.field("id").type)
        code = pc.index_in(rows["id"].combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.stack([rows["y"].to_numpy(), rows["x"].to_numpy()], 1)
        bits = np.stack([rows["d0"].to_numpy(), rows["d1"].to_numpy()], 1)
        first = rows["block"].to_numpy() == rows["p"].to_numpy()
        by_code = lambda rows: rows[np.argsort(code[rows], kind="stable")]
        left = by_code(np.nonzero(first)[0])
        right = left if first.all() else by_code(np.nonzero(~first)[0])
        out = [(a, b, turn.real, turn.imag, move.real, move.imag) for a, b, turn, move in linked(code, at, bits, left, right)]
        a, b, *fit = zip(*out) if out else [()] * 6
        return pa.Table.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64())), *(pa.array(f, pa.float64()) for f in fit)], ["a", "b", "re_t", "im_t", "re_m", "im_m"])

    return dealt.groupBy("p", "q").applyInArrow(meet, f"a {kind}, b {kind}, re_t double, im_t double, re_m double, im_m double")


def confirmed(found: DataFrame, images: DataFrame) -> DataFrame:
    """(a, b) of the :func:`links` whose images' pixels are :func:`alike`."""
    kind = images.dtypes[0][1]
    both = found.join(images.select(F.col("id").alias("a"), F.col("image").alias("left")), "a").join(images.select(F.col("id").alias("b"), F.col("image").alias("right")), "b").select("a", "b", "left", "right", "re_t", "im_t", "re_m", "im_m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(decode(x.as_py()), decode(y.as_py()), complex(rt.as_py(), it.as_py()), complex(rm.as_py(), im.as_py())) for x, y, rt, it, rm, im in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(lean(run), f"a {kind}, b {kind}")


def copies(media: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, copy_class, n_links): one row for each row of ``media``.

    ``n_links`` are the other images of different data whose matches agree with those of the row's own: all
    images meet each other (:func:`links`), so that no such link is left out. ``copy_class`` is the smallest
    id among the images that links join to it where pixels agree too (:func:`confirmed`): matches alone link
    some different pictures that have a few corners in common. Equal data, null and broken
    included, are one class and are looked at once. A null id has no class but that of equal data.
    """
    own = checkpointed(media.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(image_col), F.lit(b"")), 256).alias("content"), F.col(image_col).alias("image")))
    distinct = own.where("id is not null").groupBy("content").agg(F.min("id").alias("least"))
    images = own.join(distinct, (own.content == distinct.content) & (own.id == distinct.least)).select(own.id, own.image).dropDuplicates(["id"])
    met = checkpointed(links(checkpointed(descriptors(images))))
    degree = met.select(F.explode(F.array("a", "b")).alias("least")).groupBy("least").agg(F.count("*").alias("n_links"))
    roots = connected_components(confirmed(met, images)).withColumnsRenamed({"node": "least"})
    classes = distinct.join(roots, "least", "left").join(degree, "least", "left").select("content", F.coalesce("root", "least").alias("copy_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return own.select("id", "content").join(classes, "content", "left").select("id", "copy_class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
