"""Whitening of embeddings along their first principal components.

The eigenvectors of the covariance are found by LOBPCG: each round multiplies one block of directions
with the covariance, as a sum over the centred rows that Spark spreads; the Rayleigh-Ritz step on the
iterate, its residual and the previous direction is small and done on the driver. The residuals that
end it are those of a product made anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, checkpointed, lean
from .vectors import integer_vectors, longest, rows_of

SCALE = 256
#: Entries beyond it, 8 million before scaling, count as it.
LIMIT = 2**31 - 1
#: Directions followed beyond those asked for: with more of them fewer rounds are needed, each a pass over the rows.
GUARD = 12
#: Residuals at which eigenvectors count as found, as a share of the first eigenvalue; rounding alone leaves about 1e-15.
TOLERANCE = 2e-14
ROUNDS = 500
#: An eigenvalue under this share of the first is rounding: the rows do not vary along it.
RANK = 1e-12
BLOCK = 1024
#: Numbers that one task of a round has at least, unless there are fewer than cores: blocks are small and rounds many.
TASK = 2**21


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # of each dimension, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each
    trace: float
    residual: float  # the largest of the certified ones, as a share of the first eigenvalue
    rounds: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(1, self.n)


def fit_blocks(vectors: DataFrame, width: int) -> DataFrame:
    """(block): each distinct vector once, many to a row as little-endian 32-bit numbers, written out."""

    def pack(batches):
        for batch in batches:
            x = rows_of(batch.column(0), width).astype("<i4")
            cut = [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["block"])

    blocks = checkpointed(vectors.select("x").distinct().mapInArrow(lean(pack), "block binary"))
    numbers = (blocks.agg(F.sum(F.length("block"))).first()[0] or 0) // 4
    return blocks.coalesce(max(blocks.sparkSession.sparkContext.defaultParallelism, ceil_div(numbers, TASK)))


def summed(blocks: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str = "double") -> np.ndarray:
    """The sum over all vectors of ``of`` (rows of one block -> matrix of ``shape``). Tasks add up their own
    rows, Spark adds up the tasks; the driver gets as many rows as the matrix has."""
    columns = [f"v{j}" for j in range(shape[1])]

    def run(batches):
        total = np.zeros(shape, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            for block in batch.column(0):
                total += of(np.frombuffer(block.as_buffer(), "<i4").reshape(-1, width).astype(np.int64))
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(total[rows, j]) for j in range(shape[1]))], ["i", *columns])

    found = blocks.mapInArrow(lean(run), "i int, " + ", ".join(f"{c} {kind}" for c in columns))
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for row in found.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).collect():
        out[row["i"]] = row[1:]
    return out


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns that span ``block`` outside of what ``against`` (orthonormal blocks) spans; maybe fewer."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more, for what rounding has left
        for other in against:
            block = block - other @ (other.T @ block)
        if block.shape[1]:
            left, scale, _ = np.linalg.svd(block, full_matrices=False)
            block = left[:, scale > 1e-10]
    return block


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS):
    """(eigenvalues, eigenvectors, residual, rounds) of the ``wanted`` largest of a symmetric, non-negative
    operator of which only products with blocks of columns are asked for.

    It ends when all residuals, of a product made anew, are under ``tolerance`` times the first eigenvalue,
    or have stood still just above it, which is rounding; else it raises.
    """
    k = min(width, wanted + guard)
    x = orthonormal(np.random.default_rng(0).standard_normal((width, k)))
    vx = multiply(x)
    p = vp = np.zeros((width, 0))
    best, since, fresh = np.inf, 0, True
    for turn in range(rounds):
        value, turned = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        value, turned = value[::-1], turned[:, ::-1]
        x, vx = x @ turned, vx @ turned
        rest = vx - x * value
        first = max(value[0], np.finfo(float).tiny)
        worst = float(np.linalg.norm(rest[:, :wanted], axis=0).max() / first) if value[0] > 0 else 0.0
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= tolerance or (since >= 8 and worst <= 100 * tolerance):
            if fresh:
                return value[:wanted], x[:, :wanted], worst, turn
            x = orthonormal(x)
            vx, p, vp, fresh = multiply(x), p[:, :0], vp[:, :0], True
            continue
        w = orthonormal(rest, x, p)
        z, vz = np.hstack([x, w, p]), np.hstack([vx, multiply(w) if w.shape[1] else w, vp])
        inner = z.T @ vz
        _, turned = np.linalg.eigh((inner + inner.T) / 2)
        turned = turned[:, ::-1][:, :k]
        # The new direction: what the step added to the old iterate, made orthonormal to the new one in the basis of z.
        step = turned.copy()
        step[: x.shape[1]] = 0
        q = orthonormal(step, turned)
        x, vx, p, vp, fresh = z @ turned, vz @ turned, z @ q, vz @ q, False
    raise RuntimeError(f"no eigenvectors within {rounds} rounds: residual {best:.1e}")


def fit(vectors: DataFrame, width: int, components: int) -> Whitening:
    """The whitening of all distinct ``x`` of ``vectors``. Rows are centred before they are multiplied."""
    blocks = fit_blocks(vectors, width)
    counted = summed(blocks, width, lambda x: np.vstack([x.sum(0), np.full(width, len(x))]).T, (width, 2), "long") if width else np.zeros((0, 2), np.int64)
    sums, n = counted[:, 0], int(counted[:, 1].max(initial=0))
    mean = sums / max(1, n)
    empty = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0, 0, 0.0)
    if n == 0:
        return empty
    trace = float(summed(blocks, width, lambda x: ((x - mean) ** 2).sum(0)[:, None], (width, 1)).sum()) / n

    def product(q):
        def part(x):
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed(blocks, width, part, q.shape) / n

    value, vector, residual, turns = lobpcg(product, width, min(components, width))
    real = value > RANK * max(value[0], 0.0)
    value, vector = value[real], vector[:, real]
    if not len(value):
        return empty
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(value))])
    turn = vector / np.sqrt(value)
    k = len(value)
    middle = summed(blocks, width, lambda x: ((x - mean) @ turn).sum(0)[None], (1, k))[0] / n

    def spread(x):
        white = (x - mean) @ turn - middle
        return white.T @ white

    error = np.abs(summed(blocks, width, spread, (k, k)) / n - np.eye(k)).max()
    return Whitening(n, sums, value, vector, trace, residual, turns, float(error))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, residual): a row for each vector and
    component.

    Entries become x = floor(256 * entry), within 32 bits. Components are the unit eigenvectors of the covariance
    of all distinct x, numbered from 1 by falling eigenvalue, the entry of greatest size of each positive;
    ``whitened`` is the centred x along one, over the root of its eigenvalue. ``deviation`` is the exact sum of
    (n * x - sums)^2, null where it does not fit a long; ``explained`` the component's share of the trace;
    ``identity_error`` how far the covariance of what is whitened is from the identity; ``residual`` the largest
    certified one, as a share of the first eigenvalue. Rows whose vector is null or has null or non-finite entries
    give none; vectors shorter than the longest one end in zeros; repeated rows and null ids give rows like any
    other. Where the x vary along fewer directions there are fewer components: none for one distinct x, or no
    rows. Of components with equal eigenvalues any basis may come. The id keeps its type.
    """
    width = longest(df, vector_col)
    vectors = integer_vectors(df, id_col, vector_col, SCALE, LIMIT, width)
    model = fit(vectors, width, components)
    n, sums, mean, turn = model.n, model.sums, model.mean, model.vectors / np.sqrt(model.values)
    k = turn.shape[1]
    # Whether a row's deviation certainly fits 64 bits; if it may not, whole numbers of any length are used.
    fits = (n * float(LIMIT) + np.abs(sums.astype(float)).max(initial=0)) ** 2 * max(1, width) < 2**62

    def exact(x):
        most = n * float(np.abs(x).max(initial=0)) + np.abs(sums.astype(float)).max(initial=0)
        if fits or most**2 * max(1, width) < 2**62:
            return ((n * x - sums) ** 2).sum(1).tolist()
        wide = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in wide]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows if k else 0, BLOCK):
                batch = whole.slice(i, BLOCK)
                x = rows_of(batch.column(1), width)
                white = (x - mean) @ turn
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                deviation = pa.array(exact(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), deviation, pa.array(white.ravel())], ["id", "component", "deviation", "whitened"])

    id_type = vectors.schema["id"].dataType.simpleString()
    found = vectors.mapInArrow(lean(run), f"id {id_type}, component int, deviation long, whitened double")
    shares = model.values / model.trace if k else model.values
    explained = F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.col("component")) if k else F.lit(None).cast("double")
    return found.select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"), F.lit(model.residual).alias("residual"))
