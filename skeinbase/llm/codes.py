"""Vector code compression: each of eight parts of a vector becomes the index of the nearest codebook entry.

Equal integer parts of one position are merged into one row with a weight. Lloyd's rounds run over those
distinct rows; codes and errors of the distinct rows are then joined back to the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, checkpointed, lean, quoted
from .vectors import integer_vectors, longest, rows_of

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Distinct rows compared with a codebook at a time.
BLOCK = 4096
#: Copies of one repeated row that are given out at a time.
COPIES = 10_000


def limit(width: int) -> int:
    """The greatest size of an integer entry with which the squared distances of whole vectors fit 61 bits."""
    return 2 ** ((61 - max(1, width).bit_length()) // 2 - 1)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, the first of equally near ones."""
    codes, errors = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for i in range(0, len(values), BLOCK):
        away = ((values[i : i + BLOCK, None, :] - book[None]) ** 2).sum(2)
        codes[i : i + BLOCK] = at = away.argmin(1)
        errors[i : i + BLOCK] = away[np.arange(len(at)), at]
    return codes, errors


def parts_of(vectors: DataFrame, length: int) -> DataFrame:
    """(..., part, value): ``x`` cut into PARTS rows of ``length`` numbers."""
    rest = [c for c in vectors.columns if c != "x"]
    return vectors.select(*rest, F.posexplode(F.array(*(F.slice("x", p * length + 1, length) for p in range(PARTS)))).alias("part", "value"))


def first_books(vectors: DataFrame, length: int) -> np.ndarray:
    """The parts of the ENTRIES rows of least id (nulls last, equal ids by their numbers), fewer if there are fewer."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    return np.array([row["x"] for row in rows], np.int64).reshape(len(rows), PARTS, length).swapaxes(0, 1)


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over (part, value, weight). Tasks add up the rows of each entry, Spark adds up
    the tasks; the driver gets one row for each number of the codebooks."""
    length = books.shape[2]

    def run(batches):
        total = np.zeros((*books.shape[:2], length + 1), np.int64)
        for batch in batches:
            part, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = rows_of(batch.column(1), length)
            for p in np.unique(part):
                here = part == p
                code, _ = nearest(values[here], books[p])
                np.add.at(total[p], code, np.column_stack([values[here], np.ones(here.sum(), np.int64)]) * weight[here, None])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["at", "total"])

    rows = distinct.mapInArrow(lean(run), "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(books.shape[0] * books.shape[1] * (length + 1), np.int64)
    for row in rows:
        total[row["at"]] = row["total"]
    total = total.reshape(*books.shape[:2], length + 1)
    count = total[:, :, length:]
    return np.where(count > 0, total[:, :, :length] // np.maximum(count, 1), books)


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, value, code, error) of each distinct row."""
    length = books.shape[2]

    def run(batches):
        for batch in batches:
            part, values = batch.column(0).to_numpy(), rows_of(batch.column(1), length)
            code, error = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p in np.unique(part):
                here = part == p
                code[here], error[here] = nearest(values[here], books[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], ["part", "value", "code", "error"])

    return distinct.mapInArrow(lean(run), "part int, value array<int>, code long, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error), a row for each vector; and the codebooks, by part, entry and place.

    Entries become floor(4096 * entry); vectors are cut into 8 equal parts. Each part's codebook starts as that
    part of the 16 rows of least id and goes through 6 rounds of Lloyd's algorithm with floored means; unused entries
    stay, ties go to the lower index. ``code`` has the indexes as two hex digits each; ``error`` the squared distances
    summed over parts; ``label_error`` their sum over all rows of the label, nulls being one label.

    Rows whose vector is null or has null or non-finite entries are left out. Vectors shorter than the longest one, or
    whose length is no multiple of 8, end in zeros; entries beyond :func:`limit` (2^26 for 64 entries) count as it,
    so that all sums are exact. Repeated rows count, and come back, as often as they stand; null ids come after all
    others; with fewer than 16 rows a codebook has fewer entries, and an empty table has none and gives no rows.
    Rows of one id and label are told apart by a 64-bit hash of their vectors.
    """
    width = longest(df, vector_col)
    length = ceil_div(width, PARTS)
    label = F.col(quoted(label_col)).alias("label")
    vectors = integer_vectors(df, id_col, vector_col, SCALE, limit(width), PARTS * length, label)
    books = first_books(vectors, length)
    distinct = checkpointed(parts_of(vectors.select("x"), length).groupBy("part", "value").agg(F.count("*").alias("weight")))
    for _ in range(ROUNDS if books.size else 0):
        books = lloyd_round(distinct, books)
    rows = parts_of(vectors.withColumn("hash", F.xxhash64("x")), length)
    coded = rows.join(assigned(distinct, books), ["part", "value"]).groupBy("id", "label", "hash")
    # As many copies of a row as stand in the table have one group: their codes are the same, their errors add up.
    whole = checkpointed(coded.agg(F.bit_or(F.expr("shiftleft(code, 4 * part)")).alias("codes"), F.sum("error").alias("errors"), (F.count("*") / PARTS).cast("long").alias("copies")))
    of_label = whole.groupBy(F.col("label").alias("of")).agg(F.sum("errors").alias("label_error"))
    found = whole.join(of_label, F.col("label").eqNullSafe(F.col("of")))
    left = F.col("copies") - F.col("turn") * COPIES
    found = found.withColumn("turn", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(left, F.lit(COPIES).cast("long")))))
    code = F.concat(*(F.lower(F.lpad(F.hex(F.expr(f"shiftright(codes, {4 * p}) & 15")), 2, "0")) for p in range(PARTS)))
    return found.select("id", "label", code.alias("code"), F.expr("errors div copies").alias("error"), "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal numbers of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
