"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


#: Bytes of the batches that Python workers get: several of them share an executor's memory.
BATCH = "16m"


def bounded(spark: SparkSession, size: str = BATCH) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. If it comes from fewer files than there are cores, its rows are dealt over all of
    them: one file of one row group is else one task's work. Tables of many files are left as they are."""
    bounded(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one of ``spark.checkpoint.dir``; only where that is unset (tests, a
    single machine) a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skeinbase-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps that are done with: Spark deletes them once the driver's
    garbage is collected, which may else take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)


def lean(run: Callable) -> Callable:
    """``run``, for ``mapInArrow``, giving its task's memory back to the machine at its end: a Python
    worker lives on, and would keep what its largest task took."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def map_rows(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``df.mapInArrow`` of :func:`lean` ``run`` for columns of any names, dots and twins included: ``run`` gives its columns in
    the order of ``schema``, whatever it calls them."""

    def numbered(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, [f"_{i}" for i in range(batch.num_columns)])

    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    out = StructType([StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(lean(numbered), out).toDF(*schema.names)


def kept_columns(names: tuple[str, ...], own: tuple[str, ...]):
    """Columns to be kept beside an operator's own: one of the same name comes back as ``<name>_kept``."""
    return [F.col(quoted(n)).alias(f"{n}_kept" if n in own else n) for n in names]


def quoted(name: str) -> str:
    """A column's name that may have dots and backticks in it."""
    return "`" + name.replace("`", "``") + "`"


def with_fields(df: DataFrame, **change: str | None) -> StructType:
    """The schema of ``df`` with fields of these types put in place of those taken out (None), in order,
    or at the end; whatever the names of its columns."""
    gone = [n for n, t in change.items() if t is None]
    new = [StructField(n, DataType.fromDDL(t)) for n, t in change.items() if t is not None]
    fields = [StructField(f.name, f.dataType) for f in df.schema.fields]
    at = next((i for i, f in enumerate(fields) if f.name in gone), len(fields))
    del fields[at : at + len(gone)]
    return StructType(fields[:at] + new + fields[at:])


def as_bytes(name: str):
    """The text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def slices(batches, rows: int = 1024):
    """The same rows in smaller batches, so that what is made of them takes less memory at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def crc_mod(doc_id, mod: int) -> int:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def crc_mod_col(name: str, mod: int):
    """:func:`crc_mod` as a column."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % mod


def ceil_div(n: int, by: int) -> int:
    return max(1, -(-n // by))
