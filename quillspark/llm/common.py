"""What the operators of this subpackage share: a shared folder for written tables, Arrow batches cut by bytes, ids of rows."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it through its own sys.path only, and send them long texts in
    batches of BATCH_ROWS rows at most: the session's default of 10,000 rows holds 30 MB and more in each of several buffers.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (tests on one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, and survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less columns that an operator is about to add, in whatever case they are written."""
    gone = {n.lower() for n in names}
    return df.select(*(q(c) for c in df.columns if c.lower() not in gone))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is empty, bytes that are not UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column over bytes; the values begin at `at` (and the end), under 2 GB in all."""
    if at[-1] >= 2**31:
        raise ValueError("a batch of over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker serves one operator after another, and would keep the most that any of them took."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of a string or binary column of about limit bytes each, at least a row. Memory is given back after the last."""
    n = len(column)
    if not n:
        return
    at, size = 0, 0
    for i, width in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if size and size + width > limit:
            yield column.slice(at, i - at)
            at, size = i, 0
        size += width
    yield column.slice(at)
    give_back()


def batches_by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that one text column holds about limit bytes in each."""
    for batch in batches:
        at = 0
        for piece in pieces(batch.column(column), limit):
            yield batch.slice(at, len(piece))
            at += len(piece)


if sys.byteorder != "little":
    raise ImportError("the binary formats here need a little-endian machine")
