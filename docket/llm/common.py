"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.session import ensure_checkpoint_dir

#: Characters handled at once inside a task: bounds the Python objects alive per Arrow batch.
CHUNK_CHARS = 1_000_000


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path  # for discard
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``materialise``d tables that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("scratch", None):
            _delete(df.sparkSession, path)


#: Folders written inside the open ``temporary`` blocks, innermost last.
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables materialised inside are deleted at the end, except those handed to the function that this yields.

    Shuffle files go when the driver's JVM collects the plans that made them; it is asked to, as
    a large heap may otherwise not do so for the whole run.
    """
    made: list[str] = []
    kept: set[str] = set()
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch)
        return df

    try:
        yield keep
    finally:
        _open.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif _open:
                _open[-1].append(path)
        gc.collect()
        spark._jvm.System.gc()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, as ``doc_id`` bigint and ``text`` string (NULL kept)."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % F.lit(n)


#: Rows of two or three numbers that may be broadcast: at most about 16 MB.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its checked size ``rows`` is small; a plain (shuffled) join side otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lowest_hash(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The ``n`` rows with the lowest hash of ``cols`` (ties by their values): a bounded sample that
    depends on nothing but the rows.  A threshold on the hash thins the table first, so that
    no task has to sort more than about twice the sample."""
    top = 1 << 62
    key = F.pmod(F.xxhash64(*cols), F.lit(top))
    total = df.count()
    if total > 2 * n:
        df = df.filter(key < int(top * (2 * n / total)))
    return df.orderBy(key, *cols).limit(n)


def slices(batch: pa.RecordBatch, text_col: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into pieces of about ``chars`` bytes of text; a longer text stands alone."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def tidy(run):
    """``run`` for mapInArrow, with unused memory handed back to the system at the end of the task.

    Worker processes live on between tasks and would otherwise keep their largest size.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return wrapped


class BoundedCache(dict):
    """A dict that computes missing values and starts afresh when it holds ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
