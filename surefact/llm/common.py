"""What the operators of this subpackage share: table reading, Arrow slicing, shared-folder cuts."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a Python worker holds decoded at once; one longer text is taken alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose texts make up at most `limit` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    sizes = np.array([0 if x is None else x for x in pc.binary_length(arr).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is the empty text."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; a null is the empty text."""
    arr = batch.column(batch.schema.get_field_index(column))
    return [x if x is not None else b"" for x in arr.cast(pa.binary() if pa.types.is_string(arr.type) else pa.large_binary()).to_pylist()]


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, giving the memory that its task has freed back to the system: Python workers are used again,
    and what one stage leaves in their allocators would stand beside what the next one needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no glibc: nothing to give back by this way
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode a temporary one is set if the session names none; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = kept.get() if kept.isDefined() else ""
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"surefact-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_CUTS: dict[str, DataFrame] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write a frame into the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    The files go when the driver ends, or before by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim()  # models that a caller has let go of
    out = spark.read.schema(df.schema).parquet(path)
    if not _CUTS:
        atexit.register(lambda: [dropped(x) for x in list(_CUTS.values())])
    _CUTS[path] = out
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more; any other frame stays as it is."""
    for path in [p for p, x in _CUTS.items() if x is df]:
        del _CUTS[path]
        with suppress(Exception):  # the session has ended: its folder is cleaned with it
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def counted(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A frame of a few numbers a row as one side of a join: broadcast where it was counted to have at most `most` rows, which
    spares the shuffle of the other side; shuffled like any other beyond."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
