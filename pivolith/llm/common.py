"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def ship(spark: SparkSession) -> None:
    """Give the package's code to the Python workers, once for a session's context. They need not
    have it installed, on a cluster or where the driver found it by its working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_pivolith_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="pivolith-"), "pivolith.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._pivolith_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one if
    all run on this machine, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='pivolith-')}"
    sc.setCheckpointDir(made)
    return made


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    Parquet keeps such tables compressed and column-pruned, and a lost executor costs only
    the tasks it ran. The files go when the application ends, or earlier by forget().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/pivolith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._pivolith_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    path = getattr(df, "_pivolith_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """At the end of a task, give freed memory back to the system: Python workers live on and share
    an executor's memory with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches_of_rows(batch: pa.RecordBatch, size: int = 256, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of at most `size` rows and, unless a single row has more, `most` bytes of
    texts and lists, so that little exists as Python objects at a time."""
    n = batch.num_rows
    if batch.nbytes <= most:
        for start in range(0, n, size):
            yield batch.slice(start, size)
        return
    weight = np.zeros(n, np.int64)
    for c in batch.columns:
        kind = c.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            weight += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            weight += 8 * pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(weight), 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = min(start + size, max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df that none of the names stands for; names of columns have no case in Spark."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def private(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base
