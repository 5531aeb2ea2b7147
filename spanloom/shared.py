"""Shared working folder: intermediate tables that must outlive an executor."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

LARGE_BLOCK = 4 << 20  #: bytes
SLICE = 1 << 20  #: bytes of text that a Python worker takes apart at once

_OWNED: list[tuple[SparkSession, str]] = []
_PATHS: dict[int, str] = {}  # of the tables that written() gave, while they are held


def work_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master without the setting (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    except Exception:  # the session is already gone; the folder belongs to the cluster's cleaner then
        pass


@atexit.register
def _drop_all() -> None:
    for spark, path in _OWNED:
        _drop(spark, path)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver's Python ends."""
    path = f"{work_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    _OWNED.append((spark, path))
    return path


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(id(df), None)
        if path:
            _drop(df.sparkSession, path)
            _OWNED[:] = [x for x in _OWNED if x[1] != path]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = path
    weakref.finalize(table, _PATHS.pop, id(table), None)
    return table


def is_table(df: DataFrame) -> bool:
    """Whether ``df`` is a table of :func:`written`."""
    return id(df) in _PATHS


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Keep what goes to a Python worker at once to ``size``, however long the texts, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def slices(batch, column: int, size: int = SLICE, rows: int = 500):
    """A record batch in slices whose texts in ``column`` have ``size`` bytes together, or one row, and ``rows`` rows at most."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        stop = min(max(begin + 1, int(np.searchsorted(ends, before + size, "right"))), begin + rows, batch.num_rows)
        yield batch.slice(begin, stop - begin)
        begin = stop


def give_back() -> None:
    """Return what a Python worker has freed to the system; workers live on from task to task."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@functools.cache
def hold_little() -> None:
    """Let this process return blocks of ``LARGE_BLOCK`` and more to the system when they are freed, rather than keep them for later."""
    import ctypes

    import pyarrow

    pyarrow.set_memory_pool(pyarrow.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, LARGE_BLOCK)  # M_MMAP_THRESHOLD: else it grows to 32 MB with what is freed
        libc.mallopt(-1, 2 * LARGE_BLOCK)  # M_TRIM_THRESHOLD


def lean(function):
    """A function of batches for ``mapInArrow`` that gives freed memory back at its end."""

    def run(batches):
        yield from function(batches)
        give_back()

    return run


def sparing(function):
    """:func:`lean` for functions whose passing arrays are large against what they keep: these go back at once."""
    run = lean(function)

    def spared(batches):
        hold_little()
        yield from run(batches)

    return spared
