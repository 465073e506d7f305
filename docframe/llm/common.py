"""What the operators of this folder share: tables, folds, shared storage, byte buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between JVM and Python. Spark's own bound lets each task hold several times 64 MB.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
#: What a chain of stages has instead, with Spark's defaults: executors and workers live through all of them, and keep what the largest buffers took.
_LEAN = {_BATCH[0]: (_BATCH[1], "1048576b"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "500")}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to 8 MB where the session leaves them at Spark's default."""
    key, default, own = _BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, own)


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of 1 MB and 500 rows decoded at once, where the session leaves them at Spark's default or at 8 MB."""
    for key, (default, own) in _LEAN.items():
        if spark.conf.get(key, default) in (default, _BATCH[2]):
            spark.conf.set(key, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, (_, own) in _LEAN.items():  # of a chain that ran before in this session
        if spark.conf.get(key, None) == own:
            spark.conf.unset(key)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Only where the setting is absent and all runs on one machine (tests) is a
    temporary folder used, which goes when the process ends: on a cluster other
    machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="docframe-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/docframe-{uuid.uuid4().hex}"


#: Tables that materialize wrote, in order.
_written: list[str] = []


def drop_written(spark: SparkSession, but_last: int = 0) -> None:
    """Deletes the tables that materialize wrote, but for the last ones; no DataFrame that reads them may be used any more."""
    keep = _written[len(_written) - but_last :] if but_last else []
    jvm = spark.sparkContext._jvm
    for p in _written[: len(_written) - len(keep)]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = keep


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    df again, and columns that are not deterministic (row ids) stay fixed.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that a broadcast may hold (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def matching(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """left_semi or left_anti join of df with ids (one bigint column `key`); df is not shuffled while ids are few."""
    ids = materialize(ids)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def blocks_for(df: DataFrame, text_col: str, block_bytes: int = 24 << 20) -> int:
    """So many blocks that each holds about block_bytes of text, whatever the input's size."""
    n = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(n) // block_bytes))


def give_back() -> None:
    """Memory that the worker has freed goes back to the system: workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(batches):
    """The batches; when they end, memory is given back."""
    yield from batches
    give_back()


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of an Arrow string array; null rows are empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(array, most: int = 4 << 20):
    """(first row, texts as bytes) of an Arrow string array, about `most` bytes at once, so a large batch is never copied whole."""
    data, at = utf8(array)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, [data[a:b].tobytes() for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
        i = j
