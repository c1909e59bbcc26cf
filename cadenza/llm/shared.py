"""What the operators of this subpackage share: shared-folder tables, Arrow columns, word splitting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that no later read needs."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(f):
    """f for mapInArrow(); a worker that has come to the end of a partition gives memory back, as it lives on for other operators."""

    def run(batches):
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
            ctypes.CDLL(None).malloc_trim(0)

    return run


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def collected(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files of finished steps go from the executors' disks when nothing refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, limit: int = 1 << 20):
    """Runs of rows with at most `limit` bytes together, or one longer row: (first row, bytes, offsets that begin at 0)."""
    data, at = utf8(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def weights(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors that depend only on seed and place."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def byte_classes(delimiters: bytes) -> np.ndarray:
    """Per byte: 0 for a delimiter, else 1 + the byte with A-Z lower-cased."""
    out = np.arange(1, 257, dtype=np.uint64)
    out[ord("A") + np.arange(26)] += 32
    out[list(delimiters)] = 0
    return out


_WEIGHTS: dict[int, np.ndarray] = {}


def word_hashes(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit multilinear hashes of all words of the rows, and len(at) offsets into them."""
    value = classes[data]
    inside = value > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] |= inside[edge]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data))))
    place *= inside
    most = int(place.max()) + 1
    if len(_WEIGHTS.get(0, ())) < most:
        _WEIGHTS[0] = weights(max(64, 2 * most), 11)
    value *= _WEIGHTS[0][place]
    return mixed(np.add.reduceat(value, start)), np.searchsorted(start, at)


def shingle_hashes(data: np.ndarray, at: np.ndarray, classes: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `size` words; of all its words where it has fewer; none without words."""
    word, of = word_hashes(data, at, classes)
    factor = weights(size, 29)
    n = len(word)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        runs += word[k : k + len(runs)] * factor[k]
    runs = mixed(runs)
    out = []
    for low, high in zip(of[:-1].tolist(), of[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(runs[low : high - size + 1]))
        elif high > low:
            out.append(mixed((word[low:high] * factor[: high - low]).sum(keepdims=True, dtype=np.uint64) + np.uint64(high - low)))
        else:
            out.append(runs[:0])
    return out
