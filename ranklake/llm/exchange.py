"""Shuffles of packed NumPy records, and tables that cut lineage.

``exchange`` runs a map function over Arrow batches, packs its records into one
binary row for each target partition and flush, moves them by partition id and
hands each target partition's records to a reduce function. Spark sees few,
large rows; a lost executor recomputes its own map tasks as in any shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "part int, payload binary"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def planes(values: np.ndarray) -> bytes:
    """Differences of an integer column, byte by byte: near-sorted columns become runs of zeros for Spark's codec."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T).tobytes()


def from_planes(data: np.ndarray, n: int, dtype: np.dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(data[: n * size].reshape(size, n).T).reshape(-1).view(dtype)
    return np.cumsum(steps, dtype=dtype)


def hashes(values: np.ndarray, name: str) -> bytes:
    if name != "hash":
        return values.tobytes()
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def encode(records: np.ndarray) -> bytes:
    """Columns one after another; all but unsigned 64-bit hashes as planes of differences. A column named "hash" only
    groups candidates: its upper six bytes travel."""
    parts = [hashes(records[c], c) if records.dtype[c] == np.uint64 else planes(records[c]) for c in records.dtype.names]
    return b"".join(parts)


def decode(data: np.ndarray, dtype: np.dtype) -> np.ndarray:
    short = "hash" in dtype.names
    n = len(data) // (dtype.itemsize - 2 * short)
    out, at = np.zeros(n, dtype), 0
    for c in dtype.names:
        size = (6 if c == "hash" else dtype[c].itemsize) * n
        part = data[at : at + size]
        if c == "hash":
            whole = np.zeros((n, 8), np.uint8)
            whole[:, 2:] = part.reshape(n, 6)
            out[c] = whole.view(np.uint64).ravel()
        elif dtype[c] == np.uint64:
            out[c] = np.frombuffer(part.tobytes(), np.uint64)
        else:
            out[c] = from_planes(part, n, dtype[c])
        at += size
    return out


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, and when a task ends its free memory goes back to the system: Python workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library has it
            pass

    return run


def packed(records: np.ndarray, keys: np.ndarray, n: int, encoder: Callable[[np.ndarray], bytes] = encode) -> pa.RecordBatch | None:
    """One binary row for each of n targets; a record's target follows from its 64-bit key. Records keep their order."""
    if not len(records):
        return None
    part = ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    records = records[order]
    ends = np.cumsum(np.bincount(part, minlength=n))
    used = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
    starts = np.concatenate([[0], ends])[used]
    blobs = [encoder(records[a:b]) for a, b in zip(starts, ends[used], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "payload"])


def exchange(
    df: DataFrame,
    mapper: Callable[[Iterator[pa.RecordBatch], int], Iterator[tuple[np.ndarray, np.ndarray]]],
    dtype: np.dtype,
    reducer: Callable[[np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    encoder: Callable[[np.ndarray], bytes] = encode,
    decoder: Callable[[np.ndarray, np.dtype], np.ndarray] = decode,
) -> DataFrame:
    """mapper(batches, n) yields (records, keys); reducer gets all records of a target partition.

    With the schema ``PACKED`` the reducer yields rows of ``packed`` itself, for ``gather`` to move on.
    """
    n = partitions(df.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, keys in mapper(batches, n):
            out = packed(records, keys, n, encoder)
            if out is not None:
                yield out

    return gather(df.mapInArrow(tidy(mapped), PACKED), dtype, reducer, schema, decoder)


def gather(
    parts: DataFrame,
    dtype: np.dtype,
    reducer: Callable[[np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    decoder: Callable[[np.ndarray, np.dtype], np.ndarray] = decode,
) -> DataFrame:
    """Moves packed rows to their partitions; reducer gets all records of a partition."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [decoder(np.frombuffer(x.as_buffer(), np.uint8), dtype) for b in batches for x in b.column(1)]
        if blobs:
            records = np.concatenate(blobs)
            del blobs
            yield from reducer(records)

    return parts.repartitionById(partitions(parts.sparkSession), "part").mapInArrow(tidy(reduced), schema)


#: Settings of the queries that run here: shuffle files go when their query ends, and Arrow batches are small, as a
#: worker holds a batch, what it becomes and what the JVM sends after it.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """_SETTINGS hold within it; the session's own come back."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return _own_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="ranklake-"))


_own_folders: dict[str, str] = {}


def written(df: DataFrame, name: str, thin: bool = False) -> DataFrame:
    """Writes df as Parquet below the shared checkpoint folder and reads it back, which cuts lineage.

    The shuffles behind df have done their work then, and their files go at once. A ``thin`` table, of numbers alone, is
    written by an eighth of the shuffle's partitions, so that it is not cut into many small files.
    """
    spark = df.sparkSession
    if thin:
        df = df.coalesce(max(16, partitions(spark) // 8))
    path = f"{shared_folder(spark)}/ranklake/{name}-{uuid.uuid4().hex}"
    with bounded(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Deletes the folders of tables made by ``written`` that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        if "/ranklake/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: Column | int = 64, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table, written or cheap to read, is within ``most`` bytes: its rows and their bytes are added up."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes).cast("long"))).first()[0]
    return (size or 0) <= most


def sized(df: DataFrame, row_bytes: Column | int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is ``small``; otherwise Spark chooses, and splits skewed joins."""
    return F.broadcast(df) if small(df, row_bytes, most) else df


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys (a structured or plain array), and the start of each group in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def squeezed(rows: DataFrame, *keep: str) -> DataFrame:
    """(doc, keep, text) with the text as zstd frames, for shuffles of whole texts; ``unsqueezed`` reads it back."""
    import zstandard

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            out = pa.array([press.compress(x.as_buffer()) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", *keep)), out], names=["doc", *keep, "text"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("doc", *keep).schema) + ", text binary"
    return rows.select("doc", *keep, "text").mapInArrow(tidy(squeeze), schema)


def unsqueezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for b in batches:
        texts = pa.array([press.decompress(x.as_buffer()) for x in b.column("text")], pa.large_binary()).cast(pa.large_string())
        at = b.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)
