"""What the training-data operators share: shared storage, Arrow helpers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.shared import file_system, shared_dir
from tidewright.shipping import ship

#: Bytes of text that a Python worker turns into Python objects at once.
SLICE_CHARS = 1_000_000
#: Bytes of an Arrow batch to a Python worker. Spark's own limit of 64 MB is held several times over by each task, outside
#: the JVM's heap and from many threads, and what the C library then keeps for each thread is not given back.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)


#: Rows that a task writes at least, of tables whose size is known beforehand.
TASK_ROWS = 50_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs nothing before it.
    The table goes with release(), else when the application ends. rows: a bound on its rows, if there is one at hand: a
    small table is then written by few tasks, whatever the number of shuffle partitions."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    where, files = file_system(spark, path)
    files.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for them; they can't be read after that."""
    for df in tables:
        if path := getattr(df, "_tidewright_path", None):
            where, files = file_system(df.sparkSession, path)
            files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows dealt anew, so that a batch holds about `chars` bytes of text, or one row: large batches are cut, small
    ones put together as long as they have no more than 10,000 rows."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        for part, n in _cut(batch, text, chars):
            if held and (size + n > chars or rows + part.num_rows > 10_000):
                yield _joined(held)
                size = rows = 0
            held.append(part)
            size, rows = size + n, rows + part.num_rows
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches as one; the list is emptied."""
    (out,) = pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else held
    held.clear()
    return out


def _cut(batch: pa.RecordBatch, text: str, chars: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(part, bytes of text): each of about `chars` bytes, or one row."""
    if not batch.num_rows:
        return
    sizes = batch.column(text).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + chars, "right")) - 1)
        yield batch.slice(at, to - at), int(ends[to] - ends[at])
        at = to


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def arrow_map(df: DataFrame, columns: list, schema: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeper: str = "") -> DataFrame:
    """in_batches() over the given columns alone, so that others neither travel nor clash."""
    return in_batches(df.select(*columns), each, schema, keeper)


#: What this worker keeps between tasks: the keeper's name -> a function that drops it.
KEPT: dict[str, Callable[[], None]] = {}


def in_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeper: str = "") -> DataFrame:
    """mapInArrow with the package at hand, in batches of BATCH bytes if the session's limit is Spark's own.

    Workers live on beside the JVM, whatever the next stage does. So one hands back at the end of a task what it has
    freed, and before a task drops what other operators' tasks have kept; keeper: whose is to stay."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH[0], None) == f"{64 << 20}b":
        spark.conf.set(BATCH[0], f"{BATCH[1]}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeper)
        try:
            yield from each(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def drop_kept(keeper: str = "") -> None:
    """Drops what keepers other than this one have kept in this process."""
    for name in [n for n in KEPT if n != keeper]:
        KEPT.pop(name)()


def give_back() -> None:
    """Freed memory that Arrow's pool and the C library still hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


class IdFilter:
    """A Bloom filter of 64-bit ids, of 16 bits for each id but 32 MB at most: sent to all workers, it keeps most rows
    of other ids out of a shuffle; the join that follows is exact. Beyond some 20 million ids it keeps out fewer."""

    HASHES = 4
    LARGEST = 1 << 28

    def __init__(self, ids: DataFrame):
        """ids: one long column of a table that is cheap to read twice."""
        (column,) = ids.columns
        self.bits = bits = min(self.LARGEST, 1 << max(20, (16 * ids.count()).bit_length()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits // 64, dtype=np.uint64)
            for batch in batches:
                for at in self._places(batch.column(column).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            some = np.flatnonzero(words)
            yield pa.RecordBatch.from_pydict({"word": pa.array(some.astype(np.int64)), "mask": pa.array(words[some].view(np.int64))})

        found = in_batches(ids, mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        self._shared = ids.sparkSession.sparkContext.broadcast(words)

    def _places(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        x = ids.astype(np.int64).view(np.uint64)
        for k in range(self.HASHES):
            x = mix64(x + np.uint64(0x9E3779B97F4A7C15 + k))
            yield (x & np.uint64(self.bits - 1)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Which of the numbers may be among the ids."""
        words, ok = self._shared.value, np.ones(ids.shape, dtype=bool)
        for at in self._places(ids):
            ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok

    def keep(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose id may be among the ids."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = self.has(batch.column(column).to_numpy(zero_copy_only=False))
                if ok.any():
                    yield batch.filter(pa.array(ok))

        return in_batches(rows, run, rows.schema)
