"""Block-aware sources: a live feed, an inclusive range, the tip."""

from __future__ import annotations

import queue
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidewright.operators.combinators import block_range, indexed
from tidewright.shipping import ship


class RangeTooLarge(RuntimeError):
    """A provider's refusal of a range that holds too many results."""


# What providers say when a range is too large.
TOO_LARGE = ("block range", "response size", "max results", "too many results", "query returned more than", "-32602", "too big")
# End of fixed values.


def is_too_large(error: Exception) -> bool:
    return isinstance(error, RangeTooLarge) or any(x in str(error).lower() for x in TOO_LARGE)


class IndexedSource(ABC):
    """Rows (block_number, seq, ...) of one event type."""

    @abstractmethod
    def live(self) -> Iterator[DataFrame]:
        """Batches of new rows in order of arrival; opened anew by every call."""

    @abstractmethod
    def range(self, low: int, high: int) -> DataFrame:
        """The rows of blocks low to high, both included."""

    @abstractmethod
    def tip(self) -> int:
        """The highest block there is."""


class TableSource(IndexedSource):
    """A table or folder of events that others append to; live batches come from `feed`."""

    def __init__(self, rows: DataFrame, feed: Callable[[], Iterable[DataFrame]] | None = None):
        self.rows, self.feed = rows, feed or (lambda: ())

    def live(self) -> Iterator[DataFrame]:
        return iter(self.feed())

    def range(self, low: int, high: int) -> DataFrame:
        return block_range(self.rows, low, high)

    def tip(self) -> int:
        return self.rows.agg(F.max("block_number")).first()[0] or 0


class LogSource(TableSource):
    """Raw logs: those that match address and first topic, are not retracted and have a block."""

    def __init__(self, logs: DataFrame, addresses: list[str] | None = None, topics: list[str] | None = None, feed: Callable[[], Iterable[DataFrame]] | None = None):
        if addresses:
            logs = logs.where(F.col("address").isin(addresses))
        if topics:
            logs = logs.where(F.get("topics", F.lit(0)).isin(topics))
        super().__init__(indexed(logs), feed)


def subscribe_or_poll(subscribe: Callable[[], DataFrame], poll: Callable[[], DataFrame]) -> DataFrame:
    """The subscription if it opens, else polling; asked anew each time, an error of polling is raised."""
    try:
        return subscribe()
    except Exception:
        return poll()


def read_table(spark: SparkSession, where: str) -> DataFrame:
    """A source by its address: parquet:PATH, table:NAME or a bare path; anything else is an error."""
    kind, colon, rest = where.partition(":")
    if colon and kind == "table":
        return spark.table(rest)
    if colon and kind == "parquet":
        return spark.read.parquet(rest)
    if not colon or kind in ("file", "hdfs", "s3a", "viewfs", "abfs", "gs"):
        return spark.read.parquet(where)
    raise ValueError(f"no source for {where!r}")


def answers(values: Iterable, fetch: Callable[[Any], Any], concurrent: int = 16, timeout_s: float = 10.0) -> Iterator:
    """fetch(value) of every value, in the order in which they come in, up to `concurrent` calls at a time: a new one begins
    as soon as one ends. A None, an error and a call that takes too long give nothing; such a call is left to itself, in a
    daemon thread, and holds up no other."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def call(n: int, value: Any) -> None:
        try:
            done.put((n, fetch(value)))
        except Exception:
            done.put((n, None))

    running: dict[int, float] = {}
    waiting, left = enumerate(values), True
    while left or running:
        while left and len(running) < concurrent:
            try:
                n, value = next(waiting)
            except StopIteration:
                left = False
                break
            running[n] = time.monotonic() + timeout_s
            threading.Thread(target=call, args=(n, value), daemon=True).start()
        if not running:
            break
        try:
            n, found = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
        except queue.Empty:
            now = time.monotonic()
            for n in [n for n, until in running.items() if until <= now]:
                del running[n]
            continue
        if running.pop(n, None) is not None and found is not None:
            yield found


def look_up_remote(keys: DataFrame, column: str, fetch: Callable, schema: str, concurrent: int = 16, timeout_s: float = 10.0) -> DataFrame:
    """What fetch(key) gives for each key, as rows of the schema, in no order; see answers(). fetch runs on executors."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    ship(keys.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for row in answers((v for batch in batches for v in batch[column].tolist()), fetch, concurrent, timeout_s):
            rows.append(row)
            if len(rows) >= 1000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return keys.select(column).mapInPandas(run, schema)


def polled_hashes(polls: DataFrame, column: str = "hashes", name: str = "hash") -> DataFrame:
    """Every hash of every poll, whose arrays may be null or empty, with the poll's other columns."""
    others = [c for c in polls.columns if c != column]
    return polls.select(*others, F.explode(column).alias(name)).where(F.col(name).isNotNull())


def polled_headers(polls: DataFrame, headers: DataFrame | Callable, schema: str | None = None, column: str = "hashes", **settings) -> DataFrame:
    """The header of every polled hash; those that are not found, or whose call fails, are skipped. headers: a table with a
    column `hash`, or a function of a hash, with the schema of what it gives."""
    hashes = polled_hashes(polls, column)
    if isinstance(headers, DataFrame):
        return hashes.join(headers, "hash")
    return look_up_remote(hashes, "hash", headers, schema, **settings)


def typed_events(logs: DataFrame, fields: T.StructType, payload: str = "_payload") -> DataFrame:
    """Logs (block_number, seq, removed, payload, ...) as events (block_number, seq, fields): logs that can't be decoded,
    as a field is missing or of another type, are dropped, and so are those retracted or in no block."""
    parsed = F.try_parse_json(payload)
    found: list[Column] = [F.try_variant_get("parsed", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
    rows = indexed(logs).select("block_number", "seq", parsed.alias("parsed")).select("block_number", "seq", *found)
    return rows.dropna(subset=[f.name for f in fields])


class Channel:
    """A folder through which one query's rows become another's source: send() appends, and each subscribe() is a stream of
    what is sent after it. Nothing is lost if a reader is slow."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType([*schema.fields, T.StructField("_sent", T.LongType())])
        self._sent, self._lock = 0, threading.Lock()
        spark.createDataFrame([], self.schema).coalesce(1).write.mode("append").parquet(path)

    def send(self, rows: DataFrame) -> None:
        with self._lock:
            self._sent += 1
            rows.withColumn("_sent", F.lit(self._sent).cast("long")).select(*self.schema.names).write.mode("append").parquet(self.path)

    def subscribe(self) -> DataFrame:
        with self._lock:
            now = self._sent
        return self.spark.readStream.schema(self.schema).parquet(self.path).where(F.col("_sent") > now).drop("_sent")
