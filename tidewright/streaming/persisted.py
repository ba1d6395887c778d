"""A source with an archive behind it: replay what is stored, backfill the gap, follow the live feed.

The archive's height is the largest block up to which nothing is missing. Backfilled blocks are written when they are
complete, live ones when they are confirmed. A failed write, an event that is no JSON object, a block lower than the one
before in the backfill or a deep reorganisation live stops the writing for good, in this and every later chunk and batch;
it never stops the events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tidewright.functions.cells import readable
from tidewright.operators.combinators import live_cut
from tidewright.operators.machines import ConfirmationWindow
from tidewright.operators.ordering import block_halts, fold_sorted, one_stream
from tidewright.sources.archive import Store
from tidewright.sources.collectors import IndexedSource, is_too_large
from tidewright.sources.schema import BLOCK, PAYLOAD, EventSchema, SchemaError

CHUNK = 10_000


def windows(low: int, high: int, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Block ranges of at most `chunk` blocks that cover low to high."""
    while low <= high:
        yield low, min(low + chunk - 1, high)
        low += chunk


def read_range(source: IndexedSource, low: int, high: int) -> list[DataFrame]:
    """The range, halved again and again where the provider finds it too large; one block that is too large is an error."""
    try:
        return [source.range(low, high)]
    except Exception as e:
        if low == high or not is_too_large(e):
            raise
        middle = low + (high - low) // 2
        return read_range(source, low, middle) + read_range(source, middle + 1, high)


class WindowFold(ConfirmationWindow):
    """The confirmation window over one batch: results are (seq, fate), stored or pending, and (-1, halted) if it halted."""

    def push(self, seq: int, block: int, bad: bool = False) -> list[tuple]:
        return [(x, "stored") for (x,) in super().push(seq, block, bad)]

    def finish(self) -> list[tuple]:
        return [(x, "pending") for x in self.pending()] + [(-1, "halted")] * self.state["halted"]


class Persisted:
    """Options: schema (declared; else inferred from the first event of `signature`), start_block, to_block (then there is
    no live part), chunk, depth of confirmation; or the methods with_*, which return the source."""

    def __init__(self, source: IndexedSource, archive: Store, schema: EventSchema | None = None, signature: str | None = None, start_block: int = 0, to_block: int | None = None, chunk: int = CHUNK, depth: int = 1):
        if schema is None and signature is None:
            raise SchemaError("declare a schema or name the event's signature")
        self.source, self.archive, self.schema, self.signature = source, archive, schema, signature
        self.replayed = False
        self.halted = False
        self.queried: list[tuple[int, int]] = []
        self.with_start_block(start_block).with_to_block(to_block).with_chunk(chunk).with_depth(depth)

    def with_schema(self, schema: EventSchema) -> Persisted:
        self.schema = schema
        return self

    def with_start_block(self, block: int) -> Persisted:
        self.start_block = block
        return self

    def with_to_block(self, block: int | None) -> Persisted:
        self.to_block = block
        return self

    def with_chunk(self, blocks: int) -> Persisted:
        if blocks < 1:
            raise ValueError("a chunk is at least one block")
        self.chunk = blocks
        return self

    def with_depth(self, blocks: int) -> Persisted:
        if blocks < 1:
            raise ValueError("a confirmation depth is at least one block")
        self.depth = blocks
        return self

    def _table(self) -> str:
        return self.schema.table if self.schema else EventSchema.infer(self.signature, "{}").table

    def _write(self, rows: DataFrame) -> None:
        """Readable rows, as one commit; a schema is inferred from the first of them."""
        if self.halted:
            return
        try:
            if self.schema is None:
                first = rows.orderBy(BLOCK, "seq").select(PAYLOAD).first()
                if first is None:
                    return
                self.schema = EventSchema.infer(self.signature, first[0])
            self.archive.write(self.schema, self.schema.encode(rows), uuid.uuid4().hex)
        except Exception:
            self.halted = True

    def _backfill(self, rows: DataFrame) -> None:
        """A range, which ends with a whole block, through the block-complete writer."""
        if self.halted:
            return
        found = block_halts(one_stream(rows), bad=~readable(F.col(PAYLOAD))).first()
        if found is None:
            return
        if found["halt"] is not None:
            rows = rows.where((F.col("seq") < found["halt"]) & (F.col(BLOCK) < F.lit(found["top"])))
        self._write(rows)
        self.halted |= found["halt"] is not None

    def subscribe(self) -> Iterator[DataFrame]:
        """Batches (block_number, seq, _payload), in order: stored, backfilled, live. The live feed is opened before the
        tip is asked for, and the first range is read before this returns, so a source that fails, fails here."""
        live = None if self.to_block is not None else self.source.live()
        tip = self.source.tip() if self.to_block is None else min(self.to_block, self.source.tip())
        table = self._table()
        last = self.archive.last_block(table)
        stored = None
        if not self.replayed and last is not None:
            stored = self.archive.replay(self.archive.schema(table), last)
            if not stored.where(~readable(F.col(PAYLOAD))).isEmpty():
                raise SchemaError(f"{table} holds a payload that can't be read")
        low = max(self.start_block, 0 if last is None else last + 1)
        ranges = windows(low, tip, self.chunk)
        first = next(ranges, None)
        opened = self._range(first) if first else []
        return self._batches(stored, opened, ranges, live, tip)

    def _range(self, window: tuple[int, int]) -> list[DataFrame]:
        self.queried.append(window)
        return [x.select(BLOCK, "seq", PAYLOAD) for x in read_range(self.source, *window)]

    def _batches(self, stored: DataFrame | None, opened: list[DataFrame], ranges: Iterator[tuple[int, int]], live: Iterator[DataFrame] | None, tip: int) -> Iterator[DataFrame]:
        self.replayed = True
        if stored is not None:
            yield stored
        while True:
            for rows in opened:
                rows = rows.persist()  # a range is read once, whatever it takes to read it
                try:
                    self._backfill(rows)
                    yield rows
                finally:
                    rows.unpersist()
            window = next(ranges, None)
            if window is None:
                break
            opened = self._range(window)  # an error ends the backfill, and with it the live part
        if live is not None:
            yield from self._live(live, tip)

    def _live(self, feed: Iterator[DataFrame], tip: int) -> Iterator[DataFrame]:
        spark, flushed, pending = self.archive.spark, None, None
        for rows in feed:
            rows = live_cut(rows.select(BLOCK, "seq", PAYLOAD), tip)
            if not self.halted:
                rows, pending, flushed = self._confirm(rows, pending, flushed, spark)
            yield rows

    def _confirm(self, rows: DataFrame, pending: DataFrame | None, flushed: int | None, spark) -> tuple:
        """One batch through the window: rows confirmed now are written, those that wait are carried on. What waits is
        pushed again before the next batch, which leads to the same state, as nothing in it was ripe or dropped."""
        depth = self.depth
        every = one_stream(rows if pending is None else pending.unionByName(rows))
        judged = every.withColumn("bad", ~readable(F.col(PAYLOAD)))
        fates = fold_sorted(judged, "stream", "seq", [BLOCK, "bad"], lambda: WindowFold(depth, flushed), T.StructType([T.StructField("seq", T.LongType()), T.StructField("fate", T.StringType())]))
        fates = fates.select(F.col("seq").alias("fate_seq"), "fate").persist()
        known = every.drop("stream").join(fates, F.col("seq") == F.col("fate_seq")).drop("fate_seq")
        ripe = known.where("fate = 'stored'").drop("fate")
        top = ripe.agg(F.max(BLOCK)).first()[0]
        if top is not None:
            self._write(ripe)
            flushed = top
        if fates.where("fate = 'halted'").count():
            self.halted = True
        waiting = known.where("fate = 'pending'").drop("fate").collect()  # `depth` blocks at most
        fates.unpersist()
        return rows, spark.createDataFrame(waiting, rows.schema), flushed

    def run(self, deliver: Callable[[DataFrame], None]) -> None:
        for batch in self.subscribe():
            deliver(batch)


def persisted(source: IndexedSource, archive: Store, signature: str) -> Persisted:
    """The source with an archive behind it; see Persisted.with_* for its options."""
    return Persisted(source, archive, signature=signature)
