"""Batch forms of the order-dependent operators.

What windows can say is said with windows, per stream key. The rest folds a state machine over each key's rows in
order: rows are dealt by key and sorted within partitions, and batches stream through the machine, so a task holds the
machine's state, never a whole key. One key is one task; streams run beside each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewright.functions.pricing import backoff_column
from tidewright.operators.machines import Breaker, ConfirmationWindow, Cooldown, RateLimit, ReconnectPolicy
from tidewright.shipping import ship


#: Arrival numbers in a range of a stream.
SPAN = 100_000


def fold_sorted(rows: DataFrame, key: str, order: str, inputs: list[str], machine: Callable, results: T.StructType) -> DataFrame:
    """Each key's rows, by `order`, through a machine of its own; push() gets the order column and the inputs, or
    push_many(), if the machine has it and no value is null, those of all the rows of a key in a batch. Returns key and
    results, which begin with the order column's value of the row they belong to."""
    schema = T.StructType([rows.schema[key], *results.fields])
    arrow = to_arrow_schema(schema)
    ship(rows.sparkSession)
    dealt = rows.select(key, order, *[c for c in inputs if c != order]).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, object()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for found in batches:
            at, names = 0, (order, *inputs)
            whole = hasattr(machine(), "push_many") and not any(found.column(c).null_count for c in names)
            columns = [found.column(c).to_numpy() if whole else found.column(c).to_pylist() for c in names]
            for k, same in groupby(found.column(key).to_pylist()):
                to = at + sum(1 for _ in same)
                if own is None or k != now:
                    if own is not None:
                        out.extend((now, *x) for x in own.finish())
                    own, now = machine(), k
                parts = [c[at:to] for c in columns]
                if whole:
                    out.extend((k, *x) for x in own.push_many(*parts))
                else:
                    out.extend((k, *x) for values in zip(*parts, strict=True) for x in own.push(*values))
                at = to
                if len(out) > 20_000:
                    yield batch()
        if own is not None:
            out.extend((now, *x) for x in own.finish())
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)


def _results(*more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("seq", T.LongType()), *more])


def one_stream(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stream", F.lit("all"))


def _within(key: str) -> Window:
    return Window.partitionBy(key, "part").orderBy("seq")


def _parts(rows: DataFrame, span: int) -> DataFrame:
    """A stream cut into ranges of `span` arrival numbers, so that windows over it need no task that holds all of it."""
    return rows.withColumn("part", F.expr(f"seq DIV {int(span)}"))


def _halts(rows: DataFrame, key: str, bad: Column | None, span: int) -> DataFrame:
    """(key, part, halt, top), a row for each range: halt is the stream's first seq that steps back or is bad (null if
    none), top the highest block before it. Ranges are judged by themselves, then their ends against each other."""
    step = _parts(rows, span).select(key, "seq", "block_number", "part", F.coalesce(bad, F.lit(True)).alias("bad") if bad is not None else F.lit(False).alias("bad"))
    step = step.withColumn("wrong", F.col("bad") | F.coalesce(F.lag("block_number").over(_within(key)) > F.col("block_number"), F.lit(False)))
    step = step.withColumn("stopped", F.max("wrong").over(_within(key).rowsBetween(Window.unboundedPreceding, 0)))
    ends = step.groupBy(key, "part").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("block_number", "seq").alias("first_block"),
        F.max_by("block_number", "seq").alias("last_block"),
        F.min(F.when(F.col("wrong"), F.col("seq"))).alias("own_halt"),
        F.max(F.when(~F.col("stopped"), F.col("block_number"))).alias("own_top"),
    )
    back = F.coalesce(F.lag("last_block").over(Window.partitionBy(key).orderBy("part")) > F.col("first_block"), F.lit(False))
    ends = ends.withColumn("back", back)
    ends = ends.withColumn("own_halt", F.when(F.col("back"), F.col("first_seq")).otherwise(F.col("own_halt"))).withColumn("own_top", F.when(~F.col("back"), F.col("own_top")))
    whole = Window.partitionBy(key)
    ends = ends.withColumn("halt", F.min("own_halt").over(whole))
    counts = F.col("halt").isNull() | (F.col("first_seq") <= F.col("halt"))
    return ends.withColumn("top", F.max(F.when(counts, F.col("own_top"))).over(whole)).select(key, "part", "halt", "top")


def block_halts(rows: DataFrame, key: str = "stream", bad: Column | None = None, span: int = SPAN) -> DataFrame:
    """(key, halt, top) of every stream: where its block-complete writer halts (null: never), and the highest block before."""
    return _halts(rows, key, bad, span).groupBy(key).agg(F.min("halt").alias("halt"), F.max("top").alias("top"))


def block_writer(rows: DataFrame, key: str = "stream", bad: Column | None = None, span: int = SPAN) -> DataFrame:
    """Rows (key, seq, block_number, ...) that a block-complete writer stores: if no block is lower than the one before and
    no row is bad, all, else those before the first that is, strictly below the highest block seen until then."""
    found = _parts(rows, span).join(_halts(rows, key, bad, span), [key, "part"])
    return found.where("halt IS NULL OR seq < halt AND block_number < top").select(*rows.columns)


def confirmation_window(rows: DataFrame, depth: int, key: str = "stream", span: int = SPAN) -> DataFrame:
    """(key, seq) of the rows that the confirmation window stores.

    Rows that follow each other in one block share their fate, so only the first of each such run, cut anew where a range
    of arrivals begins, goes through the machine; its rows are found by a join. A stream's fold is then as long as its
    changes of block are many, not its rows.
    """
    runs = _parts(rows, span).select(key, "seq", "block_number", "part")
    before = F.lag("block_number").over(_within(key))
    runs = runs.withColumn("begins", before.isNull() | (before != F.col("block_number")))
    runs = runs.withColumn("run", F.max(F.when(F.col("begins"), F.col("seq"))).over(_within(key).rowsBetween(Window.unboundedPreceding, 0)))
    first = runs.where("begins").select(key, "seq", "block_number")
    stored = fold_sorted(first, key, "seq", ["block_number"], lambda: ConfirmationWindow(depth), _results())
    return runs.join(stored.select(key, F.col("seq").alias("run")), [key, "run"], "left_semi").select(key, "seq")


def cooldown(rows: DataFrame, every: int, key: str = "stream", at: str = "at_ms") -> DataFrame:
    """(key, seq) of the firings that pass."""
    return fold_sorted(rows, key, "seq", [at], lambda: Cooldown(every), _results())


def rate_limit(rows: DataFrame, most: int, window: int, key: str = "stream", at: str = "at_ms") -> DataFrame:
    """(key, seq, send): when each action is sent."""
    return fold_sorted(rows, key, "seq", [at], lambda: RateLimit(most, window), _results(T.StructField("send", T.LongType())))


def breaker(rows: DataFrame, most: int, key: str = "stream", ok: str = "ok") -> DataFrame:
    """All rows with failures (in a row so far) and verdict: islands of failures between successes; the first island to
    reach `most` opens the breaker, and what follows is rejected."""
    order = Window.partitionBy(key).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    step = rows.withColumn("island", F.sum(F.col(ok).cast("long")).over(upto))
    inside = Window.partitionBy(key, "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("streak", F.sum((~F.col(ok)).cast("long")).over(inside))
    opened = F.max(F.col("streak") >= most).over(order.rowsBetween(Window.unboundedPreceding, -1))
    verdict = F.when(F.coalesce(opened, F.lit(False)), "rejected").when(F.col(ok), "ok").otherwise("failed")
    return step.withColumn("verdict", verdict).select(*rows.columns, "verdict")


def breaker_fold(rows: DataFrame, most: int, key: str = "stream", ok: str = "ok") -> DataFrame:
    """(key, seq, verdict) by the state machine, as the stream does it."""
    return fold_sorted(rows, key, "seq", [ok], lambda: Breaker(most), _results(T.StructField("verdict", T.StringType())))


def reconnects(rows: DataFrame, key: str = "stream", max_failures: int = 3, base_ms: int = 1000, healthy_ms: int = 30_000) -> DataFrame:
    """Ended subscriptions (key, seq, uptime_ms, delivered) -> (key, seq, decision, wait_ms).

    A healthy uptime sets the count of failures to 0, a delivery sets it to 0 before this one counts, and a fatal one
    begins anew: within the rows from one such reset to the next the count goes from 1 to max_failures again and again.
    """
    order = Window.partitionBy(key).orderBy("seq")
    step = rows.select(key, "seq", F.coalesce(F.col("uptime_ms") >= healthy_ms, F.lit(False)).alias("healthy"), F.coalesce("delivered", F.lit(False)).alias("delivered"))
    step = step.withColumn("island", F.sum((F.col("healthy") | F.col("delivered")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "island").orderBy("seq")
    place = F.row_number().over(inside) - F.first("healthy").over(inside).cast("int")
    step = step.withColumn("failures", F.when(F.col("healthy"), 0).otherwise(F.pmod(place - 1, F.lit(max_failures)) + 1))
    fatal = F.col("failures") >= max_failures
    wait = backoff_column(F.lit(base_ms).cast("long"), F.col("failures")).cast("long")
    return step.select(key, "seq", F.when(fatal, "fatal").otherwise("retry").alias("decision"), F.when(~fatal, wait).alias("wait_ms"))


def reconnects_fold(rows: DataFrame, key: str = "stream", max_failures: int = 3, base_ms: int = 1000, healthy_ms: int = 30_000) -> DataFrame:
    """reconnects() by the state machine, as the supervisor does it."""
    more = (T.StructField("decision", T.StringType()), T.StructField("wait_ms", T.LongType()))
    return fold_sorted(rows, key, "seq", ["uptime_ms", "delivered"], lambda: ReconnectPolicy(max_failures, base_ms, healthy_ms), _results(*more))


def retries(rows: DataFrame, max_retries: int, base_ms: int, attempt_ok: Callable[[Column], Column]) -> DataFrame:
    """All rows with attempts, ok and waited_ms: tried until the first success or max_retries + 1 attempts; attempt i waits
    base * 2^(i - 1) after the one before, so all waits are base * (2^(attempts - 1) - 1)."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(max_retries)), attempt_ok)
    first = F.array_position(tries, True)
    attempts = F.when(first > 0, first).otherwise(F.lit(max_retries + 1)).cast("long")
    done = rows.withColumn("attempts", attempts).withColumn("ok", F.array_contains(tries, True))
    return done.withColumn("waited_ms", (F.lit(base_ms) * (F.pow(F.lit(2.0), F.col("attempts") - 1).cast("long") - 1)).cast("long"))
