"""The engine: sources, strategies, executors and observers as streaming queries, supervised.

Every strategy sees every event, every executor every action. A strategy is a function from a DataFrame of events to one
of actions, with sync_state() run before the first event if it has one. An event on which it fails is logged and left
out, the others of its batch stay. An executor is a function of an action row; an action that fails is recorded, never
raised. Executors run on the driver, one action after the other, as wrappers depend on order; one that depends on none
can run in the tasks that hold the actions instead. A source that fails is started again as the reconnect policy says; a
fatal one stops the engine. Batches of several sources are worked on one after the other, so that strategies and wrappers
need no locks.
"""

from __future__ import annotations

import logging
import threading
from bisect import bisect_right
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import accumulate, pairwise
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.functions.naming import quoted
from tidewright.operators.machines import ReconnectPolicy
from tidewright.operators.reliability import Clock, Outcome, Sink
from tidewright.shipping import ship

LOG = logging.getLogger(__name__)


def execute_batch(actions: DataFrame, sink: Sink, publish: Callable[[Outcome], None] | None = None) -> None:
    """Every action through the sink, on the driver as wrappers are order-dependent; a failure doesn't stop the rest."""
    for action in actions.toLocalIterator(prefetchPartitions=True):
        try:
            sink(action)
            outcome = Outcome(action, True, None)
        except Exception as e:
            outcome = Outcome(action, False, str(e))
        if publish:
            publish(outcome)


def executed(actions: DataFrame, sink: Sink) -> DataFrame:
    """Every action through the sink, in the task that holds it: action, ok, error. The sink is copied to each task, so it
    shares nothing with other tasks; a task that Spark runs again sends its actions again."""

    def run(action: Row) -> tuple[bool, str | None]:
        try:
            sink(action)
        except Exception as e:
            return False, str(e)
        return True, None

    ship(actions.sparkSession)
    told = F.udf(run, "ok boolean, error string", useArrow=False).asNondeterministic()  # so it is called once for each row
    return actions.select(F.struct("*").alias("action")).withColumn("told", told("action")).select("action", "told.ok", "told.error")


#: Into so many parts a batch is cut at each step of the search for what a strategy fails on; so many are tried at once.
WAYS = 8


def decided(act: Callable[[DataFrame], DataFrame], events: DataFrame) -> Iterator[DataFrame]:
    """The actions for a batch of events. If a strategy fails on it, the single events on which it fails are searched for
    and left out, with a message in the log, and it is asked again for all the others."""
    try:
        actions = _held(act(events))
    except Exception:
        LOG.warning("a strategy failed on a batch; looking for the events on which it fails")
        numbered = events.withColumn("_at", F.monotonically_increasing_id()).persist()
        try:
            yield from _sifted(act, numbered, events.columns)
        finally:
            numbered.unpersist()
        return
    try:
        yield actions
    finally:
        actions.unpersist()


def _held(actions: DataFrame) -> DataFrame:
    actions = actions.persist()
    try:
        actions.count()
    except Exception:
        actions.unpersist()
        raise
    return actions


def _sifted(act: Callable[[DataFrame], DataFrame], numbered: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """decided() for a batch in memory whose rows are numbered in `_at`. Parts of it are ranges of places, each a range of
    numbers, of which Spark reads the pages in range only; every part that fails is cut again, down to single events."""
    plain = [quoted(c) for c in columns]
    found = numbered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("part").collect()
    starts = list(accumulate((r["n"] for r in found), initial=0))

    def number(place: int) -> int:
        i = bisect_right(starts, place) - 1
        return found[i]["first"] + place - starts[i]

    def events(low: int, high: int) -> DataFrame:
        return numbered.where(F.col("_at").between(number(low), number(high - 1))).select(*plain)

    def error(actions: DataFrame | Exception) -> Exception | None:
        try:
            if isinstance(actions, Exception):
                return actions
            actions.write.format("noop").mode("overwrite").save()
        except Exception as e:
            return e

    bad, good, failing = [], [], [(0, starts[-1])] if found else []
    with ThreadPoolExecutor(WAYS) as pool:
        while failing:
            parts = [part for low, high in failing for part in _cut(low, high)]
            asked = []  # one after the other, as strategies need no locks; only the jobs run beside each other
            for part in parts:
                try:
                    asked.append(act(events(*part)))
                except Exception as e:
                    asked.append(e)
            errors = list(pool.map(inheritable_thread_target(numbered.sparkSession)(error), asked))
            failing = []
            for (low, high), e in zip(parts, errors, strict=True):
                if e is None:
                    good.append((low, high))
                elif high - low > 1:
                    failing.append((low, high))
                else:
                    bad.append(number(low))
                    for event in events(low, high).collect():
                        LOG.error("a strategy failed on %s: %s", event, str(e).split("\n")[0])
    if not good:
        return
    rest = [numbered.where(~F.col("_at").isin(bad)).select(*plain) if bad else numbered.select(*plain)]
    while rest:
        try:
            actions = _held(act(rest.pop(0)))
        except Exception:
            if not good:
                raise
            rest, good = [events(*part) for part in sorted(good)], []  # it fails on no event, but on all the others at once
            continue
        good = []
        try:
            yield actions
        finally:
            actions.unpersist()


def _cut(low: int, high: int) -> list[tuple[int, int]]:
    """A range in up to WAYS parts of about the same length."""
    ends = sorted({low + (high - low) * i // WAYS for i in range(WAYS + 1)})
    return list(pairwise(ends))


class OutcomeTable:
    """Outcomes as a folder of Parquet that other queries stream from: the feedback loop's way back. They are written by
    flush(), or when `most` are held; those of executors in tasks are written by the tasks."""

    def __init__(self, spark: SparkSession, path: str, action: T.StructType, most: int = 10_000):
        self.spark, self.path, self.most = spark, path, most
        self.schema = T.StructType([T.StructField("action", action), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])
        self._held: list[Outcome] = []
        self._lock = threading.RLock()

    def publish(self, outcome: Outcome) -> None:
        with self._lock:
            self._held.append(outcome)
            if len(self._held) >= self.most:
                self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._held = [(o.action, o.ok, o.error) for o in self._held], []
            if rows:
                self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def write(self, told: DataFrame) -> None:
        """Outcomes as executed() returns them, which don't pass through the driver."""
        with self._lock:
            told.write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)


@dataclass
class Handle:
    """The running engine. fatal is set when a source is given up."""

    fatal: threading.Event = field(default_factory=threading.Event)
    stopped: threading.Event = field(default_factory=threading.Event)
    queries: list[StreamingQuery] = field(default_factory=list)
    threads: list[threading.Thread] = field(default_factory=list)
    error: BaseException | None = None

    def stop(self) -> None:
        self.stopped.set()
        for q in self.queries:
            if q.isActive:
                q.stop()

    def join(self, seconds: float | None = None) -> bool:
        for t in self.threads:
            t.join(seconds)
        return not any(t.is_alive() for t in self.threads)


class Pipeline:
    def __init__(self, spark: SparkSession, checkpoint: str, policy: Callable[[], ReconnectPolicy] = ReconnectPolicy, clock: Clock | None = None):
        self.spark, self.checkpoint, self.policy, self.clock = spark, checkpoint.rstrip("/"), policy, clock or Clock()
        self.sources: list[Callable[[], DataFrame]] = []
        self.strategies: list[Any] = []
        self.executors: list[Callable[[DataFrame], None]] = []
        self.observers: list[Callable[[str, DataFrame], None]] = []
        self._lock = threading.Lock()

    def add_source(self, reader: Callable[[], DataFrame]) -> Pipeline:
        self.sources.append(reader)
        return self

    def add_strategy(self, strategy: Any) -> Pipeline:
        self.strategies.append(strategy)
        return self

    def add_executor(self, sink: Sink, publish: Callable[[Outcome], None] | None = None) -> Pipeline:
        self.executors.append(lambda actions: execute_batch(actions, sink, publish))
        return self

    def add_task_executor(self, sink: Sink, outcomes: OutcomeTable) -> Pipeline:
        """A sink that needs no order and no state, and so can run in many tasks at once; its outcomes go to the table."""
        self.executors.append(lambda actions: outcomes.write(executed(actions, sink)))
        return self

    def add_observer(self, observer: Callable[[str, DataFrame], None]) -> Pipeline:
        """Gets ("event" or "action", batch); what it raises is ignored."""
        self.observers.append(observer)
        return self

    def start(self, available_now: bool = False) -> Handle:
        """Synchronises the strategies, an error of which is raised here, then starts a supervised query for each source."""
        for s in self.strategies:
            if hasattr(s, "sync_state"):
                s.sync_state()
        handle = Handle()
        for i, reader in enumerate(self.sources):
            thread = threading.Thread(target=self._supervise, args=(handle, i, reader, available_now), daemon=True)
            handle.threads.append(thread)
            thread.start()
        return handle

    def _batch(self, events: DataFrame, _: int) -> None:
        events.persist()
        try:
            with self._lock:
                self._observe("event", events)
                for s in self.strategies:
                    for actions in decided(s.process if hasattr(s, "process") else s, events):
                        self._observe("action", actions)
                        for execute in self.executors:
                            execute(actions)
        finally:
            events.unpersist()

    def _observe(self, what: str, batch: DataFrame) -> None:
        for o in self.observers:
            try:
                o(what, batch)
            except Exception:  # noqa: S110  an observer changes nothing
                pass

    def _supervise(self, handle: Handle, i: int, reader: Callable[[], DataFrame], available_now: bool) -> None:
        policy = self.policy()
        while not handle.stopped.is_set():
            began, delivered = self.clock.now(), threading.Event()

            def batch(events: DataFrame, n: int, delivered: threading.Event = delivered) -> None:
                if not events.isEmpty():
                    delivered.set()
                self._batch(events, n)

            try:
                writer = reader().writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.checkpoint}/source-{i}")
                query = (writer.trigger(availableNow=True) if available_now else writer).start()
                handle.queries.append(query)
                query.awaitTermination()
                return  # a finite source that ends, or stop()
            except Exception as e:
                handle.error = e
            if handle.stopped.is_set():
                return
            if delivered.is_set():
                policy.delivered()
            decision, wait = policy.failed(self.clock.now() - began)
            if decision == "fatal":
                handle.fatal.set()
                handle.stop()
                return
            self.clock.sleep(wait)


def count_events(events: DataFrame, name: str) -> DataFrame:
    """An observation of the number of rows, for any query that reads on."""
    return events.observe(name, F.count(F.lit(1)).alias("rows"))


def row_dict(action: Row) -> dict:
    return action.asDict(recursive=True)
