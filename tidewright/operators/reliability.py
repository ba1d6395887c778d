"""Sink wrappers over batches of actions, as columns, and as driver objects around a sink function.

A sink is a function of an action that returns or raises. Wrap in the order deadline, retry, fallback, rate limit,
breaker, gate, report: the deadline is then asked before every attempt and the report sees the final verdict.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.pricing import backoff_ms
from tidewright.operators.machines import Breaker, RateLimit

Sink = Callable[[Any], None]


class Clock:
    """Time in milliseconds; tests give one that only moves when told to."""

    def now(self) -> int:
        return int(time.monotonic() * 1000)

    def sleep(self, ms: int) -> None:
        time.sleep(ms / 1000)


class ManualClock(Clock):
    def __init__(self):
        self.at = 0

    def now(self) -> int:
        return self.at

    def sleep(self, ms: int) -> None:
        self.at += ms


class BreakerOpen(RuntimeError):
    pass


def retry(sink: Sink, max_retries: int = 3, base_ms: int = 100, clock: Clock | None = None) -> Sink:
    """Up to max_retries more attempts, the first after base, then doubling; the last error is raised."""
    clock = clock or Clock()

    def run(action: Any) -> None:
        for attempt in range(max_retries + 1):
            try:
                return sink(action)
            except Exception:
                if attempt == max_retries:
                    raise
                clock.sleep(backoff_ms(base_ms, attempt))

    return run


def fallback_to(sink: Sink, other: Sink) -> Sink:
    """An action that fails goes to the other sink, whose verdict counts."""

    def run(action: Any) -> None:
        try:
            sink(action)
        except Exception:
            other(action)

    return run


def limit_rate(sink: Sink, most: int, window_ms: int = 1000, clock: Clock | None = None) -> Sink:
    """At most `most` attempts in a window; an action over that waits, and failed attempts count."""
    clock, machine = clock or Clock(), RateLimit(most, window_ms)

    def run(action: Any) -> None:
        ((_, send),) = machine.push(0, clock.now())
        clock.sleep(max(0, send - clock.now()))
        sink(action)

    return run


def break_circuit(sink: Sink, most: int) -> tuple[Sink, Breaker]:
    """The sink behind a breaker, and the handle with is_open and reset()."""
    if most < 1:
        raise ValueError("a breaker needs at least one failure")
    handle = Breaker(most)

    def run(action: Any) -> None:
        if handle.is_open:
            raise BreakerOpen("circuit breaker is open")
        try:
            sink(action)
        except Exception:
            handle.push(0, False)
            raise
        handle.push(0, True)

    return run, handle


def deadline(sink: Sink, expires_at: Callable[[Any], int | None], clock: Clock | None = None) -> Sink:
    """Drops, without an error, an action whose time is reached."""
    clock = clock or Clock()

    def run(action: Any) -> None:
        at = expires_at(action)
        if at is None or clock.now() < at:
            sink(action)

    return run


def gated(sink: Sink, is_open: threading.Event | Callable[[], bool]) -> Sink:
    """Drops actions, without an error, while the gate is closed; a dry run is a gate that stays closed."""
    asked = is_open.is_set if isinstance(is_open, threading.Event) else is_open

    def run(action: Any) -> None:
        if asked():
            sink(action)

    return run


def dry_run(sink: Sink) -> Sink:
    return gated(sink, lambda: False)


@dataclass(frozen=True)
class Outcome:
    action: Any
    ok: bool
    error: str | None


def report(sink: Sink, publish: Callable[[Outcome], None]) -> Sink:
    """Publishes every outcome, then gives the sink's own verdict; a publisher that fails changes nothing."""

    def tell(outcome: Outcome) -> None:
        try:
            publish(outcome)
        except Exception:  # noqa: S110  nobody listens
            pass

    def run(action: Any) -> None:
        try:
            sink(action)
        except Exception as e:
            tell(Outcome(action, False, str(e)))
            raise
        tell(Outcome(action, True, None))

    return run


def drop_expired(actions: DataFrame, expires_at: Column, now: Column) -> DataFrame:
    """The column form of deadline(): strictly before the deadline, or without one."""
    return actions.where(expires_at.isNull() | (expires_at > now))


def gate_intervals(actions: DataFrame, closed: list[tuple[int, int]], at: str = "seq") -> DataFrame:
    """The column form of gated(), for the intervals [from, to) in which the gate was closed: a filter, no exchange."""
    shut = F.lit(False)
    for low, high in closed:
        shut = shut | ((F.col(at) >= low) & (F.col(at) < high))
    return actions.where(~shut)


def outcomes(actions: DataFrame, ok: Column, error: Column) -> DataFrame:
    """action struct, ok, error (null if ok)."""
    return actions.select(F.struct(*actions.columns).alias("action"), ok.alias("ok"), F.when(~ok, error).alias("error"))


def first_that_succeeds(actions: DataFrame, primary: Column, secondary: Column) -> DataFrame:
    """ok and by: the primary's success, else the secondary's verdict."""
    return actions.withColumn("ok", primary | secondary).withColumn("by", F.when(primary, "primary").otherwise("secondary"))
