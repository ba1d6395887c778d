"""Chains: the operators on sources, actions and sinks as methods, each giving a new link."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame

from tidewright.operators import combinators as C
from tidewright.operators import reliability as R
from tidewright.operators.machines import Breaker


@dataclass(frozen=True)
class Source:
    """A source as a function that opens it anew, as fallback() must try each time."""

    open: Callable[[], DataFrame]

    @classmethod
    def of(cls, rows: DataFrame) -> Source:
        return cls(lambda: rows)

    def _then(self, step: Callable[[DataFrame], DataFrame]) -> Source:
        return Source(lambda: step(self.open()))

    def map(self, **columns: Column) -> Source:
        return self._then(lambda rows: C.map_events(rows, **columns))

    def filter_map(self, keep: str, **columns: Column) -> Source:
        return self._then(lambda rows: C.filter_map(rows, keep, **columns))

    def widen(self, kind: str, name: str | None = None) -> Source:
        return self._then(lambda rows: C.widen(rows, kind, name))

    def merge(self, *others: Source) -> Source:
        return Source(lambda: C.merge(self.open(), *(o.open() for o in others)))

    def chain(self, *others: Source) -> Source:
        return Source(lambda: C.chain(self.open(), *(o.open() for o in others)))

    def fallback(self, *others: Source) -> Source:
        return Source(lambda: C.fallback(self.open, *(o.open for o in others)))

    def decide(self, strategy: Callable[[DataFrame], DataFrame]) -> Actions:
        return Actions(lambda: strategy(self.open()))


@dataclass(frozen=True)
class Actions:
    """What a strategy decides."""

    open: Callable[[], DataFrame]

    def filter(self, allowed: Column) -> Actions:
        return Actions(lambda: C.filter_actions(self.open(), allowed))

    def map(self, **columns: Column) -> Actions:
        return Actions(lambda: C.map_events(self.open(), **columns))

    def route(self, sinks: dict[str, Column]) -> Actions:
        return Actions(lambda: C.route(self.open(), sinks))


class SinkChain:
    """A sink and its wrappers, the innermost first; called like a sink."""

    def __init__(self, sink: R.Sink, clock: R.Clock | None = None, handles: tuple[Breaker, ...] = ()):
        self.sink, self.clock, self.handles = sink, clock or R.Clock(), handles

    def __call__(self, action: Any) -> None:
        self.sink(action)

    def _around(self, sink: R.Sink, *handles: Breaker) -> SinkChain:
        return SinkChain(sink, self.clock, self.handles + handles)

    def map(self, f: Callable[[Any], Any]) -> SinkChain:
        """An action that f turns into None is left out."""

        def run(action: Any) -> None:
            made = f(action)
            if made is not None:
                self.sink(made)

        return self._around(run)

    def deadline(self, expires_at: Callable[[Any], int | None]) -> SinkChain:
        return self._around(R.deadline(self.sink, expires_at, self.clock))

    def retry(self, max_retries: int = 3, base_ms: int = 100) -> SinkChain:
        return self._around(R.retry(self.sink, max_retries, base_ms, self.clock))

    def fallback(self, other: R.Sink) -> SinkChain:
        return self._around(R.fallback_to(self.sink, other))

    def rate_limit(self, most: int, window_ms: int = 1000) -> SinkChain:
        return self._around(R.limit_rate(self.sink, most, window_ms, self.clock))

    def circuit_breaker(self, most: int) -> SinkChain:
        """Its handle, with is_open and reset(), is the last of `handles`."""
        return self._around(*R.break_circuit(self.sink, most))

    def gated(self, is_open: Any) -> SinkChain:
        return self._around(R.gated(self.sink, is_open))

    def dry_run(self) -> SinkChain:
        return self._around(R.dry_run(self.sink))

    def report(self, publish: Callable[[R.Outcome], None]) -> SinkChain:
        return self._around(R.report(self.sink, publish))
