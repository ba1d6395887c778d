"""The state machines on streams: one state for each key, kept by Spark between batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.machines import Breaker, ConfirmationWindow, Cooldown, RateLimit
from tidewright.shipping import ship

#: The state store that holds more than memory.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def machine_stream(events: DataFrame, key: str, order: str, inputs: list[str], machine: Callable, results: str) -> DataFrame:
    """Each key's events through its machine; a batch's events are sorted by `order` first, as a stream has no order
    within a batch. results: DDL of what the machine hands out. Append mode."""
    ship(events.sparkSession)
    columns = [order, *inputs]
    kind = events.schema[key].dataType.simpleString()
    names = [f.name for f in T.StructType.fromDDL(results)]

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = machine()
        if state.exists:
            own.state = json.loads(state.get[0])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [x for values in zip(*(rows[c].tolist() for c in columns), strict=True) for x in own.push(*values)]
        state.update((json.dumps(own.state),))
        if out:
            found = pd.DataFrame(out, columns=names)
            found.insert(0, key, [who[0]] * len(found))
            yield found

    return events.select(key, *columns).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {results}", "state string", "append", GroupStateTimeout.NoTimeout)


def confirm_stream(events: DataFrame, depth: int, key: str = "stream") -> DataFrame:
    return machine_stream(events, key, "seq", ["block_number"], lambda: ConfirmationWindow(depth), "seq long")


def cooldown_stream(events: DataFrame, every: int, key: str = "stream", at: str = "at_ms") -> DataFrame:
    return machine_stream(events, key, "seq", [at], lambda: Cooldown(every), "seq long")


def rate_limit_stream(events: DataFrame, most: int, window: int, key: str = "stream", at: str = "at_ms") -> DataFrame:
    return machine_stream(events, key, "seq", [at], lambda: RateLimit(most, window), "seq long, send long")


def breaker_stream(events: DataFrame, most: int, key: str = "stream", ok: str = "ok") -> DataFrame:
    return machine_stream(events, key, "seq", [ok], lambda: Breaker(most), "seq long, verdict string")
