"""Submitting transactions: priced once and sent, or sent again with the same nonce and higher fees until confirmed.

A Submitter is a sink, for one action after the other; submit_rows() runs one in every task, for actions in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewright.functions.pricing import Fees, PricingError, ReplacementSchedule, escalation_percent, ladder_columns, price_wide
from tidewright.shipping import ship


class Client(Protocol):
    """The node that takes transactions. Calls raise on failure or timeout."""

    def estimate_gas(self, tx: dict) -> int: ...
    def estimate_fees(self) -> Fees: ...
    def nonce(self) -> int: ...
    def send(self, tx: dict) -> Any: ...
    def confirmed(self, sent: Any, wait_ms: int) -> bool: ...


@dataclass(frozen=True)
class Submission:
    tx: dict = field(default_factory=dict)
    profit: int | None = None
    bid: int | None = None


@dataclass(frozen=True)
class Replacement:
    """How long an attempt is watched, by how much the next one pays more, and how many may follow the first."""

    wait_ms: int = 12_000
    percent: int = 125
    most: int = 3

    def __post_init__(self):
        escalation_percent(self.percent)


class Unconfirmed(RuntimeError):
    pass


class Submitter:
    """A sink for Submission. A bid over 100 % is refused before the node is asked anything."""

    def __init__(self, client: Client, bump: int = 100, replacement: Replacement | None = None):
        self.client, self.bump, self.replacement = client, bump, replacement

    def __call__(self, action: Submission) -> None:
        if action.bid is not None and action.bid > 100:
            raise PricingError(f"bid of {action.bid} % exceeds 100 %")
        gas = self.client.estimate_gas(action.tx)
        fees = price_wide(self.client.estimate_fees(), gas, self.bump, action.profit, action.bid)
        tx = action.tx | {"gas": gas}
        if self.replacement is None:
            self.client.send(tx | _paid(fees))
            return
        if tx.get("nonce") is None:
            tx["nonce"] = self.client.nonce()
        schedule = ReplacementSchedule(fees, self.replacement.percent, self.replacement.most)
        while fees is not None:
            if self.client.confirmed(self.client.send(tx | _paid(fees)), self.replacement.wait_ms):
                return
            fees = schedule.escalate()
        raise Unconfirmed(f"not confirmed after {schedule.issued} attempts")


def _paid(fees: Fees) -> dict:
    return {"max_fee": fees.max_fee, "priority_fee": fees.priority_fee}


class _Watched:
    """A client that remembers what was sent last."""

    def __init__(self, client: Client):
        self.client, self.last = client, None

    def send(self, tx: dict) -> Any:
        sent = self.client.send(tx)
        self.last = tx
        return sent

    def __getattr__(self, name: str) -> Any:
        return getattr(self.client, name)


#: What submit_rows() tells of an action: the fees of the last attempt that the client took, as decimal text, as they may
#: exceed a BIGINT; whether it was refused by its price; and the error.
_TOLD = {"max_fee": T.StringType(), "priority_fee": T.StringType(), "refused": T.BooleanType(), "error": T.StringType()}


def submit_rows(actions: DataFrame, keys: list[str], client: Callable[[], Client], submission: Callable[[Client, dict], Submission], bump: int = 100, replacement: Replacement | None = None) -> DataFrame:
    """A Submitter in every task, with a client of its own: keys, max_fee, priority_fee, refused, error. submission makes
    the Submission of a row. An action that fails is recorded, the rest go on. A task that Spark runs again sends its
    actions again, as a batch of the engine would; actions that share a nonce or an order are for the Submitter itself."""
    schema = T.StructType([*[actions.schema[k] for k in keys], *[T.StructField(n, k) for n, k in _TOLD.items()]])
    arrow = to_arrow_schema(schema)
    ship(actions.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = _Watched(client())
        submit = Submitter(node, bump, replacement)
        for found in batches:
            told: dict[str, list] = {n: [] for n in _TOLD}
            for row in found.to_pylist():
                node.last, refused, error = None, False, None
                try:
                    submit(submission(node.client, row))
                except Exception as e:
                    refused, error = isinstance(e, PricingError), str(e)
                paid = node.last
                told["max_fee"].append(paid and str(paid["max_fee"]))
                told["priority_fee"].append(paid and str(paid["priority_fee"]))
                told["refused"].append(refused)
                told["error"].append(error)
            made = [found.column(n) if n in keys else pa.array(told[n]) for n in arrow.names]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, arrow, strict=True)], schema=arrow)

    return actions.mapInArrow(run, schema)


def replacement_attempts(actions: DataFrame, max_fee: Column, priority_fee: Column, replacement: Replacement, confirms: Callable[[Column], Column]) -> DataFrame:
    """The column form for recorded outcomes: a row for each attempt made, with its fees and whether it was confirmed;
    attempts end with the first one that is."""
    ladder = ladder_columns(max_fee, priority_fee, replacement.percent, replacement.most)
    tries = F.transform(F.sequence(F.lit(0), F.lit(replacement.most)), confirms)
    first = F.array_position(tries, True)
    made = F.when(first > 0, F.slice(ladder, F.lit(1), first.cast("int"))).otherwise(ladder)
    out = actions.select(*actions.columns, F.inline(made))
    return out.withColumn("confirmed", confirms(F.col("attempt")))
