"""Event schemas: declared, or inferred from the first event and then frozen."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from tidewright.functions.cells import infer_type, stored_column
from tidewright.functions.naming import SPARK_TYPES, table_name

#: Columns that every table has, and the name of the folder that holds heights.
BLOCK, PAYLOAD, PROGRESS = "block_number", "_payload", "_progress"


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class EventSchema:
    """A table and its own columns as (name, stored type), between block_number and _payload."""

    table: str
    columns: tuple[tuple[str, str], ...]

    def __post_init__(self):
        if self.table == PROGRESS:
            raise SchemaError(f"{PROGRESS} is a reserved table name")
        names = [n for n, _ in self.columns]
        for name in names:
            if name in (BLOCK, PAYLOAD, "seq"):
                raise SchemaError(f"{name} is a reserved column name")
        if len({*names}) < len(names):
            raise SchemaError("a column is declared twice")
        for _, kind in self.columns:
            if kind not in SPARK_TYPES:
                raise SchemaError(f"{kind} is no stored type")

    @classmethod
    def infer(cls, signature: str, event: str) -> EventSchema:
        """The table named by the signature, with a column for each field of the JSON event, sorted by name."""
        value = json.loads(event)
        if not isinstance(value, dict):
            raise SchemaError("an event must be a JSON object")
        return cls(table_name(signature), tuple((k, infer_type(value[k])) for k in sorted(value)))

    @property
    def stored(self) -> T.StructType:
        """What the archive holds: block, arrival order, own columns, payload."""
        own = [T.StructField(n, SPARK_TYPES[k], metadata={"sqltype": k}) for n, k in self.columns]
        return T.StructType([T.StructField(BLOCK, T.LongType(), False), T.StructField("seq", T.LongType(), False), *own, T.StructField(PAYLOAD, T.StringType())])

    def encode(self, events: DataFrame, block: Column | str = BLOCK, seq: Column | str = "seq", payload: Column | str = PAYLOAD) -> DataFrame:
        """Rows as stored: each own column is looked up in the payload by name, missing is null, the rest is dropped;
        the payload keeps everything."""
        text = F.col(payload) if isinstance(payload, str) else payload
        own = [stored_column(text, n, k).cast(SPARK_TYPES[k]).alias(n) for n, k in self.columns]
        block, seq = (F.col(x) if isinstance(x, str) else x for x in (block, seq))
        return events.select(block.cast("long").alias(BLOCK), seq.cast("long").alias("seq"), *own, text.alias(PAYLOAD))

    def decode(self, rows: DataFrame, fields: T.StructType) -> DataFrame:
        """Events out of payloads; one that can't be read fails the query, it is never skipped."""
        return rows.select(BLOCK, "seq", F.from_json(PAYLOAD, fields, {"mode": "FAILFAST"}).alias("event")).select(BLOCK, "seq", "event.*")


def payload_of(events: DataFrame, hidden: tuple[str, ...] = (BLOCK, "seq")) -> DataFrame:
    """Adds _payload, the event's fields as a JSON object."""
    return events.withColumn(PAYLOAD, F.to_json(F.struct(*[c for c in events.columns if c not in hidden])))
