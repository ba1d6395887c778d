"""JSON to stored values and back, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def infer_type(value) -> str:
    """The stored type of a parsed JSON value: booleans and 64-bit integers INTEGER, wider integers TEXT, other numbers
    REAL, everything else TEXT."""
    if isinstance(value, bool):
        return "INTEGER"
    if isinstance(value, int):
        return "INTEGER" if LONG_MIN <= value <= LONG_MAX else "TEXT"
    return "REAL" if isinstance(value, float) else "TEXT"


def stored_value(value):
    """The stored form of a parsed JSON value."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value if LONG_MIN <= value <= LONG_MAX else str(value)
    if isinstance(value, (dict, list)):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return value


def stored_column(payload: Column, field: str, kind: str) -> Column:
    """The field of a JSON object as a stored value of that type; null where missing, null or not of the type."""
    raw = F.get_json_object(payload, "$['" + field.replace("'", "\\'") + "']")
    if kind == "INTEGER":
        return F.when(raw == "true", F.lit(1)).when(raw == "false", F.lit(0)).otherwise(raw.try_cast("long")).cast("long")
    if kind == "REAL":
        return raw.try_cast("double")
    if kind == "BLOB":
        return F.encode(raw, "UTF-8")
    return raw


def hex_bytes(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def payload_variant(payload: Column) -> Column:
    """The parsed payload, or the text itself where it doesn't parse."""
    return F.coalesce(F.try_parse_json(payload), payload.cast("variant"))


def cell_json(name: str, kind: T.DataType) -> Column:
    """A cell as it is served: integers and finite reals as numbers, bytes as hex, a payload parsed, else text."""
    cell = F.col(name)
    if name == "_payload":
        return payload_variant(cell)
    if isinstance(kind, T.BinaryType):
        return hex_bytes(cell)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(cell) & (F.abs(cell) != float("inf")), cell)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return cell.cast("long")
    return cell.cast("string")


def field_names(payload: Column) -> Column:
    """The fields of a JSON object, sorted; null if it is none."""
    return F.array_sort(F.json_object_keys(payload))


def readable(payload: Column) -> Column:
    """Whether a payload is a JSON object; null is none."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(payload)), F.lit("OBJECT")), F.lit(False))


def rows_json(rows: DataFrame, hidden: tuple[str, ...] = ("seq",), keep: tuple[str, ...] = ()) -> DataFrame:
    """One column, json: each row as a JSON object in column order; and the columns to keep as they are."""
    shown = [cell_json(f.name, f.dataType).alias(f.name) for f in rows.schema if f.name not in hidden]
    return rows.select(*keep, F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))
