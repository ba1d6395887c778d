"""Names and types: snake case, table names from signatures, type keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# The stored types, their keywords in the read layer, and the Spark types that hold them.
SPARK_TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "NUMERIC": T.StringType()}
KEYWORDS = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}
# End of fixed values.


def snake_case(name: str) -> str:
    """An underscore before every upper-case ASCII letter but the first character; all lower case."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def snake_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def table_name(signature: str) -> str:
    """What stands before the parenthesis of an event's signature, in snake case."""
    return snake_case(signature.partition("(")[0])


def table_name_column(signature: Column) -> Column:
    return snake_column(F.substring_index(signature, "(", 1))


def keyword(kind: T.DataType) -> str:
    """The read layer's name of a column type; text kinds are TEXT, unknown ones their own name in upper case."""
    name = kind.simpleString()
    return KEYWORDS.get(name, name.upper())


def quoted(identifier: str) -> str:
    """An identifier for Spark SQL."""
    return "`" + identifier.replace("`", "``") + "`"
