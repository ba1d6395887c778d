"""The event archive: an append-only table for each event type, with a committed height.

Layout under the root: data/<table>/batch=<id>/*.parquet and _progress/<table>/<id>.json, the commit record, which is
written under another name and renamed. Readers list the records first and read only the batches they name, so rows and
height appear together; a batch that was written again after a failure changes nothing. A record never changes, so a
reader opens each once; every MANIFEST records the writer puts all of them into one more file, <number>.manifest, from which
a new reader begins. All file access goes through Hadoop's file systems, so the root may be any store that Spark reaches
and that renames files atomically.
"""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidewright.functions.naming import keyword
from tidewright.sources.schema import BLOCK, PAYLOAD, PROGRESS, EventSchema, SchemaError


#: Commit records between two manifests.
MANIFEST = 32


class Store(ABC):
    """What a persisted source needs of an archive."""

    spark: SparkSession

    @abstractmethod
    def write(self, schema: EventSchema, rows: DataFrame, batch: str) -> int | None:
        """Appends rows and their height as one; returns the table's height."""

    @abstractmethod
    def last_block(self, table: str) -> int | None:
        """The table's height, None if it has none."""

    @abstractmethod
    def schema(self, table: str) -> EventSchema:
        """The table's schema; KeyError if there is no such table."""

    @abstractmethod
    def replay(self, schema: EventSchema, to: int) -> DataFrame:
        """(block_number, seq, _payload) up to a block, in order; no rows if there is no such table."""


class Archive(Store):
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._records: dict[str, dict[str, dict]] = {}  # table -> file name -> record, as they were read
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, path: str, text: str) -> None:
        hidden = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(hidden))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(self._path(hidden), self._path(path)):
            self._fs.delete(self._path(hidden), False)
            raise OSError(f"{path} can't be committed")

    def commits(self, table: str) -> list[dict]:
        where, known = f"{self.root}/{PROGRESS}/{table}", self._records.setdefault(table, {})
        names = self._names(where)
        records = [n for n in names if n.endswith(".json")]
        manifests = [n for n in names if n.endswith(".manifest")]
        if manifests and len([n for n in records if n not in known]) > 1:
            known |= json.loads(self._read(f"{where}/{manifests[-1]}"))
        for n in records:
            if n not in known:
                known[n] = json.loads(self._read(f"{where}/{n}"))
        return [known[n] for n in records]

    def _summarise(self, table: str) -> None:
        """Writes a manifest if MANIFEST records have come since the last one."""
        where = f"{self.root}/{PROGRESS}/{table}"
        names = self._names(where)
        count = sum(n.endswith(".json") for n in names)
        last = max((int(n.split(".")[0]) for n in names if n.endswith(".manifest")), default=0)
        if count - last >= MANIFEST:
            self.commits(table)
            self._commit(f"{where}/{count:012}.manifest", json.dumps(self._records[table]))

    # writing

    def write(self, schema: EventSchema, rows: DataFrame, batch: str) -> int | None:
        """Rows as schema.stored, appended with their height as one commit; the height so far stays if it is higher.
        No rows write nothing; a batch that is already committed is skipped. Returns the table's height."""
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in schema.stored]:
            raise SchemaError(f"rows of {schema.table} are {rows.schema.simpleString()}, not {schema.stored.simpleString()}")
        record = f"{self.root}/{PROGRESS}/{schema.table}/{batch}.json"
        if not self._fs.exists(self._path(record)):
            where = f"{self.root}/data/{schema.table}/batch={batch}"
            rows.repartitionByRange(BLOCK).sortWithinPartitions(BLOCK, "seq").write.mode("overwrite").parquet(where)
            found = self.spark.read.schema(schema.stored).parquet(where).agg(F.max(BLOCK), F.count("*")).first()
            if found[1]:
                self._commit(record, json.dumps({"table": schema.table, "batch": batch, "last_block": found[0], "rows": found[1], "columns": schema.columns}))
                self._summarise(schema.table)
            else:
                self._fs.delete(self._path(where), True)
        return self.last_block(schema.table)

    # reading

    def last_block(self, table: str) -> int | None:
        return max((c["last_block"] for c in self.commits(table)), default=None)

    def schema(self, table: str) -> EventSchema:
        found = self.commits(table)
        if not found:
            raise KeyError(table)
        return EventSchema(table, tuple(map(tuple, found[0]["columns"])))

    def read(self, table: str) -> DataFrame:
        """The committed rows; of a table without any, KeyError."""
        schema = self.schema(table)
        return self.spark.read.schema(schema.stored).parquet(*[f"{self.root}/data/{table}/batch={c['batch']}" for c in self.commits(table)])

    def replay(self, schema: EventSchema, to: int) -> DataFrame:
        """Payloads up to a block, in order; only what is asked for is read."""
        if not self.commits(schema.table):
            return self.spark.createDataFrame([], schema.stored).select(BLOCK, "seq", PAYLOAD)
        return self.read(schema.table).where(F.col(BLOCK) <= to).select(BLOCK, "seq", PAYLOAD).orderBy(BLOCK, "seq")

    def exists(self, table: str) -> bool:
        plain = table and "/" not in table and not table.startswith(("_", "."))
        return bool(plain) and any(n.endswith(".json") for n in self._names(f"{self.root}/{PROGRESS}/{table}"))

    def tables(self) -> list[str]:
        return [t for t in self._names(f"{self.root}/{PROGRESS}") if self.exists(t)]

    def columns(self, table: str) -> list[tuple[str, str]]:
        """(name, type keyword) in declared order, arrival order left out; text kinds are TEXT."""
        return [(f.name, keyword(f.dataType)) for f in self.schema(table).stored if f.name != "seq"]

    def watermarks(self) -> list[tuple[str, int]]:
        return [(t, self.last_block(t)) for t in self.tables()]

    def healthy(self) -> bool:
        try:
            return self.spark.sql("SELECT 1").first()[0] == 1 and self._fs.exists(self._path(self.root))
        except (AnalysisException, OSError):
            return False


class ReadOnlyArchive:
    """The archive's reading half. A root that doesn't exist is an error, it is never created."""

    def __init__(self, spark: SparkSession, root: str):
        self._archive = Archive(spark, root)
        if not self._archive._fs.exists(self._archive._path(root)):
            raise FileNotFoundError(root)
        for name in ("last_block", "schema", "read", "exists", "tables", "columns", "watermarks", "healthy"):
            setattr(self, name, getattr(self._archive, name))


def table_keywords(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, keyword(f.dataType)) for f in schema]
