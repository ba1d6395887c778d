"""A streaming source in Python: new blocks by number, at a fixed pace for each trigger."""

from __future__ import annotations

import hashlib

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class BlockDataSource(DataSource):
    """format("blocks"): rows (number, hash). Options: start (0), per_batch (10), until (no end). The hash is a digest of
    the number, so that the feed replays as it was."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "number long, hash string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return BlockReader(self.options)


class BlockReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.start, self.step = int(options.get("start", 0)), int(options.get("per_batch", 10))
        self.until = int(options["until"]) if "until" in options else None

    def initialOffset(self) -> dict:
        return {"number": self.start}

    def read(self, start: dict):
        high = start["number"] + self.step
        high = high if self.until is None else max(start["number"], min(high, self.until + 1))
        return self.rows(start["number"], high), {"number": high}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self.rows(start["number"], end["number"])

    def commit(self, end: dict) -> None:
        pass

    @staticmethod
    def rows(low: int, high: int):
        return iter([(n, "0x" + hashlib.sha256(str(n).encode()).hexdigest()) for n in range(low, high)])
