"""The read layer: tables, schemas, pages and heights of an archive, as functions and over HTTP (GET only)."""

from __future__ import annotations

import json
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.cells import rows_json
from tidewright.sources.schema import BLOCK

LONG_MAX = 2**63 - 1


class ServeError(Exception):
    status = 500

    def body(self) -> dict:
        return {"error": str(self)}


class UnknownTable(ServeError):
    status = 404

    def __init__(self, table: str):
        super().__init__(f"unknown table: {table}")


class InvalidQuery(ServeError):
    status = 400

    def __init__(self, name: str):
        super().__init__(f"invalid query parameter: {name}")


class Unavailable(ServeError):
    status = 503


@dataclass(frozen=True)
class Limits:
    default: int = 100
    most: int = 1000

    def clamp(self, asked: int | None) -> int:
        return min(max(self.default if asked is None else asked, 1), max(1, self.most))


@dataclass(frozen=True)
class Bounds:
    low: int
    high: int
    limit: int
    offset: int


def unsigned(params: dict[str, str], name: str) -> int | None:
    """The parameter as an unsigned 64-bit integer, spaces around it allowed; None if it isn't given."""
    text = params.get(name)
    if text is None:
        return None
    text = text.strip()
    if not (text.isascii() and text.isdigit()) or int(text) >= 2**64:
        raise InvalidQuery(name)
    return int(text)


def bounds(params: dict[str, str], limits: Limits | None = None) -> Bounds:
    low, high, limit, offset = (unsigned(params, x) for x in ("from_block", "to_block", "limit", "offset"))
    top = lambda x: min(x, LONG_MAX)
    return Bounds(top(low or 0), LONG_MAX if high is None else top(high), (limits or Limits()).clamp(limit), min(offset or 0, 2**31 - 1))


def page(rows: DataFrame, at: Bounds) -> DataFrame:
    """The page in stored order; Spark takes the first offset + limit rows of each partition, no full sort."""
    return rows.where(F.col(BLOCK).between(at.low, at.high)).orderBy(BLOCK, "seq").offset(at.offset).limit(at.limit)


def cursor(params: dict[str, str]) -> tuple[int, int] | None:
    """The parameter after, block:seq of the last row that was seen; None if it isn't given."""
    text = params.get("after")
    if text is None:
        return None
    block, colon, seq = text.partition(":")
    found = {"after": block}, {"after": seq if colon else ""}
    return tuple(min(unsigned(x, "after"), LONG_MAX) for x in found)


def page_after(rows: DataFrame, at: Bounds, seen: tuple[int, int]) -> DataFrame:
    """The page that follows a row: blocks before it are not read, and no offset is counted off, however far in it is."""
    block, seq = seen
    later = rows.where((F.col(BLOCK) >= block) & ((F.col(BLOCK) > block) | (F.col("seq") > seq)))
    return page(later, Bounds(at.low, at.high, at.limit, 0))


class ReadLayer:
    """archive: an Archive or ReadOnlyArchive."""

    def __init__(self, archive, limits: Limits | None = None):
        self.archive, self.limits = archive, limits or Limits()

    def _known(self, table: str) -> None:
        if not self.archive.exists(table):
            raise UnknownTable(table)

    def health(self) -> dict:
        if not self.archive.healthy():
            raise Unavailable("database unavailable")
        return {"status": "ok"}

    def tables(self) -> dict:
        return {"tables": self.archive.tables()}

    def schema(self, table: str) -> dict:
        self._known(table)
        return {"table": table, "columns": [{"name": n, "type": k} for n, k in self.archive.columns(table)]}

    def rows(self, table: str, params: dict[str, str] | None = None) -> dict:
        self._known(table)
        at, seen = bounds(params or {}, self.limits), cursor(params or {})
        if seen is None:
            found = rows_json(page(self.archive.read(table), at)).collect()
            return {"rows": [json.loads(r["json"]) for r in found], "limit": at.limit, "offset": at.offset}
        kept = rows_json(page_after(self.archive.read(table), at, seen), keep=(BLOCK, "seq")).collect()
        end = f"{kept[-1][BLOCK]}:{kept[-1]['seq']}" if len(kept) == at.limit else None
        return {"rows": [json.loads(r["json"]) for r in kept], "limit": at.limit, "next": end}

    def status(self) -> dict:
        return {"tables": [{"table": t, "last_block": b} for t, b in self.archive.watermarks()]}

    def get(self, url: str) -> tuple[int, dict]:
        """(status, body) of a GET."""
        parts = urlsplit(url)
        params = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
        where = [unquote(x) for x in parts.path.strip("/").split("/")]
        try:
            if where in (["health"], ["tables"], ["status"]):
                return 200, getattr(self, where[0])()
            if len(where) == 3 and where[0] == "tables" and where[2] in ("schema", "rows"):
                return 200, self.schema(where[1]) if where[2] == "schema" else self.rows(where[1], params)
            return 404, {"error": "not found"}
        except ServeError as e:
            return e.status, e.body()
        except Exception:
            return 500, {"error": "database error"}

    def server(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        """A server to run with serve_forever() and end with shutdown()."""
        layer = self

        class Handler(BaseHTTPRequestHandler):
            def _send(self, status: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self):
                self._send(*layer.get(self.path))

            def _refuse(self):
                self._send(405, {"error": "method not allowed"})

            do_POST = do_PUT = do_DELETE = do_PATCH = _refuse

            def log_message(self, *_):
                pass

        return ThreadingHTTPServer((host, port), Handler)
