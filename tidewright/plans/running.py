"""Queries that run the engine: sources, the archive behind one, strategies and sinks, the read layer; and their SQL.

They read whole tables. Where a query cuts a table in two, in what was there and what came later, the cut follows its size.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, types as T
from pyspark.sql import functions as F

from tidewright.functions import cells, naming
from tidewright.functions.pricing import Fees, PricingError, escalation_percent
from tidewright.operators import combinators as C
from tidewright.operators import reliability as R
from tidewright.operators import submission as S
from tidewright.operators.fluent import SinkChain, Source
from tidewright.operators.machines import ReconnectPolicy
from tidewright.plans import serving
from tidewright.plans.catalog import _FEES, _archived, _confirm_sql, _fees, _ok, _table, ev, ev_r, query
from tidewright.shared import scratch
from tidewright.sources import collectors
from tidewright.sources.archive import Archive, ReadOnlyArchive
from tidewright.sources.live import BlockDataSource
from tidewright.sources.schema import EventSchema, SchemaError, payload_of
from tidewright.streaming.persisted import Persisted, persisted, read_range
from tidewright.streaming.pipeline import OutcomeTable, Pipeline

SCHEMA = EventSchema("page_view", (("k", "INTEGER"),))
K = T.StructType([T.StructField("k", T.LongType())])


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).withColumn("_payload", F.col("props"))


def _top(spark: SparkSession, sf_dir: str) -> int:
    return ev(spark, sf_dir).agg(F.max("block_number")).first()[0] or 0


# sources


@query("SELECT block_number AS number, '0x' || sha256(CAST(block_number AS VARCHAR)) AS hash FROM (SELECT DISTINCT block_number FROM {ev})")
def block_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(BlockDataSource)
    top, where = _top(spark, sf_dir), scratch(spark)
    feed = spark.readStream.format("blocks").option("per_batch", str(top // 3 + 1)).option("until", str(top)).load()
    running = feed.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema("number long, hash string").parquet(f"{where}/out")


@query("SELECT block_number AS poll, 'h' || seq AS hash FROM {ev} WHERE seq % 11 <> 0")
def polled_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.collect_list(F.struct(F.when(F.col("seq") % 11 != 0, F.concat(F.lit("h"), "seq")).alias("h")))
    polls = ev(spark, sf_dir).groupBy(F.col("block_number").alias("poll")).agg(F.transform(hashes, lambda x: x["h"]).alias("hashes"))
    return collectors.polled_hashes(polls)


@query("SELECT block_number AS poll, 'h' || seq AS hash, seq AS number FROM {ev} WHERE seq % 9 <> 0")
def polled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).select("block_number", "seq", F.concat(F.lit("h"), "seq").alias("hash"))
    polls = rows.groupBy(F.col("block_number").alias("poll")).agg(F.collect_list("hash").alias("hashes"))
    headers = rows.where("seq % 9 <> 0").select("hash", F.col("seq").alias("number"))
    return collectors.polled_headers(polls, headers).select("poll", "hash", "number")


def _transaction(n: int) -> tuple | None:
    """A node that doesn't know some hashes and fails on others."""
    if n % 7 == 0:
        raise OSError("no answer")
    return None if n % 9 == 0 else (n, f"tx{n}")


@query("SELECT seq, 'tx' || seq AS tx FROM {ev} WHERE event_type = 'purchase' AND seq % 7 <> 0 AND seq % 9 <> 0")
def pending_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collectors.look_up_remote(ev(spark, sf_dir).where("event_type = 'purchase'"), "seq", _transaction, "seq long, tx string")


@query("SELECT block_number, seq FROM {ev} WHERE event_type IN ('purchase', 'click') AND user_id % 5 IN (1, 2) AND seq % 13 <> 0 AND block_number BETWEEN 10 AND (SELECT max(block_number) // 2 FROM {ev})")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.concat(F.lit("t"), F.col("user_id") % 5)
    logs = ev(spark, sf_dir).select("block_number", "seq", F.col("event_type").alias("address"), F.array(topic).alias("topics"), (F.col("seq") % 13 == 0).alias("removed"))
    return collectors.LogSource(logs, ["purchase", "click"], ["t1", "t2"]).range(10, _top(spark, sf_dir) // 2).select("block_number", "seq")


@query("SELECT block_number, seq, CAST(props->>'$.k' AS BIGINT) AS k FROM {ev} WHERE seq % 5 > 1 AND seq % 13 <> 0 AND seq % 17 <> 0")
def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    payload = F.when(seq % 5 == 0, "not json").when(seq % 5 == 1, F.when(seq % 2 == 0, '{"k":"x"}').otherwise('{"other":1}')).otherwise(F.col("props"))
    logs = ev(spark, sf_dir).select(F.when(seq % 17 != 0, F.col("block_number")).alias("block_number"), "seq", (seq % 13 == 0).alias("removed"), payload.alias("_payload"))
    return collectors.typed_events(logs, K)


@query("SELECT seq, value FROM {ev} WHERE event_type = 'click'")
def channel_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, where = ev(spark, sf_dir).select("seq", "value", "event_type"), scratch(spark)
    kind = lambda k: rows.where(F.col("event_type") == k).drop("event_type")
    channel = collectors.Channel(spark, f"{where}/channel", kind("view").schema)
    channel.send(kind("purchase"))
    heard = channel.subscribe()
    channel.send(kind("click"))
    heard.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(heard.schema).parquet(f"{where}/out")


@query("SELECT seq FROM {ev} WHERE event_type = 'view'")
def subscribe_or_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collectors.subscribe_or_poll(lambda: spark.read.parquet(f"{sf_dir}/no_such_feed.parquet"), lambda: ev(spark, sf_dir))
    return found.where("event_type = 'view'").select("seq")


@query("SELECT n_nationkey, n_name FROM nation")
def read_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collectors.read_table(spark, f"parquet:{sf_dir}/nation.parquet").select("n_nationkey", "n_name")


class _Narrow(collectors.TableSource):
    """Refuses ranges of more than `widest` blocks."""

    def __init__(self, rows: DataFrame, widest: int):
        super().__init__(rows)
        self.widest = widest

    def range(self, low: int, high: int) -> DataFrame:
        if high - low + 1 > self.widest:
            raise RuntimeError("query returned more than 10000 results")
        return super().range(low, high).withColumn("low", F.lit(low).cast("long")).withColumn("high", F.lit(high).cast("long"))


@query("""WITH RECURSIVE t AS (SELECT max(block_number) AS top FROM {ev}),
w AS (SELECT CAST(0 AS BIGINT) AS low, top AS high FROM t UNION ALL
SELECT CASE WHEN s = 0 THEN low ELSE mid + 1 END, CASE WHEN s = 0 THEN mid ELSE high END FROM (SELECT low, high, low + (high - low) // 2 AS mid FROM w, t WHERE high - low + 1 > top // 10 + 1), (VALUES (0), (1)) v(s))
SELECT seq, low, high FROM {ev}, w, t WHERE high - low + 1 <= top // 10 + 1 AND block_number BETWEEN low AND high""")
def bisected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _top(spark, sf_dir)
    return C.merge(*read_range(_Narrow(ev(spark, sf_dir), top // 10 + 1), 0, top)).select("seq", "low", "high")


# a source with an archive behind it

_CUT = "(SELECT max(block_number) * 3 // 4 FROM {ev})"
_LIVE = f"(SELECT seq, block_number FROM {{ev_r}} WHERE block_number > {_CUT} AND seq >= ({_CUT} + 1) * 10)"


def _cut(spark: SparkSession, sf_dir: str) -> tuple[int, Callable[[], Iterable[DataFrame]]]:
    """The tip at three quarters of the blocks, and a feed of what comes later, in batches."""
    cut = _top(spark, sf_dir) * 3 // 4
    later = ev_r(spark, sf_dir).where(F.col("seq") >= (cut + 1) * 10).withColumn("_payload", F.lit('{"k":1}'))
    first, last = later.agg(F.min("seq"), F.max("seq")).first()

    def feed() -> Iterator[DataFrame]:
        step = (last - first) // 3 + 1
        for low in range(first, last + 1, step):
            yield later.where(F.col("seq").between(low, low + step - 1))

    return cut, feed if first is not None else lambda: iter(())


@query(f"""WITH live AS MATERIALIZED (SELECT * FROM {_LIVE}), kept AS ({_confirm_sql("live", 3)})
SELECT block_number, seq, true AS stored FROM {{ev}} WHERE block_number <= {_CUT} UNION ALL
SELECT block_number, seq, seq IN (SELECT seq FROM kept) FROM live""")
def persisted_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, feed = _cut(spark, sf_dir)
    source = collectors.TableSource(C.block_range(_rows(spark, sf_dir), 0, cut), feed)
    archive, delivered = Archive(spark, scratch(spark)), []
    Persisted(source, archive, SCHEMA).with_chunk(cut // 3 + 1).with_depth(3).run(lambda batch: delivered.append(batch.select("block_number", "seq")))
    kept = archive.read("page_view").select("seq", F.lit(True).alias("stored"))
    return C.merge(*delivered).join(kept, "seq", "left").select("block_number", "seq", F.coalesce("stored", F.lit(False)).alias("stored"))


_ODD = "SELECT event_id AS seq, event_id // 10 - CASE WHEN {turn} AND event_id = top * 3 // 5 THEN 2 ELSE 0 END AS b, {bad} AND event_id = top * 3 // 5 AS bad, top // 50 + 1 AS chunk FROM events, (SELECT max(event_id) AS top FROM events)"
_HALTED = """WITH e AS ({odd}), s AS (SELECT *, b // chunk AS c, coalesce(lag(b) OVER (PARTITION BY b // chunk ORDER BY seq) > b, false) OR bad AS wrong FROM e),
h AS (SELECT min(seq) AS halt, min(c) AS hc FROM s WHERE wrong), t AS (SELECT max(b) AS top FROM s, h WHERE c = hc AND seq < halt)
SELECT b AS block_number, seq FROM s, h, t WHERE c < hc OR c = hc AND seq < halt AND b < top"""


def _backfilled(spark: SparkSession, rows: DataFrame, top: int, chunk: int) -> DataFrame:
    archive = Archive(spark, scratch(spark))
    feed = persisted(collectors.TableSource(rows.select("block_number", "seq", "_payload")), archive, "PageView(uint256)")
    feed.with_to_block(top).with_chunk(chunk).run(lambda batch: None)
    return archive.read("page_view").select("block_number", "seq")


@query(_HALTED.replace("{odd}", _ODD.replace("{turn}", "true").replace("{bad}", "false")))
def persisted_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event steps back in the middle: nothing after it is stored, in this chunk or a later one."""
    rows = _rows(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0]
    rows = rows.withColumn("block_number", F.col("block_number") - F.when(F.col("seq") == last * 3 // 5, 2).otherwise(0))
    return _backfilled(spark, rows, last // 10, last // 50 + 1)


@query(_HALTED.replace("{odd}", _ODD.replace("{turn}", "false").replace("{bad}", "true")))
def persisted_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event in the middle is no JSON object: as if it stepped back."""
    rows = _rows(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0]
    rows = rows.withColumn("_payload", F.when(F.col("seq") == last * 3 // 5, "[1]").otherwise(F.col("_payload")))
    return _backfilled(spark, rows, last // 10, last // 50 + 1)


@query(f"SELECT 1 AS subscription, seq FROM {{ev}} WHERE block_number <= {_CUT} UNION ALL SELECT s, seq FROM {_LIVE}, (VALUES (1), (2)) v(s)")
def replay_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored is replayed by the first subscription alone."""
    cut, feed = _cut(spark, sf_dir)
    rows, archive = C.block_range(_rows(spark, sf_dir), 0, cut), Archive(spark, scratch(spark))
    archive.write(SCHEMA, SCHEMA.encode(rows), "seed")
    source = Persisted(collectors.TableSource(rows, feed), archive, SCHEMA)
    heard = [batch.select(F.lit(n).alias("subscription"), "seq") for n in (1, 2) for batch in source.subscribe()]
    return C.merge(*heard)


class _Failing(collectors.TableSource):
    """The third range that is asked for fails."""

    asked = 0

    def range(self, low: int, high: int) -> DataFrame:
        self.asked += 1
        if self.asked == 3:
            raise OSError("no answer")
        return super().range(low, high)


@query("SELECT block_number, seq, true AS stored FROM {ev} WHERE block_number < 2 * ((SELECT max(block_number) FROM {ev}) // 5 + 1)")
def poisoned_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that fails ends the backfill and the live part; the height stays below it."""
    archive, delivered, top = Archive(spark, scratch(spark)), [], _top(spark, sf_dir)
    rows = _rows(spark, sf_dir)
    source = Persisted(_Failing(rows, lambda: iter([rows])), archive, SCHEMA).with_chunk(top // 5 + 1)
    try:
        source.run(lambda batch: delivered.append(batch.select("block_number", "seq")))
    except OSError:
        pass
    kept = archive.read("page_view").select("seq", F.lit(True).alias("stored"))
    return C.merge(*delivered).join(kept, "seq", "left").select("block_number", "seq", F.coalesce("stored", F.lit(False)).alias("stored"))


# archive and read layer


@query("""SELECT 'page_view' AS table_name, true AS found, 'block_number INTEGER,k INTEGER,missing TEXT,_payload TEXT' AS columns, CAST(max(block_number) AS DOUBLE) AS last_block FROM {ev} UNION ALL
SELECT 'purchase', true, 'block_number INTEGER,k INTEGER,_payload TEXT', max(block_number) FROM {ev} WHERE event_type = 'purchase' UNION ALL
SELECT 'nope', false, NULL, NULL UNION ALL SELECT '_progress', false, NULL, NULL""")
def archive_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, _ = _archived(spark, sf_dir)
    own = EventSchema("purchase", SCHEMA.columns)
    archive.write(own, own.encode(_rows(spark, sf_dir).where("event_type = 'purchase'")), "0")
    reader = ReadOnlyArchive(spark, archive.root)
    heights = dict(reader.watermarks())
    rows = [(t, reader.exists(t), ",".join(f"{n} {k}" for n, k in reader.columns(t)) if reader.exists(t) else None, heights.get(t)) for t in (*reader.tables(), "nope", "_progress")]
    return spark.createDataFrame(rows, "table_name string, found boolean, columns string, last_block long").withColumn("last_block", F.col("last_block").cast("double"))


@query("""SELECT * FROM (VALUES ('as declared', true), ('a column too many', false), ('a column too few', false), ('another type', false), ('reserved column', false), ('reserved table', false), ('unknown type', false), ('not an object', false), ('reserved field', false),
('a root that is there', true), ('no root', false)) t(attempt, accepted)""")
def refused_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive accepts: rows of the declared shape, schemas without reserved names, and roots that exist."""
    archive = Archive(spark, scratch(spark))
    rows = SCHEMA.encode(_rows(spark, sf_dir))
    attempts: dict[str, Callable] = {
        "as declared": lambda: archive.write(SCHEMA, rows, "0"),
        "a column too many": lambda: archive.write(SCHEMA, rows.withColumn("more", F.lit(1)), "1"),
        "a column too few": lambda: archive.write(SCHEMA, rows.drop("k"), "2"),
        "another type": lambda: archive.write(SCHEMA, rows.withColumn("k", F.col("k").cast("string")), "3"),
        "reserved column": lambda: EventSchema("t", (("block_number", "TEXT"),)),
        "reserved table": lambda: EventSchema("_progress", ()),
        "unknown type": lambda: EventSchema("t", (("a", "DATE"),)),
        "not an object": lambda: EventSchema.infer("T", "3"),
        "reserved field": lambda: EventSchema.infer("T", '{"block_number":1}'),
        "a root that is there": lambda: ReadOnlyArchive(spark, archive.root).healthy(),
        "no root": lambda: ReadOnlyArchive(spark, archive.root + "-none"),
    }

    def accepted(attempt: Callable) -> bool:
        try:
            return attempt() is not False
        except (SchemaError, FileNotFoundError):
            return False

    return spark.createDataFrame([(k, accepted(f)) for k, f in attempts.items()], "attempt string, accepted boolean")


_PATHS = ["/health", "/tables", "/tables/page_view/schema", "/status", "/tables/page_view/rows", "/tables/page_view/rows?limit=5000", "/tables/page_view/rows?limit=7&offset=13", "/tables/page_view/rows?from_block=30&to_block=31", "/tables/page_view/rows?from_block=100000000000", "/tables/page_view/rows?after=20:205&limit=3", "/tables/page_view/rows?limit=-1", "/tables/page_view/rows?offset=x", "/tables/page_view/rows?after=3", "/tables/nope/rows?limit=-1", "/tables/nope/schema", "/nope"]


@query("""WITH n AS (SELECT count(*) AS n, max(block_number) AS top FROM {ev}) SELECT CAST(i AS INTEGER) AS path, CAST(status AS INTEGER) AS status, CAST(items AS DOUBLE) AS items, CAST(first_block AS DOUBLE) AS first_block, error FROM (
SELECT 0 AS i, 200 AS status, NULL AS items, NULL AS first_block, NULL AS error UNION ALL SELECT 1, 200, 1, NULL, NULL UNION ALL SELECT 2, 200, 4, NULL, NULL UNION ALL SELECT 3, 200, 1, top, NULL FROM n
UNION ALL SELECT 4, 200, least(n, 100), 0, NULL FROM n UNION ALL SELECT 5, 200, least(n, 1000), 0, NULL FROM n UNION ALL SELECT 6, 200, 7, 1, NULL UNION ALL SELECT 7, 200, 20, 30, NULL UNION ALL SELECT 8, 200, 0, NULL, NULL UNION ALL SELECT 9, 200, 3, 20, NULL
UNION ALL SELECT 10, 400, NULL, NULL, 'invalid query parameter: limit' UNION ALL SELECT 11, 400, NULL, NULL, 'invalid query parameter: offset' UNION ALL SELECT 12, 400, NULL, NULL, 'invalid query parameter: after'
UNION ALL SELECT 13, 404, NULL, NULL, 'unknown table: nope' UNION ALL SELECT 14, 404, NULL, NULL, 'unknown table: nope' UNION ALL SELECT 15, 404, NULL, NULL, 'not found')""")
def serve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, _ = _archived(spark, sf_dir)
    layer = serving.ReadLayer(ReadOnlyArchive(spark, archive.root))
    rows = []
    for i, path in enumerate(_PATHS):
        status, body = layer.get(path)
        items = next((body[k] for k in ("rows", "columns", "tables") if k in body), None)
        first = items[0].get("block_number", items[0].get("last_block")) if items and isinstance(items[0], dict) else None
        rows.append((i, status, None if items is None else len(items), first, body.get("error")))
    made = spark.createDataFrame(rows, "path int, status int, items long, first_block long, error string")
    return made.withColumns({c: F.col(c).cast("double") for c in ("items", "first_block")})


# functions


@query("SELECT seq, CASE WHEN seq % 2 = 0 THEN 'k' ELSE 'event_type,user_id,value' END AS fields FROM {ev}")
def field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("seq") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct("value", "user_id", "event_type")))
    return ev(spark, sf_dir).select("seq", F.array_join(cells.field_names(payload), ",").alias("fields"))


_SAMPLES = {'{"v":true}': "INTEGER", '{"v":7}': "INTEGER", '{"v":9223372036854775808}': "TEXT", '{"v":1.5}': "REAL", '{"v":"x"}': "TEXT", '{"v":[1]}': "TEXT", '{"v":null}': "TEXT"}


@query(f"SELECT seq, CASE seq % 7 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_SAMPLES.values()))} END AS kind FROM {{ev}}")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.get(F.array(*map(F.lit, _SAMPLES)), (F.col("seq") % 7).cast("int"))
    rows = ev(spark, sf_dir).select("seq", payload.alias("payload"))
    kinds = [(p, EventSchema.infer("V", p).columns[0][1]) for p in _SAMPLES]
    return rows.join(F.broadcast(spark.createDataFrame(kinds, "payload string, kind string")), "payload").select("seq", "kind")


@query("""SELECT seq, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS _payload FROM {ev}""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_of(ev(spark, sf_dir).select("block_number", "seq", "user_id", "event_type")).select("seq", "_payload")


@query("SELECT seq, 'u' || user_id AS \"order by `x`\" FROM {ev}")
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = naming.quoted("order by `x`")
    return ev(spark, sf_dir).selectExpr("seq", f"concat('u', user_id) AS {name}").selectExpr("seq", name)


_TEXTS = {"0": 0, " 17 ": 17, "18446744073709551615": 2**63 - 1, "18446744073709551616": None, "-1": None, "+1": None, "": None, "1.0": None, "0x1": None, "١": None}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{t}', {'NULL' if v is None else f"'{v}'"})" for t, v in _TEXTS.items())}) t(given, parsed)")
def unsigned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(text: str) -> str | None:
        try:
            return str(serving.bounds({"from_block": text}).low)
        except serving.InvalidQuery:
            return None

    return spark.createDataFrame([(t, parsed(t)) for t in _TEXTS], "given string, parsed string")


_MESSAGES = {"Block range is too wide": True, "response size should not greater than 150000000 bytes": True, "exceeds max results 10000": True, "Too Many Results": True, "query returned more than 10000 results": True, "error code -32602": True, "request too big": True, "connection refused": False, "timeout": False, "": False}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{t}', {v})" for t, v in _MESSAGES.items())}) t(message, splits)")
def refused_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, collectors.is_too_large(RuntimeError(t))) for t in _MESSAGES], "message string, splits boolean")


@query("SELECT o_orderkey, 90 + o_orderkey % 40 AS percent, 90 + o_orderkey % 40 >= 110 AS accepted FROM orders")
def escalation_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    def accepted(percent: int) -> bool:
        try:
            return escalation_percent(percent) == percent
        except PricingError:
            return False

    known = spark.createDataFrame([(p, accepted(p)) for p in range(90, 130)], "percent long, accepted boolean")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40 + 90).alias("percent"))
    return rows.join(F.broadcast(known), "percent").select("o_orderkey", "percent", "accepted")


# chains, strategies and sinks


@query("SELECT seq, value FROM {ev} WHERE event_type = 'purchase'")
def project_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir)
    wide = C.merge(C.widen(rows.where("event_type = 'purchase'").select("seq", "value"), "purchase"), C.widen(rows.where("event_type = 'click'").select("seq", "user_id"), "click"))
    return C.project_kind(wide, "purchase")


@query("SELECT seq, event_type FROM {ev}")
def fallback_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = [lambda n=n: spark.read.parquet(f"{sf_dir}/no_such_{n}.parquet") for n in range(3)]
    return C.fallback(*missing, lambda: ev(spark, sf_dir).select("seq", "event_type"), lambda: ev(spark, sf_dir).where("false"))


@query("SELECT seq, sink FROM (SELECT seq, value, 'submit' AS sink FROM {ev} WHERE event_type = 'purchase' UNION ALL SELECT seq, value, 'notify' FROM {ev} WHERE event_type IN ('purchase', 'signup')) WHERE value >= 100")
def fluent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir)
    missing = Source(lambda: spark.read.parquet(f"{sf_dir}/no_such_feed.parquet"))
    kept = {c: F.col(c) for c in ("seq", "event_type", "value")}
    purchases = missing.fallback(Source.of(rows)).filter_map("kind", **kept, kind=F.when(F.col("event_type") == "purchase", F.lit("p")))
    signups = Source.of(rows.where("event_type = 'signup'")).map(**kept, kind=F.lit("s"))
    chosen = purchases.merge(signups).decide(lambda events: events.where("kind IS NOT NULL")).filter(F.col("value") >= 100)
    return chosen.route({"submit": F.col("kind") == "p", "notify": F.lit(True)}).open().select("seq", "sink")


@query("""WITH a AS (SELECT seq, {seq_ok} AS good, (row_number() OVER (ORDER BY seq) - 1) // 50 AS stream FROM {ev} WHERE event_type = 'purchase'),
i AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS island FROM a),
s AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY stream, island ORDER BY seq) AS streak FROM i),
o AS (SELECT stream, min(seq) AS opened FROM s WHERE streak >= 2 GROUP BY 1)
SELECT seq, seq <= opened OR opened IS NULL AS reached, good AND (seq <= opened OR opened IS NULL) AS ok FROM s LEFT JOIN o ON o.stream = s.stream""")
def breaker_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink behind a breaker that is reset by hand after every 50 actions."""
    reached: set[int] = set()

    def sink(action: Row) -> None:
        reached.add(action["seq"])
        if action["seq"] * 7919 % 10 < 3:
            raise RuntimeError("refused")

    told: list[R.Outcome] = []
    chain = SinkChain(sink, R.ManualClock()).circuit_breaker(2).report(told.append)
    for n, action in enumerate(ev(spark, sf_dir).where("event_type = 'purchase'").orderBy("seq").select("seq").toLocalIterator()):
        if n % 50 == 0:
            chain.handles[-1].reset()
        try:
            chain(action)
        except RuntimeError:
            pass
    rows = [(o.action["seq"], o.action["seq"] in reached, o.ok) for o in told]
    return spark.createDataFrame(rows, "seq long, reached boolean, ok boolean")


class _Node:
    """A node that estimates what the transaction says and takes all."""

    def estimate_gas(self, tx: dict) -> int:
        return tx["units"]

    def estimate_fees(self) -> Fees:
        return self.fees

    def send(self, tx: dict) -> None:
        pass

    def submission(self, order: dict) -> S.Submission:
        self.fees = Fees(order["max_fee"], order["prio"])
        return S.Submission({"o_orderkey": order["o_orderkey"], "units": order["gas"]}, order["profit"], order["bid"])


@query(f"SELECT o_orderkey, bid <= 100 AS sent, CAST(CASE WHEN bid <= 100 THEN profit // gas * bid // 100 END AS DOUBLE) AS max_fee, CAST(CASE WHEN bid <= 100 THEN least(prio, profit // gas * bid // 100) END AS DOUBLE) AS priority_fee FROM ({_FEES})")
def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bid over 100 % is refused; any other error ends the query."""
    told = S.submit_rows(_fees(spark, sf_dir).drop("bump"), ["o_orderkey"], _Node, _Node.submission)
    sent = F.when(F.col("error").isNull(), True).when(F.col("refused"), False).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return told.select("o_orderkey", sent.alias("sent"), *[F.col(c).cast("double").alias(c) for c in ("max_fee", "priority_fee")])


@query("""SELECT 'action' AS what, seq, {seq_ok} AS ok, CASE WHEN NOT ({seq_ok}) THEN 'refused ' || seq END AS error FROM {ev}, (SELECT max(event_id) AS top FROM events) WHERE event_type = 'purchase' AND seq <> top // 3
UNION ALL SELECT 'events', count(*), NULL, NULL FROM {ev} UNION ALL SELECT 'synchronised', 1, NULL, NULL""")
def engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events through a strategy that fails on one of them, a sink that refuses some actions, and an observer."""
    where, rows = scratch(spark), ev(spark, sf_dir).select("seq", "event_type", "value")
    odd = rows.agg(F.max("seq")).first()[0] // 3
    rows.repartitionByRange(3, "seq").write.parquet(f"{where}/in")
    seen = {"events": 0, "synchronised": 0}

    class Purchases:
        def sync_state(self) -> None:
            seen["synchronised"] += 1

        def process(self, events: DataFrame) -> DataFrame:
            checked = F.when(F.col("seq") == odd, F.raise_error(F.lit("odd")).cast("long")).otherwise(F.col("seq"))
            return events.select(checked.alias("seq"), "event_type").where("event_type = 'purchase'").select("seq")

    def sink(action: Row) -> None:
        if action["seq"] * 7919 % 10 < 3:
            raise RuntimeError(f"refused {action['seq']}")

    def watch(what: str, batch: DataFrame) -> None:
        if what == "event":
            seen["events"] += batch.count()

    outcomes = OutcomeTable(spark, f"{where}/outcomes", T.StructType([T.StructField("seq", T.LongType())]), most=500)
    engine = Pipeline(spark, f"{where}/state").add_source(lambda: spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
    engine.add_strategy(Purchases()).add_task_executor(sink, outcomes).add_observer(watch)
    engine.start(available_now=True).join()
    acted = spark.read.schema(outcomes.schema).parquet(outcomes.path).select(F.lit("action").alias("what"), "action.seq", "ok", "error")
    return acted.unionByName(spark.createDataFrame([(k, n, None, None) for k, n in seen.items()], acted.schema))


@query("SELECT true AS fatal, CAST(6000 AS BIGINT) AS waited_ms, CAST(3 AS BIGINT) AS attempts")
def fatal_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that never opens is tried three times, with two waits, and then ends the engine."""
    clock, tried = R.ManualClock(), []

    def broken() -> DataFrame:
        tried.append(1)
        return spark.readStream.parquet(f"{sf_dir}/no_such_feed.parquet")

    handle = Pipeline(spark, scratch(spark), lambda: ReconnectPolicy(3, 1000), clock).add_source(broken).start()
    handle.join()
    return spark.createDataFrame([(handle.fatal.is_set(), clock.now(), len(tried))], "fatal boolean, waited_ms long, attempts long")


@query("SELECT 'purchases' AS strategy, s.sink, seq FROM {ev}, (VALUES ('one'), ('two')) s(sink) WHERE event_type = 'purchase' UNION ALL SELECT 'large', s.sink, seq FROM {ev}, (VALUES ('one'), ('two')) s(sink) WHERE value >= 100")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies, each of which sees every event, and two sinks, each of which gets every action."""
    where, rows = scratch(spark), ev(spark, sf_dir).select("seq", "event_type", "value")
    rows.repartitionByRange(2, "seq").write.parquet(f"{where}/in")
    taken: list[tuple] = []
    engine = Pipeline(spark, f"{where}/state").add_source(lambda: spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
    for name, chosen in (("purchases", F.col("event_type") == "purchase"), ("large", F.col("value") >= 100)):
        engine.add_strategy(lambda events, name=name, chosen=chosen: events.where(chosen).select(F.lit(name).alias("strategy"), "seq"))
    for sink in ("one", "two"):
        engine.add_executor(lambda action, sink=sink: taken.append((action["strategy"], sink, action["seq"])))
    engine.start(available_now=True).join()
    return spark.createDataFrame(taken, "strategy string, sink string, seq long")


@query("SELECT seq, 3 AS opened, 2000 + 4000 AS waited_ms FROM {ev}")
def flaky_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that opens at the third attempt: two waits, the second twice as long, and no event is lost."""
    where, rows = scratch(spark), ev(spark, sf_dir).select("seq")
    rows.write.parquet(f"{where}/in")
    clock, tried, seen = R.ManualClock(), [], []

    def source() -> DataFrame:
        tried.append(1)
        if len(tried) < 3:
            raise OSError("no connection")
        return spark.readStream.schema(rows.schema).parquet(f"{where}/in")

    engine = Pipeline(spark, f"{where}/state", lambda: ReconnectPolicy(4, 1000), clock).add_source(source)
    engine.add_strategy(lambda events: events).add_executor(lambda action: seen.append(action["seq"]))
    engine.start(available_now=True).join()
    return spark.createDataFrame([(n, len(tried), clock.now()) for n in seen], "seq long, opened int, waited_ms int")


@query("SELECT seq AS again FROM {ev} WHERE event_type = 'purchase' AND NOT ({seq_ok})")
def feedback_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of a first engine are the source of a second, whose strategy takes the actions that failed."""
    where, rows = scratch(spark), ev(spark, sf_dir).where("event_type = 'purchase'").select("seq")
    rows.write.parquet(f"{where}/in")

    def sink(action: Row) -> None:
        if action["seq"] * 7919 % 10 < 3:
            raise RuntimeError("refused")

    outcomes, again = (OutcomeTable(spark, f"{where}/{name}", rows.schema, most=300) for name in ("outcomes", "again"))
    first = Pipeline(spark, f"{where}/first").add_source(lambda: spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
    first.add_strategy(lambda events: events).add_task_executor(sink, outcomes).start(available_now=True).join()
    second = Pipeline(spark, f"{where}/second").add_source(outcomes.stream)
    second.add_strategy(lambda told: told.where("NOT ok").select("action.seq")).add_task_executor(lambda action: None, again)
    second.start(available_now=True).join()
    return spark.read.schema(again.schema).parquet(again.path).select(F.col("action.seq").alias("again"))


@query("SELECT true AS stopped, false AS fatal, true AS gapless")
def shut_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An endless feed that is stopped from outside: its queries end, and what it delivered has no gap."""
    spark.dataSource.register(BlockDataSource)
    seen: list[int] = []
    engine = Pipeline(spark, scratch(spark)).add_source(lambda: spark.readStream.format("blocks").option("per_batch", "50").load())
    engine.add_strategy(lambda events: events.select("number")).add_executor(lambda action: seen.append(action["number"]))
    handle = engine.start()
    while len(seen) < 100 and any(t.is_alive() for t in handle.threads):
        time.sleep(0.1)
    handle.stop()
    ended = handle.join(60) and not any(q.isActive for q in handle.queries)
    return spark.createDataFrame([(ended, handle.fatal.is_set(), sorted(seen) == list(range(len(seen))))], "stopped boolean, fatal boolean, gapless boolean")


@query("SELECT 'events' AS table_name, CAST(max(block_number) AS DOUBLE) AS last_block, count(*) AS replayed FROM {ev} UNION ALL SELECT 'nope', NULL, 0")
def missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was never written has no height and replays nothing; it is no error."""
    archive, rows = Archive(spark, scratch(spark)), []
    for name in ("events", "nope"):
        schema = EventSchema(name, SCHEMA.columns)
        if name == "events":
            archive.write(schema, schema.encode(_rows(spark, sf_dir)), "0")
        rows.append((name, archive.last_block(name), archive.replay(schema, 2**40).count()))
    made = spark.createDataFrame(rows, "table_name string, last_block long, replayed long")
    return made.withColumn("last_block", F.col("last_block").cast("double"))
