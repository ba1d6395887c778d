"""The event engine's queries by name, and the same rows in SQL.

ev: events with seq = event_id and ten events a block; ev_r: the same with a reorganisation of two blocks every 97th
event. Actions are purchases, or orders. Failures are simulated by arithmetic on ids, never at random.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidewright.functions import cells, naming, pricing
from tidewright.operators import combinators as C
from tidewright.operators import ordering as O
from tidewright.operators import reliability as R
from tidewright.operators import submission as S
from tidewright.plans import serving
from tidewright.shared import scratch
from tidewright.sources.archive import Archive, table_keywords
from tidewright.sources.schema import EventSchema
from tidewright.streaming import stateful
from tidewright.streaming.persisted import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EV = "SELECT event_id AS seq, event_id // 10 AS block_number, user_id, event_type, value, props, epoch_us(ts) // 1000 AS at_ms FROM events"
EV_R = "SELECT event_id AS seq, greatest(event_id // 10 - CASE WHEN event_id % 97 = 0 AND event_id > 0 THEN 2 ELSE 0 END, 0) AS block_number FROM events"
OK = "(event_id * 7919) % 10 >= 3"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.format(ev=f"({EV})", ev_r=f"({EV_R})", ok=OK, seq_ok=OK.replace("event_id", "seq")).split())
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr("event_id DIV 10").alias("block_number"), "user_id", "event_type", "value", "props", at.alias("at_ms"))


def ev_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.when((F.col("event_id") % 97 == 0) & (F.col("event_id") > 0), 2).otherwise(0)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.greatest(F.expr("event_id DIV 10") - back, F.lit(0)).cast("long").alias("block_number"))


def _ok(seq: Column, attempt: Column | int = 0) -> Column:
    return (seq * 7919 + attempt * 31) % 10 >= 3


# map, filter, union


@query("SELECT seq, block_number, event_type AS kind, CASE WHEN event_type = 'purchase' THEN value END AS purchase_value, CASE WHEN event_type = 'click' THEN CAST(user_id AS DOUBLE) END AS click_user FROM {ev}")
def map_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return C.map_events(ev(spark, sf_dir), seq=F.col("seq"), block_number=F.col("block_number"), kind=kind, purchase_value=F.when(kind == "purchase", F.col("value")), click_user=F.when(kind == "click", F.col("user_id").cast("double")))


@query("SELECT seq, block_number, CAST(props->>'$.k' AS BIGINT) AS k FROM {ev} WHERE CAST(props->>'$.k' AS BIGINT) >= 50")
def filter_map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = cells.stored_column(F.col("props"), "k", "INTEGER")
    return C.filter_map(ev(spark, sf_dir), "k", seq=F.col("seq"), block_number=F.col("block_number"), k=F.when(k >= 50, k))


@query("SELECT seq, event_type, value FROM {ev} WHERE event_type IN ('click', 'purchase')")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).select("seq", "event_type", "value")
    return C.merge(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"))


@query("SELECT seq, block_number, event_type FROM {ev}")
def merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).select("seq", "block_number", "event_type")
    kinds = ("click", "error", "purchase", "signup", "view")
    return C.merge_all(spark, [rows.where(F.col("event_type") == k) for k in kinds])


@query("SELECT 0 AS segment, seq, event_type FROM {ev} WHERE event_type = 'signup' UNION ALL SELECT 1, seq, event_type FROM {ev} WHERE event_type = 'click' ORDER BY 1, 2")
def chain_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).select("seq", "event_type")
    return C.chain(rows.where("event_type = 'signup'"), rows.where("event_type = 'click'")).orderBy("segment", "seq")


#: Parts in which queries read or archive a whole table.
PARTS = 4


def _part_windows(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The table's blocks, from 0 to its tip, in PARTS ranges."""
    top = ev(spark, sf_dir).agg(F.max("block_number")).first()[0] or 0
    return list(windows(0, top, top // PARTS + 1))


@query("SELECT CAST(block_number // ((SELECT max(block_number) FROM {ev}) // 4 + 1) AS INTEGER) AS segment, seq FROM {ev}")
def chain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir)
    return C.chain(*[C.block_range(rows, *w).select("seq") for w in _part_windows(spark, sf_dir)]).orderBy("segment", "seq")


@query("SELECT seq, block_number FROM {ev} WHERE event_type = 'error'")
def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.fallback(lambda: spark.read.parquet(f"{sf_dir}/no_such_table.parquet"), lambda: ev(spark, sf_dir))
    return found.where("event_type = 'error'").select("seq", "block_number")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50 AND o_totalprice <= 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def risk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    allowed = (price >= 50) & (price <= 250000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return C.filter_actions(_table(spark, sf_dir, "orders"), allowed).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def allowlist_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.allow_listed(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), listed, ["o_custkey"])


@query("SELECT seq, 'submit' AS sink FROM {ev} WHERE event_type = 'purchase' UNION ALL SELECT seq, 'notify' FROM {ev} WHERE event_type IN ('purchase', 'signup') AND value >= 100")
def route_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return C.route(ev(spark, sf_dir), {"submit": kind == "purchase", "notify": kind.isin("purchase", "signup") & (F.col("value") >= 100)}).select("seq", "sink")


@query("SELECT event_id AS seq, event_id // 10 AS block_number FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0")
def removed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    logs = ev(spark, sf_dir).withColumn("removed", seq % 13 == 0).withColumn("block_number", F.when(seq % 17 != 0, F.col("block_number")))
    return C.indexed(logs).select("seq", "block_number")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> 0")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return C.look_up(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), known, ["l_orderkey"])


@query("SELECT a.seq, a.user_id FROM {ev} a WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM {ev} b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.seq < a.seq AND (b.seq * 7919) % 10 >= 3)")
def feedback_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ev(spark, sf_dir).where("event_type = 'purchase'").select("seq", "user_id")
    return C.suppress_done(actions, actions.withColumn("ok", _ok(F.col("seq"))), "user_id")


# archive and read layer


def _archived(spark: SparkSession, sf_dir: str) -> tuple[Archive, EventSchema]:
    """The whole table in an archive, a commit for each part."""
    schema = EventSchema("page_view", (("k", "INTEGER"), ("missing", "TEXT")))
    archive = Archive(spark, scratch(spark))
    rows = ev(spark, sf_dir).withColumn("_payload", F.col("props"))
    for i, window in enumerate(_part_windows(spark, sf_dir)):
        archive.write(schema, schema.encode(C.block_range(rows, *window)), str(i))
    return archive, schema


@query("SELECT block_number, seq, props AS _payload FROM {ev} ORDER BY 1, 2")
def replay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, schema = _archived(spark, sf_dir)
    return archive.replay(schema, archive.last_block("page_view"))


@query("SELECT 'page_view' AS table_name, max(block_number) AS last_block FROM {ev}")
def last_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, schema = _archived(spark, sf_dir)
    return spark.createDataFrame(archive.watermarks(), "table_name string, last_block long")


@query("SELECT block_number, CAST(props->>'$.k' AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing, props AS _payload FROM {ev} WHERE block_number >= 350 ORDER BY block_number, seq LIMIT 300 OFFSET 100")
def archive_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, schema = _archived(spark, sf_dir)
    return serving.page(archive.read("page_view"), serving.bounds({"from_block": "350", "limit": "300", "offset": "100"})).drop("seq")


@query("SELECT block_number, seq, props AS _payload FROM {ev} WHERE block_number > 60 OR block_number = 60 AND seq > 603 ORDER BY block_number, seq LIMIT 300")
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, schema = _archived(spark, sf_dir)
    rows = archive.read("page_view").select("block_number", "seq", "_payload")
    return serving.page_after(rows, serving.bounds({"limit": "300"}), serving.cursor({"after": "60:603"}))


@query("SELECT max(block_number) AS tip FROM {ev}")
def tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).agg(F.max("block_number").alias("tip"))


@query("SELECT block_number, seq, user_id, event_type, value, props AS _payload FROM {ev} WHERE block_number BETWEEN 10 AND 80 ORDER BY block_number, seq LIMIT 100 OFFSET 50")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).drop("at_ms").withColumnRenamed("props", "_payload")
    return serving.page(rows, serving.bounds({"from_block": "10", "to_block": "80", "offset": "50"}))


@query("SELECT block_number, seq FROM {ev} ORDER BY block_number, seq LIMIT 1000")
def page_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.page(ev(spark, sf_dir).select("block_number", "seq"), serving.bounds({"limit": "5000"}))


@query("SELECT block_number, seq FROM {ev} WHERE block_number < 30 ORDER BY 1, 2 LIMIT 300")
def page_json_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells.rows_json(serving.page(ev(spark, sf_dir).select("block_number", "seq"), serving.Bounds(0, 29, 300, 0)), hidden=())
    return found.select(F.from_json("json", "block_number long, seq long").alias("r")).select("r.*")


@query("SELECT 'events' AS table_name, max(event_id // 10) AS last_block FROM events UNION ALL SELECT 'orders', max(o_orderkey) FROM orders ORDER BY 1")
def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ev(spark, sf_dir).select(F.lit("events").alias("table_name"), "block_number")
    orders = _table(spark, sf_dir, "orders").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("block_number"))
    return C.merge(events, orders).groupBy("table_name").agg(F.max("block_number").alias("last_block")).orderBy("table_name")


@query("SELECT * FROM (VALUES (0, 'event_id', 'INTEGER'), (1, 'ts', 'TIMESTAMP_NTZ'), (2, 'user_id', 'INTEGER'), (3, 'event_type', 'TEXT'), (4, 'value', 'REAL'), (5, 'props', 'TEXT')) t(position, name, type)")
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table_keywords(_table(spark, sf_dir, "events").schema)
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(found)], "position int, name string, type string")


@query("SELECT block_number, seq, CAST(props->>'$.k' AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS missing, props AS _payload FROM {ev}")
def encode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = EventSchema("transfers_custom", (("amount", "NUMERIC"), ("missing", "TEXT")))
    renamed = ev(spark, sf_dir).withColumn("_payload", F.col("props"))
    encoded = schema.encode(renamed, payload=F.replace("_payload", F.lit('"k"'), F.lit('"amount"')))
    return encoded.withColumn("_payload", F.replace("_payload", F.lit('"amount"'), F.lit('"k"')))


@query("SELECT block_number, seq, CAST(props->>'$.k' AS BIGINT) AS k FROM {ev}")
def decode_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = EventSchema("page_view", (("k", "INTEGER"),))
    stored = schema.encode(ev(spark, sf_dir).withColumn("_payload", F.col("props")))
    return schema.decode(stored, T.StructType([T.StructField("k", T.LongType())]))


@query("SELECT seq, lower(event_type[1] || regexp_replace(event_type[2:] || 'ERC20Done', '([A-Z])', '_\\1', 'g')) AS table_name FROM {ev}")
def snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.concat(F.initcap("event_type"), F.lit("ERC20Done(address,uint256)"))
    return ev(spark, sf_dir).select("seq", naming.table_name_column(signature).alias("table_name"))


@query("SELECT seq, '0x' || lower(hex(encode(props))) AS raw FROM {ev}")
def hex_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("seq", cells.hex_bytes(F.encode("props", "UTF-8")).alias("raw"))


@query("SELECT seq, CASE WHEN seq % 2 = 0 THEN props->>'$.k' END AS k, CASE WHEN seq % 2 = 1 THEN 'not json ' || seq END AS raw FROM {ev}")
def payload_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = ev(spark, sf_dir).withColumn("p", F.when(F.col("seq") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("not json "), F.col("seq"))))
    parsed = cells.payload_variant(F.col("p"))
    is_text = F.schema_of_variant(parsed) == "STRING"
    return mixed.select("seq", F.when(~is_text, F.try_variant_get(parsed, "$.k", "string")).alias("k"), F.when(is_text, F.try_variant_get(parsed, "$", "string")).alias("raw"))


# backfill, live, ordering


@query("SELECT low, least(low + 99, (SELECT max(block_number) FROM {ev})) AS high FROM (SELECT unnest(generate_series(0, (SELECT max(block_number) FROM {ev}), 100)) AS low)")
def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ev(spark, sf_dir).agg(F.max("block_number")).first()[0]
    return spark.createDataFrame(list(windows(0, top, 100)), "low long, high long")


@query("SELECT seq, block_number, CASE WHEN block_number <= 300 THEN 'backfill' ELSE 'live' END AS segment FROM {ev}")
def live_cut_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).select("seq", "block_number")
    return C.merge(C.block_range(rows, 0, 300).withColumn("segment", F.lit("backfill")), C.live_cut(rows, 300).withColumn("segment", F.lit("live")))


@query("SELECT seq, block_number FROM {ev} WHERE block_number BETWEEN 101 AND 250")
def bounded_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.block_range(ev(spark, sf_dir), 101, 250).select("seq", "block_number")


_WRITER = """WITH e AS (SELECT *, lag(block_number) OVER (ORDER BY seq) > block_number AS back FROM {rel}),
h AS (SELECT min(seq) AS halt FROM e WHERE back), m AS (SELECT max(block_number) AS top FROM e, h WHERE halt IS NULL OR seq < halt)
SELECT seq, block_number FROM e, h, m WHERE halt IS NULL OR seq < halt AND block_number < top"""


@query(_WRITER.replace("{rel}", "{ev}"))
def block_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.block_writer(O.one_stream(ev(spark, sf_dir).select("seq", "block_number"))).drop("stream")


@query(_WRITER.replace("{rel}", "{ev_r}"))
def block_writer_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.block_writer(O.one_stream(ev_r(spark, sf_dir))).drop("stream")


def _confirm_sql(rel: str, depth: int) -> str:
    return f"""WITH e AS MATERIALIZED (SELECT seq, block_number AS b, lag(block_number) OVER (ORDER BY seq) > block_number AS back FROM {rel}),
c AS MATERIALIZED (SELECT a.seq, a.b, min(CASE WHEN z.b >= a.b + {depth} THEN z.seq END) AS mature, min(CASE WHEN z.back AND z.b <= a.b THEN z.seq END) AS dropped FROM e a JOIN e z ON z.seq > a.seq AND (z.b >= a.b + {depth} OR z.back) GROUP BY 1, 2),
k AS MATERIALIZED (SELECT * FROM c WHERE mature IS NOT NULL AND (dropped IS NULL OR mature < dropped)),
h AS (SELECT min(z.seq) AS halt FROM k JOIN e z ON z.back AND z.seq > k.mature AND z.b <= k.b)
SELECT seq FROM k, h WHERE halt IS NULL OR mature < halt"""


def _confirm(name: str, rows: Query, rel: str, depth: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return O.confirmation_window(O.one_stream(rows(spark, sf_dir).select("seq", "block_number")), depth).select("seq")

    run.__name__ = name
    query(_confirm_sql(rel, depth))(run)


_confirm("confirm_plain_d1", ev, "{ev}", 1)
for _depth, _end in ((1, "_halt"), (2, "_halt"), (3, ""), (5, "")):
    _confirm(f"confirm_d{_depth}{_end}", ev_r, "{ev_r}", _depth)

COOL_ALL, COOL_USER = 3_600_000, 86_400_000


def _cooldown_sql(key: str, every: int) -> str:
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT seq, {key} AS stream, at_ms FROM {{ev}} WHERE event_type = 'purchase'),
f AS (SELECT stream, min(seq) AS seq FROM p GROUP BY 1 UNION ALL
SELECT f.stream, (SELECT min(n.seq) FROM p n WHERE n.stream = f.stream AND n.seq > f.seq AND n.at_ms >= (SELECT c.at_ms FROM p c WHERE c.seq = f.seq) + {every}) FROM f WHERE f.seq IS NOT NULL)
SELECT stream, seq FROM f WHERE seq IS NOT NULL"""


@query(_cooldown_sql("CAST(0 AS BIGINT)", COOL_ALL))
def cooldown_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).where("event_type = 'purchase'").withColumn("stream", F.lit(0).cast("long"))
    return O.cooldown(rows, COOL_ALL)


@query(_cooldown_sql("user_id", COOL_USER))
def cooldown_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cooldown(ev(spark, sf_dir).where("event_type = 'purchase'").withColumn("stream", F.col("user_id")), COOL_USER)


RATE, RATE_MS = 3, 7_200_000


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT seq, user_id AS stream, at_ms, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM {{ev}} WHERE event_type = 'purchase'),
s AS (SELECT stream, i, seq, at_ms AS send, CAST(NULL AS BIGINT) AS s1, CAST(NULL AS BIGINT) AS s2 FROM p WHERE i = 1 UNION ALL
SELECT p.stream, p.i, p.seq, greatest(p.at_ms, s.send, coalesce(s.s2 + {RATE_MS}, 0)), s.send, s.s1 FROM s JOIN p ON p.stream = s.stream AND p.i = s.i + 1)
SELECT stream, seq, send FROM s""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).where("event_type = 'purchase'").withColumn("stream", F.col("user_id"))
    return O.rate_limit(rows, RATE, RATE_MS)


# reliability

_TRIES = "SELECT seq, n, (seq * 7919 + n * 31) % 10 >= 3 AS good FROM {ev}, (SELECT unnest(generate_series(0, 3)) AS n) WHERE event_type = 'purchase'"


@query(f"""SELECT seq, CAST(coalesce(min(CASE WHEN good THEN n END) + 1, 4) AS BIGINT) AS attempts, bool_or(good) AS ok,
CAST(100 * (pow(2, coalesce(min(CASE WHEN good THEN n END), 3)) - 1) AS BIGINT) AS waited_ms FROM ({_TRIES}) GROUP BY seq""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ev(spark, sf_dir).where("event_type = 'purchase'").select("seq")
    return O.retries(actions, 3, 100, lambda n: _ok(F.col("seq"), n))


@query("SELECT CAST(n AS BIGINT) AS attempt, CAST(100 * least(pow(2, n), 4294967295) AS BIGINT) AS wait_ms FROM (SELECT unnest(generate_series(0, 40)) AS n)")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(41).select(F.col("id").alias("attempt"), pricing.backoff_column(F.lit(100).cast("long"), F.col("id")).cast("long").alias("wait_ms"))


@query("SELECT seq, (seq * 7919) % 10 >= 3 OR (seq * 7919 + 31) % 10 >= 3 AS ok, CASE WHEN (seq * 7919) % 10 >= 3 THEN 'primary' ELSE 'secondary' END AS \"by\" FROM {ev} WHERE event_type = 'purchase'")
def fallback_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ev(spark, sf_dir).where("event_type = 'purchase'").select("seq")
    return R.first_that_succeeds(actions, _ok(F.col("seq")), _ok(F.col("seq"), 1))


_BREAK = """WITH a AS (SELECT seq, user_id AS stream, {seq_ok} AS good FROM {ev}),
i AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS island FROM a),
s AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY stream, island ORDER BY seq) AS streak FROM i),
o AS (SELECT stream, min(seq) AS opened FROM s WHERE streak >= 3 GROUP BY 1)
SELECT s.stream, seq, CASE WHEN seq > opened THEN 'rejected' WHEN good THEN 'ok' ELSE 'failed' END AS verdict FROM s LEFT JOIN o ON o.stream = s.stream"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("seq", F.col("user_id").alias("stream"), _ok(F.col("seq")).alias("ok"))


@query(_BREAK)
def breaker_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.breaker(_attempts(spark, sf_dir), 3).select("stream", "seq", "verdict")


@query("""WITH RECURSIVE a AS MATERIALIZED (SELECT seq, user_id AS stream, (seq * 37) % 45000 AS up, (seq * 7919) % 10 >= 7 AS delivered, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM {ev}),
r AS (SELECT stream, i, seq, CASE WHEN up >= 30000 THEN 0 ELSE 1 END AS n FROM a WHERE i = 1 UNION ALL
SELECT a.stream, a.i, a.seq, CASE WHEN a.up >= 30000 THEN 0 WHEN a.delivered OR r.n >= 3 THEN 1 ELSE r.n + 1 END FROM r JOIN a ON a.stream = r.stream AND a.i = r.i + 1)
SELECT stream, seq, CASE WHEN n >= 3 THEN 'fatal' ELSE 'retry' END AS decision, CASE WHEN n < 3 THEN CAST(1000 * pow(2, n) AS DOUBLE) END AS wait_ms FROM r""")
def reconnect_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    ended = ev(spark, sf_dir).select("seq", F.col("user_id").alias("stream"), (seq * 37 % 45000).alias("uptime_ms"), (seq * 7919 % 10 >= 7).alias("delivered"))
    return O.reconnects(ended).withColumn("wait_ms", F.col("wait_ms").cast("double"))


@query("SELECT seq, at_ms FROM {ev} WHERE event_type = 'purchase' AND at_ms + (seq * 37) % 1000 > at_ms + 500")
def deadline_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ev(spark, sf_dir).where("event_type = 'purchase'")
    return R.drop_expired(actions, F.col("at_ms") + F.col("seq") * 37 % 1000, F.col("at_ms") + 500).select("seq", "at_ms")


@query("SELECT seq FROM {ev} WHERE NOT (seq BETWEEN 200 AND 299 OR seq BETWEEN 700 AND 949)")
def gated_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gate_intervals(ev(spark, sf_dir), [(200, 300), (700, 950)]).select("seq")


@query("SELECT action_seq, ok, error FROM (SELECT seq AS action_seq, {seq_ok} AS ok, CASE WHEN NOT ({seq_ok}) THEN 'refused ' || seq END AS error FROM {ev} WHERE event_type = 'purchase')")
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ev(spark, sf_dir).where("event_type = 'purchase'").select("seq", "value")
    found = R.outcomes(actions, _ok(F.col("seq")), F.concat(F.lit("refused "), F.col("seq")))
    return found.select(F.col("action.seq").alias("action_seq"), "ok", "error")


@query("SELECT event_type, count(*) AS events, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS actions FROM {ev} GROUP BY 1")
def observer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("actions"))


# fees

_FEES = "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS max_fee, o_custkey % 500 AS prio, 21000 + o_orderkey % 7 AS gas, 100 + o_orderkey % 50 AS bump, CAST(o_totalprice AS BIGINT) * 1000 AS profit, o_orderkey % 120 AS bid FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)"


def _fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("long")
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(key, price.alias("max_fee"), (F.col("o_custkey") % 500).alias("prio"), (21000 + key % 7).alias("gas"), (100 + key % 50).alias("bump"), (price * 1000).alias("profit"), (key % 120).alias("bid"))


@query(f"SELECT o_orderkey, greatest(max_fee - prio, 0) + prio * bump // 100 AS max_fee, least(prio * bump // 100, greatest(max_fee - prio, 0) + prio * bump // 100) AS priority_fee FROM ({_FEES})")
def price_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fees(spark, sf_dir)
    top, tip_, _ = pricing.price_columns(*(F.col(c) for c in ("max_fee", "prio", "gas", "bump")))
    return f.select("o_orderkey", top.alias("max_fee"), tip_.alias("priority_fee"))


@query(f"SELECT o_orderkey, CAST(CASE WHEN bid <= 100 THEN profit // gas * bid // 100 END AS DOUBLE) AS max_fee, CAST(CASE WHEN bid <= 100 THEN least(prio * bump // 100, profit // gas * bid // 100) END AS DOUBLE) AS priority_fee, CASE WHEN bid > 100 THEN 'bid exceeds 100 percent' END AS error FROM ({_FEES})")
def price_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, tip_, error = pricing.price_columns(*(F.col(c) for c in ("max_fee", "prio", "gas", "bump", "profit", "bid")))
    return _fees(spark, sf_dir).select("o_orderkey", top.cast("double").alias("max_fee"), tip_.cast("double").alias("priority_fee"), error.alias("error"))


@query(f"""WITH RECURSIVE l AS (SELECT o_orderkey, 0 AS attempt, max_fee, least(prio, max_fee) AS priority_fee FROM ({_FEES}) UNION ALL
SELECT o_orderkey, attempt + 1, max_fee * 125 // 100, least(priority_fee * 125 // 100, max_fee * 125 // 100) FROM l WHERE attempt < 4) SELECT * FROM l""")
def escalate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = pricing.ladder_columns(F.col("max_fee"), F.col("prio"), 125, 4)
    return _fees(spark, sf_dir).select("o_orderkey", F.inline(ladder))


@query(f"""WITH RECURSIVE l AS (SELECT o_orderkey, 0 AS attempt, max_fee, least(prio, max_fee) AS priority_fee FROM ({_FEES}) UNION ALL
SELECT o_orderkey, attempt + 1, max_fee * 125 // 100, least(priority_fee * 125 // 100, max_fee * 125 // 100) FROM l WHERE attempt < 3 AND (o_orderkey * 7919 + attempt * 31) % 10 < 3)
SELECT o_orderkey, attempt, max_fee, priority_fee, (o_orderkey * 7919 + attempt * 31) % 10 >= 3 AS confirmed FROM l""")
def replacement_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fees = _fees(spark, sf_dir).select("o_orderkey", F.col("max_fee").alias("top"), "prio")
    key = F.col("o_orderkey")
    return S.replacement_attempts(fees, F.col("top"), F.col("prio"), S.Replacement(), lambda n: _ok(key, n)).drop("top", "prio")


# streams


def _streamed(rows: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator over rows as a stream of files, run until all are read; the result as it was written."""
    spark = rows.sparkSession
    where = scratch(spark)
    rows.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{where}/in")
    before = spark.conf.get(stateful.ROCKSDB[0])
    spark.conf.set(*stateful.ROCKSDB)
    try:
        source = spark.readStream.schema(rows.schema).parquet(f"{where}/in")
        made = operator(source)
        made.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(stateful.ROCKSDB[0], before)
    return spark.read.schema(made.schema).parquet(f"{where}/out")


@query(_confirm_sql("{ev_r}", 3))
def stream_vs_batch_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(O.one_stream(ev_r(spark, sf_dir)), lambda s: stateful.confirm_stream(s, 3)).select("seq")


@query(_cooldown_sql("user_id", COOL_USER))
def stream_vs_batch_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).where("event_type = 'purchase'").select("seq", F.col("user_id").alias("stream"), "at_ms")
    return _streamed(rows, lambda s: stateful.cooldown_stream(s, COOL_USER))


@query(_BREAK)
def stream_vs_batch_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(_attempts(spark, sf_dir), lambda s: stateful.breaker_stream(s, 3))
