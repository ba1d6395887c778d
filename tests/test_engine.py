"""Combinators, archive, replay / backfill / live scripts, read layer and streams, on a small session."""

import json
import random
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidewright.functions import cells, pricing
from tidewright.operators import combinators as C
from tidewright.operators import ordering as O
from tidewright.operators import submission as S
from tidewright.operators.fluent import SinkChain, Source
from tidewright.operators.machines import BlockWriter, ConfirmationWindow, ReconnectPolicy
from tidewright.operators.reliability import ManualClock
from tidewright.plans import running, serving
from tidewright.sources.archive import Archive, ReadOnlyArchive
from tidewright.sources.collectors import IndexedSource, LogSource, RangeTooLarge, answers, look_up_remote, read_table, subscribe_or_poll
from tidewright.sources.live import BlockDataSource
from tidewright.sources.schema import EventSchema, SchemaError
from tidewright.streaming import stateful
from tidewright.streaming.persisted import Persisted, windows
from tidewright.streaming.pipeline import OutcomeTable, Pipeline, decided

SCHEMA = EventSchema("value_set", (("value", "TEXT"),))


def rows(spark, pairs, first=0):
    data = [(b, first + i, json.dumps({"value": hex(v)})) for i, (b, v) in enumerate(pairs)]
    return spark.createDataFrame(data, "block_number long, seq long, _payload string")


class Script(IndexedSource):
    """A source that plays lists and records the ranges it was asked for."""

    def __init__(self, spark, tip=0, backfill=(), live=(), widest=None, fail=()):
        self.spark, self.top, self.backfill, self.feed, self.widest, self.fail, self.asked = spark, tip, list(backfill), list(live), widest, list(fail), []

    def live(self):
        return iter([rows(self.spark, [x], 1000 + i) for i, x in enumerate(self.feed)])

    def range(self, low, high):
        self.asked.append((low, high))
        if self.widest and high - low >= self.widest:
            raise RangeTooLarge("query returned more than 10000 results")
        if len(self.asked) in self.fail:
            raise OSError("range query failed")
        return rows(self.spark, [x for x in self.backfill if low <= x[0] <= high], low * 10)

    def tip(self):
        return self.top


def values(batches):
    return [int(json.loads(r["_payload"])["value"], 16) for b in batches for r in b.orderBy("seq").collect()]


def stored(archive):
    return [int(r["value"], 16) for r in archive.read("value_set").orderBy("block_number", "seq").collect()] if archive.commits("value_set") else []


def seeded(spark, root, pairs):
    archive = Archive(spark, root)
    if pairs:
        archive.write(SCHEMA, SCHEMA.encode(rows(spark, pairs)), "seed")
    return archive


# (seed, source, options) -> delivered, stored, height
SCRIPTS = {
    "live only": ([], dict(tip=9, live=[(10, 1), (10, 2), (11, 3)]), {}, [1, 2, 3], [1, 2], 10),
    "replay then live": ([(5, 1), (6, 2)], dict(tip=6, live=[(7, 3)]), {}, [1, 2, 3], [1, 2], 6),
    "gap": ([(5, 1)], dict(tip=8, backfill=[(6, 2), (7, 3)], live=[(9, 4)]), {}, [1, 2, 3, 4], [1, 2, 3], 7),
    "chunks": ([], dict(tip=25, backfill=[(5, 1), (15, 2), (25, 3)], live=[(26, 4)]), dict(chunk=10), [1, 2, 3, 4], [1, 2, 3], 25),
    "bisected": ([], dict(tip=25, backfill=[(5, 1), (15, 2), (25, 3)], live=[(26, 4)], widest=10), dict(chunk=100), [1, 2, 3, 4], [1, 2, 3], 25),
    "start block": ([], dict(tip=125, backfill=[(99, 1), (110, 2)]), dict(start_block=100), [2], [2], 110),
    "start below height": ([(110, 1)], dict(tip=125, backfill=[(105, 9), (115, 2)]), dict(start_block=100), [1, 2], [1, 2], 115),
    "reorganised": ([], dict(tip=9, live=[(10, 1), (11, 2), (10, 3), (11, 4), (12, 5), (13, 6)]), dict(depth=2), [1, 2, 3, 4, 5, 6], [3, 4], 11),
    "no overlap": ([(5, 1)], dict(tip=7, backfill=[(6, 2), (7, 3)], live=[(7, 3), (8, 4)]), {}, [1, 2, 3, 4], [1, 2, 3], 7),
    "bounded": ([], dict(tip=25, backfill=[(5, 1), (15, 2), (25, 3)], live=[(26, 4)]), dict(to_block=20), [1, 2], [1, 2], 15),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_persisted_scripts(spark, root, name):
    seed, source, options, delivered, kept, height = SCRIPTS[name]
    archive, source = seeded(spark, root, seed), Script(spark, **source)
    feed = Persisted(source, archive, SCHEMA, **options)
    assert values(feed.subscribe()) == delivered
    assert (stored(archive), archive.last_block("value_set")) == (kept, height)
    if name == "replay then live":
        assert not source.asked
        assert values(feed.subscribe()) == [3]  # what was replayed once isn't again
    if name == "chunks":
        assert feed.queried == [(0, 9), (10, 19), (20, 25)]
    if name == "start block":
        assert feed.queried == [(100, 125)]


def test_a_failed_range_ends_backfill_and_live(spark, root):
    archive = seeded(spark, root, [])
    feed = Persisted(Script(spark, tip=25, backfill=[(5, 1), (15, 2), (25, 3)], live=[(26, 4)], fail=[2]), archive, SCHEMA, chunk=10)
    seen = []
    with pytest.raises(OSError):
        for batch in feed.subscribe():
            seen += values([batch])
    assert (seen, stored(archive), archive.last_block("value_set")) == ([1], [1], 5)


def test_a_failed_first_range_keeps_the_replay(spark, root):
    feed = Persisted(Script(spark, tip=7, backfill=[(7, 3)], live=[(8, 4)], fail=[1]), seeded(spark, root, [(5, 1), (6, 2)]), SCHEMA)
    with pytest.raises(OSError):
        feed.subscribe()
    assert values(feed.subscribe()) == [1, 2, 3, 4]


def test_unreadable_payload_fails_the_subscription(spark, root):
    archive = seeded(spark, root, [])
    archive.write(SCHEMA, SCHEMA.encode(spark.createDataFrame([(5, 0, "not json")], "block_number long, seq long, _payload string")), "seed")
    with pytest.raises(SchemaError):
        Persisted(Script(spark, tip=5), archive, SCHEMA).subscribe()


def test_a_failed_write_halts_the_archive_not_the_events(spark, root):
    archive = seeded(spark, root, [])
    real = archive.write

    def write(schema, found, batch):
        if found.where("block_number = 6").count():
            raise OSError("disk")
        return real(schema, found, batch)

    archive.write = write
    feed = Persisted(Script(spark, tip=4, live=[(5, 1), (6, 2), (7, 3), (8, 4)]), archive, SCHEMA)
    assert values(feed.subscribe()) == [1, 2, 3, 4]
    assert (stored(archive), archive.last_block("value_set")) == ([1], 5)


# backfilled (block, value) in order of arrival, a value None for a payload that is no object -> stored, height, halted
HALTS = {
    "a step back in the first chunk": ([(5, 1), (4, 2), (15, 3)], [], None),
    "a step back in the second": ([(5, 1), (12, 2), (15, 3), (14, 4), (25, 5)], [1, 2], 12),
    "unreadable": ([(1, 1), (2, None), (3, 3), (25, 5)], [], None),
    "unreadable in the second chunk": ([(5, 1), (12, 2), (13, 3), (15, None), (25, 5)], [1, 2], 12),
}


@pytest.mark.parametrize("name", HALTS)
def test_a_halted_backfill_leaves_no_gap(spark, root, name):
    script, kept, height = HALTS[name]
    data = [(b, i, "7" if v is None else json.dumps({"value": hex(v)})) for i, (b, v) in enumerate(script)]
    every = spark.createDataFrame(data, "block_number long, seq long, _payload string")
    source = Script(spark, tip=25, live=[(26, 9), (27, 10), (28, 11)])
    source.range = lambda low, high: C.block_range(every, low, high)
    archive = seeded(spark, root, [])
    feed = Persisted(source, archive, SCHEMA, chunk=10)
    assert sum(batch.count() for batch in feed.subscribe()) == len(script) + 3
    assert feed.halted and (stored(archive), archive.last_block("value_set")) == (kept, height)


def test_an_unreadable_live_event_halts(spark, root):
    source = Script(spark, tip=4)
    source.live = lambda: iter([rows(spark, [(5, 1), (6, 2)], 0), spark.createDataFrame([(7, 5, "not json")], "block_number long, seq long, _payload string"), rows(spark, [(8, 3), (9, 4)], 10)])
    archive = seeded(spark, root, [])
    feed = Persisted(source, archive, SCHEMA)
    assert sum(batch.count() for batch in feed.subscribe()) == 5
    assert feed.halted and (stored(archive), archive.last_block("value_set")) == ([1], 5)
    assert values(Persisted(Script(spark, tip=5), archive, SCHEMA).subscribe()) == [1]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_ranges_of_a_stream_agree_with_the_machines(spark, span):
    rng, data, expected = random.Random(span), [], {"writer": set(), 1: set(), 2: set()}
    for stream in range(60):
        at, machines = 5, {"writer": BlockWriter(), 1: ConfirmationWindow(1), 2: ConfirmationWindow(2)}
        for i in range(rng.randrange(1, 25)):
            at = max(0, at + rng.choice([0, 0, 1, 1, 2] + [-1, -2] * (stream % 3 > 0)))
            bad = rng.random() < 0.01
            data.append((stream, i, at, bad))
            for k, m in machines.items():
                expected[k] |= {(stream, x) for (x,) in m.push(i, at, bad and k == "writer")}
        expected["writer"] |= {(stream, x) for (x,) in machines["writer"].finish()}
    df = spark.createDataFrame(data, "stream long, seq long, block_number long, bad boolean")
    got = lambda d: {(r["stream"], r["seq"]) for r in d.collect()}
    assert got(O.block_writer(df, bad=F.col("bad"), span=span)) == expected["writer"]
    for depth in (1, 2):
        assert got(O.confirmation_window(df, depth, span=span)) == expected[depth]


def test_no_window_holds_a_whole_stream(spark):
    df = O.one_stream(spark.range(10).selectExpr("id AS seq", "id AS block_number"))
    plan = O.block_writer(df)._jdf.queryExecution().optimizedPlan().toString()
    windows_ = [x for x in plan.split("\n") if "Window" in x and "block_number" in x]
    assert windows_ and all("part" in x.split("[")[-2] + x.split("[")[-3] for x in windows_)


@pytest.mark.parametrize("most", [1, 3])
def test_reconnects_agree_with_the_policy(spark, most):
    rng = random.Random(most)
    data = [(k, i, rng.choice([10, 50_000, 29_999, 30_000]), rng.random() < 0.3) for k in range(40) for i in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(data, "stream long, seq long, uptime_ms long, delivered boolean")
    assert sorted(map(repr, O.reconnects(df, max_failures=most).collect())) == sorted(map(repr, O.reconnects_fold(df, max_failures=most).collect()))


def test_hung_calls_hold_up_nothing():
    def fetch(n):
        if n % 10 == 0:
            time.sleep(60)
        time.sleep(0.01)
        return n

    began = time.monotonic()
    assert sorted(answers(range(60), fetch, 4, 0.5)) == [n for n in range(60) if n % 10]
    assert time.monotonic() - began < 10
    assert list(answers([], fetch)) == []


def test_a_strategy_loses_only_the_events_it_fails_on(spark):
    events = spark.range(40).repartition(3).persist()
    act = lambda batch: batch.select(F.when(F.col("id").isin(7, 8, 30), F.raise_error(F.lit("odd")).cast("long")).otherwise(F.col("id")).alias("id")).where("id % 2 = 0")
    got = [r["id"] for part in decided(act, events) for r in part.collect()]
    assert sorted(got) == [n for n in range(0, 40, 2) if n not in (8, 30)]
    assert [r["id"] for part in decided(lambda batch: batch, events) for r in part.collect()] and not list(decided(act, events.where("id = 7")))


def test_a_batch_with_odd_events_stays_one(spark, caplog):
    """Whatever the events on which a strategy fails, it is asked for all the others at once."""
    events = spark.range(3000).repartition(5).persist()
    for odd in ([], [0], [2999], [5, 6, 1700]):
        act = lambda batch, odd=odd: batch.select(F.when(F.col("id").isin(odd), F.raise_error(F.lit("odd")).cast("long")).otherwise(F.col("id")).alias("id"))
        caplog.clear()
        parts = [sorted(r["id"] for r in part.collect()) for part in decided(act, events)]
        assert parts == [[n for n in range(3000) if n not in odd]]
        assert sum(r.levelname == "ERROR" for r in caplog.records) == len(odd)

    def crowd(batch):  # fails on no single event
        return batch.select(F.when(F.lit(batch.count() > 1000), F.raise_error(F.lit("many")).cast("long")).otherwise(F.col("id")).alias("id"))

    assert sorted(r["id"] for part in decided(crowd, events) for r in part.collect()) == list(range(3000))


def test_executors_in_tasks(spark, tmp_path, monkeypatch):
    """Each action once, with its fields as a row; none passes through the driver, and none is written by it."""
    from tidewright.streaming import pipeline

    monkeypatch.setattr(pipeline, "execute_batch", None)

    def sink(action):
        if action.n % 3 == 0:
            raise RuntimeError(f"refused {action.n} {action.more.odd}")

    source = spark.range(1000).selectExpr("id AS n", "named_struct('odd', id % 2 = 1) AS more", "id AS `a.b`")
    source.write.parquet(f"file://{tmp_path}/in")
    outcomes = OutcomeTable(spark, f"file://{tmp_path}/outcomes", source.schema, most=5)
    engine = Pipeline(spark, f"file://{tmp_path}/state").add_source(lambda: spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in"))
    engine.add_strategy(lambda events: events).add_task_executor(sink, outcomes).start(available_now=True).join()
    told = spark.read.schema(outcomes.schema).parquet(outcomes.path)
    assert len(told.inputFiles()) <= 8
    got = sorted((r.action.n, r.ok, r.error) for r in told.collect())
    assert got == [(n, n % 3 > 0, None if n % 3 else f"refused {n} {str(n % 2 == 1)}") for n in range(1000)]


def test_the_feedback_query_leaves_the_driver_alone(spark, monkeypatch):
    """No action and no outcome passes through the driver, in either engine."""

    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(type(spark.range(1)), name, refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    found = running.feedback_loop(spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert found.count() == events.where("event_type = 'purchase' AND event_id * 7919 % 10 < 3").count() > 0


def test_manifests(spark, root, monkeypatch):
    import tidewright.sources.archive as module

    monkeypatch.setattr(module, "MANIFEST", 3)
    archive = seeded(spark, root, [])
    for i in range(7):
        archive.write(SCHEMA, SCHEMA.encode(rows(spark, [(i, i)], i)), f"b{i}")
    fresh, read = Archive(spark, root), []
    real = fresh._read
    fresh._read = lambda path: read.append(path) or real(path)
    assert fresh.last_block("value_set") == 6 and len(fresh.commits("value_set")) == 7
    assert len(read) == 2 and read[0].endswith(".manifest")  # one manifest, one record after it
    assert fresh.exists("value_set") and not fresh.exists("nope") and not fresh.exists("_progress") and not fresh.exists("../x")


def test_chains(spark):
    clock, sent = ManualClock(), []

    def sink(n):
        sent.append(n)
        if n < 0:
            raise OSError

    told = []
    chain = SinkChain(sink, clock).deadline(lambda n: 5000 if n == 5 else None).retry(2, 1000).circuit_breaker(1).map(lambda n: n or None).report(told.append)
    for n in (1, 0, -1, 2):
        try:
            chain(n)
        except (OSError, RuntimeError):
            pass
    assert sent == [1, -1, -1, -1] and [o.ok for o in told] == [True, True, False, False] and clock.now() == 3000
    chain.handles[0].reset()
    chain(5), clock.sleep(2000), chain(5)
    assert sent[4:] == [5]
    a = Source.of(spark.range(3))
    assert [r["id"] for r in a.map(id=F.col("id") + 1).chain(a).open().orderBy("segment", "id").collect()] == [1, 2, 3, 0, 1, 2]


def test_schema(spark):
    assert EventSchema.infer("Transfer(address,uint256)", '{"from":"0x1","amount":"0x2"}').columns == (("amount", "TEXT"), ("from", "TEXT"))
    for bad in ((("block_number", "TEXT"),), (("_payload", "TEXT"),), (("a", "DATE"),)):
        with pytest.raises(SchemaError):
            EventSchema("t", bad)
    with pytest.raises(SchemaError):
        EventSchema("_progress", ())
    with pytest.raises(SchemaError):
        EventSchema.infer("T", "3")
    own = EventSchema("transfers_custom", (("amount", "NUMERIC"), ("missing", "TEXT"), ("flag", "INTEGER"), ("ratio", "REAL")))
    found = own.encode(spark.createDataFrame([(1, 1, '{"amount":"0x2a","flag":true,"ratio":1.5,"other":1}')], "block_number long, seq long, _payload string")).first()
    assert tuple(found)[2:6] == ("0x2a", None, 1, 1.5)


def test_commits_are_whole_and_idempotent(spark, root):
    archive = seeded(spark, root, [(5, 1), (6, 2)])
    archive.write(SCHEMA, SCHEMA.encode(rows(spark, [(9, 9)])), "seed")
    assert (stored(archive), archive.last_block("value_set")) == ([1, 2], 6)
    SCHEMA.encode(rows(spark, [(7, 7)])).write.parquet(f"{root}/data/value_set/batch=crashed")
    assert stored(archive) == [1, 2]
    archive.write(SCHEMA, SCHEMA.encode(rows(spark, [(3, 3)])), "late")
    assert archive.last_block("value_set") == 6
    with pytest.raises(SchemaError):
        archive.write(SCHEMA, rows(spark, [(7, 7)]), "shape")


def test_read_layer(spark, root):
    archive = seeded(spark, root, [(102, 3), (100, 1), (101, 2)])
    layer = serving.ReadLayer(ReadOnlyArchive(spark, root))
    assert layer.get("/health") == (200, {"status": "ok"})
    assert layer.get("/tables") == (200, {"tables": ["value_set"]})
    assert layer.get("/status") == (200, {"tables": [{"table": "value_set", "last_block": 102}]})
    assert layer.get("/tables/value_set/schema")[1]["columns"] == [{"name": "block_number", "type": "INTEGER"}, {"name": "value", "type": "TEXT"}, {"name": "_payload", "type": "TEXT"}]
    blocks = lambda q: [r["block_number"] for r in layer.get(f"/tables/value_set/rows{q}")[1]["rows"]]
    assert blocks("") == [100, 101, 102]
    assert blocks("?limit=1&offset=1") == [101]
    assert blocks("?from_block=101&to_block=101") == [101]
    assert blocks("?from_block=500") == []
    assert layer.get("/tables/value_set/rows?limit=-1") == (400, {"error": "invalid query parameter: limit"})
    assert layer.get("/tables/nope/rows?limit=-1") == (404, {"error": "unknown table: nope"})
    first = layer.get("/tables/value_set/rows?after=0:0&limit=2")[1]
    assert [r["block_number"] for r in first["rows"]] == [100, 101]
    rest = layer.get(f"/tables/value_set/rows?limit=2&after={first['next']}")[1]
    assert [r["block_number"] for r in rest["rows"]] == [102] and rest["next"] is None
    assert layer.get("/tables/value_set/rows?limit=1")[1]["rows"][0]["_payload"] == {"value": "0x1"}
    assert (serving.Limits().clamp(5000), serving.Limits().clamp(0), serving.Limits().clamp(None)) == (1000, 1, 100)
    server = layer.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/tables")) == {"tables": ["value_set"]}
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(f"{url}/tables", method="POST"))
    assert e.value.code == 405
    server.shutdown()
    with pytest.raises(FileNotFoundError):
        ReadOnlyArchive(spark, root + "/none")
    assert archive.healthy()


def test_cells(spark):
    schema = "block_number long, value long, ratio double, raw binary, missing long, _payload string"
    df = spark.createDataFrame([(100, 7, 1.5, bytearray(b"\x00\xff"), None, '{"value":"7"}'), (101, 8, float("nan"), None, 1, "raw")], schema)
    got = [json.loads(r["json"]) for r in cells.rows_json(df).orderBy("json").collect()]
    assert got[0] == {"block_number": 100, "value": 7, "ratio": 1.5, "raw": "0x00ff", "missing": None, "_payload": {"value": "7"}}
    assert got[1]["ratio"] is None and got[1]["_payload"] == "raw"


def test_combinators(spark):
    a, b = spark.createDataFrame([(1, "x")], "n long, s string"), spark.createDataFrame([(2,)], "n long")
    assert sorted(map(tuple, C.merge(a, b).collect()), key=str) == [(1, "x"), (2, None)]
    assert [r["n"] for r in C.chain(b, b, a.select("n")).orderBy("segment").collect()] == [2, 2, 1]
    assert C.merge_all(spark, [], b.schema).count() == 0
    wide = C.merge(C.widen(a, "named"), C.widen(b, "plain"))
    assert [tuple(r) for r in C.project_kind(wide, "named").collect()] == [(1, "x")]
    missing = lambda: spark.read.parquet("/no/such/path")
    assert C.fallback(missing, lambda: a).count() == 1
    with pytest.raises(Exception):
        C.fallback(missing)
    with pytest.raises(ValueError):
        C.fallback()
    assert subscribe_or_poll(missing, lambda: b).count() == 1
    with pytest.raises(ValueError):
        read_table(spark, "mysql://x")
    assert list(windows(5, 4)) == []


def test_remote_look_up_and_logs(spark):
    def fetch(n):
        if n == 3:
            raise OSError("not found")
        return None if n == 4 else (n, f"tx{n}")

    keys = spark.range(40)
    got = sorted(tuple(r) for r in look_up_remote(keys, "id", fetch, "id long, tx string", concurrent=8).collect())
    assert got == [(n, f"tx{n}") for n in range(40) if n not in (3, 4)]
    logs = spark.createDataFrame([("a", ["t"], 1, 0, False), ("a", ["u"], 2, 1, False), ("b", ["t"], 3, 2, False), ("a", ["t"], 4, 3, True), ("a", ["t"], None, 4, False), ("a", [], 5, 5, False)], "address string, topics array<string>, block_number long, seq long, removed boolean")
    source = LogSource(logs, ["a"], ["t"])
    assert [r["seq"] for r in source.range(0, 9).collect()] == [0] and source.tip() == 1


def test_batch_forms_agree_with_machines(spark):
    df = spark.range(3000).selectExpr("id AS seq", "id % 7 AS stream", "(id * 7919) % 10 >= 3 AS ok")
    key = lambda d: sorted(map(tuple, d.select("stream", "seq", "verdict").collect()))
    assert key(O.breaker(df, 4)) == key(O.breaker_fold(df, 4))


def test_wide_prices(spark):
    top = 2**128 - 1
    df = spark.createDataFrame([(str(top), "10", "21000", "150", None, None), ("1000", "10", "0", "100", "5", "5")], "a string, b string, c string, d string, e string, f string")
    got = [tuple(r["p"]) for r in df.select(pricing.price_wide_udf()(*df.columns).alias("p")).collect()]
    assert got == [(str(top - 10 + 15 if top - 10 + 15 <= top else top), "15", None), (None, None, "gas is zero")]


def test_submissions_in_tasks(spark):
    class Wallet:
        """A node whose fees are those of the row; it fails on row 3 and confirms second attempts."""

        def estimate_gas(self, tx):
            return tx["gas"]

        def estimate_fees(self):
            return pricing.Fees(self.row["fee"], 7)

        def nonce(self):
            return 1

        def send(self, tx):
            if self.row["id"] == 3:
                raise OSError("no answer")
            self.row["sent"] = self.row.get("sent", 0) + 1
            return self.row["sent"]

        def confirmed(self, sent, wait_ms):
            return sent == 2

        def submission(self, row):
            self.row = row
            return S.Submission({"gas": row["gas"]}, row["profit"], row["bid"])

    given = [(n, 100 + n, 10 * (n % 2), 5000, [None, 50, 101][n % 3]) for n in range(40)]
    actions = spark.createDataFrame(given, "id long, fee long, gas long, profit long, bid long").repartition(3)
    for replacement in (None, S.Replacement(most=2)):
        told = S.submit_rows(actions, ["id"], Wallet, Wallet.submission, 150, replacement).collect()
        assert len(told) == 40
        for r in told:
            n, fee, gas, profit, bid = given[r["id"]]
            try:
                fees = pricing.price_wide(pricing.Fees(fee, 7), gas, 150, profit, bid)
                fees = pricing.escalate_wide(fees, 125) if replacement else fees
                expected = (None, None, False, "no answer") if n == 3 else (str(fees.max_fee), str(fees.priority_fee), False, None)
            except pricing.PricingError as e:
                expected = (None, None, True, str(e))
            assert tuple(r)[1:] == expected, n


def test_submitted_leaves_the_driver_alone(spark, monkeypatch):
    """No order passes through the driver, however many there are."""

    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(type(spark.range(1)), name, refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    found = running.submitted(spark, "/root/testdata/sf0.001")
    assert found.count() == 1500 and found.columns == ["o_orderkey", "sent", "max_fee", "priority_fee"]


def test_pipeline_with_feedback(spark, tmp_path):
    spark.dataSource.register(BlockDataSource)
    seen, acted, synced = [], [], []

    class Even:
        def sync_state(self):
            synced.append(True)

        def process(self, events):
            return events.where("number % 2 = 0").select("number")

    def sink(action):
        acted.append(action["number"])
        if action["number"] == 4:
            raise RuntimeError("refused")

    outcomes = OutcomeTable(spark, f"file://{tmp_path}/outcomes", spark.createDataFrame([], "number long").schema)
    engine = Pipeline(spark, f"file://{tmp_path}/checkpoint")
    engine.add_source(lambda: spark.readStream.format("blocks").option("per_batch", "5").option("until", "9").load())
    engine.add_strategy(Even()).add_executor(sink, outcomes.publish).add_observer(lambda what, batch: seen.append((what, batch.count())))
    handle = engine.start()
    for _ in range(120):
        if len(acted) >= 5:
            break
        time.sleep(0.5)
    handle.stop()
    assert handle.join(30) and synced == [True]
    assert sorted(acted)[:5] == [0, 2, 4, 6, 8] and ("event", 5) in seen
    outcomes.flush()
    back = spark.read.schema(outcomes.schema).parquet(outcomes.path)
    assert back.where("NOT ok").select("action.number", "error").first() == (4, "refused")


def test_a_source_that_never_opens_is_fatal(spark, tmp_path):
    clock = ManualClock()

    def broken():
        raise OSError("no connection")

    handle = Pipeline(spark, f"file://{tmp_path}", lambda: ReconnectPolicy(3, 1000), clock).add_source(broken).start()
    assert handle.join(30) and handle.fatal.is_set()
    assert clock.now() == 6000


def test_streams_agree_with_batches(spark, tmp_path):
    df = spark.range(400).selectExpr("id AS seq", "id % 3 AS stream", "id DIV 4 - IF(id % 37 = 0 AND id > 0, 2, 0) AS block_number", "id * 100 AS at_ms")
    df.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    made = stateful.rate_limit_stream(source, 2, 1000)
    made.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.select("stream", "seq").collect())) == sorted(map(tuple, df.select("stream", "seq").collect()))
    assert F is not None
