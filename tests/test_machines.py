"""Pure state machines and policies, against scripts with known answers and against independent statements of the rules."""

import random

import numpy as np
import pytest

from tidewright.functions import naming, pricing
from tidewright.functions.cells import infer_type, stored_value
from tidewright.functions.pricing import Fees
from tidewright.operators import reliability as R
from tidewright.operators import submission as S
from tidewright.operators.machines import BlockWriter, Breaker, ConfirmationWindow, Cooldown, RateLimit, ReconnectPolicy


def written(machine, script, finish=False):
    out = [x for seq, (block, *bad) in enumerate(script) for (x,) in machine.push(seq, block, *bad)]
    if finish:
        out += [x for (x,) in machine.finish()]
    return [script[i][0] for i in out]


@pytest.mark.parametrize(
    ("depth", "script", "expected", "halted"),
    [
        (2, [1, 2, 3, 4], [1, 2], False),
        (1, [1, 2, 3], [1, 2], False),
        (2, [5, 6, 5, 6, 7], [5], False),
        (1, [5, 6, 5, 7], [5], True),
    ],
)
def test_window_scripts(depth, script, expected, halted):
    window = ConfirmationWindow(depth)
    assert written(window, [(b,) for b in script]) == expected
    assert window.state["halted"] is halted


def test_window_keeps_the_corrected_rows():
    window = ConfirmationWindow(2)
    out = [x for seq, b in enumerate([5, 6, 5, 6, 7]) for (x,) in window.push(seq, b)]
    assert out == [2]  # the second 5


def test_window_halts_on_unreadable():
    assert written(ConfirmationWindow(2), [(1,), (2, True), (3,), (4,)]) == []


def test_block_writer_scripts():
    assert written(BlockWriter(), [(1,), (1,), (2,), (3,)], finish=True) == [1, 1, 2, 3]
    assert written(BlockWriter(), [(5,), (4,), (5,)], finish=True) == []
    assert written(BlockWriter(), [(1,), (2, True), (3,)], finish=True) == []


def stored_by_rules(blocks, depth):
    """Which rows the window stores, said declaratively and in quadratic time."""
    n = len(blocks)
    back = [i > 0 and blocks[i] < blocks[i - 1] for i in range(n)]
    first = lambda s, test: next((i for i in range(s + 1, n) if test(i)), None)
    found = {}
    for s in range(n):
        drop = first(s, lambda i: back[i] and blocks[i] <= blocks[s])
        ripe = first(s, lambda i: blocks[i] >= blocks[s] + depth)
        if ripe is not None and (drop is None or ripe < drop):
            found[s] = ripe
    halt = min((i for s, ripe in found.items() for i in range(ripe + 1, n) if back[i] and blocks[i] <= blocks[s]), default=None)
    return sorted(s for s, ripe in found.items() if halt is None or ripe < halt)


def test_window_against_rules():
    rng = random.Random(7)
    for _ in range(400):
        blocks, at = [], 5
        for _ in range(rng.randrange(1, 25)):
            at = max(0, at + rng.choice([0, 1, 1, 1, 2, -1, -2]))
            blocks.append(at)
        depth = rng.randrange(1, 5)
        window = ConfirmationWindow(depth)
        assert sorted(x for i, b in enumerate(blocks) for (x,) in window.push(i, b)) == stored_by_rules(blocks, depth)


def test_cooldown():
    cool = Cooldown(60)
    assert [bool(cool.push(i, t)) for i, t in enumerate([0, 31, 62, 121, 122])] == [True, False, True, False, True]


def test_cooldown_of_many_at_once():
    rng = random.Random(4)
    for rising in (True, False):
        for _ in range(100):
            at = [rng.randrange(300) for _ in range(rng.randrange(40))]
            at = sorted(at) if rising else at
            one, many = Cooldown(60), Cooldown(60)
            expected = [x for i, t in enumerate(at) for x in one.push(i, t)]
            cut = rng.randrange(len(at) + 1)
            seq, times = np.arange(len(at)), np.array(at, dtype=np.int64)
            assert many.push_many(seq[:cut], times[:cut]) + many.push_many(seq[cut:], times[cut:]) == expected
            assert one.state == many.state


def test_rate_limit():
    limit = RateLimit(1, 1000)
    assert [limit.push(i, 0)[0][1] for i in range(3)] == [0, 1000, 2000]
    rng = random.Random(3)
    for _ in range(200):
        k, ready, sends = rng.randrange(1, 4), 0, []
        limit = RateLimit(k, 1000)
        for i in range(20):
            ready += rng.randrange(0, 700)
            expected = max([ready, *sends[-1:], *([sends[-k] + 1000] if len(sends) >= k else [])])
            sends.append(limit.push(i, ready)[0][1])
            assert sends[-1] == expected


def test_breaker():
    breaker = Breaker(2)
    assert [breaker.push(i, ok)[0][1] for i, ok in enumerate([False, True, False, False, True])] == ["failed", "ok", "failed", "failed", "rejected"]
    breaker.reset()
    assert breaker.push(9, True) == [(9, "ok")]


def test_reconnect():
    policy = ReconnectPolicy(4, 1000)
    assert [policy.failed() for _ in range(4)] == [("retry", 2000), ("retry", 4000), ("retry", 8000), ("fatal", None)]
    policy = ReconnectPolicy(3, 1000)
    policy.failed(), policy.failed()
    assert policy.failed(45_000) == ("retry", 1000)
    assert [policy.failed()[0] for _ in range(3)] == ["retry", "retry", "fatal"]


def test_backoff_and_prices():
    assert [pricing.backoff_ms(100, i) for i in range(4)] == [100, 200, 400, 800]
    assert pricing.backoff_ms(2**60, 40) == 2**64 - 1
    est = Fees(1000, 10)
    assert pricing.price_wide(Fees(100, 10), 21000, 150) == Fees(105, 15)
    assert pricing.price_wide(est, 21000, 100, 2_100_000, 50) == Fees(50, 10)
    assert pricing.price_wide(est, 21000, 100, 2_100_000, 5) == Fees(5, 5)
    assert pricing.price_wide(Fees(10, 100), 21000) == Fees(100, 100)
    for bad in ({"gas": 0, "profit": 1, "bid": 5}, {"gas": 1, "profit": 1, "bid": 101}):
        with pytest.raises(pricing.PricingError):
            pricing.price_wide(est, **bad)
    schedule = pricing.ReplacementSchedule(Fees(200, 20), 125, 2)
    assert [schedule.escalate() for _ in range(3)] == [Fees(250, 25), Fees(312, 31), None]
    assert pricing.escalate_wide(Fees(2**128 - 1, 1), 125).max_fee == 2**128 - 1
    with pytest.raises(pricing.PricingError):
        pricing.escalation_percent(109)


def test_names_and_cells():
    assert naming.table_name("ERC20Transfer(address,uint256)") == "e_r_c20_transfer"
    values = {True: ("INTEGER", 1), 2**63 - 1: ("INTEGER", 2**63 - 1), 2**63: ("TEXT", str(2**63)), 1.5: ("REAL", 1.5), "x": ("TEXT", "x"), None: ("TEXT", None)}
    for value, (kind, stored) in values.items():
        assert (infer_type(value), stored_value(value)) == (kind, stored)
    assert stored_value({"a": [1, 2]}) == '{"a":[1,2]}'


class Flaky:
    def __init__(self, failures):
        self.failures, self.calls, self.clock = failures, [], R.ManualClock()

    def __call__(self, action):
        self.calls.append((action, self.clock.now()))
        if len(self.calls) <= self.failures:
            raise RuntimeError(f"failure {len(self.calls)}")


def test_retry_waits_and_raises_the_last_error():
    sink = Flaky(99)
    with pytest.raises(RuntimeError, match="failure 3"):
        R.retry(sink, 2, 1000, sink.clock)("a")
    assert [t for _, t in sink.calls] == [0, 1000, 3000]
    sink = Flaky(1)
    R.retry(sink, 3, 100, sink.clock)("a")
    assert len(sink.calls) == 2


def test_deadline_inside_retry():
    sink = Flaky(99)
    R.retry(R.deadline(sink, lambda _: 1500, sink.clock), 3, 1000, sink.clock)("a")
    assert len(sink.calls) == 2


def test_wrappers():
    good, bad, told = Flaky(0), Flaky(99), []
    R.fallback_to(bad, good)("a")
    assert good.calls and bad.calls
    R.report(good, told.append)("b")
    with pytest.raises(RuntimeError):
        R.report(bad, told.append)("c")
    assert [(o.action, o.ok) for o in told] == [("b", True), ("c", False)]
    sink, handle = R.break_circuit(bad, 2)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            sink("x")
    seen = len(bad.calls)
    with pytest.raises(R.BreakerOpen):
        sink("x")
    assert len(bad.calls) == seen and handle.is_open
    R.dry_run(bad)("y")
    assert len(bad.calls) == seen
    paced = Flaky(0)
    run = R.limit_rate(paced, 2, 1000, paced.clock)
    for i in range(3):
        run(i)
    assert [t for _, t in paced.calls] == [0, 0, 1000]


class Node:
    def __init__(self, confirms_at=None):
        self.sent, self.asked, self.confirms_at = [], 0, confirms_at

    def estimate_gas(self, tx):
        self.asked += 1
        return 21000

    def estimate_fees(self):
        return Fees(200, 20)

    def nonce(self):
        return 7

    def send(self, tx):
        self.sent.append(tx)
        return len(self.sent)

    def confirmed(self, sent, wait_ms):
        return sent == self.confirms_at


def test_submission():
    node = Node()
    with pytest.raises(pricing.PricingError):
        S.Submitter(node)(S.Submission(profit=1, bid=101))
    assert not node.asked
    S.Submitter(node)(S.Submission({"to": "x"}))
    assert node.sent == [{"to": "x", "gas": 21000, "max_fee": 200, "priority_fee": 20}]
    node = Node(confirms_at=2)
    S.Submitter(node, replacement=S.Replacement(most=2))(S.Submission())
    assert [(t["nonce"], t["max_fee"], t["priority_fee"]) for t in node.sent] == [(7, 200, 20), (7, 250, 25)]
    node = Node()
    with pytest.raises(S.Unconfirmed, match="3 attempts"):
        S.Submitter(node, replacement=S.Replacement(most=2))(S.Submission({"nonce": 3}))
    assert [t["max_fee"] for t in node.sent] == [200, 250, 312] and node.sent[0]["nonce"] == 3
    with pytest.raises(pricing.PricingError):
        S.Replacement(percent=105)
