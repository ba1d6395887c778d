"""The order-dependent operators as plain state machines, used by the batch and the streaming forms alike.

A machine takes one event after the other with push() and hands out results as tuples; finish() ends a finite input. Its
state is a JSON value in `state`, so that a stream can keep it between batches.
"""

from __future__ import annotations

import numpy as np


class BlockWriter:
    """Writes a block when a higher one appears, the last at the end. A lower block halts it for good; nothing that was
    not yet written is written then. Results: (seq,) of the rows written."""

    def __init__(self):
        self.state = {"block": None, "rows": [], "halted": False}

    def push(self, seq: int, block: int, bad: bool = False) -> list[tuple]:
        s = self.state
        if s["halted"]:
            return []
        if bad or s["block"] is not None and block < s["block"]:
            s.update(halted=True, rows=[])
            return []
        out = []
        if s["block"] is not None and block > s["block"]:
            out, s["rows"] = [(x,) for x in s["rows"]], []
        s["block"] = block
        s["rows"].append(seq)
        return out

    def finish(self) -> list[tuple]:
        out, self.state["rows"] = [(x,) for x in self.state["rows"]], []
        return out


class ConfirmationWindow:
    """Writes block b once the head is `depth` above it. A lower block than the head is a reorganisation: above what is
    written, the buffered blocks from it on are dropped and the head goes back; at or below that, the window halts for
    good. What is not confirmed at the end stays unwritten. Results: (seq,) of the rows written, lowest block first."""

    def __init__(self, depth: int = 1, flushed: int | None = None):
        self.depth = depth
        self.state = {"head": None, "flushed": flushed, "blocks": [], "halted": False}  # blocks: [block, [seq, ...]], ascending

    def push(self, seq: int, block: int, bad: bool = False) -> list[tuple]:
        s = self.state
        if s["halted"]:
            return []
        if bad or s["flushed"] is not None and block <= s["flushed"]:
            s.update(halted=True, blocks=[])
            return []
        blocks = s["blocks"]
        if s["head"] is not None and block < s["head"]:
            while blocks and blocks[-1][0] >= block:
                blocks.pop()
        s["head"] = block
        if blocks and blocks[-1][0] == block:
            blocks[-1][1].append(seq)
        else:
            blocks.append([block, [seq]])
        out, ripe = [], 0
        while ripe < len(blocks) and blocks[ripe][0] + self.depth <= block:
            out += [(x,) for x in blocks[ripe][1]]
            s["flushed"] = blocks[ripe][0]
            ripe += 1
        if ripe:
            s["blocks"] = blocks[ripe:]
        return out

    def pending(self) -> list[int]:
        return [x for _, rows in self.state["blocks"] for x in rows]

    def finish(self) -> list[tuple]:
        return []


class Cooldown:
    """After a firing, later ones are dropped until `every` has passed since it; one at that very time passes."""

    def __init__(self, every: int):
        self.every = every
        self.state = {"fired": None}

    def push(self, seq: int, at: int) -> list[tuple]:
        if self.state["fired"] is not None and at - self.state["fired"] < self.every:
            return []
        self.state["fired"] = at
        return [(seq,)]

    def push_many(self, seq: np.ndarray, at: np.ndarray) -> list[tuple]:
        """push() of many at once: where times don't fall, the next firing is looked up instead of asking each."""
        if (at[1:] < at[:-1]).any():
            return [x for values in zip(seq.tolist(), at.tolist(), strict=True) for x in self.push(*values)]
        out, i, fired = [], 0, self.state["fired"]
        while True:
            if fired is not None:
                i = max(i, int(np.searchsorted(at, fired + self.every)))
            if i >= len(at):
                break
            fired = int(at[i])
            out.append((int(seq[i]),))
            i += 1
        self.state["fired"] = fired
        return out

    def finish(self) -> list[tuple]:
        return []


class RateLimit:
    """At most `most` sends in any `window`: an action over that waits, in order, and is never dropped. Results: (seq, send)."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window
        self.state = {"sent": []}

    def push(self, seq: int, ready: int) -> list[tuple]:
        sent = self.state["sent"]
        send = max(ready, sent[-1]) if sent else ready
        if len(sent) == self.most:
            send = max(send, sent[0] + self.window)
        sent.append(send)
        if len(sent) > self.most:
            sent.pop(0)
        return [(seq, send)]

    def finish(self) -> list[tuple]:
        return []


class Breaker:
    """Opens after `most` failures in a row and rejects from then on, without counting, until reset(); a success sets the
    count to zero. Results: (seq, verdict) with verdict ok, failed or rejected."""

    def __init__(self, most: int):
        self.most = most
        self.state = {"failures": 0}

    @property
    def is_open(self) -> bool:
        return self.state["failures"] >= self.most

    def reset(self) -> None:
        self.state["failures"] = 0

    def push(self, seq: int, ok: bool) -> list[tuple]:
        if self.is_open:
            return [(seq, "rejected")]
        self.state["failures"] = 0 if ok else self.state["failures"] + 1
        return [(seq, "ok" if ok else "failed")]

    def finish(self) -> list[tuple]:
        return []


class ReconnectPolicy:
    """Counts failed or short-lived subscriptions in a row; a delivery or a healthy uptime zeroes the count. A failure
    waits base * 2^count, count included; at max_failures it is fatal. After a healthy uptime the wait is the base."""

    def __init__(self, max_failures: int = 3, base_ms: int = 1000, healthy_ms: int = 30_000):
        self.max_failures, self.base_ms, self.healthy_ms = max_failures, base_ms, healthy_ms
        self.state = {"failures": 0}

    def delivered(self) -> None:
        self.state["failures"] = 0

    def failed(self, uptime_ms: int = 0) -> tuple[str, int | None]:
        from tidewright.functions.pricing import backoff_ms

        if uptime_ms >= self.healthy_ms:
            self.state["failures"] = 0
            return "retry", backoff_ms(self.base_ms, 0)
        self.state["failures"] += 1
        if self.state["failures"] >= self.max_failures:
            return "fatal", None
        return "retry", backoff_ms(self.base_ms, self.state["failures"])

    def push(self, seq: int, uptime_ms: int, delivered: bool) -> list[tuple]:
        """One subscription that lived uptime_ms; a fatal one starts the count anew."""
        if delivered:
            self.delivered()
        decision, wait = self.failed(uptime_ms)
        if decision == "fatal":
            self.state["failures"] = 0
        return [(seq, decision, wait)]

    def finish(self) -> list[tuple]:
        return []

