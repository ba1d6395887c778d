"""Connected components by alternating stars, and all-pairs comparison within cells, a block against a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.llm.common import in_batches, materialize, release


#: A key with over one HEAVY-th of a table's rows is heavy: there are fewer than HEAVY of them, whatever the table's size.
HEAVY = 256
#: Lanes that a part can have, at most.
LANES = 1 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long), a table -> (node, component): the least node reachable; nodes without an edge to another don't
    appear.

    Large and small stars in turn until the edges stay as they are: every node ends as a leaf of its component's least
    node. Each step is written to the shared folder, so lineage stays short; release() deletes the last of them. Loops,
    repeated and reversed edges don't matter; null ends are left out.
    """
    now, state = _write(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), edges.count())
    while state[0]:
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = now.union(turned).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large, seen = _write(_with_least(turned, least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), state[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, seen[0])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, before = now, state
        now, state = _write(small, 2 * seen[0])
        release(old, large)
        if state == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._tidewright_path = now._tidewright_path
    return out


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of their u; least: u, m, n. The hubs, keys with over a HEAVY-th of all edges, are sent to every
    task, so that their rows stay where they are; the rows of others are joined."""
    limit = max(64, 2 * total // HEAVY)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    others = least.where(F.col("n") <= limit).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def _write(edges: DataFrame, most: int) -> tuple[DataFrame, tuple]:
    """The edges, `most` of them at most, as a table, with their number and an order-free digest, both seen while writing."""
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s"))
    out = materialize(watched, "edges", most)
    return out, (seen.get["n"], seen.get["x"], seen.get["s"])


def link_blocks(rows: DataFrame, size: str, prepare: Callable[[list[bytes]], Any], links: Callable[[Any, Any], np.ndarray], block: int = 512, stream: int = 512, lane: int = 8) -> DataFrame:
    """Compares the rows of each cell and returns (id, n, root): n is the weight of the rows linked with id, root the
    least id linked with it through links of one comparison; an id has a row for each comparison that links it.

    rows: cell (long), home (boolean), id (long), weight (long), data (binary), and the column `size`, the cell's number
    of home rows. Each pair with a home row in it is compared once. A cell's home rows are dealt into parts of about
    `block`; a part, its anchors, is held in memory, while the home rows of the parts before it and all guests pass by,
    `stream` at a time, `lane` parts of them in one task: beyond that, other tasks hold the same anchors. Guests
    are dealt to lanes by a hash. links() gives the boolean matrix of which rows of the first link with which of the
    second, both as prepare() makes them of their data.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    part = F.when(F.col("home"), F.pmod(F.xxhash64("id"), parts).cast("int")).otherwise(F.lit(0))
    own = rows.select("cell", "home", "id", "weight", "data", parts.alias("parts"), part.alias("part"))
    dealt = own.select("cell", "home", "id", "weight", "data", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("against"))
    anchor = F.col("home") & (F.col("part") == F.col("against"))
    last = F.greatest(F.floor((F.col("against") - 1) / lane).cast("int"), F.lit(0))  # the part's last lane
    own_lane = F.when(F.col("home"), F.floor(F.col("part") / lane)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), last + 1)).cast("int")
    lanes = F.when(anchor, F.sequence(F.lit(0), last)).otherwise(F.array(own_lane))
    dealt = dealt.select("cell", "against", (~anchor).alias("passing"), "id", "weight", "data", F.explode(lanes).alias("lane"))
    dealt = dealt.select("cell", (F.col("against").cast("long") * LANES + F.col("lane")).alias("against"), "passing", "id", "weight", "data")
    dealt = dealt.repartition("cell", "against").sortWithinPartitions("cell", "against", "passing", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group, anchors, held = None, [], []
        ready = None  # the anchors as links() takes them

        def flush() -> pa.RecordBatch:
            i, n, r = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_pydict({"id": pa.array(i), "n": pa.array(n), "root": pa.array(r)})

        def made(parts: list[pa.RecordBatch]) -> tuple:
            table = pa.Table.from_batches(parts)
            return table.column("id").to_numpy(), table.column("weight").to_numpy(), prepare(table.column("data").to_pylist())

        def compare() -> None:
            if ready and held:
                out.append(_compare(ready, made(held), links))
            held.clear()

        def all_anchors() -> None:
            """The anchors are complete: in their first lane they are compared with each other."""
            nonlocal ready
            if anchors:
                ready = made(anchors)
                anchors.clear()
                if group[1] % LANES == 0:
                    out.append(_compare(ready, None, links))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "against", "passing")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[at].tolist())
                if key != group:
                    compare()
                    all_anchors()
                    if group is None or key[:2] != group[:2]:
                        ready = None
                    group = key
                if not key[2]:
                    anchors.append(batch.slice(at, to - at))
                    continue
                while at < to:
                    step = min(to - at, stream - sum(x.num_rows for x in held))
                    held.append(batch.slice(at, step))
                    at += step
                    if sum(x.num_rows for x in held) >= stream:
                        compare()
            if sum(len(x[0]) for x in out) > 50_000:
                yield flush()
        compare()
        all_anchors()
        if out:
            yield flush()

    return in_batches(dealt, run, "id long, n long, root long")


def _compare(one: tuple, two: tuple | None, links: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weights, data) with others, or with each other: of the rows that link, id, weight linked with, least id reached."""
    ids, weight, data = one
    other_ids, other_weight, other_data = two or one
    linked = links(data, other_data)
    if not two:
        np.fill_diagonal(linked, False)
    left, right = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked = linked[np.ix_(left, right)]
    a, b = ids[left], other_ids[right]
    n, m = linked @ other_weight[right], linked.T @ weight[left]
    top = np.iinfo(np.int64).max
    while len(left):
        new_a = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(axis=0))
        if not two:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    if not two:
        return ids[left], n, a
    return np.concatenate((ids[left], other_ids[right])), np.concatenate((n, m)), np.concatenate((a, b))
