"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_map, in_batches, materialize, release
from tidewright.llm.graph import connected_components, link_blocks

#: Cells up to which one level is fitted; more are the leaves of about as many parents as each has leaves.
FLAT = 64
#: Cells of one length, at most: a model of so many centroids is sent to all workers (64 components: 32 MB).
MOST_CELLS = 1 << 16


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors, from a farthest-first start; the same vectors in order give the same cells."""
    k = max(1, min(k, len(vectors)))
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < k:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        new = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def cells_of(vectors: np.ndarray, centres: np.ndarray, reach: float, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): each vector's nearest cell, and as a guest those whose border with it is within reach; of them
    only those of lower number, or all."""
    near = vectors @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
    gap = near[np.arange(len(near)), home][:, None] - near
    number = np.arange(len(centres))
    guest = (gap <= reach * apart[home] + 1e-7) & ((number < home[:, None]) if lower else (number != home[:, None]))  # of nearly equal centres apart is only exact to 1e-8
    rows, cells = np.nonzero(guest)
    return np.concatenate((np.arange(len(near)), rows)), np.concatenate((home, cells)), np.concatenate((np.ones(len(near), dtype=bool), np.zeros(len(rows), dtype=bool)))


@dataclass(frozen=True)
class Cells:
    """Centroids of parents, and of the leaves of some of them; each leaf, and each parent without, has a number."""

    parents: np.ndarray
    leaves: dict[int, np.ndarray]

    @property
    def first(self) -> np.ndarray:
        """The number of each parent's first leaf."""
        sizes = [len(self.leaves[p]) if p in self.leaves else 1 for p in range(len(self.parents))]
        return np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def deal(self, vectors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of every vector in the cells that it visits. Of two vectors within reach of each other the
        one at home in the parent of higher number visits the other's parent; there it visits the leaf that is nearest
        and all whose border with that leaf is within reach, the other's among them. Of two at home in one parent
        the one in the leaf of higher number visits the other's leaf. So every such pair meets in one cell, once."""
        row, parent, home = cells_of(vectors, self.parents, reach)
        first, out = self.first, []
        for p in np.unique(parent).tolist():
            for own in (True, False):
                some = row[(parent == p) & (home == own)]
                if not len(some):
                    continue
                if p not in self.leaves:
                    out.append((some, np.full(len(some), first[p]), np.full(len(some), own)))
                    continue
                at, leaf, nearest = cells_of(vectors[some], self.leaves[p], reach, lower=own)
                out.append((some[at], first[p] + leaf, nearest & own))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, sample: int = 20_000, cell_rows: int = 4096) -> DataFrame:
    """A row for each id: id, n_links, component_id, kept (whether it is its component's least id); as a table.

    Linked are vectors of one length with a cosine, in double precision, of at least the threshold. Null, zero and
    empty vectors and those with a null or non-finite component link with nothing and are kept. Equal vectors are one
    class, compared once and counted each. Rows that repeat an id are one vector, the one of least digest; rows
    without an id are left out. An empty table gives no rows. Other columns are neither read nor returned.

    There is a cell for every cell_rows vectors of a length, up to MOST_CELLS. Over FLAT cells have two levels: the parents'
    centroids are fitted on about `sample` vectors, drawn by a hash of the digest, and those of each parent's leaves,
    beside each other on the executors, on as many of its vectors. Every vector is assigned. A vector is also compared in
    the cells whose border is within sqrt(1 - threshold^2): a border is a plane through 0, and a unit vector further from
    it has no unit vector of that cosine beyond it. So no pair is missed, however the vectors are spread; of evenly
    spread ones most meet in some cell, and comparisons come near to those of all pairs, a vector being sent to one task
    for every 2 * cell_rows vectors. Of those in fewer dimensions or in groups, it visits a few cells, however many there are.
    """

    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    stored = np.float32 if single else np.float64

    def unit_rows(data: list[bytes]) -> np.ndarray:
        found = np.array([np.frombuffer(x, dtype=stored) for x in data], dtype=np.float64)
        found /= np.abs(found).max(axis=1)[:, None]
        return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]

    def read_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(stored)  # null is NaN
            upto = lambda x: np.concatenate(([0], np.cumsum(x)))[at]
            fine = (np.diff(upto(~np.isfinite(flat))) == 0) & (np.diff(upto(flat != 0)) > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            data = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(at.tolist(), at[1:].tolist(), fine.tolist(), strict=False)]
            digest = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "digest": pa.array(digest, pa.binary()), "size": pa.array(np.where(fine, np.diff(at), 0), pa.int32()), "data": pa.array(data, pa.binary())})

    own = vectors.where(F.col(id_col).isNotNull())
    read = materialize(arrow_map(own, [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")], "id long, digest binary, size int, data binary", read_vectors), "vectors")
    total = read.count()
    ids = materialize(read.groupBy("id").agg(F.min("digest").alias("digest")), "ids", total)
    classes = ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    reps = materialize(classes.join(read.select("digest", "id", "size", "data").dropDuplicates(["id", "digest"]), "digest").where("id = rep").select("digest", "rep", "weight", "size", "data"), "classes", total)
    release(read)
    reach = math.sqrt(1 - threshold**2) if threshold > 0 else 1.0
    space = 1 << 30
    key = F.pmod(F.xxhash64("digest"), F.lit(space))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for length in np.unique(size).tolist():
                yield length, batch.filter(pa.array(size == length))

    def dealt_cells(models: dict[int, Cells], part: pa.RecordBatch, length: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        model = models.get(length)
        if model is None:
            row, cell, home = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=np.int64), np.ones(part.num_rows, dtype=bool)
        else:
            row, cell, home = model.deal(unit_rows(part.column("data").to_pylist()), reach)
        return row, (length << 20) + cell, home.astype(bool)

    def fit() -> dict[int, Cells]:
        """Models of the lengths that need several cells; of others all vectors are one cell."""
        counts = {r["size"]: r["n"] for r in reps.groupBy("size").agg(F.count("*").alias("n")).where(f"n > {cell_rows}").collect()}
        if not counts:
            return {}
        share = min(space, -(-space * sample // sum(counts.values())))
        drawn = reps.where(F.col("size").isin(*counts) & (key < share)).select("digest", "size", "data").collect()
        drawn.sort(key=lambda r: bytes(r["digest"]))
        models, wanted = {}, {}
        for size, n in counts.items():
            some = [bytes(r["data"]) for r in drawn if r["size"] == size]
            cells = min(MOST_CELLS, -(-n // cell_rows))
            if some:
                models[size] = Cells(spherical_kmeans(unit_rows(some), cells if cells <= FLAT else math.isqrt(cells - 1) + 1), {})
                wanted[size] = n / cells if cells > FLAT else None  # rows of a leaf
        if any(wanted.values()):
            leaves = fit_leaves({k: m for k, m in models.items() if wanted[k]}, wanted)
            models = {k: Cells(m.parents, leaves.get(k, {})) for k, m in models.items()}
        return models

    def fit_leaves(models: dict[int, Cells], wanted: dict[int, float]) -> dict[int, dict[int, np.ndarray]]:
        parents = materialize(arrow_map(reps.where(F.col("size").isin(*models)), ["digest", "size", "data"], "parent long, digest binary, data binary", lambda batches: at_home(batches, models)), "parents")
        numbers = {r["parent"]: r["n"] for r in parents.groupBy("parent").agg(F.count("*").alias("n")).collect()}  # a row for each parent
        shares = F.create_map(*[F.lit(x) for p, n in numbers.items() for x in (p, min(space, -(-space * sample // n)))])
        some = parents.where(key < F.element_at(shares, F.col("parent"))).repartition("parent").sortWithinPartitions("parent", "digest")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def centres() -> pa.RecordBatch:
                found = spherical_kmeans(unit_rows(held), max(1, math.ceil(numbers[now] / wanted[now >> 20])))
                held.clear()
                return pa.RecordBatch.from_pydict({"parent": pa.array([now] * len(found)), "leaf": pa.array(np.arange(len(found))), "centre": pa.array([x.tobytes() for x in found], pa.binary())})

            for batch in batches:
                for p, data in zip(batch.column("parent").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if held and p != now:
                        yield centres()
                    now = p
                    held.append(data)
            if held:
                yield centres()

        found: dict[int, dict[int, np.ndarray]] = {}
        made = in_batches(some, run, "parent long, leaf long, centre binary").orderBy("parent", "leaf").collect()  # MOST_CELLS rows at most, or nearly
        release(parents)
        for p in dict.fromkeys(r["parent"] for r in made):
            found.setdefault(p >> 20, {})[p & ((1 << 20) - 1)] = np.array([np.frombuffer(r["centre"]) for r in made if r["parent"] == p])
        return found

    def at_home(batches: Iterator[pa.RecordBatch], models: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
        for length, part in lengths(batches):
            row, cell, home = dealt_cells(models, part, length, -1.0)
            yield pa.RecordBatch.from_pydict({"parent": pa.array(cell[home]), "digest": part.column("digest").take(pa.array(row[home])), "data": part.column("data").take(pa.array(row[home]))})

    shared = vectors.sparkSession.sparkContext.broadcast(fit())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, part in lengths(batches):
            _, cell, home = dealt_cells(shared.value, part, length, -1.0)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell[home])})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, part in lengths(batches):
            row, cell, home = dealt_cells(shared.value, part, length, reach)
            for at in range(0, len(row), 20_000):
                take = pa.array(row[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 20_000]), *(part.column(c).take(take) for c in ("rep", "weight", "data")), pa.array(home[at : at + 20_000])], names=["cell", "id", "weight", "data", "home"])

    sizes = materialize(arrow_map(reps, ["size", "data"], "cell long", count).groupBy("cell").agg(F.count("*").alias("homes")), "sizes")
    dealt = arrow_map(reps, ["rep", "weight", "size", "data"], "cell long, id long, weight long, data binary, home boolean", assign).join(sizes, "cell")
    found = materialize(link_blocks(dealt, "homes", unit_rows, lambda one, two: one @ two.T >= threshold, cell_rows), "links")
    linked = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = reps.select("digest", "rep", "weight").join(linked, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = ids.join(per_class, "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
    out = materialize(out, "linked", total)
    release(ids, reps, sizes, found, groups)
    return out
