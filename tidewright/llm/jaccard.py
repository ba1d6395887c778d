"""Similarity join of documents on word n-grams: MinHash LSH forest, then exact Jaccard similarity.

Every text becomes its set of hashed shingles (n words each); texts with one set are one class, compared once. The
forest has `trees` prefix tries, each over `depth` MinHash values of its own and kept as the sorted list of its signatures:
a node is a run of rows with one prefix. Matching begins with whole signatures. How alike their pairs are tells how many
links each shorter prefix would find, and prefixes are shortened, a value at a time, until the recall so estimated reaches
the target. Classes that share a prefix of that length, and whose sketches agree, fall into one component of candidates,
within which every pair is verified by exact set intersection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import IdFilter, arrow_map, in_batches, materialize, mix64, ragged, release, slices, texts
from tidewright.llm.graph import connected_components, link_blocks

#: An odd base of the polynomial hash, and random values of the bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


#: MinHash values of each tree that make a sketch.
SKETCHED = 4
#: Trees whose whole signatures are matched for the estimate.
PROBED = 8
#: Rows of a node that are compared with each other; those of larger ones are candidates of each other as they are.
NODE = 512


@dataclass(frozen=True)
class Forest:
    """words: in a shingle. threshold: least Jaccard similarity of a link. depth, shortest: most and fewest MinHash values of
    a prefix. recall: share of all links to be found. doubt: so many links right at the threshold are assumed besides
    those seen. plausible: least share of a sketch on which candidates agree, far enough below the threshold that
    a link's sketch never falls short (by 5 deviations for 128 values and 0.8)."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 32
    depth: int = 12
    shortest: int = 5
    recall: float = 0.99999
    doubt: float = 3.0
    plausible: float = 0.6

    def found(self, similarity: np.ndarray, depth: int) -> np.ndarray:
        """With which probability some tree matches, to a depth, two sets of that similarity."""
        return 1 - (1 - similarity**depth) ** self.trees

    def prefix(self, seen: np.ndarray) -> int:
        """The longest prefix with the target recall. seen[k]: of how many pairs with one whole signature in one of PROBED
        trees k values of the sketches agree. A pair of similarity s is seen PROBED * s^depth times on average, so
        the number of links at s is that of pairs seen over this, seen or not."""
        share = np.arange(len(seen)) / max(1, len(seen) - 1)
        similarity = np.clip((share - 1 / 256) / (1 - 1 / 256), 0, 1)  # unequal values have one byte by chance
        links = similarity >= self.threshold
        number = np.append(seen[links] / (PROBED * similarity[links] ** self.depth), self.doubt)
        similarity = np.append(similarity[links], self.threshold)
        for depth in range(self.depth, self.shortest, -1):
            if number @ self.found(similarity, depth) >= self.recall * number.sum():
                return depth
        return self.shortest


class Powers:
    """Powers of BASE and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = np.uint64(pow(int(BASE), len(self.up), 2**64))
            back = np.uint64(pow(int(BASE), -len(self.down), 2**64))
            self.up, self.down = np.concatenate((self.up, self.up * k)), np.concatenate((self.down, self.down * back))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def shingles(docs: list[str], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes: runs of `words` lower-case words, split at ASCII white
    space; a text with fewer words is one shingle, one without words has none."""
    flat = [b" ".join(x.lower().encode().split()) for x in docs]
    data = np.frombuffer(b" ".join([*flat, b""]), dtype=np.uint8)
    size = np.array([len(x) for x in flat], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    up, down = POWERS.upto(len(data) + 1)
    summed = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[data] * up[: len(data)], dtype=np.uint64)))
    gaps = np.flatnonzero(data == 32)  # the end of every word; an empty text's gap ends no word
    starts = np.concatenate(([0], gaps[:-1] + 1)) if len(gaps) else gaps
    real = gaps > starts
    starts, ends = starts[real], gaps[real]
    of = np.searchsorted(begin, starts, "right") - 1  # of several texts that begin there, only the last has words
    count = np.bincount(of, minlength=len(docs))
    first = np.cumsum(count) - count
    runs = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    at = ragged(first, runs)
    last = np.minimum(at + words - 1, np.repeat(first + count - 1, runs))
    hashes = mix64((summed[ends[last]] - summed[starts[at]]) * down[starts[at]])
    return [np.unique(x) for x in np.split(hashes, np.cumsum(runs)[:-1])] if len(docs) else []


def minhash(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """The last byte of every MinHash value: an array (sets, trees, depth); of an empty set 255."""
    seeds = mix64(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    odd, salt = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), mix64(seeds).astype(np.uint32)
    least = np.full((len(sets), trees * depth), np.uint32(2**32 - 1))
    some = np.empty((256, trees * depth), dtype=np.uint32)
    for i, own in enumerate(sets):
        own = (own >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(own), 256):
            part = own[at : at + 256, None]
            made = np.bitwise_xor(part, salt, out=some[: len(part)])
            np.multiply(made, odd, out=made)
            np.minimum(least[i], made.min(axis=0), out=least[i])
    return least.astype(np.uint8).reshape(len(sets), trees, depth)


def prefix_keys(values: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key of the first `depth` values of every tree: an array (rows, trees)."""
    rows, trees, _ = values.shape
    key = np.broadcast_to(mix64(np.arange(1, trees + 1, dtype=np.uint64)), (rows, trees)).copy()
    for at in range(0, depth, 8):
        word = np.zeros((rows, trees), dtype=np.uint64)
        for k in range(at, min(at + 8, depth)):
            word = (word << np.uint64(8)) | values[:, :, k]
        key = mix64(key ^ word) + np.uint64(0x9E3779B97F4A7C15)
    return key


def _signatures(docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """id, own (a hash of the text), digest (of its set; null if that is empty), forest (its MinHash values)."""
    trees, depth, words = forest.trees, forest.depth, forest.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = shingles(texts(batch, "text"), words)
            values = minhash(sets, trees, depth)
            none = np.array([not len(x) for x in sets])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "own": batch.column("own"),
                    "digest": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary(), mask=none),
                    "forest": pa.array([x.tobytes() for x in values], pa.binary()),
                }
            )

    text = F.col(text_col)
    return arrow_map(docs, [F.col(id_col).cast("long").alias("id"), text_hash(text).alias("own"), text.alias("text")], "id long, own long, digest binary, forest binary", run)


def text_hash(text: Column) -> Column:
    """Of several rows with one id, the one whose text has the least counts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _nodes(reps: DataFrame, forest: Forest, depth: int, trees: int) -> DataFrame:
    """key, rep, sketch, first: the classes in nodes at a depth with other classes, as a table; first is the node's least
    class if it has more than NODE, else null."""
    shape = (forest.trees, forest.depth)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        values = np.frombuffer(b"".join(batch.column("forest").to_pylist()), dtype=np.uint8).reshape(-1, *shape)
        return values, prefix_keys(values[:, :trees], depth)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, key = read(batch)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64).ravel()), "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), trees))})

    nodes = arrow_map(reps, ["rep", "forest"], "key long, rep long", keys).groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n"))
    # One row in ten at most is taken to be left of the keys; where more are, the tasks are longer.
    nodes = materialize(nodes.where("first < last").select("key", "first", "n"), "nodes", reps.count() * trees // 10)
    shared = IdFilter(nodes.select("key"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, key = read(batch)
                row, tree = np.nonzero(shared.has(key.view(np.int64)))
                sketch = np.ascontiguousarray(values[:, :, :SKETCHED]).reshape(len(values), -1)
                for at in range(0, len(row), 20_000):
                    some = row[at : at + 20_000]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key[some, tree[at : at + 20_000]].view(np.int64)), "rep": batch.column("rep").take(pa.array(some)), "sketch": pa.array([x.tobytes() for x in sketch[some]], pa.binary())})

    found = arrow_map(reps, ["rep", "forest"], "key long, rep long, sketch binary", members)
    large = nodes.where(F.col("n") > NODE).select("key", "first")
    out = materialize(found.join(large, "key", "left").select("key", "rep", "first", F.when(F.col("first").isNull(), F.col("sketch")).alias("sketch")), "nodes")
    release(nodes)
    return out


@lru_cache(maxsize=64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _compared(batches: Iterator[pa.RecordBatch], most: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by key: (reps, left, right, agreements) of some nodes at a time, and of all pairs within each."""
    held = None

    def pairs(rows: pa.RecordBatch, last: bool) -> Iterator:
        key = rows.column("key").to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        ends = np.append(cuts, len(key))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        size = ends - starts
        starts, size = starts[size > 1], size[size > 1]
        reps, sketch = rows.column("rep").to_numpy(), rows.column("sketch")
        total = np.cumsum(size * (size - 1) // 2)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            own, parts = size[at:to], []
            for n in np.unique(own).tolist():
                a, b = _pairs(n)
                base = starts[at:to][own == n][:, None]
                parts.append(((base + a).ravel(), (base + b).ravel()))
            left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
            low, high = int(starts[at]), int(starts[to - 1] + size[to - 1])
            values = np.frombuffer(b"".join(sketch.slice(low, high - low).to_pylist()), dtype=np.uint8).reshape(high - low, -1)
            left, right = left - low, right - low
            yield reps[low:high], left, right, (values[left] == values[right]).sum(axis=1)
            at = to

    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        yield from pairs(held, False)
        key = held.column("key").to_numpy()
        held = held.slice(int(np.searchsorted(key, key[-1])))
    if held is not None:
        yield from pairs(held, True)


def _small(nodes: DataFrame) -> DataFrame:
    return nodes.where("first IS NULL").select("key", "rep", "sketch").repartition("key").sortWithinPartitions("key", "rep")


def likeness(nodes: DataFrame, values: int) -> np.ndarray:
    """How many pairs of a node agree in 0, 1, ... values of their sketches; nodes of more than NODE classes don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(values + 1, dtype=np.int64)
        for _, _, _, same in _compared(batches):
            seen += np.bincount(same, minlength=values + 1)
        yield pa.RecordBatch.from_pydict({"same": pa.array(np.arange(values + 1)), "n": pa.array(seen)})

    found = in_batches(_small(nodes), run, "same long, n long").groupBy("same").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(values + 1)
    for r in found:
        seen[r["same"]] = r["n"]
    return seen


def plausible_edges(nodes: DataFrame, least: int) -> DataFrame:
    """a, b: edges that connect the classes of a node as far as a chain of them agrees in `least` values of their sketches;
    in nodes of more than NODE classes an edge to the first from every other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, left, right, same in _compared(batches):
            left, right = left[same >= least], right[same >= least]
            root = reps.copy()
            while len(left):
                low = np.minimum(root[left], root[right])
                if (low == root[left]).all() and (low == root[right]).all():
                    break
                np.minimum.at(root, left, low)
                np.minimum.at(root, right, low)
            some = np.unique(np.stack([reps[root < reps], root[root < reps]], axis=1), axis=0)
            if len(some):
                yield pa.RecordBatch.from_pydict({"a": pa.array(some[:, 0]), "b": pa.array(some[:, 1])})

    return in_batches(_small(nodes), run, "a long, b long").unionByName(nodes.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))


def candidate_edges(reps: DataFrame, forest: Forest) -> DataFrame:
    """(a, b) as a table: edges between the classes (rep, forest) that may be linked. Whole signatures are matched first;
    how alike those pairs are tells how far prefixes must be shortened."""
    values = forest.trees * min(SKETCHED, forest.depth)
    whole = _nodes(reps, forest, forest.depth, min(PROBED, forest.trees))
    depth = forest.prefix(likeness(whole, values))
    release(whole)
    nodes = _nodes(reps, forest, depth, forest.trees)
    edges = materialize(plausible_edges(nodes, int(forest.plausible * values)).distinct(), "candidate-edges", nodes.count())
    release(nodes)
    edges._depth = depth
    return edges


def sets_of(data: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in data]


def similar_sets(one: list[np.ndarray], two: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of sorted hashes have at least that Jaccard similarity: exact, by intersection counts."""
    size = [np.array([len(x) for x in sets], dtype=np.int64) for sets in (one, two)]
    shared = np.zeros((len(one), len(two)))
    if len(one) * len(two) <= 64:
        for i, a in enumerate(one):
            for j, b in enumerate(two):
                shared[i, j] = len(np.intersect1d(a, b, assume_unique=True))
    else:
        sets = one if one is two else one + two
        owner = np.repeat(np.arange(len(sets)), size[0] if one is two else np.concatenate(size))
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
        column = np.cumsum(fresh) - 1
        often = np.bincount(column) > 1  # others meet no second set
        keep = often[column]
        column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
        total, step = int(often.sum()), 8192
        cuts = np.searchsorted(column, np.arange(0, total + step, step))
        for k, (at, to) in enumerate(zip(cuts, cuts[1:], strict=False)):
            some = np.zeros((len(sets), step), dtype=np.float32)
            some[owner[at:to], column[at:to] - k * step] = 1
            shared += some[: len(one)] @ some[0 if one is two else len(one) :].T
    union = size[0][:, None] + size[1][None, :] - shared
    return shared / np.maximum(union, 1) >= threshold


def join_similar(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each id: id, class_id, n_links, n_copies, rep_id, is_representative; as a table.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least the threshold. n_links counts
    the other documents linked directly, copies included; n_copies the documents with the very same set, itself
    included, rep_id their least id; class_id is the least id reached by links, is_representative if that is its own.
    Null, empty and wordless texts have no shingles: linked with nothing, a class of their own. Fewer words than a
    shingle are one shingle. Rows that repeat an id are one document, with the text of least text_hash(); rows without an
    id are left out. An empty table gives no rows. Other columns are neither read nor returned.

    A class of copies costs one comparison. Of different texts every link is counted: a component of c different
    candidates takes c^2 / 2 comparisons, dealt out as blocks, and no pair becomes a row.
    """
    forest = forest or Forest()
    own = docs.where(F.col(id_col).isNotNull())
    signed = materialize(_signatures(own, forest, id_col, text_col), "signatures")
    total = signed.count()
    ids = materialize(signed.groupBy("id").agg(F.min(F.struct("own", "digest")).alias("least"), F.count("*").alias("n")).select("id", "least.own", "least.digest", "n"), "ids", total)
    classes = materialize(ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes", total)
    reps = signed.join(classes, (signed["digest"] == classes["digest"]) & (signed["id"] == classes["rep"])).select("rep", "forest")
    repeats = ids.where("n > 1").limit(1).count() > 0
    reps = materialize(reps.dropDuplicates(["rep"]) if repeats else reps, "representatives", 5 * total)  # rows of 400 bytes: a fifth as many for each task
    release(signed)
    edges = candidate_edges(reps, forest)
    release(reps)
    near = connected_components(edges)
    candidates = materialize(near.join(classes.select(F.col("rep").alias("node"), "copies", "digest"), "node"), "candidates", total)
    release(edges, near)
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = [x.tobytes() for x in shingles(texts(batch, "text"), words)]
            same = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in sets], pa.binary())
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "id", "weight", "size")), pa.array([True] * len(sets)), pa.array(sets, pa.binary())], names=["cell", "id", "weight", "size", "home", "data"])
            yield made.filter(pa.compute.equal(same, batch.column("digest")))

    words, threshold = forest.words, forest.threshold
    texts_ = own.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    texts_ = IdFilter(candidates.select("node")).keep(texts_, "node").hint("merge")
    loaded = candidates.join(sizes, "component").join(texts_, "node").select(F.col("component").alias("cell"), F.col("node").alias("id"), F.col("copies").alias("weight"), "size", "digest", "text")
    loaded = in_batches(loaded, load, "cell long, id long, weight long, size long, home boolean, data binary")
    if repeats:
        loaded = loaded.dropDuplicates(["id"])
    found = materialize(link_blocks(loaded, "size", sets_of, lambda one, two: similar_sets(one, two, threshold)), "links")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(linked, classes["rep"] == linked["id"], "left").drop("id").join(groups, F.col("rep") == groups["node"], "left")
    per_class = per_class.select("digest", "rep", "copies", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ids.drop("n").join(per_class, "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("rep", "id").alias("rep_id"),
        (F.coalesce("class_id", "id") == F.col("id")).alias("is_representative"),
    )
    out = materialize(out, "joined", total)
    release(ids, classes, candidates, found, groups)
    return out
