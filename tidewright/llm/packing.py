"""Packing into windows of fixed size, online, by the sum of squares.

counts[h] is the number of open windows filled to level h. A piece goes to the level (or a new window) that makes the
sum of counts[h] squared least. Every task packs the documents it reads, with its own level array, and at its end
cuts pieces of the emptiest windows to fill the fullest, so that at most one window of a task is not full. Memory is
bounded by one open window for each level and the sort of sequences handed out, never by the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewright.llm.bpe import SLICE, word_encoder
from tidewright.llm.common import arrow_map, slices, texts

Piece = tuple  # (document id, start, ids, tokens of the document)


class Packer:
    """Hands out full windows as lists of pieces; close() hands out the rest."""

    def __init__(self, size: int = 2048):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)  # of open windows by level; none at 0 and at size
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def place(self, length: int) -> int:
        """The level of the window that a piece of this length goes to; 0 is a new one.

        From level h the sum of squares changes by 1 - 2 counts[h], and by 1 + 2 counts[h + length] unless that is full.
        Ties go to the highest level, which leaves the least room.
        """
        levels = np.arange(self.size - length, -1, -1)
        change = 1 - 2 * self.counts[levels] + 1 + 2 * self.counts[levels + length]
        change[0] -= 1
        change[-1] -= 1
        change[:-1][self.counts[levels[:-1]] == 0] = np.iinfo(np.int64).max
        return int(levels[int(change.argmin())])

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Whole windows of a document leave at once, its remainder is placed."""
        total = len(ids)
        whole = total - total % self.size
        for at in range(0, whole, self.size):
            yield [(doc, at, ids[at : at + self.size], total)]
        if whole < total:
            yield from self._put((doc, whole, ids[whole:].copy(), total))

    def _put(self, piece: Piece) -> Iterator[list[Piece]]:
        level = self.place(len(piece[2]))
        window = []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        window.append(piece)
        level += len(piece[2])
        if level == self.size:
            yield window
        else:
            self.open[level].append(window)
            self.counts[level] += 1

    def close(self) -> Iterator[list[Piece]]:
        """Fills the fullest windows with pieces of the emptiest, cut where need be; the last may stay short."""
        rest = [w for level in sorted(self.open) for w in self.open[level]]
        spare: list[Piece] = []
        while rest:
            window = rest.pop()
            room = self.size - sum(len(p[2]) for p in window)
            while room and (spare or rest):
                if not spare:
                    spare = rest.pop(0)
                doc, start, ids, total = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start, ids[:-room], total))
                    doc, start, ids = doc, start + len(ids) - room, ids[-room:]
                window.append((doc, start, ids, total))
                room -= len(ids)
            yield window
        if spare:
            yield spare
        self.open.clear()
        self.counts[:] = 0


def pack_texts(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int | None = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    encode: makes, in the worker, the function from texts to ids (little-endian unsigned 32-bit). A document's ids are
    those and end_id; a null text is empty and has end_id alone. Each id lies in one piece; offsets in a sequence have
    no gap. sequence_id is the task's number times 2^40 plus a count, so it is unique and takes no second pass; sequences
    are as many as needed to hold the tokens, plus at most one short one for each task. Rows are packed in the order
    read: of a table scan that is fixed; after a shuffle, sort within partitions first. Repeated rows are packed
    each. Texts of any length are cut at every window. An empty table gives no rows. Other columns are neither read nor
    returned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_id = docs.select(id_col).schema
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encode(), Packer(size)
        task = TaskContext.get().partitionId() << 40
        ending = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        made, rows, held = 0, [], 0

        def windows() -> Iterator[list[Piece]]:
            for batch in slices(batches, text_col, SLICE):
                for doc, ids in zip(batch.column(id_col).to_pylist(), encoder(texts(batch, text_col)), strict=True):
                    yield from packer.add(doc, np.frombuffer(ids + ending, dtype="<u4"))
            yield from packer.close()

        def batch_of(rows: list) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            length = np.array([len(x) for x in ids], dtype=np.int64)
            columns = {id_col: pa.array(doc, to_arrow), "start": pa.array(start, pa.int64()), "length": pa.array(length)}
            columns |= {"ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), "doc_tokens": pa.array(total, pa.int64())}
            columns |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_pydict(columns)

        from pyspark.sql.pandas.types import to_arrow_type

        to_arrow = to_arrow_type(arrow_id[id_col].dataType)
        for window in windows():
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, ids, total, task + made, offset))
                offset += len(ids)
            held += offset
            made += 1
            if held > 1 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return arrow_map(docs, [id_col, text_col], schema, run, "encoders")


def pack_words(docs: DataFrame, path: str, **settings) -> DataFrame:
    """pack_texts() with the tokenizers file at path, such as word_bpe_49k.json."""
    return pack_texts(docs, lambda: word_encoder(path).encode, **settings)
