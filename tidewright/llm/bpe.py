"""Byte-pair encoding on padded numpy matrices.

Words of one length bucket stand in one matrix of ids; a second matrix holds the rank of every adjacent pair.
Each round, every row that still has a pair in the table merges its leftmost pair of least rank: the pair's place
comes from argmin, the row is compacted by one column, and only the two pairs beside the new id are looked up
again, in an open-addressing hash table. Rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import KEPT, arrow_map, ragged, slices, texts

NONE = np.int32(2**31 - 1)
#: Words a worker remembers; beyond it the memory starts anew, results stay the same.
REMEMBERED = 350_000
#: Cells of one matrix of words.
CELLS = 1 << 20
#: Bytes of text that are encoded at once.
SLICE = 3_000_000
#: Rows longer than this are merged one by one, many pairs a round.
WIDE = 256


class PairTable:
    """(left id, right id) -> (rank, merged id), in an open-addressing hash table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        left_over, slot = np.arange(len(keys)), self._slot(keys)
        while len(left_over):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(slot), dtype=bool)
            take[first] = True
            take &= free
            put = left_over[take]
            self.keys[slot[take]], self.ranks[slot[take]], self.merged[slot[take]] = keys[put], rank[put], merged[put]
            left_over, slot = left_over[~take], (slot[~take] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids; NONE where there is no such pair, also for a negative id."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        ranks, merged = np.full(keys.shape, NONE, dtype=np.int32), np.zeros(keys.shape, dtype=np.int32)
        at = self.keys[slot]
        hit = at == keys
        ranks[hit], merged[hit] = self.ranks[slot[hit]], self.merged[slot[hit]]
        todo = np.flatnonzero(~hit & (at != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            ranks[todo[hit]], merged[todo[hit]] = self.ranks[slot[todo[hit]]], self.merged[slot[todo[hit]]]
            todo = todo[~hit & (at != np.uint64(2**64 - 1))]
        bad = (left < 0) | (right < 0)
        ranks[bad] = NONE
        return ranks, merged


def merge_rows(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges every row of a padded matrix (pad -1) to its end, a pair a round; the ids row after row, and the rows' lengths."""
    n, wide = ids.shape
    out, out_len, row = np.full((n, wide), -1, dtype=np.int32), np.zeros(n, dtype=np.int64), np.arange(n)
    ranks, made = (x.reshape(n, wide - 1) for x in pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
    while len(row):
        width = ids.shape[1]
        at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(row), dtype=np.int64)
        live = ranks[np.arange(len(row)), at] != NONE if width > 1 else np.zeros(len(row), dtype=bool)
        if not live.all():
            over = ~live
            out[row[over], :width], out_len[row[over]] = ids[over], lengths[over]
            row, ids, lengths, ranks, made, at = row[live], ids[live], lengths[live], ranks[live], made[live], at[live]
            if not len(row):
                break
        here, columns = np.arange(len(row)), np.arange(width)
        ids[here, at] = made[here, at]
        ids = ids[columns != at[:, None] + 1].reshape(len(row), width - 1)
        lengths = lengths - 1
        keep = columns[:-1] != at[:, None]
        ranks, made = ranks[keep].reshape(len(row), width - 2), made[keep].reshape(len(row), width - 2)
        for beside in (at - 1, at):
            ok = (beside >= 0) & (beside < width - 2)
            k, b = here[ok], beside[ok]
            ranks[k, b], made[k, b] = pairs.find(ids[k, b], ids[k, b + 1])
    return out[out >= 0], out_len


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One long row: each round merges, from the left, the pairs of least rank as long as no merge makes a pair of
    that rank or a lower one; so the result is that of one merge a round."""
    ranks, made = pairs.find(ids[:-1], ids[1:])
    while len(ids) > 1 and (least := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == least)
        if len(at) > 1 and (np.diff(at) == 1).any():  # overlapping pairs: every other one of each run
            run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
            first = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
        new = made[at]
        before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
        joined = np.concatenate(([False], at[1:] == at[:-1] + 2))
        before[joined] = new[np.flatnonzero(joined) - 1]
        after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        low = np.minimum(pairs.find(before, new)[0], pairs.find(new, after)[0]) <= least
        if low.any():
            at, new = at[: int(low.argmax()) + 1], new[: int(low.argmax()) + 1]
        ids[at] = new
        keep = np.ones(len(ids), dtype=bool)
        keep[at + 1] = False
        ids = ids[keep]
        if len(at) * 8 > len(ids):
            ranks, made = pairs.find(ids[:-1], ids[1:])
        else:
            keep = keep[1:]
            ranks, made = ranks[keep], made[keep]
            spot = at - np.arange(len(at))
            spot = np.unique(np.concatenate((spot - 1, spot)))
            spot = spot[(spot >= 0) & (spot < len(ids) - 1)]
            ranks[spot], made[spot] = pairs.find(ids[spot], ids[spot + 1])
    return ids


def merge_words(ids: np.ndarray, length: np.ndarray, pairs: PairTable) -> list[bytes]:
    """The words' first ids, one word after the other, merged to the end; each as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(length)
    start = np.cumsum(length) - length
    for i in np.flatnonzero(length > WIDE).tolist():
        out[i] = merge_long(ids[start[i] : start[i] + length[i]], pairs).astype("<u4").tobytes()
    low = 0
    for high in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, WIDE):
        own = np.flatnonzero((length > low) & (length <= high))
        low = high
        for part in np.array_split(own, max(1, -(-len(own) * high // CELLS))):
            if not len(part):
                continue
            sizes = length[part]
            rows = np.full((len(part), high), -1, dtype=np.int32)
            rows[np.arange(high) < sizes[:, None]] = ids[ragged(start[part], sizes)]
            flat, sizes = merge_rows(rows, sizes, pairs)
            data, ends = flat.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            for i, at, end in zip(part.tolist(), [0, *ends], ends, strict=False):
                out[i] = data[at:end]
    return out


class ByteEncoder:
    """A vocabulary of byte strings and their ranks: two neighbours merge if the vocabulary holds what they spell."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        words = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            words[rank] = token
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.start, self.spelt = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(words), dtype=np.uint8)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        found = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        self.pairs = PairTable(left, right, rank.astype(np.int32), rank.astype(np.int32))
        self.split = regex.compile(pattern).findall
        self.quick = re.compile(narrow(pattern)).findall
        self.memory: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.quick(text) if text.isascii() or _latin(text) else self.split(text)

    def encode(self, docs: list[str]) -> list[bytes]:
        """Every text's ids as little-endian unsigned 32-bit integers."""
        split = [self.pieces(x) for x in docs]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = list(set().union(*split).difference(self.memory))
        data = [p.encode() for p in new]
        length = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        self.memory.update(zip(new, merge_words(self.first[np.frombuffer(b"".join(data), dtype=np.uint8)], length, self.pairs), strict=True))
        know = self.memory.__getitem__
        return [b"".join(map(know, x)) for x in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids spell."""
        at = np.frombuffer(ids, dtype="<u4")
        return self.spelt[ragged(self.start[at], self.size[at])].tobytes()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def narrow(pattern: str) -> str:
    """The pattern for texts of code points under 256 in the syntax of re, its properties written out from that range."""
    import regex

    def members(prop: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(prop, chr(c)))

    for prop in (r"\p{L}", r"\p{N}", r"\s"):
        inside = members(prop)
        pattern = re.sub(r"\[\^?[^\]]*\]", lambda m, p=prop, i=inside: m[0].replace(p, i), pattern).replace(r"\S", f"[^{inside}]" if prop == r"\s" else r"\S")
        pattern = re.sub(r"(\[[^\]]*\])|" + re.escape(prop), lambda m, i=inside: m[1] or f"[{i}]", pattern)
    return pattern


class WordEncoder:
    """A tokenizers file of kind BPE with an end of word, such as word_bpe_49k.json: its normaliser and splitter, its merges.

    Texts are split as the library does by default: first at the file's added tokens, whose strings have one id, then into
    words. Each distinct word is merged once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.pairs = PairTable(*(np.array([vocab[f(x)] for x in pairs], dtype=np.int64) for f in (lambda x: x[0], lambda x: x[1])), np.arange(len(pairs), dtype=np.int32), np.array([vocab[x[0] + x[1]] for x in pairs], dtype=np.int32))
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.library = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(split).findall
        self.odd = newer_letters()
        self.quick = re.compile(narrow(split)).findall
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x[k] for x in spec["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that are found otherwise than as they stand")
        self.begin = os.path.commonprefix(list(added))
        self.added = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) or r"(?!)")
        self.fixed = {(x,): int(i).to_bytes(4, "little") for x, i in added.items()}  # no word is a tuple
        self.memory: dict[str | tuple, bytes] = dict(self.fixed)

    def words(self, text: str) -> list[str | tuple]:
        found = self.added.findall(text) if self.begin in text else ()
        if not found:
            return self.plain_words(text)
        first, *rest = (self.plain_words(x) for x in self.added.split(text))
        return first + [w for token, more in zip(found, rest, strict=True) for w in ((token,), *more)]

    def plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.quick(text.lower())
        if _latin(text):  # already composed, and lower case stays in the range or needs the long way
            low = text.lower()
            return self.quick(low) if _latin(low) else self.split(low)
        text = self.normal(text)
        if self.odd.search(text):  # the library's Unicode is older than regex's: it splits such texts itself
            letters = {c: b for b, c in enumerate(byte_letters())}
            return [bytes(letters[c] for c in piece).decode() for piece, _ in self.library(text)]
        return self.split(text)

    def encode(self, docs: list[str]) -> list[bytes]:
        split = [self.words(x) for x in docs]
        if len(self.memory) > REMEMBERED:
            self.memory = dict(self.fixed)
        new = list(set().union(*split).difference(self.memory))
        data = [p.encode() for p in new]
        length = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        flat, ends = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(length) - 1
        ids = self.first[flat]
        ids[ends] = self.last[flat[ends]]
        self.memory.update(zip(new, merge_words(ids, length, self.pairs), strict=True))
        know = self.memory.__getitem__
        return [b"".join(map(know, x)) for x in split]


def byte_letters() -> list[str]:
    """The printable letter of every byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=1)
def newer_letters():
    """Finds letters and numbers that regex knows and Python's own Unicode tables, as old as the library's, don't."""
    import unicodedata

    import regex

    known = regex.compile(r"[\p{L}\p{N}]")
    odd = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    return regex.compile("[" + "".join(f"\\U{c:08x}" for c in odd) + "]" if odd else r"(?!)")


@lru_cache(maxsize=2)
def _encoder(kind: type, *what: str):
    return kind(*what)


def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    KEPT["encoders"] = _encoder.cache_clear
    return _encoder(ByteEncoder, path, pattern)


def word_encoder(path: str) -> WordEncoder:
    KEPT["encoders"] = _encoder.cache_clear
    return _encoder(WordEncoder, path)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Byte-level BPE of every whole text, decoded again: id, n_tokens, ids_sha256, decoded_sha256, round_trip and, if asked, ids.

    A null text is empty: no tokens, and the digests of nothing. A null id stays null; repeated rows each give a row;
    a text without white space, however long, is one word and is merged whole. An empty table gives no rows. Other
    columns are neither read nor returned, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, pattern)
        for batch in slices(batches, text_col, SLICE):
            docs_ = texts(batch, text_col)
            ids = encoder.encode(docs_)
            back = [encoder.decode(x) for x in ids]
            columns = {
                id_col: batch.column(id_col),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                "round_trip": pa.array([x == y.encode() for x, y in zip(back, docs_, strict=True)], pa.bool_()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return arrow_map(docs, [id_col, text_col], schema, run, "encoders")


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that each array of ids spells: id, bytes. Null is empty; an id outside the vocabulary is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, pattern)
        for batch in batches:
            found = [encoder.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "bytes": pa.array(found, pa.binary())})

    kind = rows.schema[id_col].dataType.simpleString()
    return arrow_map(rows, [id_col, ids_col], f"{id_col} {kind}, bytes binary", run, "encoders")
