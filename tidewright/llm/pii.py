"""Personal data: patterns, and terms that reveal it by co-occurrence.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Every value found is a protected entity. Over the
corpus, a term (a word near an entity) reveals an entity as far as its pointwise mutual information with the entity
reaches the entity's own information content: log2(P(e|t) / P(e)) / -log2 P(e), 1 if the term never comes without the
entity. Terms over one threshold are generalised in every text, those over a higher one are removed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_map, in_batches, materialize, release, slices, texts

# The patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# End of fixed values.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"\w+")

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Disclosure:
    """near: words on each side of an entity that count as its context. contexts: different contexts in which a term
    must stand with an entity, so that copies of one passage prove nothing. generalise, remove: shares of the entity's
    information. broadcast_bytes: up to here the terms found are sent to all workers, beyond it they are joined."""

    near: int = 8
    contexts: int = 4
    generalise: float = 0.9
    remove: float = 0.98
    broadcast_bytes: int = 32 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ in turn: the longest local part that begins after the last match, and the domain."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            after = domain.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """The value an entity is known by: lower case, for numbers the digits alone."""
    return f"{kind}:{NOT_DIGIT.sub('', value) if kind in ('card', 'phone') else value.lower()}"


def outside(words: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """The words, in order, that no span overlaps; spans by start."""
    taken: list[list[int]] = []
    for _, a, b in spans:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    k, free = 0, []
    for a, b in words:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or b <= taken[k][0]:
            free.append((a, b))
    return free


def contexts(text: str, spans: list[Span], near: int) -> Iterator[tuple[str, list[str]]]:
    """Each base span's entity and the lower-case words around it, up to `near` on each side; words that a span overlaps
    are left out."""
    words = outside([m.span() for m in WORD.finditer(text)], spans) if spans else []
    starts = [a for a, _ in words]
    for kind, a, b in spans:
        at = bisect_left(starts, a)
        yield entity(kind, text[a:b]), [text[x:y].lower() for x, y in words[max(0, at - near) : at + near]]


def words_of(text: str) -> set[str]:
    """The text's different words, cut as in contexts() and term_spans() and then in lower case."""
    return {w.lower() for w in {*WORD.findall(text)}}


def term_spans(text: str, terms: dict[str, str], spans: list[Span]) -> list[Span]:
    """Where the terms stand in the text, words that a base span overlaps left out."""
    if terms.keys().isdisjoint(words_of(text)):
        return []
    return [("term", a, b) for a, b in outside([m.span() for m in WORD.finditer(text) if m[0].lower() in terms], spans)]


def sanitise(text: str, spans: list[Span], terms: dict[str, str]) -> str:
    """Base spans become their kind in brackets; a term's class (a number or a word) or nothing; overlaps are one span,
    named by its first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        word = text[a:b]
        shown = f"[{kind.upper()}]" if kind != "term" else "" if terms[word.lower()] == "remove" else "[NUMBER]" if word.isdigit() else "[WORD]"
        out += [text[at:a], shown]
        at = b
    return "".join([*out, text[at:]])


def revealing_terms(docs: DataFrame, text_col: str = "text", rule: Disclosure | None = None) -> DataFrame:
    """A table of term, action (generalise or remove), ratio: the terms whose disclosure of some entity exceeds a threshold.

    P(e|t) is the number of texts with t near e over the number of texts with t; P(e) that of texts with e over the
    number of texts. All these are numbers of different texts, so that copies count neither above nor below.
    """
    rule = rule or Disclosure()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            key, place, own, word = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_pydict({"entity": pa.array(key, pa.binary()), "place": pa.array(place, pa.binary()), "doc": pa.array(own, pa.binary()), "term": pa.array(word, pa.string())})

        for batch in slices(batches, "text"):
            for text in texts(batch, "text"):
                spans = base_spans(text)
                own = hashlib.blake2b(text.encode(), digest_size=16).digest() if spans else b""
                for who, words in contexts(text, spans, rule.near):
                    place = hashlib.blake2b("\0".join(words).encode(), digest_size=16).digest()
                    key = hashlib.blake2b(who.encode(), digest_size=16).digest()
                    rows += [(key, place, own, w) for w in {*words, ""}]
                    if len(rows) > 20_000:
                        yield made()
        if rows:
            yield made()

    only = docs.select(F.col(text_col).alias("text"))
    seen = arrow_map(only, ["text"], "entity binary, place binary, doc binary, term string", near).distinct()
    pairs = seen.groupBy("entity", "term").agg(F.count_distinct("place").alias("places"), F.count_distinct("doc").alias("n"))
    pairs = materialize(pairs.where(f"places >= {rule.contexts}").drop("places"), "cooccurrence")
    entities = pairs.where("term = ''").select("entity", F.col("n").alias("n_entity"))
    together = pairs.where("term <> ''")
    terms = materialize(together.select("term").distinct(), "candidates")
    copied = _copied(only.where("text IS NOT NULL"))
    with_text = _different(only.where("text IS NOT NULL"), copied)
    often = _text_counts(with_text, terms, rule)
    total = with_text.count()
    ratio = F.log2(F.least(F.lit(1.0), F.col("n") / F.col("n_text")) * total / F.col("n_entity")) / F.log2(total / F.col("n_entity"))
    found = together.join(entities, "entity").join(often, "term").where(F.col("n_entity") < total).select("term", ratio.alias("ratio"))
    found = found.groupBy("term").agg(F.max("ratio").alias("ratio")).where(f"ratio >= {rule.generalise}")
    found = materialize(found.select("term", F.when(F.col("ratio") >= rule.remove, "remove").otherwise("generalise").alias("action"), "ratio"), "terms")
    release(pairs, terms, copied)
    return found


def _copied(texts_: DataFrame) -> DataFrame:
    """The hashes that several rows' texts have, as a table."""
    return materialize(texts_.select(F.xxhash64("text").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copied")


def _different(texts_: DataFrame, copied: DataFrame) -> DataFrame:
    """Each text once. Only the texts whose hash comes more than once are shuffled, as long as Spark can broadcast
    their hashes."""
    keyed = texts_.select("text", F.xxhash64("text").alias("key"))
    single = keyed.join(copied, "key", "left_anti").select("text")
    return single.unionAll(keyed.join(copied, "key", "left_semi").select("text").distinct())


def _bytes(terms: DataFrame) -> int:
    return terms.agg(F.sum(F.octet_length("term") + 64).alias("n")).first()["n"] or 0


def _text_counts(texts_: DataFrame, terms: DataFrame, rule: Disclosure) -> DataFrame:
    """term, n_text: in how many of the texts each of the terms stands."""
    if _bytes(terms) <= rule.broadcast_bytes:
        shared = terms.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, found = shared.value, Counter()
            if terms:
                for batch in slices(batches, "text"):
                    for text in texts(batch, "text"):
                        found.update(terms.intersection(words_of(text)))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        counted = arrow_map(texts_, ["text"], "term string, n long", count)
        return counted.groupBy("term").agg(F.sum("n").alias("n_text"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Counter(w for text in texts(batch, "text") for w in words_of(text))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    words = arrow_map(texts_, ["text"], "term string, n long", explode)
    return words.groupBy("term").agg(F.sum("n").alias("n_text")).join(terms, "term")


def find_pii(docs: DataFrame, terms: DataFrame | None = None, rule: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, sanitised; if asked, also row, a struct of all
    columns but the text.

    terms: revealing_terms(docs) by default. Spans are kind:start:end, by start and kind, comma-joined, in code points
    of the whole text; base_sha256 is the digest of the base spans alone. A null text is empty, without spans, and its
    sanitised text is null. Repeated rows agree; an empty table gives no rows. Other columns are not
    returned but in row, so their names can't clash.
    """
    rule = rule or Disclosure()
    terms = (revealing_terms(docs, text_col, rule) if terms is None else terms).select("term", "action")
    small = _bytes(terms) <= rule.broadcast_bytes
    shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["action"] for r in terms.collect()} if small else {})
    others = F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([others] if whole_row else []))
    if not small:  # too many terms to send: each text gets its own by a join
        own = materialize(own.withColumn("at", F.monotonically_increasing_id()), "rows")

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found = [[*words_of(x)] for x in texts(batch, "text")]
                at = np.repeat(batch.column("at").to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_pydict({"at": pa.array(at), "term": pa.array([w for x in found for w in x], pa.string())})

        words = arrow_map(own, ["at", "text"], "at long, term string", explode)
        hits = words.join(terms, "term").groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("terms"))
        own = own.join(hits, "at", "left").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value
        for batch in slices(batches, "text"):
            own_terms = [everywhere] * batch.num_rows if small else [dict(x or ()) for x in batch.column("terms").to_pylist()]
            base = [base_spans(x) for x in texts(batch, "text")]
            every, clean = [], []
            for text, spans, known in zip(batch.column("text").to_pylist(), base, own_terms, strict=True):
                more = in_order(spans + term_spans(text, known, spans)) if known and text else spans
                every.append(more)
                clean.append(sanitise(text, more, known) if more else text)
            counts = [Counter(k for k, _, _ in x) for x in every]
            columns = {"id": batch.column("id")}
            columns |= {f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS}
            columns |= {"base_sha256": pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base], pa.string()), "spans": pa.array([written(x) for x in every], pa.string()), "sanitised": pa.array(clean, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"row": batch.column("row")} if whole_row else {}))

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, sanitised string"
    if whole_row:
        schema += f", row {own.schema['row'].dataType.simpleString()}"
    return in_batches(own, run, schema).withColumnRenamed("id", id_col)
