"""URL filters: host and path rules, and beyond them a ratio of character language models.

Two variable-order Markov models, of accepted and of rejected URLs, smoothed by Witten-Bell interpolation from the
longest context seen down to a uniform letter. A URL without a rule is allowed if the difference of its
log-likelihoods, divided by its length, reaches a threshold that was calibrated on labelled URLs held out of the fit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_map

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The text of the longest rule that fits the host or a domain above it and starts the path; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # a longer one is asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


class CharModel:
    """P(character | up to `order` characters before it), interpolated: with c(ctx) tokens and t(ctx) types seen after a
    context, P = (c(ctx, x) + t(ctx) P_shorter(x)) / (c(ctx) + t(ctx)); below the empty context every character has 1/256."""

    def __init__(self, urls: Iterable[str], order: int = 5):
        self.order = order
        self.seen: dict[str, int] = {}
        self.total: dict[str, int] = {}
        self.types: dict[str, int] = {}
        for url in urls:
            text = "\x02" + url + "\x03"
            for i in range(1, len(text)):
                for k in range(min(order, i) + 1):
                    gram = text[i - k : i + 1]
                    n = self.seen.get(gram, 0)
                    self.seen[gram] = n + 1
                    context = gram[:-1]
                    self.total[context] = self.total.get(context, 0) + 1
                    if not n:
                        self.types[context] = self.types.get(context, 0) + 1

    def log_likelihood(self, url: str) -> float:
        text = "\x02" + url + "\x03"
        seen, total, types, order, out = self.seen.get, self.total.get, self.types, self.order, 0.0
        for i in range(1, len(text)):
            p = 1 / 256
            for k in range(min(order, i) + 1):
                context = text[i - k : i]
                n = total(context)
                if n is None:
                    break
                t = types[context]
                p = (seen(text[i - k : i + 1], 0) + t * p) / (n + t)
            out += math.log(p)
        return out


@dataclass(frozen=True)
class UrlModel:
    accepted: CharModel
    rejected: CharModel
    threshold: float

    def score(self, url: str) -> float:
        """Log-likelihood difference per character, the end included."""
        return (self.accepted.log_likelihood(url) - self.rejected.log_likelihood(url)) / (len(url) + 1)


def train(labelled: list[tuple[str, bool]], order: int = 5, held_out: int = 5) -> UrlModel:
    """Fits on all but every held_out-th URL (by its CRC-32); the threshold is the midpoint of scores that gives the
    held-out ones the best mean of both classes' accuracies, the one nearest to 0 of several. With a class missing, 0."""
    own = [(u, ok) for u, ok in labelled if zlib.crc32(u.encode()) % held_out]
    rest = [(u, ok) for u, ok in labelled if not zlib.crc32(u.encode()) % held_out]
    model = UrlModel(CharModel((u for u, ok in own if ok), order), CharModel((u for u, ok in own if not ok), order), 0.0)
    scores = sorted((model.score(u), ok) for u, ok in rest)
    good, bad = sum(ok for _, ok in scores), sum(not ok for _, ok in scores)
    if not good or not bad:
        return model
    best, cut = (-1.0, 0.0), 0.0
    below_good = below_bad = 0
    for i in range(len(scores) + 1):
        if i:
            below_good += scores[i - 1][1]
            below_bad += not scores[i - 1][1]
        at = scores[0][0] - 1e-6 if not i else scores[-1][0] + 1e-6 if i == len(scores) else (scores[i - 1][0] + scores[i][0]) / 2
        rank = ((good - below_good) / good + below_bad / bad, -abs(at))
        if rank > best:
            best, cut = rank, at
    return UrlModel(model.accepted, model.rejected, cut)


def fit_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", per_class: int = 4000, order: int = 5) -> UrlModel:
    """Learns from URLs that a rule allows or blocks: up to per_class distinct ones of each class, drawn by
    a hash, which bounds the fit. The same URLs give the same model however they are partitioned."""
    host, path = split_url(F.col("url"))
    allow = F.create_map(*[x for r in rules for x in (F.lit(r.text), F.lit(r.allow))])
    rows = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").select("url", match_rule(host, path, rules).alias("rule")).where("rule IS NOT NULL")
    rows = rows.select("url", F.element_at(allow, F.col("rule")).alias("ok"), F.xxhash64("url").alias("key"))
    space = 1 << 30
    counts = {r["ok"]: r["n"] for r in rows.groupBy("ok").agg(F.count_distinct("url").alias("n")).collect()}
    labelled = []
    for ok, n in sorted(counts.items()):
        for share in (min(space, -(-space * 4 * per_class // n)), space):
            drawn = rows.where((F.col("ok") == F.lit(ok)) & (F.pmod("key", F.lit(space)) < share))
            found = drawn.select("key", "url").distinct().orderBy("key", "url").limit(per_class).collect()
            if len(found) >= min(n, per_class):
                break
        labelled += [(r["url"], ok) for r in found]
    return train(labelled, order)


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, score (null with a rule), verdict.

    A null url, or one without ://, has an empty host and path, no rule, and the method's verdict of its text, null as
    empty. Hosts compare as they stand, ports and user names included. Whole urls are scored however long. Repeated
    rows agree; an empty table gives no rows. Other columns are neither read nor returned.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), path.alias("path"))
    split = split.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    allow = {r.text: r.allow for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rule = batch.column("rule").to_pylist()
            scores = [None if r is not None else own.score(u or "") for r, u in zip(rule, batch.column(url_col).to_pylist(), strict=True)]
            ok = [allow[r] if r is not None else s >= own.threshold for r, s in zip(rule, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (id_col, "host", "path", "rule")), pa.array(scores, pa.float64()), pa.array(["allow" if x else "block" for x in ok], pa.string())],
                names=[id_col, "host", "path", "rule", "score", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return arrow_map(split, [id_col, url_col, "host", "path", "rule"], f"{id_col} {kind}, host string, path string, rule string, score double, verdict string", run)
