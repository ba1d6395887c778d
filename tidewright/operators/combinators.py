"""Sources, decisions and sinks as DataFrame transformations: map, filter, union, sequence, routing, fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

Reader = Callable[[], DataFrame]


def map_events(events: DataFrame, **columns: Column) -> DataFrame:
    """Every event as the given columns."""
    return events.select(*[c.alias(n) for n, c in columns.items()])


def filter_map(events: DataFrame, keep: str, **columns: Column) -> DataFrame:
    """Every event as the given columns; those where the column `keep` comes out null are dropped."""
    return map_events(events, **columns).where(F.col(keep).isNotNull())


def widen(events: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """Events of one kind as the tagged union: kind, and a struct column of that name with all fields."""
    return events.select(F.lit(kind).alias("kind"), F.struct(*events.columns).alias(name or kind))


def project_kind(events: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """The fields of one kind out of the tagged union; other kinds are dropped, which is no error."""
    return events.where(F.col("kind") == kind).select(f"{name or kind}.*")


def merge(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, in no order; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merge_all(spark: SparkSession, sources: Iterable[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """merge() of any number; none at all give no rows."""
    found = list(sources)
    return merge(*found) if found else spark.createDataFrame([], schema or T.StructType())


def chain(*sources: DataFrame) -> DataFrame:
    """All rows of the first source, then all of the second, and so on: `segment` tells which, so that order survives
    any later exchange; sort by it and each source's own order."""
    return merge(*[s.withColumn("segment", F.lit(i)) for i, s in enumerate(sources)])


def fallback(*readers: Reader) -> DataFrame:
    """The first source that opens, asked in order each time; the others are never touched. If none opens, the last
    one's error. A source opens if its schema can be resolved."""
    if not readers:
        raise ValueError("no source to fall back on")
    for i, reader in enumerate(readers):
        try:
            found = reader()
            found.schema  # noqa: B018
            return found
        except Exception:
            if i == len(readers) - 1:
                raise
    raise AssertionError


def filter_actions(actions: DataFrame, allowed: Column) -> DataFrame:
    """The risk gate: actions that fail it are dropped, null counts as failing."""
    return actions.where(F.coalesce(allowed, F.lit(False)))


def allow_listed(actions: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    return actions.join(listed.select(*on).distinct(), on, "left_semi")


def route(actions: DataFrame, sinks: dict[str, Column]) -> DataFrame:
    """A row for each sink that takes the action; an action that no sink takes is skipped."""
    taken = F.array(*[F.when(F.coalesce(takes, F.lit(False)), F.lit(name)) for name, takes in sinks.items()])
    return actions.withColumn("sink", F.explode(F.array_compact(taken)))


def indexed(events: DataFrame) -> DataFrame:
    """Events that stay: not retracted and in a block."""
    return events.where("NOT coalesce(removed, false) AND block_number IS NOT NULL")


def look_up(keys: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Keys with what they stand for; keys without any are dropped."""
    return keys.join(values, on)


def suppress_done(actions: DataFrame, outcomes: DataFrame, on: str) -> DataFrame:
    """The feedback loop: drops an action if an earlier action with its key has already succeeded."""
    done = outcomes.where("ok").groupBy(on).agg(F.min("seq").alias("done_seq"))
    return actions.join(done, on, "left").where("done_seq IS NULL OR seq <= done_seq").drop("done_seq")


def live_cut(events: DataFrame, tip: int) -> DataFrame:
    return events.where(F.col("block_number") > tip)


def block_range(events: DataFrame, low: int, high: int) -> DataFrame:
    """Blocks from low to high, both included."""
    return events.where(F.col("block_number").between(low, high))


def project(events: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The columns (name, Spark type) by name: missing ones are null, others dropped."""
    return events.select(*[(F.col(n) if n in events.columns else F.lit(None)).cast(k).alias(n) for n, k in columns])
