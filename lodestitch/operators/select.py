"""Ranking and capped selection, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .retrieve import CHANNELS, RESCUE

FLAGS = ("exact_name", "exact_address", "name_token", "address_token")


def _weights(channels: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    return F.transform(channels, lambda c: F.try_element_at(known, c))


def rank_raw(found: DataFrame) -> DataFrame:
    """Adds rank: more exact channels, more token channels, higher score, lesser id."""
    w = W.partitionBy("s1").orderBy((F.col("exact_name") + F.col("exact_address")).desc(), (F.col("name_token") + F.col("address_token")).desc(), F.col("score").desc(), "cand")
    return found.withColumn("rank", F.row_number().over(w))


def rank_channels(found: DataFrame) -> DataFrame:
    """Adds rank: the strongest channel, the sum of weights, the number of channels, the score, lesser id."""
    weighed = found.withColumn("__w", _weights(F.col("channels")))
    total = F.round(F.aggregate("__w", F.lit(0.0), lambda a, x: a + x), 6)
    w = W.partitionBy("s1").orderBy(F.array_max("__w").desc(), total.desc(), F.size("channels").desc(), F.col("score").desc(), "cand")
    return weighed.withColumn("rank", F.row_number().over(w)).drop("__w")


def provenance_raw() -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in FLAGS])), ",")


def provenance_channels(channels: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.lit(c) for c in CHANNELS]), lambda c: F.array_contains(channels, c)), ",")


def strongest_channel(channels: Column) -> Column:
    order = F.array(*[F.lit(c) for c in sorted(CHANNELS, key=lambda c: (-CHANNELS[c], list(CHANNELS).index(c)))])
    return F.get(F.filter(order, lambda c: F.array_contains(channels, c)), F.lit(0))


def rescue_only(channels: Column) -> Column:
    return F.forall(channels, lambda c: c.isin(*RESCUE))


def select(ranked: DataFrame, cap: int, floor: int = 2, quota: int | None = None, by: tuple[str, ...] = ("s1",)) -> DataFrame:
    """At most `cap` of each query's ranked candidates, re-ranked: first up to `floor` of each source, then by rank;
    of those that only rescue channels found, at most `quota`."""
    if cap < 0:
        raise ValueError("a cap can't be negative")
    rows = ranked.withColumn("__src", F.row_number().over(W.partitionBy(*by, "source").orderBy("rank")))
    rows = rows.withColumn("__prio", F.when((F.col("source") == "S2") & (F.col("__src") <= floor), 0).when((F.col("source") == "S3") & (F.col("__src") <= floor), 1).otherwise(2))
    if quota is not None:
        rows = rows.withColumn("__rescue", rescue_only(F.col("channels")))
        rows = rows.withColumn("__rq", F.row_number().over(W.partitionBy(*by, "__rescue").orderBy("__prio", "rank"))).where(~F.col("__rescue") | (F.col("__rq") <= quota))
    rows = rows.withColumn("__at", F.row_number().over(W.partitionBy(*by).orderBy("__prio", "rank"))).where(F.col("__at") <= cap)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("rank")))
    return rows.drop("__src", "__prio", "__rescue", "__rq", "__at")


def sweep(ranked: DataFrame, caps: list[int], quotas: list[int | None] = (None,), floor: int = 2) -> DataFrame:
    """The selection under every (cap, quota), with both as columns."""
    out = None
    for cap in caps:
        for quota in quotas:
            own = select(ranked, cap, floor, quota).withColumn("cap", F.lit(cap)).withColumn("quota", F.lit(quota).cast("int"))
            out = own if out is None else out.unionByName(own)
    return out


def choose_cap(points: DataFrame, most: float = 100.0) -> DataFrame:
    """(cap): the last of ascending points (cap, links, pairs) before a step adds no link, or more than `most` pairs a link.

    One row per swept cap goes in, so a window over all of them is small.
    """
    w = W.orderBy("cap")
    steps = points.withColumn("dl", F.col("links") - F.lag("links").over(w)).withColumn("dp", F.col("pairs") - F.lag("pairs").over(w))
    bad = F.col("dl").isNotNull() & ((F.col("dl") <= 0) | (F.col("dp") > most * F.col("dl")))
    first = steps.withColumn("stop", F.min(F.when(bad, F.col("cap"))).over(W.partitionBy()))
    return first.where("stop is null or cap < stop").agg(F.max("cap").alias("cap"))


def wide(selected: DataFrame, queries: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids): a row per query, in rank order; a query without candidates has ''."""
    lists = selected.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]), ",").alias("ids"))
    return queries.select(F.col("entity_id").alias("s1")).join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("candidate_entity_ids"))
