"""Retrieval: equi-joins on (country, source, key), bounded before they join.

A key is bounded by its pool or by its document frequency, so the rows of a query are bounded
whatever the corpus; exact pools are cut on the target side once, not per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .index import EXACT, TOKENS, Index, raw_records, tagged

POOL = 120
RARE = 3
#: The order of channels, their weights, and those that only rescue.
CHANNELS = {
    "raw_name_exact": 9.0, "raw_address_exact": 8.0, "canonical_name_exact": 10.0, "accent_name_exact": 8.5, "canonical_address_exact": 9.0, "romanized_exact": 9.5,
    "raw_name_token": 3.0, "raw_address_token": 2.5, "canonical_name_token": 4.0, "canonical_address_token": 3.5, "romanized_token": 4.5,
    "postal_exact": 1.5, "romanized_ngram": 2.0, "phonetic_exact": 1.75,
}
RESCUE = ("postal_exact", "romanized_ngram", "phonetic_exact")
EXACT_POOL, TOKEN_POSTINGS, NGRAM_POSTINGS, TOKENS_PER_FIELD = 250, 250, 400, 4


def exact(queries: DataFrame, records: DataFrame, keys: dict[str, str], pool: int) -> DataFrame:
    """(s1, source, cand, channel): targets with the query's value, the `pool` least ids of each value.

    queries: (s1, country, and a column per key). keys: channel -> column, the same on both sides. Values are compared by
    their SHA-256, so that no text is shuffled.
    """
    digest = lambda v: F.when(F.col(v) != "", F.unhex(F.sha2(v, 256)))
    melt = lambda df, more: df.select(*more, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), digest(v).alias("value")) for c, v in keys.items()])).alias("k")).select(*more, "k.channel", "k.value").where("value is not null")
    place = F.row_number().over(W.partitionBy("country", "source", "channel", "value").orderBy("entity_id"))
    pools = melt(records, ["country", "source", "entity_id"]).withColumn("at", place).where(F.col("at") <= pool)
    return melt(queries, ["s1", "country"]).join(pools, ["country", "channel", "value"]).select("s1", "source", F.col("entity_id").alias("cand"), "channel")


def rare(tokens: DataFrame, index: Index, limits: dict[str, int], per_field: int) -> DataFrame:
    """(s1, source, cand, channel, score): targets that hold, in the query's field, one of its rarest tokens there; a row per token they share.

    tokens: (s1, country, channel, field, token). A token is usable up to its channel's limit of
    documents; the rarest `per_field` a query, source and channel are looked up (ties by token).
    The score is 1 / log2(df + 2); `by_channel` sums it over the tokens that a target holds.
    """
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    df = index.df.where(F.col("df") <= max(limits.values()))
    place = F.row_number().over(W.partitionBy("s1", "source", "channel").orderBy("df", "token"))
    chosen = tokens.distinct().join(df, ["country", "token"]).where(F.col("df") <= F.try_element_at(limit, F.col("channel"))).withColumn("at", place).where(F.col("at") <= per_field)
    # the same bound on the side of the postings: common tokens don't reach the join
    postings = index.postings.join(df.select("country", "source", "token"), ["country", "source", "token"], "left_semi")
    hits = chosen.join(postings, ["country", "source", "field", "token"])
    return hits.select("s1", "source", F.col("entity_id").alias("cand"), "channel", (1 / F.log2(F.col("df") + 2)).alias("score"))


def by_channel(hits: DataFrame) -> DataFrame:
    """(s1, source, cand, channel, score): the sum over each target's rows of a channel. Hits are dealt by their query once; what
    follows (sums, ranks, selection and metrics of a query) needs no other exchange."""
    return hits.repartition("s1").groupBy("s1", "source", "cand", "channel").agg(F.round(F.sum("score"), 9).alias("score"))


def raw_queries(queries: DataFrame) -> DataFrame:
    """(s1, country, name, address, name_tokens, address_tokens) of S1 records."""
    return raw_records(queries.withColumn("source", F.lit("S1"))).withColumnRenamed("entity_id", "s1").drop("source")


def raw_candidates(queries: DataFrame, index: Index, pool: int = POOL) -> DataFrame:
    """(s1, cand, source, exact_name, exact_address, name_token, address_token, score) of S1 records: exact and rare tokens, names and addresses."""
    q = raw_queries(queries)
    found = exact(q, index.records, {"exact_name": "name", "exact_address": "address"}, pool).withColumn("score", F.lit(0.0))
    melted = F.flatten(F.array(*[tagged(F.col(f"{f}_tokens"), channel=f"{f}_token", field=f) for f in ("name", "address")]))
    tokens = q.select("s1", "country", F.explode(melted).alias("t")).select("s1", "country", "t.*")
    found = by_channel(found.unionByName(rare(tokens, index, {"name_token": pool, "address_token": pool}, RARE)))
    flags = [F.max(F.when(F.col("channel") == c, 1).otherwise(0)).alias(c) for c in ("exact_name", "exact_address", "name_token", "address_token")]
    return found.groupBy("s1", "cand", "source").agg(*flags, F.round(F.sum("score"), 9).alias("score"))


def without_boilerplate(tokens: DataFrame, boilerplate: DataFrame | None) -> DataFrame:
    return tokens if boilerplate is None else tokens.join(boilerplate.select("token").distinct(), "token", "left_anti")


def canonical_candidates(view: DataFrame, index: Index, boilerplate: DataFrame | None = None) -> DataFrame:
    """(s1, cand, source, channels array, score) of canonical views of S1 records: 14 channels.

    Canonical name and address channels look up the query's mapped and romanised tokens in the
    target's plain normalised field, as the published method does.
    """
    found = exact(view.withColumnRenamed("entity_id", "s1"), index.records, EXACT, EXACT_POOL).withColumn("score", F.lit(0.0))
    found = by_channel(found.unionByName(_token_hits(view, index, boilerplate)))
    return found.groupBy("s1", "cand", "source").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.round(F.sum("score"), 9).alias("score"))


def canonical_candidates_of_tokens(view: DataFrame, index: Index, boilerplate: DataFrame | None = None) -> DataFrame:
    """(s1, source, cand, channel, score) of the six token channels."""
    return by_channel(_token_hits(view, index, boilerplate))


def _token_hits(view: DataFrame, index: Index, boilerplate: DataFrame | None) -> DataFrame:
    q = view.withColumnRenamed("entity_id", "s1")
    own = {
        "raw_name_token": F.filter(F.split("raw_name", " "), lambda t: F.length(t) >= 2), "raw_address_token": F.filter(F.split("raw_address", " "), lambda t: F.length(t) >= 2),
        "canonical_name_token": F.col("name_tokens"), "canonical_address_token": F.col("address_tokens"), "romanized_token": F.filter(F.split("romanized_name", " "), lambda t: t != ""), "romanized_ngram": F.col("name_ngrams"),
    }
    melted = F.flatten(F.array(*[tagged(F.array_distinct(own[c]), channel=c, field=f) for c, f in TOKENS.items()]))
    tokens = q.select("s1", "country", F.explode(melted).alias("t")).select("s1", "country", "t.*")
    words = without_boilerplate(tokens.where("channel <> 'romanized_ngram'"), boilerplate)
    tokens = words.unionByName(tokens.where("channel = 'romanized_ngram'"))
    limits = {c: NGRAM_POSTINGS if c == "romanized_ngram" else TOKEN_POSTINGS for c in TOKENS}
    return rare(tokens, index, limits, TOKENS_PER_FIELD)


def only_channels(found: DataFrame, channels: list[str]) -> DataFrame:
    """Candidates by these channels alone; the score stays that of all channels."""
    return found.withColumn("channels", F.array_intersect("channels", F.array(*[F.lit(c) for c in channels]))).where(F.size("channels") > 0)


def token_neighbours(queries: DataFrame, targets: DataFrame, df_cap: int = 200, post_cap: int = 50, order: str = "entity_id") -> DataFrame:
    """(s1, cand, jaccard): same-country targets that share a name token of at most df_cap documents.

    queries, targets: (id, country, words). The first post_cap targets of a token in `order`, over all countries, count.
    """
    posted = targets.select(F.col("entity_id").alias("cand"), F.col("country").alias("other"), F.col("words").alias("theirs"), F.col(order).alias("o"), F.explode("words").alias("token"))
    # counted before the window, with partial sums: a common token's rows never meet
    usable = targets.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= df_cap).select("token")
    place = F.row_number().over(W.partitionBy("token").orderBy("o", "cand"))
    posted = posted.join(usable, "token", "left_semi").withColumn("at", place).where(F.col("at") <= post_cap)
    q = queries.select("s1", "country", "words", F.explode("words").alias("token"))
    pairs = q.join(posted, "token").where("country = other").select("s1", "cand", "words", "theirs").distinct()
    both = F.size(F.array_intersect("words", "theirs"))
    return pairs.select("s1", "cand", (both / F.size(F.array_union("words", "theirs"))).alias("jaccard"))
