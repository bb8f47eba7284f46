"""Token statistics: document frequencies, IDF and boilerplate, per country and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLOBAL = "global"
#: What a token without statistics weighs.
UNSEEN = 10.0


def idf(docs: DataFrame, tokens: str, threshold: float = 0.01) -> DataFrame:
    """(country, token, df, n, idf, is_boilerplate) per country and for GLOBAL, of docs (country, tokens).

    Both levels come from one pass with grouping sets; tokens of a document count once.
    """
    own = docs.select("country", F.explode(F.array_distinct(tokens)).alias("token"))
    counted = own.groupingSets([["country", "token"], ["token"]], "country", "token").agg(F.count(F.lit(1)).alias("df"), F.grouping("country").alias("all"))
    sizes = docs.groupingSets([["country"], []], "country").agg(F.count(F.lit(1)).alias("n"), F.grouping("country").alias("all"))
    level = F.when(F.col("all") == 1, GLOBAL).otherwise(F.col("country")).alias("country")
    counted, sizes = counted.select(level, "token", "df"), sizes.select(level, "n")
    return counted.join(sizes, "country").select(
        "country", "token", "df", "n", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 4).alias("idf"), (F.col("df") / F.col("n") >= threshold).alias("is_boilerplate")
    )


def weighed(tokens: DataFrame, resource: DataFrame) -> DataFrame:
    """Adds idf to tokens (country, token, ...): the country's, else the global one, else UNSEEN."""
    own = resource.select("country", "token", F.col("idf").alias("own"))
    every = resource.where(F.col("country") == GLOBAL).select("token", F.col("idf").alias("every"))
    return tokens.join(own, ["country", "token"], "left").join(every, "token", "left").withColumn("idf", F.coalesce("own", "every", F.lit(UNSEEN))).drop("own", "every")


def flagged(tokens: DataFrame, resource: DataFrame) -> DataFrame:
    """Adds is_boilerplate to tokens (country, token, ...): by the country's set, or the global one where the country has none."""
    known = resource.select("country").distinct().withColumn("known", F.lit(True))
    boiler = resource.where("is_boilerplate").select(F.col("country").alias("level"), "token", F.lit(True).alias("hit"))
    rows = tokens.join(known, "country", "left").withColumn("level", F.when(F.col("known"), F.col("country")).otherwise(GLOBAL))
    return rows.join(boiler, ["level", "token"], "left").withColumn("is_boilerplate", F.coalesce("hit", F.lit(False))).drop("known", "level", "hit")


def mined_country(country):
    """The country a record's tokens are mined for: of India, the US and France itself, of others the US."""
    return F.when(country.isin("India", "US", "France"), country).otherwise("US")


def mine(canonical: DataFrame, threshold: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(name statistics, address statistics, boilerplate (country, token) of either) of canonical records."""
    rows = canonical.withColumn("country", mined_country(F.col("country")))
    names, addresses = idf(rows, "name_tokens", threshold), idf(rows, "address_tokens", threshold)
    both = names.unionByName(addresses).where("is_boilerplate").select("country", "token").distinct()
    return names, addresses, both


def frequencies(records: DataFrame, fields: list[str]) -> DataFrame:
    """(country, source, token, df): records of a shard that hold a token in any of the token fields."""
    return records.select("country", "source", F.explode(F.array_distinct(F.concat(*fields))).alias("token")).groupBy("country", "source", "token").agg(F.count(F.lit(1)).alias("df"))
