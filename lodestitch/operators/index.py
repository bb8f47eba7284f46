"""Indexes: targets by shard (country, source), their postings and document frequencies, as Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_raw, raw_tokens
from .represent import canonical_view
from .tokens import frequencies

SCHEMA_VERSION = "1"
RAW_FIELDS = {"name": "name_tokens", "address": "address_tokens"}
#: Exact fields and token fields of the canonical index, by channel.
EXACT = {
    "raw_name_exact": "raw_name", "raw_address_exact": "raw_address", "canonical_name_exact": "normalized_name", "accent_name_exact": "accent_name",
    "canonical_address_exact": "normalized_address", "romanized_exact": "romanized_name", "postal_exact": "postal_code", "phonetic_exact": "phonetic_name",
}
TOKENS = {
    "raw_name_token": "raw_name", "raw_address_token": "raw_address", "canonical_name_token": "normalized_name",
    "canonical_address_token": "normalized_address", "romanized_token": "romanized_name", "romanized_ngram": "name_ngrams",
}


@dataclass
class Index:
    """records: one row per target. postings: (country, source, field, token, entity_id). df: (country, source, token, df)."""

    records: DataFrame
    postings: DataFrame
    df: DataFrame

    def save(self, path: str) -> None:
        """Written by shard (country, source), so that a query's country prunes partitions. Each shard is spread over
        tasks by a hash of its rows: a country with most of the rows is no single task's work."""
        for part, rows, spread in (("records", self.records, "entity_id"), ("postings", self.postings, "token"), ("df", self.df, "token")):
            rows.hint("rebalance", "country", "source", spread).write.partitionBy("country", "source").parquet(f"{path}/{part}")
        self.records.sparkSession.createDataFrame([(SCHEMA_VERSION,)], "version string").write.json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Index:
    """An index written by `save`; another version is refused."""
    found = spark.read.schema("version string").json(f"{path}/manifest").first()
    if found is None or found[0] != SCHEMA_VERSION:
        raise ValueError(f"{path}: index version {found and found[0]}, not {SCHEMA_VERSION}")
    shard = lambda part: spark.read.parquet(f"{path}/{part}").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("country", "source")})
    return Index(*map(shard, ("records", "postings", "df")))


def raw_records(targets: DataFrame) -> DataFrame:
    """(entity_id, source, country, name, address, name_tokens, address_tokens) of targets (records with source)."""
    rows = targets.select("entity_id", "source", F.btrim("country").alias("country"), normalize_raw(F.col("business_name")).alias("name"), normalize_raw(F.col("business_address")).alias("address"))
    return rows.withColumn("name_tokens", raw_tokens(F.col("name"))).withColumn("address_tokens", raw_tokens(F.col("address")))


def tagged(tokens: Column, **tags: str) -> Column:
    """Tokens as structs (tags..., token)."""
    fixed = [F.lit(v).alias(k) for k, v in tags.items()]
    return F.transform(tokens, lambda t: F.struct(*fixed, t.alias("token")))


def _postings(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One explode over all fields. explode_outer and a filter: with plain explode Spark would evaluate the token expressions again in a pushed-down filter."""
    pairs = F.flatten(F.array(*[tagged(F.array_distinct(column), field=field) for field, column in fields.items()]))
    rows = records.select("country", "source", "entity_id", F.explode_outer(pairs).alias("p"))
    return rows.where("p is not null").select("country", "source", "p.field", "p.token", "entity_id")


def build_raw(targets: DataFrame) -> Index:
    """The index over raw names and addresses."""
    records = raw_records(targets)
    return Index(records, _postings(records, RAW_FIELDS), frequencies(records, list(RAW_FIELDS.values())))


def build_canonical(targets: DataFrame) -> Index:
    """The index over eight exact and six token fields of canonical views."""
    return index_views(canonical_view(targets).join(targets.select("entity_id", "source"), "entity_id"))


def index_views(view: DataFrame) -> Index:
    """The same over canonical views with their source."""
    split = {f"__{c}": F.array_distinct(F.filter(F.split(F.col(c), " "), lambda t: t != "")) for c in TOKENS.values() if c != "name_ngrams"}
    records = view.withColumns(split).withColumn("__name_ngrams", F.col("name_ngrams"))
    fields = {c: f"__{c}" for c in TOKENS.values()}
    return Index(view, _postings(records, fields), frequencies(records, list(fields.values())))


def comparison_space(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(pairs): query and target pairs of the same country."""
    q = queries.groupBy("country").agg(F.count(F.lit(1)).alias("q"))
    t = targets.groupBy("country").agg(F.count(F.lit(1)).alias("t"))
    return q.join(t, "country").agg(F.coalesce(F.sum(F.col("q") * F.col("t")), F.lit(0)).alias("pairs"))


def entity_scripts(index: Index, ids: DataFrame) -> DataFrame:
    """(country, entity_id, source_script), "unknown" for ids that the index doesn't hold."""
    own = index.records.select("country", "entity_id", "source_script")
    return ids.join(own, ["country", "entity_id"], "left").withColumn("source_script", F.coalesce("source_script", F.lit("unknown")))
