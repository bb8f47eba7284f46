"""The linkage end to end: raw and canonical candidate generation, and matching, over records and truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_raw
from ..operators import decide, features, index, model, retrieve, select, splits, tokens
from ..operators.represent import canonical_view
from ..sources.tables import by_source, entity_id, entity_view

CAP, FLOOR, QUOTA = 50, 2, 10


@dataclass
class Corpus:
    """records of all sources; queries are those of S1, targets the others with their source; links (s1, cand) are the
    true pairs, truth (s1, targets) gathers them for each query."""

    records: DataFrame
    queries: DataFrame
    targets: DataFrame
    links: DataFrame
    truth: DataFrame


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The entity view of a documents table; the same normalised text in one language stands in for truth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    records = entity_view(docs)
    queries, targets = by_source(records)
    own = docs.select("doc_id", "text", "lang").withColumn("k", F.md5(normalize_raw(F.col("text")).cast("binary")))
    key = own.select(entity_id(F.col("doc_id")).alias("entity_id"), F.coalesce("lang", F.lit("")).alias("country"), "k")
    links = same_key_links(key)
    return Corpus(records, queries, targets, links, gathered(key, links))


def same_key_links(keys: DataFrame) -> DataFrame:
    """(s1, cand) of keys (entity_id, country, k): targets of the query's country and key. A pair is a row: a common key is
    split by Spark's skew join, no group is gathered."""
    theirs = keys.where("entity_id not like 'S1-%'").select(F.col("entity_id").alias("cand"), "country", "k")
    return keys.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1"), "country", "k").join(theirs, ["country", "k"]).select("s1", "cand")


def gathered(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(s1, targets): each query's links, in order; none for a query without."""
    lists = links.groupBy("s1").agg(F.array_sort(F.collect_list("cand")).alias("targets"))
    own = keys.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1"))
    return own.join(lists, "s1", "left").select("s1", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def kept(df: DataFrame) -> DataFrame:
    """Held for the several branches that read it; what an executor loses is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def raw_ranked(c: Corpus) -> DataFrame:
    return select.rank_raw(retrieve.raw_candidates(c.queries, index.build_raw(c.targets)))


def views(c: Corpus) -> DataFrame:
    """Canonical views of all records, made once for both sides, the index and the boilerplate."""
    return kept(canonical_view(c.records))


def canonical_ranked(c: Corpus, view: DataFrame | None = None) -> DataFrame:
    view = views(c) if view is None else view
    idx = index.index_views(view.join(c.targets.select("entity_id", "source"), "entity_id"))
    found = retrieve.canonical_candidates(view.where("entity_id like 'S1-%'"), idx, boilerplate(view))
    return select.rank_channels(found)


def boilerplate(view: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(token): global boilerplate of names and addresses, mined from all records."""
    level = lambda f: tokens.idf(view, f, threshold).where(f"is_boilerplate and country = '{tokens.GLOBAL}'").select("token")
    return level("name_tokens").unionByName(level("address_tokens")).distinct()


def matched(c: Corpus, rounds: int = model.ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(scored (s1, cand, prob), labelled features) of capped raw candidates: features, a model early-stopped on held-out queries, probabilities."""
    chosen = select.select(raw_ranked(c), CAP, FLOOR)
    rows = features.raw_features(chosen, c.records)
    strata = splits.strata(c.truth.select("s1", F.size("targets").alias("n")).join(c.records.select(F.col("entity_id").alias("s1"), "country"), "s1"))
    # read for training, for stopping and for each use of the probabilities: retrieval and comparisons run once
    rows = kept(features.labelled(rows, c.truth, model.holdout(strata)))
    fitted = model.train(rows, features.RAW_FEATURES, rounds=rounds)
    return kept(model.probabilities(fitted, rows, features.RAW_FEATURES)), rows


def decided(c: Corpus) -> DataFrame:
    """(s1, predicted) at the threshold with the best macro F0.5."""
    scored, _ = matched(c)
    best = decide.choose_threshold(scored, c.truth).first()["threshold"]
    return decide.kept(scored, c.truth, best)
