"""A corpus pipeline of the operators in lodestitch.llm: each stage's result is written and read again by the next.

Stages: quality classifier (rejected documents go), quality rules (rejected documents go), MinHash
near-dedup (one document of each group stays), best-fit packing. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestitch.llm import minhash_neardup, packing, quality_classifier, quality_rules
from lodestitch.llm._common import stored
from lodestitch.llm.queries import table, tokenizer, trusted


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, trusted(spark, sf_dir))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("minhash_neardup", dedup), ("best_fit_packing", pack)]
#: No stage can be said in SQL as a whole (a trained model, hashed samples, best-fit): tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
