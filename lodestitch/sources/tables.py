"""Sources: strict TSV scans in three dialects, id lists, truth, merged candidates, entity views."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import PROVENANCE, RECORD, TRUTH, ddl

#: quoted: quotes may hold tabs and line ends; plain: none; sampled: plain, and pandas' words for missing values are null.
DIALECTS = {
    "quoted": {"quote": '"', "escape": '"', "multiLine": True},
    "plain": {"quote": ""},
    "sampled": {"quote": ""},
}
#: What pandas reads as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class SourceError(ValueError):
    """A source breaks its contract."""


def _none(df: DataFrame, what: str) -> None:
    if bad := df.limit(3).collect():
        raise SourceError(f"{what}: " + ", ".join(str(r[0]) for r in bad))


def read_tsv(spark: SparkSession, path: str, columns: list[str], dialect: str = "quoted") -> DataFrame:
    """A scan that refuses any other header; empty fields are '', not null."""
    head = spark.read.text(path).limit(1).collect()
    if not head or head[0][0].lstrip("﻿").rstrip("\r").split("\t") != columns:
        raise SourceError(f"{path}: header must be {columns}")
    options = {"sep": "\t", "header": True, "enforceSchema": False, "nullValue": "\u0000", "emptyValue": "", **DIALECTS[dialect]}
    rows = spark.read.options(**options).schema(ddl(columns)).csv(path)
    empty = "" if dialect != "sampled" else None
    rows = rows.select(*[F.coalesce(F.col(c), F.lit(empty)).alias(c) if empty is not None else F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in columns])
    return rows.where(~all_blank(columns))


def all_blank(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.btrim(F.col(c)), F.lit("")) == "")
    return out


def read_records(spark: SparkSession, path: str, dialect: str = "quoted") -> DataFrame:
    return read_tsv(spark, path, RECORD, dialect)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id): one id a line, trimmed, blanks dropped, each once."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).where("entity_id <> ''").distinct()


def only_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the requested ids; an id without a record is an error."""
    _none(ids.join(records, "entity_id", "left_anti"), "requested ids without a record")
    return records.join(ids, "entity_id", "left_semi")


def ids_of(column: Column) -> Column:
    """A comma list as an array: trimmed, empty items dropped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != ""))


def id_list_fault(column: Column, prefixes: bool = False) -> Column:
    """Why a non-empty comma list is refused, or null: empty item, repeated id, foreign prefix."""
    items = F.split(column, ",")
    out = F.when(F.coalesce(column, F.lit("")) == "", F.lit(None).cast("string")).when(F.exists(items, lambda x: F.btrim(x) == ""), "empty item").when(F.size(items) != F.size(F.array_distinct(items)), "repeated id")
    return out.when(~F.forall(items, lambda x: x.rlike("^S[23]-")), "foreign prefix") if prefixes else out


def read_truth(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(s1, targets array<string>); with ids, exactly theirs."""
    rows = read_tsv(spark, path, TRUTH)
    _none(rows.where(id_list_fault(F.col("matched_entity_ids")).isNotNull()), "malformed truth lists of")
    rows = rows.select(F.col("source1_entity_id").alias("s1"), ids_of(F.col("matched_entity_ids")).alias("targets"))
    if ids is not None:
        own = ids.select(F.col("entity_id").alias("s1"))
        _none(own.join(rows, "s1", "left_anti"), "ids without truth")
        rows = rows.join(own, "s1", "left_semi")
    return rows


def load_entities(sources: list[DataFrame], needed: DataFrame) -> DataFrame:
    """Records of up to three sources with the needed ids; a needed id in none is an error."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return only_ids(rows, needed)


def merged_candidates(candidates: DataFrame, provenance: DataFrame) -> DataFrame:
    """(s1, cand, rank, ...) of wide candidates joined with their provenance; any row without its counterpart at the same rank is an error."""
    wide = candidates.select(F.col("source1_entity_id").alias("s1"), F.posexplode(ids_of(F.col("candidate_entity_ids"))).alias("at", "cand")).select("s1", "cand", (F.col("at") + 1).alias("rank"))
    rows = provenance.select(F.col("source1_entity_id").alias("s1"), F.col("candidate_entity_id").alias("cand"), F.col("rank").cast("int").alias("rank"), *PROVENANCE[2:4], *PROVENANCE[5:])
    key = ["s1", "cand", "rank"]
    _none(wide.join(rows, key, "left_anti"), "candidates without provenance")
    _none(rows.join(wide, key, "left_anti"), "provenance without candidates")
    return wide.join(rows, key)


def collect_ids(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ids on either side."""
    return candidates.select(F.col("source1_entity_id").alias("entity_id")).distinct(), candidates.select(F.explode(ids_of(F.col("candidate_entity_ids"))).alias("entity_id")).distinct()


def owners(truth: DataFrame, order: str = "s1") -> DataFrame:
    """(target, s1): whom a target belongs to; of several the last in order."""
    return truth.select(F.explode("targets").alias("target"), "s1").groupBy("target").agg(F.max_by("s1", F.col(order)).alias("s1"))


def train_records(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, country, n): strata input; refuses repeated ids and ids on one side only."""
    _none(records.groupBy("entity_id").count().where("count > 1"), "repeated ids")
    _none(truth.groupBy("s1").count().where("count > 1"), "repeated truth")
    both = records.select(F.col("entity_id").alias("s1"), "country").join(truth, "s1", "full")
    _none(both.where("country is null or targets is null"), "ids on one side only")
    return both.select("s1", "country", F.size("targets").alias("n"))


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an explicit order: a sample that many files can't change."""
    return df.orderBy(order).limit(n)


def token_resource(spark: SparkSession, path: str) -> DataFrame:
    """(country, token, idf) of a JSON document {country: {token: idf}}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return rows.select(F.explode("m").alias("country", "t")).select("country", F.explode("t").alias("token", "idf"))


def boilerplate_resource(spark: SparkSession, path: str) -> DataFrame:
    """(country, token) of a JSON document {country: [token]}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return rows.select(F.explode("m").alias("country", "t")).select("country", F.explode("t").alias("token"))


def dataset_dir(split: str, candidates: list[str]) -> str:
    """EVAL_<SPLIT>_DIR, else the first folder that is there."""
    named = os.environ.get(f"EVAL_{split.upper()}_DIR")
    for path in [named] if named else candidates:
        if os.path.isdir(path):
            return path
    raise SourceError(f"no folder for {split}")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds line, from 1 in the order of a column."""
    return df.withColumn("line", F.row_number().over(W.orderBy(order)))


def entity_id(doc_id: Column) -> Column:
    """S1-, S2- or S3- by doc_id mod 3, and the id in eight digits."""
    return F.concat(F.lit("S"), (doc_id % 3 + 1).cast("string"), F.lit("-"), F.lpad(doc_id.cast("string"), 8, "0"))


def entity_view(documents: DataFrame) -> DataFrame:
    """Documents as records: source by doc_id mod 3, country the language, name the first line cut to 12 words, address the second line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return documents.select(
        entity_id(F.col("doc_id")).alias("entity_id"),
        F.array_join(F.slice(F.split(F.get(lines, F.lit(0)), " "), 1, 12), " ").alias("business_name"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
    )


def by_source(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, targets): S1 records, and S2 and S3 records with their source."""
    return records.where("entity_id like 'S1-%'"), records.where("entity_id not like 'S1-%'").withColumn("source", F.substring("entity_id", 1, 2))
