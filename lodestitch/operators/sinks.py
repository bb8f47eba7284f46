"""Sinks: TSV writers, manifests and content hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SourceError, id_list_fault
from .select import provenance_channels, provenance_raw, strongest_channel


def write_tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order, header, no quotes, '' for an empty list; white space at the ends of a field stays, which Spark's writer
    would cut. Sorted by ranges, so no task takes all rows."""
    df.sort(*order).write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def provenance_rows(selected: DataFrame) -> DataFrame:
    """Provenance of selected raw candidates, a row per pair."""
    return selected.select(
        F.col("s1").alias("source1_entity_id"), F.col("cand").alias("candidate_entity_id"), F.col("source").alias("target_source"), provenance_raw().alias("provenance"), "rank",
        "exact_name", "exact_address", "name_token", "address_token", F.format_string("%.9f", F.col("score")).alias("retrieval_score"),
    )


def channel_rows(selected: DataFrame, scripts: DataFrame) -> DataFrame:
    """Provenance of selected canonical candidates; scripts: (entity_id, source_script)."""
    rows = selected.join(scripts.select(F.col("entity_id").alias("cand"), F.col("source_script").alias("script")), "cand", "left")
    return rows.select(
        F.col("s1").alias("source1_entity_id"), F.col("cand").alias("candidate_entity_id"), F.col("source").alias("target_source"), provenance_channels(F.col("channels")).alias("provenance"), "rank",
        F.format_string("%.9f", F.col("score")).alias("retrieval_score"), strongest_channel(F.col("channels")).alias("strongest_channel"), F.coalesce("script", F.lit("unknown")).alias("target_script"),
    )


def matching_rows(predictions: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) of predictions (s1, predicted); repeated or foreign ids are refused."""
    rows = predictions.select(F.col("s1").alias("source1_entity_id"), F.array_join("predicted", ",").alias("matched_entity_ids"))
    if bad := rows.where(id_list_fault(F.col("matched_entity_ids"), True).isNotNull()).limit(1).collect():
        raise SourceError(f"{bad[0][0]}: refused list {bad[0][1]}")
    return rows


def gold_slice(truth: DataFrame, wanted: DataFrame) -> DataFrame:
    """Truth of the wanted queries (s1); one without truth is an error."""
    if bad := wanted.join(truth, "s1", "left_anti").limit(1).collect():
        raise SourceError(f"{bad[0]['s1']} has no truth")
    return truth.join(wanted, "s1", "left_semi")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sha256): of the sorted tab-separated rows. Rows are hashed where they are and hashes summed in prefix
    groups, so what meets in the end is 256 lines whatever the table's size."""
    lines = df.select(F.sha2(F.concat_ws("\t", *columns), 256).alias("h"))
    groups = lines.groupBy(F.substring("h", 1, 2).alias("g")).agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "g", "s", "n"))), "\n"), 256).alias("sha256"))


def ids_hash(df: DataFrame, column: str) -> str:
    """SHA-256 of sorted ids, one a line; for lists that fit on the driver."""
    ids = [r[0] for r in df.select(column).sort(column).toLocalIterator()]
    return hashlib.sha256("".join(f"{i}\n" for i in ids).encode()).hexdigest()


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A sorted-key JSON document as one text file."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small table as Markdown."""
    body = [[str(x) for x in r] for r in rows.select(*columns).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, body)])
