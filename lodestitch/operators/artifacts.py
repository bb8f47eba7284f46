"""Artifacts: frozen splits and samples, token resources, audits, packs, capacity, and what is built once and reused."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANDIDATES, MISSES, PACK, TRUTH
from ..sources.tables import SourceError, id_list_fault, ids_of, read_ids, read_truth, read_tsv
from ..storage import exists, replace
from . import index, metrics, sinks, splits, validate

PARTS = ("fit", "loop", "report")


def digest(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def write_ids(ids: DataFrame, path: str, column: str = "s1") -> None:
    """One id a line in ascending order, by ranges: no task takes all ids."""
    ids.select(F.col(column).alias("value")).sort("value").write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


# -- splits and samples


def write_split(assigned: DataFrame, allocation: DataFrame, path: str, seed: int = 42) -> dict:
    """Id files of the parts, manifest and SPLIT.md of an assignment (s1, country, bucket, split) below `path`; the manifest is returned."""
    spark, parts = assigned.sparkSession, {}
    for name in PARTS:
        own = assigned.where(F.col("split") == name).select("s1")
        write_ids(own, f"{path}/{name}_ids")
        parts[name] = {"path": f"{name}_ids", "count": own.count(), "sha256": sinks.content_hash(own, ["s1"]).first()["sha256"]}
    strata = [r.asDict() for r in allocation.select("country", "bucket", "n", *PARTS).sort("country", "bucket").collect()]  # one row per stratum
    manifest = {"seed": seed, "counts": {n: p["count"] for n, p in parts.items()}, "strata": strata, "artifacts": parts}
    manifest["sha256"] = digest(manifest)
    sinks.write_json(spark, manifest, f"{path}/manifest")
    spark.createDataFrame([(split_text(manifest),)], "value string").coalesce(1).write.text(f"{path}/SPLIT.md")
    return manifest


def split_text(manifest: dict) -> str:
    """The split as a page for readers."""
    rows = lambda head, body: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in body)]
    lines = ["# Split", "", f"Queries are dealt by strata of country and number of matches, in hash order of seed {manifest['seed']}. Parts are frozen: a threshold or a cap is chosen on loop alone, and report is read once.", ""]
    lines += [*rows(["part", "ids", "sha256"], [(n, p["count"], p["sha256"]) for n, p in manifest["artifacts"].items()]), ""]
    lines += rows(["country", "matches", "queries", *PARTS], [(s["country"], s["bucket"], s["n"], *(s[p] for p in PARTS)) for s in manifest["strata"]])
    return "\n".join(lines)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(s1, split) of a written split; parts that overlap, or that differ from the manifest, are refused."""
    manifest, out = read_json(spark, f"{path}/manifest"), None
    stated = manifest.pop("sha256")
    if digest(manifest) != stated:
        raise SourceError(f"{path}: the manifest has been changed")
    own = {n: read_ids(spark, f"{path}/{n}_ids").withColumnRenamed("entity_id", "s1") for n in PARTS}
    for name, ids in own.items():
        if sinks.content_hash(ids, ["s1"]).first()["sha256"] != manifest["artifacts"][name]["sha256"]:
            raise SourceError(f"{path}: {name} differs from the manifest")
        part = ids.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    splits.assert_disjoint(*own.values())
    return out


def write_sample(sample: DataFrame, path: str, **meta) -> dict:
    """The ids of a sample, and what it was drawn with."""
    write_ids(sample, f"{path}/ids")
    document = {**meta, "count": sample.count(), "sha256": sinks.content_hash(sample, ["s1"]).first()["sha256"]}
    sinks.write_json(sample.sparkSession, document, f"{path}/meta")
    return document


# -- token resources, audits, packs


def save_resource(names: DataFrame, addresses: DataFrame, boilerplate: DataFrame, path: str) -> None:
    """Token statistics as three tables of JSON lines in order; a vocabulary of any size is no single document."""
    for name, rows, columns in (("name_idf", names, ["country", "token", "idf"]), ("address_idf", addresses, ["country", "token", "idf"]), ("boilerplate", boilerplate, ["country", "token"])):
        rows.select(*columns).sort("country", "token").write.json(f"{path}/{name}")


def load_resource(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(name statistics, address statistics, boilerplate) of a saved resource."""
    idf = "country string, token string, idf double"
    return spark.read.schema(idf).json(f"{path}/name_idf"), spark.read.schema(idf).json(f"{path}/address_idf"), spark.read.schema("country string, token string").json(f"{path}/boilerplate")


def write_misses(rows: DataFrame, path: str) -> None:
    """The miss audit (s1, truth_ids, candidate_ids, missed_ids, status, reason) under its published header."""
    sinks.write_tsv(rows.select(*[F.col(a).alias(b) for a, b in zip(["s1", "truth_ids", "candidate_ids", "missed_ids", "status", "reason"], MISSES)]), path, [MISSES[0]])


def write_pack(pack: DataFrame, path: str) -> dict:
    """A difficulty pack and its manifest: rows by kind, and the hash of the rows."""
    sinks.write_tsv(pack, f"{path}/pack", [PACK[2], PACK[0]])
    kinds = {r["kind"]: r["count"] for r in pack.groupBy("kind").count().collect()}
    manifest = {"rows": sum(kinds.values()), "kinds": kinds, "sha256": sinks.content_hash(pack, PACK).first()["sha256"]}
    sinks.write_json(pack.sparkSession, manifest, f"{path}/manifest")
    return manifest


# -- files of results


def score_files(spark: SparkSession, predictions: str, truth: str) -> dict:
    """Macro F0.5 of a file of matches against one of truth, and of predicting nothing."""
    rows = read_tsv(spark, predictions, TRUTH)
    if bad := rows.where(id_list_fault(F.col("matched_entity_ids"), True).isNotNull()).limit(1).collect():
        raise SourceError(f"{predictions}: malformed list of {bad[0][0]}")
    if bad := rows.groupBy("source1_entity_id").count().where("count > 1").limit(1).collect():
        raise SourceError(f"{predictions}: {bad[0][0]} comes again")
    found = rows.select(F.col("source1_entity_id").alias("s1"), ids_of(F.col("matched_entity_ids")).alias("predicted"))
    gold = read_truth(spark, truth)
    return {"macro_f05": metrics.macro_f05(found, gold).first()["macro_f05"], "predict_nothing": metrics.predict_nothing(gold).first()["macro_f05"], "entities": gold.count()}


def validate_files(spark: SparkSession, matching: str, required: DataFrame, valid: DataFrame | None = None, candidates: str | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a file of matches: its header, its rows, and, as a warning, matches outside the file of candidates."""
    fault = validate.header_fault(spark, matching, TRUTH)
    if fault:
        return [f"header: {fault}"], []
    found = validate.report(validate.violations(validate.lines_of(spark, matching), required, valid)).sort("rule").collect()
    errors, warnings = [f"{r['rule']}: {r['offenders']} ({r['examples']})" for r in found], []
    if candidates:
        lists = lambda path, names: read_tsv(spark, path, names).select(F.col(names[0]).alias("s1"), F.col(names[1]).alias("ids"))
        outside = validate.not_subset(lists(matching, TRUTH), lists(candidates, CANDIDATES)).count()
        warnings += [f"not_among_candidates: {outside}"] if outside else []
    return errors, warnings


# -- capacity, and what is built once


def measured(step: Callable[[], DataFrame], entities: int) -> dict:
    """Rows and seconds of a step that is carried out whole."""
    began = time.perf_counter()
    rows = step().count()
    seconds = time.perf_counter() - began
    return {"entities": entities, "pair_rows": rows, "elapsed_seconds": round(seconds, 3), "seconds_per_entity": round(seconds / entities, 6) if entities else None}


def projected(measurement: dict, entities: int, before: dict | None = None) -> dict:
    """A measurement carried on to more entities in proportion, and against an earlier one."""
    per, old = measurement["seconds_per_entity"], (before or {}).get("seconds_per_entity")
    return {"measurement": measurement, "projected_seconds": None if per is None else round(per * entities, 1), "over_before": round(per / old, 3) if per and old else None}


def ensure_index(spark: SparkSession, path: str, targets: DataFrame, build: Callable[[DataFrame], index.Index] = index.build_raw) -> index.Index:
    """The index of these targets at `path`: loaded if it was built from rows of the same hash, else built beside and moved there whole."""
    columns = [c for c in ("entity_id", "source", "business_name", "business_address", "country") if c in targets.columns]
    told = {"targets": sinks.content_hash(targets, columns).first()["sha256"], "kind": build.__name__}
    if exists(spark, f"{path}/built") and read_json(spark, f"{path}/built") == told:
        return index.load(spark, path)
    staged = f"{path}.staged"
    if exists(spark, staged):
        replace(spark, staged, f"{path}.dropped")
    build(targets).save(staged)
    sinks.write_json(spark, told, f"{staged}/built")
    replace(spark, staged, path)
    return index.load(spark, path)


def ensure_rows(spark: SparkSession, path: str, sha256: str, make: Callable[[], DataFrame], columns: list[str]) -> DataFrame:
    """Frozen rows at `path`: left alone if their hash is the frozen one, else made anew beside and moved there only if theirs is."""
    same = lambda df: sinks.content_hash(df, columns).first()["sha256"] == sha256
    if exists(spark, path) and same(spark.read.parquet(path)):
        return spark.read.parquet(path)
    staged = f"{path}.staged"
    make().write.mode("overwrite").parquet(staged)
    if not same(spark.read.parquet(staged)):
        raise SourceError(f"{staged} differs from the frozen rows; {path} was left as it was")
    replace(spark, staged, path)
    return spark.read.parquet(path)
