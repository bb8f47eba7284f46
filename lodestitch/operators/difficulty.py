"""The difficulty pack: true pairs and near misses by kind; and slice labels."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import bucket_name, is_legal_variant, jaccard, overlap_bucket, script_class, word_set
from ..schema import PACK
from .retrieve import token_neighbours

#: Kinds in the order in which they are filled, and the bounds that define them.
KINDS = [
    "easy_latin", "legal_suffix", "low_overlap", "accented_latin", "indic_other_side", "empty_address_match", "multi_id", "unmatched_distractor_near_miss",
    "stolen_neighborhood_near_miss", "singleton_lookalike", "singleton_isolated",
]
NEAR_MISS_MIN, ISOLATED_MAX, LOW_OVERLAP_MAX, EASY_NAME_MIN, EASY_ADDRESS_MIN = 0.5, 0.10, 0.10, 0.70, 0.30
PER_KIND = 30


def eligible(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, related, kind, bucket, reason) of every query and kind it is eligible for; records hold all sources."""
    own = records.select("entity_id", "business_name", "business_address", "country", word_set(F.col("business_name")).alias("words"), word_set(F.col("business_address")).alias("places"))
    side = lambda p, key: own.select(F.col("entity_id").alias(key), *[F.col(c).alias(p + c) for c in ("business_name", "business_address", "words", "places")])
    links = truth.select("s1", F.explode("targets").alias("cand"))
    pairs = links.join(side("l_", "s1"), "s1").join(side("r_", "cand"), "cand")
    pairs = pairs.withColumn("j", jaccard(F.col("l_words"), F.col("r_words"), 0.0)).withColumn("aj", jaccard(F.col("l_places"), F.col("r_places"), 0.0)).withColumn("cls", script_class(F.col("r_business_name")))
    blank = F.btrim("r_business_address") == ""
    say = lambda text, value: F.format_string(text + "%.2f", value)
    tests = [
        ("easy_latin", (F.col("cls") == "latin") & (F.col("j") >= EASY_NAME_MIN) & ~blank & (F.col("aj") >= EASY_ADDRESS_MIN), overlap_bucket(F.col("j")), say("latin near-exact j=", F.col("j"))),
        ("legal_suffix", is_legal_variant(F.col("l_business_name"), F.col("r_business_name")), overlap_bucket(F.col("j")), F.lit("legal-suffix/word-order variant")),
        ("low_overlap", F.col("j") <= LOW_OVERLAP_MAX, overlap_bucket(F.col("j")), say("gold pair low overlap j=", F.col("j"))),
        ("accented_latin", F.col("cls") == "accented_latin", F.lit("na"), F.lit("accented-latin target name")),
        ("indic_other_side", F.col("cls") == "indic", F.lit("na"), F.lit("indic target name vs latin source1")),
        ("empty_address_match", blank, F.lit("na"), F.lit("gold target has empty address")),
    ]
    fits = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), bucket.alias("bucket"), reason.alias("reason"))) for kind, test, bucket, reason in tests]))
    rows = pairs.select("s1", F.col("cand").alias("related"), F.explode(fits).alias("x")).select("s1", "related", "x.*")

    n = F.size("targets")
    rows = rows.unionByName(truth.where((n == 4) | (n == 5)).select("s1", F.array_join("targets", ",").alias("related"), F.lit("multi_id").alias("kind"), F.lit("na").alias("bucket"), F.format_string("full gold list length %d", n).alias("reason")))

    queries = own.join(truth.select(F.col("s1").alias("entity_id"), "targets"), "entity_id").withColumnRenamed("entity_id", "s1")
    near = token_neighbours(queries, own.where("entity_id not like 'S1-%'"))
    owner = links.groupBy("cand").agg(F.max("s1").alias("owner"))
    near = near.join(queries.select("s1", "targets"), "s1").join(owner, "cand", "left")
    miss = near.where((F.size("targets") > 0) & ~F.array_contains("targets", F.col("cand")) & (F.col("jaccard") >= NEAR_MISS_MIN) & (F.col("owner").isNull() | (F.col("owner") != F.col("s1"))))
    miss = miss.withColumn("kind", F.when(F.col("owner").isNull(), "unmatched_distractor_near_miss").otherwise("stolen_neighborhood_near_miss"))
    first = miss.withColumn("at", F.row_number().over(W.partitionBy("s1", "kind").orderBy(F.desc("jaccard"), "cand"))).where("at = 1")
    reason = F.when(F.col("owner").isNull(), say("non-match lookalike j=", F.col("jaccard"))).otherwise(F.concat(F.lit("owned by "), "owner", say(" j=", F.col("jaccard"))))
    rows = rows.unionByName(first.select("s1", F.col("cand").alias("related"), "kind", overlap_bucket(F.col("jaccard")).alias("bucket"), reason.alias("reason")))

    alone = truth.where(F.size("targets") == 0).select("s1")
    best = near.groupBy("s1").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "cand")).alias("b"))
    alone = alone.join(best, "s1", "left").select("s1", F.col("b.cand").alias("cand"), F.coalesce(-F.col("b.j"), F.lit(0.0)).alias("j"))
    look = F.col("cand").isNotNull() & (F.col("j") >= NEAR_MISS_MIN)
    alone = alone.where(look | (F.col("j") <= ISOLATED_MAX)).select(
        "s1", F.when(look, F.col("cand")).otherwise("").alias("related"), F.when(look, "singleton_lookalike").otherwise("singleton_isolated").alias("kind"),
        F.when(look, overlap_bucket(F.col("j"))).otherwise("none").alias("bucket"), F.when(look, say("singleton with lookalike j=", F.col("j"))).otherwise("singleton, no close neighbour").alias("reason"),
    )
    return rows.unionByName(alone)


def pack(rows: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """(source1_entity_id, related_entity_ids, kind, overlap_bucket, reason): kinds are filled in order, each query used once.

    A kind takes its `per_kind` first queries not used by kinds before it: eleven steps, each a top-n
    on the cluster that gives the driver `per_kind` rows at most.
    """
    used: list[str] = []
    picked: list[tuple] = []
    for kind in KINDS:
        own = rows.where(F.col("kind") == kind)
        if used:
            own = own.where(~F.col("s1").isin(used))
        once = own.groupBy("s1").agg(F.min(F.struct("related", "bucket", "reason")).alias("x")).orderBy("s1").limit(per_kind).select("s1", "x.*").collect()
        used += [r["s1"] for r in once]
        picked += [(r["s1"], r["related"], kind, r["bucket"], r["reason"]) for r in once]
    return rows.sparkSession.createDataFrame(picked, ", ".join(f"{c} string" for c in PACK))


def slices(records: DataFrame, truth: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """(s1, country, singleton, gold_list_bucket, target_empty_address, source_composition, target_script_class, and with
    predictions cross_country_prediction, false_id_type, predicted_vs_gold_length) of each query."""
    own = records.select("entity_id", "business_name", "business_address", "country")
    rows = truth.join(own.select(F.col("entity_id").alias("s1"), "country"), "s1")
    has = lambda s: F.exists("targets", lambda x: x.startswith(s))
    label = F.when(F.col("country").isin("US", "India", "France"), F.col("country")).otherwise("OTHER")
    made = F.when(has("S2") & has("S3"), "both").when(has("S2"), "s2_only").when(has("S3"), "s3_only").otherwise("none")
    rows = rows.select("s1", "targets", F.col("country").alias("own"), label.alias("country"), (F.size("targets") == 0).alias("singleton"), bucket_name(F.size("targets")).alias("gold_list_bucket"), made.alias("source_composition"))
    links = truth.select("s1", F.explode("targets").alias("entity_id")).join(own, "entity_id")
    per = links.groupBy("s1").agg(F.max(F.btrim("business_address") == "").alias("target_empty_address"), F.max(F.struct(F.when(script_class(F.col("business_name")) == "indic", 2).when(script_class(F.col("business_name")) == "accented_latin", 1).otherwise(0).alias("k"))).alias("c"))
    rows = rows.join(per, "s1", "left").withColumn("target_empty_address", F.coalesce("target_empty_address", F.lit(False)))
    rows = rows.withColumn("target_script_class", F.when(F.col("c.k") == 2, "indic").when(F.col("c.k") == 1, "accented_latin").when(F.col("c.k") == 0, "latin").otherwise("none")).drop("c")
    if predictions is None:
        return rows.drop("targets", "own")
    owned = truth.select(F.explode("targets").alias("entity_id")).distinct().withColumn("owned", F.lit(True))
    wrong = predictions.select("s1", F.explode("predicted").alias("entity_id")).join(rows.select("s1", "targets", "own"), "s1").join(own.select("entity_id", F.col("country").alias("theirs")), "entity_id", "left").join(owned, "entity_id", "left")
    false_ = ~F.array_contains("targets", F.col("entity_id"))
    per = wrong.groupBy("s1").agg(F.max(F.coalesce(F.col("own") != F.col("theirs"), F.lit(False))).alias("cross_country_prediction"), F.max(false_ & F.col("owned").isNotNull()).alias("stolen"), F.max(false_ & F.col("owned").isNull()).alias("unmatched"))
    rows = rows.join(per, "s1", "left").join(predictions, "s1", "left")
    n, g = F.coalesce(F.size("predicted"), F.lit(0)), F.size("targets")
    return rows.select(
        *[c for c in rows.columns if c not in ("targets", "own", "cross_country_prediction", "stolen", "unmatched", "predicted")], F.coalesce("cross_country_prediction", F.lit(False)).alias("cross_country_prediction"),
        F.when(F.coalesce("stolen", F.lit(False)), "stolen_id").when(F.coalesce("unmatched", F.lit(False)), "unmatched_distractor").otherwise("none").alias("false_id_type"),
        F.when(n > g, "longer").when(n == g, "equal").otherwise("shorter").alias("predicted_vs_gold_length"),
    )


#: Slice keys, their level and closed categories.
SLICES = {
    "country": ("entity", ["US", "India", "France", "OTHER"], True), "singleton": ("entity", [], False), "gold_list_bucket": ("entity", ["0", "1", "2-3", "4-5", "6+"], False),
    "target_empty_address": ("entity", [], False), "source_composition": ("entity", ["none", "s2_only", "s3_only", "both"], False), "short_name": ("entity", [], False), "generic_name": ("entity", [], False),
    "target_script_class": ("entity", ["latin", "accented_latin", "indic"], False), "cross_country_prediction": ("prediction", [], False), "false_id_type": ("prediction", ["stolen_id", "unmatched_distractor"], False),
    "predicted_vs_gold_length": ("prediction", ["longer", "equal", "shorter"], False),
}


def slice_document() -> dict:
    return {"version": "1", "slices": [{"key": k, "level": level, "categories": c, "open_set": o} for k, (level, c, o) in SLICES.items()]}


def validate_slices(document: dict) -> None:
    """Refuses missing fields, repeated or unknown keys, a level or categories of the wrong kind."""
    seen = set()
    for s in document.get("slices") or [{}]:
        if {"key", "level", "categories", "open_set"} - s.keys():
            raise ValueError("a slice lacks a field")
        if s["key"] in seen or s["key"] not in SLICES:
            raise ValueError(f"slice {s['key']} is repeated or unknown")
        if s["level"] not in ("entity", "prediction") or not isinstance(s["categories"], list) or not isinstance(s["open_set"], bool):
            raise ValueError(f"slice {s['key']} has a field of the wrong kind")
        seen.add(s["key"])


def slice_hash(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
