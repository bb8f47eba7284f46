"""Canonical records: one projection over raw ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import character_ngrams, normalize_country, normalize_raw, phonetic_name, source_of, with_address, with_name
from ..schema import VERSION

CANONICAL = [
    "entity_id", "source", "country", "normalized_name", "romanized_name", "accent_folded_name", "normalized_address", "source_script", "postal_code",
    "is_empty_address", "has_landmark_ref", "is_cedex", "name_tokens", "address_tokens", "normalizer_version",
]
#: Names a column may go by; the first found counts, else the place in the table.
ALIASES = {"entity_id": ("entity_id", "id"), "business_name": ("business_name", "name"), "business_address": ("business_address", "address"), "country": ("country",)}


def canonical(records: DataFrame, source: str = "") -> DataFrame:
    """CANONICAL columns of records (entity_id, business_name, business_address, country)."""
    rows = records.select("entity_id", "business_name", "business_address", normalize_country(F.col("country")).alias("country"))
    rows = with_address(with_name(rows, "business_name"), "business_address", "country")
    named = F.lit(source) if source else source_of(F.col("entity_id"))
    return rows.withColumn("source", named).withColumn("normalizer_version", F.lit(VERSION)).select(*CANONICAL)


def canonical_any(table: DataFrame, source: str = "") -> DataFrame:
    """As `canonical`, finding columns by their aliases; id and name fall back to the first and second column."""
    at = {"entity_id": 0, "business_name": 1}
    picked = []
    for want, names in ALIASES.items():
        name = next((n for n in names if n in table.columns), table.columns[at[want]] if want in at and at[want] < len(table.columns) else None)
        picked.append((F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")).alias(want))
    return canonical(table.select(*picked), source)


def canonical_view(records: DataFrame) -> DataFrame:
    """What retrieval over canonical fields reads: raw and canonical texts, distinct tokens, phonetic key, n-grams."""
    rows = records.select("entity_id", "business_name", "business_address", normalize_country(F.col("country")).alias("country"))
    rows = with_address(with_name(rows, "business_name"), "business_address", "country")
    return rows.select(
        "entity_id", "country", normalize_raw(F.col("business_name")).alias("raw_name"), normalize_raw(F.col("business_address")).alias("raw_address"),
        "normalized_name", "romanized_name", F.col("accent_folded_name").alias("accent_name"), "normalized_address", F.coalesce("postal_code", F.lit("")).alias("postal_code"),
        "source_script", F.array_distinct("name_tokens").alias("name_tokens"), F.array_distinct("address_tokens").alias("address_tokens"),
        phonetic_name(F.col("romanized_name")).alias("phonetic_name"), character_ngrams(F.col("romanized_name")).alias("name_ngrams"),
    )
