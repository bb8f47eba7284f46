"""Validators of result files: each rule's offenders, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ids_of

SHOWN = 5


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(s1, ids, tabbed) of a TSV's lines but the header; blank lines dropped."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = rows.where("at > 0").select(F.split("value", "\t", 2).alias("p")).select(F.get("p", F.lit(0)).alias("s1"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("ids"), (F.size("p") > 1).alias("tabbed"))
    return parts.where("tabbed or trim(s1) <> ''")


def header_fault(spark: SparkSession, path: str, columns: list[str]) -> str | None:
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return "empty"
    if "\t" not in head[0][0] and "," in head[0][0]:
        return "comma-separated"
    return None if [c.strip().lower() for c in head[0][0].split("\t")] == columns else "header"


def violations(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(rule, offender) of result rows (s1, ids, tabbed) against required (s1) and, where given, valid (entity_id) ids."""
    good = rows.where("tabbed")
    items = good.where("trim(ids) <> ''").select("s1", F.split("ids", ",").alias("x"))
    each = items.select(F.explode(F.array_distinct("x")).alias("o"))
    rule = lambda name, df: df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).alias("offender")).distinct()
    targets = each.where("o like 'S2-%' or o like 'S3-%'")
    out = [
        rule("malformed_row", rows.where("not tabbed").select("s1")), rule("duplicate_row", good.groupBy("s1").count().where("count > 1").select("s1")),
        rule("repeated_id", items.where(F.size("x") != F.size(F.array_distinct("x"))).select("s1")), rule("self_match", each.where("o like 'S1-%'")),
        rule("wrong_prefix", each.where("o not like 'S1-%' and o not like 'S2-%' and o not like 'S3-%'")),
        rule("missing_entity", required.select("s1").join(good.select("s1"), "s1", "left_anti")), rule("unexpected_entity", good.select("s1").join(required.select("s1"), "s1", "left_anti")),
    ]
    if valid is not None:
        out.append(rule("unknown_id", targets.join(valid.select(F.col("entity_id").alias("o")), "o", "left_anti")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def report(found: DataFrame) -> DataFrame:
    """(rule, offenders, examples): each broken rule, its number of offenders and the first few.

    The first few of each rule come from a limited window, so a rule that everything breaks gathers no group.
    """
    from pyspark.sql import Window as W

    few = found.withColumn("at", F.row_number().over(W.partitionBy("rule").orderBy("offender"))).where(F.col("at") <= SHOWN)
    shown = few.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ", ").alias("examples"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("offenders")).join(shown, "rule")


def not_subset(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1, extra): matches (s1, ids) that aren't among the query's candidates (s1, ids); queries on one side only have extra null."""
    m, c = matching.select("s1", ids_of(F.col("ids")).alias("m")), candidates.select("s1", ids_of(F.col("ids")).alias("c"))
    both = m.join(c, "s1", "full")
    return both.where("m is null or c is null or size(array_except(m, c)) > 0").select("s1", F.array_join(F.array_except("m", "c"), ",").alias("extra"))


def verify_subset(matching: DataFrame, candidates: DataFrame) -> int:
    """The number of rows, if every match is a candidate."""
    if bad := not_subset(matching, candidates).limit(1).collect():
        raise ValueError(f"{bad[0]['s1']}: not among its candidates: {bad[0]['extra']}")
    return matching.count()
