"""Stratified splits and samples: largest remainders over strata, hash order inside them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import bucket_name


def strata(records: DataFrame) -> DataFrame:
    """(s1, country, bucket) of records (s1, country, n)."""
    return records.select("s1", "country", bucket_name(F.col("n")).alias("bucket"))


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """Adds take to strata (country, bucket, n): shares of `total` in proportion, the leftover to the largest remainders.

    One row per stratum goes in, so the windows over all of them are small.
    """
    every = W.partitionBy()
    rows = sizes.withColumn("__all", F.sum("n").over(every))
    rows = rows.withColumn("__base", F.expr(f"({total} * n) div __all")).withColumn("__rest", F.expr(f"({total} * n) % __all"))
    rows = rows.withColumn("__left", F.lit(total) - F.sum("__base").over(every)).withColumn("__at", F.row_number().over(W.orderBy(F.desc("__rest"), "country", "bucket")))
    return rows.withColumn("take", (F.col("__base") + (F.col("__at") <= F.col("__left")).cast("int")).cast("bigint")).drop("__all", "__base", "__rest", "__left", "__at")


def allocate(rows: DataFrame, loop: int = 25_000, percent: int = 10) -> DataFrame:
    """(country, bucket, n, report, loop, fit): report is floor(n * percent / 100) of each stratum, loop a largest-remainder share, fit the rest."""
    sizes = rows.groupBy("country", "bucket").agg(F.count(F.lit(1)).alias("n"))
    out = largest_remainder(sizes, loop).select("country", "bucket", "n", F.expr(f"n * {percent} div 100").alias("report"), F.col("take").alias("loop"))
    return out.withColumn("fit", F.col("n") - F.col("report") - F.col("loop"))


def check_allocation(allocation: DataFrame) -> None:
    if bad := allocation.where("fit < 0").limit(1).collect():
        raise ValueError(f"stratum {bad[0]['country']}/{bad[0]['bucket']} is too small for its shares")


def assign(rows: DataFrame, allocation: DataFrame, seed: int = 42) -> DataFrame:
    """(s1, country, bucket, split): in hash order of each stratum the first are report, the next loop, the rest fit."""
    place = F.row_number().over(W.partitionBy("country", "bucket").orderBy(F.xxhash64("s1", F.lit(seed)), "s1"))
    at = rows.withColumn("at", place).join(allocation.select("country", "bucket", "report", "loop"), ["country", "bucket"])
    split = F.when(F.col("at") <= F.col("report"), "report").when(F.col("at") <= F.col("report") + F.col("loop"), "loop").otherwise("fit")
    return at.select("s1", "country", "bucket", split.alias("split"))


def assign_seeded(ids: dict[tuple[str, str], list[str]], shares: dict[tuple[str, str], tuple[int, int]], seed: int = 42) -> dict[str, str]:
    """The same by one seeded generator that walks the strata in order, for id lists that fit on the driver."""
    rng, out = random.Random(seed), {}
    for key in sorted(ids):
        own = sorted(ids[key])
        rng.shuffle(own)
        report, loop = shares[key]
        out |= {s: "report" if k < report else "loop" if k < report + loop else "fit" for k, s in enumerate(own)}
    return out


def draw(rows: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """(s1): a stratified sample of `total` queries."""
    sizes = largest_remainder(rows.groupBy("country", "bucket").agg(F.count(F.lit(1)).alias("n")), total)
    if sizes.where("take > n").limit(1).collect() or (sizes.agg(F.sum("n")).first()[0] or 0) < total:
        raise ValueError("the sample is larger than the population")
    place = F.row_number().over(W.partitionBy("country", "bucket").orderBy(F.xxhash64("s1", F.lit(seed)), "s1"))
    return rows.withColumn("at", place).join(sizes, ["country", "bucket"]).where("at <= take").select("s1")


def assert_disjoint(*parts: DataFrame) -> None:
    both = parts[0].select("s1")
    for p in parts[1:]:
        both = both.unionByName(p.select("s1"))
    if bad := both.groupBy("s1").count().where("count > 1").limit(1).collect():
        raise ValueError(f"{bad[0]['s1']} is in several splits")


def assert_no_leak(sample: DataFrame, fit: DataFrame) -> None:
    if bad := sample.select("s1").join(fit.select("s1"), "s1", "left_anti").limit(1).collect():
        raise ValueError(f"{bad[0]['s1']} isn't of the fit split")


def check(assigned: DataFrame, rows: DataFrame) -> None:
    """Splits are disjoint, and hold every query."""
    assert_disjoint(assigned)
    if rows.select("s1").exceptAll(assigned.select("s1")).limit(1).collect():
        raise ValueError("a query is in no split")
