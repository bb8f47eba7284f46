"""Decisions: candidates kept at a threshold, and the threshold with the best macro F0.5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import f05


def kept(scored: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(s1, predicted array): candidates of probability >= threshold, the surest first; every query has a row."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    lists = scored.where(F.col("prob") >= threshold).groupBy("s1").agg(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), "cand"))).alias("x"))
    return queries.select("s1").join(lists, "s1", "left").select("s1", F.coalesce(F.transform("x", lambda y: y["cand"]), F.array().cast("array<string>")).alias("predicted"))


def by_threshold(scored: DataFrame, truth: DataFrame, steps: int = 100) -> DataFrame:
    """(threshold, macro_f05) for thresholds 0, 1/steps, ..., 1.

    A candidate counts for the thresholds up to floor(prob * steps): counts per query and step are
    summed from above, so the work is a row per query and distinct step, not per candidate and threshold.
    Queries that no candidate reaches count 1 if they have no truth.
    """
    links = truth.select("s1", F.explode("targets").alias("cand"), F.lit(1).alias("hit"))
    at = F.least(F.floor(F.round(F.col("prob") * steps, 9)), F.lit(steps)).cast("int")
    steps_of = scored.join(links, ["s1", "cand"], "left").groupBy("s1", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    per = truth.select("s1", F.size("targets").alias("t")).join(steps_of.groupBy("s1").agg(F.collect_list(F.struct("at", "n", "hits")).alias("x")), "s1", "left")
    grid = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    above = F.filter(F.coalesce("x", F.array().cast("array<struct<at:int,n:bigint,hits:bigint>>")), lambda y: y["at"] >= F.col("k"))
    add = lambda name: F.aggregate(above, F.lit(0).cast("bigint"), lambda a, y: a + y[name])
    n, hits, t = F.col("n"), F.col("hits").cast("double"), F.col("t")
    score = F.when((n == 0) & (t == 0), 1.0).when(hits == 0, 0.0).otherwise(1.25 * (hits / n) * (hits / t) / (0.25 * hits / n + hits / t))
    return grid.withColumn("n", add("n")).withColumn("hits", add("hits")).groupBy((F.col("k") / steps).alias("threshold")).agg(F.round(F.avg(score), 9).alias("macro_f05"))


def choose_threshold(scored: DataFrame, truth: DataFrame, steps: int = 100) -> DataFrame:
    """(threshold, macro_f05): the best; of equal ones the higher."""
    return by_threshold(scored, truth, steps).orderBy(F.desc("macro_f05"), F.desc("threshold")).limit(1)


def macro_at(scored: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    both = kept(scored, truth, threshold).join(truth, "s1")
    return both.agg(F.round(F.avg(f05(F.col("predicted"), F.col("targets"))), 9).alias("macro_f05"))
