"""The pair classifier: gradient-boosted trees of Spark's ML library, early-stopped on held-out queries."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Boosting rounds at most, and the gain on held-out queries below which a round is the last.
ROUNDS, LEAST_GAIN = 300, 0.01


def holdout(strata: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(s1): of each stratum (columns besides s1) the first floor(n * fraction) queries in hash order."""
    by = [c for c in strata.columns if c != "s1"]
    w = W.partitionBy(*by)
    rows = strata.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__at", F.row_number().over(w.orderBy(F.xxhash64("s1", F.lit(seed)), "s1")))
    return rows.where(F.col("__at") <= F.floor(F.col("__n") * fraction)).select("s1")


def vectors(features: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="__x").transform(features)


def train(labelled: DataFrame, names: list[str], rounds: int = ROUNDS, depth: int = 5, rate: float = 0.1, seed: int = 42) -> GBTClassificationModel:
    """Fit on rows (features, label, is_held); held-out rows only stop the boosting."""
    gbt = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed, validationIndicatorCol="is_held", validationTol=LEAST_GAIN, minInstancesPerNode=5)
    return gbt.fit(vectors(labelled, names))


def probabilities(model: GBTClassificationModel, features: DataFrame, names: list[str]) -> DataFrame:
    """(s1, cand, prob)."""
    return model.transform(vectors(features, names)).select("s1", "cand", vector_to_array("probability")[1].alias("prob"))


def save(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)
