"""What several operators share: tables in the shared folder, components, cells of hot groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import remove, shared_path, stored

__all__ = ["cells", "components", "remove", "shared_path", "stored"]


#: Edges that one task joins at once, in place of further rounds.
FEW_EDGES = 1 << 15


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, to) of every node of all edges (u, v): union-find in memory."""
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = top(a), top(b)
            if a != b:
                parent[b] = a
    if parent:
        yield pd.DataFrame({"u": list(parent), "to": [top(x) for x in list(parent)]})


def components(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node that has an edge.

    Randomised contraction: in each round every node takes the name of the neighbour (or itself)
    with the least hash, edges are renamed, and loops and repeats go. Nodes shrink by a constant
    factor a round whatever the shape, so a long chain costs logarithmic rounds. Only minima and
    equi-joins against unique keys are used: no group is ever gathered, and a node with very
    many edges is split by Spark's skew join. What is left at FEW_EDGES or fewer ends in one task:
    rounds cost the driver some dozens of stages each. `root` is a name of the component, not its least node.
    """
    spark = edges.sparkSession
    here = shared_path(spark)
    stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{here}/e0")
    e, named, k = spark.read.parquet(f"{here}/e0"), None, 0
    while left := e.count():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        h = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        to = both.groupBy("u").agg(F.min(F.least(h("u"), h("v"))).alias("m")).select("u", F.col("m.n").alias("to"))
        few = left <= FEW_EDGES
        to = stored(e.coalesce(1).mapInPandas(_joined, f"u {kind}, to {kind}") if few else to, f"{here}/r{k}")
        renamed = None if few else (
            e.join(to, "u").select(F.col("to").alias("a"), "v")
            .join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        if named is None:
            named, over = to.select(F.col("u").alias("node"), F.col("to").alias("root")), [f"{here}/e{k}"]
            at = f"{here}/r{k}"
        else:
            step = to.select(F.col("u").alias("root"), F.col("to").alias("next"))
            named = stored(named.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{here}/n{k}")
            over, at = [f"{here}/e{k}", f"{here}/r{k}", at], f"{here}/n{k}"
        if renamed is not None:
            e = stored(renamed, f"{here}/e{k + 1}")
        remove(spark, *over)  # nothing reads these any more
        if renamed is None:
            break
        k += 1
    if named is None:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return named


def cells(rows: DataFrame, key: list[str], part: Column, size: int) -> DataFrame:
    """Deal the rows of each key to square cells, so that any two rows of a key meet in exactly
    one cell and no cell holds more than about two blocks of `size` rows.

    A key of n rows has b = ceil(n / size) blocks (by the hash `part`) and cells (i, j), i <= j; a
    row goes to the b cells of its block. Keys of one row are left out. Adds block, cell_i, cell_j.
    """
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / F.lit(size)).cast("int")
    return (
        rows.join(counts, key)
        .withColumn("__b", blocks)
        .withColumn("block", F.pmod(part, F.col("__b")).cast("int"))
        .withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
        .withColumn("cell_i", F.least("block", "__j"))
        .withColumn("cell_j", F.greatest("block", "__j"))
        .drop("__n", "__b", "__j")
    )
