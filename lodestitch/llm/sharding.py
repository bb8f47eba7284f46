"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions, racks and shards with weights. A document goes down the
tree: at each level every child draws -ln(u) / weight from a hash of (document, child), and the
least draw wins. A child wins in proportion to its weight, and its draw depends on nothing but
the document, itself and its weight: when weights change, documents move only into subtrees
whose weight grew or out of those whose weight fell.

Growth opens a region of its own for the new shard, so the only draw that is new is the new
region's: whoever moves, moves into the new shard (law `key`).

A document's place in its shard (slot) follows ascending ids. Rows are ordered by one range
exchange over (shard, id, place in the scan), so neither a large shard nor a repeated id meets in
one task; slots are then counts of the partitions before plus the place inside one.

Nulls: a null text counts as empty; a null id draws as a value of its own. Repeated rows keep
their own slots. Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import stored


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a rack and a region of its own."""
    return [*leaves, Leaf(max(x.region for x in leaves) + 1, max(x.rack for x in leaves) + 1, max(x.shard for x in leaves) + 1, weight)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{level}{child}:"), key)), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _pick(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the least draw; the lesser number wins a tie."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.least(*[F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items())])["c"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a text key, as one expression: a draw among regions, then racks, then shards."""
    weigh = lambda xs, f: {k: sum(x.weight for x in xs if f(x) == k) for k in sorted({f(x) for x in xs})}

    def choose(xs: list[Leaf], levels: list) -> Column:
        name, f = levels[0]
        children = weigh(xs, f)
        if len(levels) == 1:
            return _pick(key, name, children)
        below = {c: choose([x for x in xs if f(x) == c], levels[1:]) for c in children}
        if len(below) == 1:
            return next(iter(below.values()))
        won, out = _pick(key, name, children), None
        for c, x in below.items():
            out = F.when(won == c, x) if out is None else out.when(won == c, x)
        return out

    return choose(leaves, [("region", lambda x: x.region), ("rack", lambda x: x.rack), ("shard", lambda x: x.shard)]).cast("int")


def assign(docs: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    key, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_of(key, leaves).alias("shard"), shard_of(key, grown(leaves)).alias("grown_shard"),
        ).withColumn("place", F.monotonically_increasing_id())
    )
    ordered = stored(rows.repartitionByRange("shard", "doc_id", "place").sortWithinPartitions("shard", "doc_id", "place").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = ordered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "part", (before - F.col("first")).alias("shift"))
    return ordered.join(runs, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
