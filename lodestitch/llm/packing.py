"""Best-fit packing of token sequences.

Documents are encoded, ended with an id, and cut only where they are longer than a sequence. The
pieces of the whole corpus are packed best-fit decreasing: longest first, each into the open
sequence that it fills most tightly, found by a segment tree over remaining capacities in
logarithmic time.

Pieces of one length are alike to the method, so it runs over the histogram of lengths (at most one
number per length up to `size`, whatever the corpus holds) and places a length's pieces run by
run: a run is pieces that go into neighbouring sequences of one remaining capacity, as many into
each as fit, which is what placing them one by one does. The driver holds the histogram and the
runs, both bounded by `size`. A piece then finds its sequence by its rank among the pieces of its
length: its place in its task plus the counts of the tasks before. No group of pieces is gathered.

Nulls: a null text counts as empty (a document of the end id alone); a null id stays null. Repeated
rows are packed as often as they come. A text of any length is cut as a whole. Pieces of equal
length (ties) go in the order of the scan. Empty tables give no rows. Only the id and text columns
are read, so extra columns of whatever names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import stored
from .tokenizing import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """A segment tree whose leaves are remaining capacities 0..size; a node is the number of open bins below it."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.width
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least `need` that an open bin has, or -1."""
        count, at = self.count, need + self.width
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:  # the sibling to the right holds larger capacities
                at += 1
                while at < self.width:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return -1


def best_fit_runs(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces of each length 1..size: rows (length, rank, bin, per bin, offset), ascending.

    The pieces of a length from `rank` on (up to the next run's) go `per bin` each into bins `bin`,
    `bin` + 1, ..., the first of a bin at `offset`.
    """
    tree, open_bins, n, runs = CapacityTree(size), [[] for _ in range(size + 1)], 0, []

    def leave(capacity: int, first: int, bins: int) -> None:
        if capacity and bins:
            open_bins[capacity].append((first, bins))
            tree.add(capacity, bins)

    for need in sorted(counts, reverse=True):
        rank, left = 0, counts[need]
        while left:
            room = tree.tightest(need)
            if room < 0:
                room, first, bins = size, n, -(-left // (size // need))
                n += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
            # a bin that still has room after a piece is the tightest for the next one
            per = room // need
            used = min(bins, -(-left // per))
            leave(room, first + used, bins - used)
            placed = min(left, used * per)
            full, rest = divmod(placed, per)
            leave(room - per * need, first, full)
            leave(room - rest * need, first + full, min(rest, 1))
            runs.append((need, rank, first, per, size - room))
            rank, left = rank + placed, left - placed
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def placed_by(runs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of the pieces of these lengths and ranks."""
    key = lambda length, rank: (length << 40) | rank
    run = runs[np.searchsorted(key(runs[:, 0], runs[:, 1]), key(lengths, ranks), side="right") - 1]
    at = ranks - run[:, 1]
    return run[:, 2] + at // run[:, 3], run[:, 4] + at % run[:, 3] * lengths


def cut(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, its task (part) and its place among the pieces of its length there (nth)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, part, seen = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), [0] * (size + 1)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = enc.encode(text) + end
                for piece, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start : start + 4 * size]
                    length = len(own) // 4
                    out.append((doc_id, piece, start // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            rows = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            yield rows.assign(doc_id=pd.array([None if x is None else int(x) for x in rows["doc_id"]], "Int64"))

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"{PIECES}, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = stored(cut(docs, tokenizer, size, end_id))
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    runs = best_fit_runs(dict(counts.groupBy("length").agg(F.sum("n").alias("n")).collect()), size)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        bins, offsets = placed_by(shared.value, lengths.to_numpy(np.int64), ranks.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
