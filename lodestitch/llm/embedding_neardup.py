"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are vectors of a bounded sample, taken farthest first and never closer
than SPREAD: however dense a region, few pivots lie in it, so its vectors are told apart by pivots
that a pair of near-duplicates sees in almost the same order. Vectors spread less than that have
few pivots and all meet. The number of pivots grows with the square root of the indexed classes, up
to MAX_PIVOTS, so that lists grow slower than the corpus. A vector is described by its NEAREST
closest pivots in order of distance.

The inverted lists are keyed by SHARED pivots at once: a vector enters the list of every
SHARED-subset of its description, so two vectors meet in a list exactly if they share at least
SHARED pivots. A list of many classes is dealt to square cells of bounded size. In a cell, pivots
that a pair shares up to the list's greatest one are counted first: a count of SHARED means that
this list holds the least subset the pair shares, and only there is it a candidate, once. Rows carry
descriptions so far, no vectors. Nodes with a candidate meet in the same cells once more with
their vectors, and candidates are verified by their cosine in double precision. What leaves a cell
are its nodes' numbers of links and a spanning set of them, not all pairs.

Equal vectors are one class with a count; only classes are indexed.

Each label is searched on its own. Nulls: a vector without a label, or that is null, zero, or
holds a null or non-finite component, links with nothing and is its own component. Vectors of
different lengths are never linked; lengths too rare for the sample have no pivots and all meet.
Repeated ids are vectors of their own. A cosine of exactly the threshold (a tie) is a link; of
pivots at the same distance the lesser comes first. Empty tables give no rows. Only the id, vector
and label columns are read, so extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cells, components, stored

#: Pivots of a vector length: PER_ROOT times the square root of the classes, within these bounds.
PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 1, 64, 1024
#: Classes that pivots are chosen from, those of the least hashes.
SAMPLE = 4096
#: Greatest cosine between two pivots.
SPREAD = 0.7
#: Pivots in a description, and how many of them a pair must share.
NEAREST, SHARED = 7, 3
BLOCK = 1024
#: Cells of at most SMALL rows are compared pair by pair, many cells and some PAIRS of them at once; larger ones as matrices.
SMALL, PAIRS = 64, 1 << 15
#: Lists are numbered in this base.
BASE = 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the greatest component first, so that no square leaves the range of doubles."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def pivots_for(classes: int) -> int:
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, PER_ROOT * classes**0.5)))


def spread_pivots(vectors: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the unit vectors: the first, then each time the one farthest from those taken, while its cosine to them is at most SPREAD."""
    at = [0]
    near = vectors @ vectors[0]
    while len(at) < most and near[k := int(near.argmin())] <= SPREAD:
        at.append(k)
        near = np.maximum(near, vectors @ vectors[k])
    return vectors[at]


def describe(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, NEAREST) pivots of unit vectors, nearest first; of equal distances the lesser pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, : min(NEAREST, len(pivots))]


def list_keys(order: np.ndarray) -> np.ndarray:
    """(n, subsets) keys: the pivots of each SHARED-subset of a description, ascending, as one number."""
    if order.shape[1] < SHARED:
        return np.zeros((len(order), 1), np.int64)  # too few pivots to tell vectors apart: one list
    chosen = np.sort(order, axis=1)[:, np.array(list(combinations(range(order.shape[1]), SHARED)))]
    return (chosen * (BASE ** np.arange(SHARED - 1, -1, -1))).sum(axis=2)


def candidates(order: np.ndarray, key: int, block: np.ndarray, crossed: bool) -> np.ndarray:
    """(n, n) booleans for the members of a cell of list `key`: the pairs that are candidates there.

    All share the list's SHARED pivots, and so as many at least. Of the pivots up to the greatest of
    these, a pair that shares no more is in no list of a lesser subset.
    """
    n = len(order)
    if order.shape[1] < SHARED:
        found = np.ones((n, n), bool)
    else:
        low, place = np.unique(order, return_inverse=True)
        hot = np.zeros((n, len(low)), np.float32)
        np.put_along_axis(hot, place.reshape(order.shape), 1, axis=1)
        hot = hot[:, low <= key % BASE]
        found = hot @ hot.T == SHARED
    if crossed:
        found &= block[:, None] != block[None, :]
    np.fill_diagonal(found, False)
    return found


def verified(found: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidates (n, n) of unit vectors reach the threshold."""
    near = np.zeros_like(found)
    for at in range(0, len(x), 256):
        some = found[at : at + 256]
        if some.any():
            near[at : at + 256] = some & (x[at : at + 256] @ x.T >= threshold - 1e-9)
    a, b = np.nonzero(np.triu(near))
    for at in range(0, len(a), 1 << 16):  # the product of blocks sums in an order of its own
        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        near[p, q] = near[q, p] = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
    return near


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what `near` connects."""
    seen, out = np.zeros(len(near), bool), []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not seen[start]:
            seen[start], open_ = True, [start]
            while open_:
                a = open_.pop()
                new = np.flatnonzero(near[a] & ~seen).tolist()
                seen[new] = True
                out += [(a, b) for b in new]
                open_ += new
    return out


CELL = ["label", "size", "list", "cell_i", "cell_j"]
MEMBER = "label long, size int, list long, cell_i int, cell_j int, block int, node long, order array<int>"


def by_cell(rows: DataFrame, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str) -> DataFrame:
    """What `work` makes of many whole cells at once: their rows, and the places where cells begin and where the last one ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            edges = edges_of(pdf, CELL)
            if edges[-2] and (out := work(pdf.iloc[: edges[-2]], edges[:-1])) is not None:
                yield out
            held = pdf.iloc[edges[-2] :]  # the last cell may go on in the next batch
        if held is not None and len(held) > 1 and (out := work(held, np.array([0, len(held)]))) is not None:
            yield out

    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(run, schema)


def edges_of(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where runs of rows that agree in the columns begin, and where the last one ends."""
    marks = pdf[columns].to_numpy()
    return np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(pdf)]])


def small_pairs(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b: the pairs of all cells of at most SMALL rows, some PAIRS at once."""
    sizes = np.diff(edges)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        i, j = np.triu_indices(n, 1)
        starts = edges[:-1][sizes == n]
        step = max(1, PAIRS // len(i))
        for at in range(0, len(starts), step):
            some = starts[at : at + step, None]
            yield (some + i).ravel(), (some + j).ravel()


class Cells:
    """Whole cells of vectors of one size, as arrays; says which pairs are candidates."""

    def __init__(self, pdf: pd.DataFrame, edges: np.ndarray):
        self.edges = edges
        self.order = np.concatenate(pdf["order"].to_numpy()).reshape(len(pdf), -1)
        self.list, self.block = pdf["list"].to_numpy(), pdf["block"].to_numpy()
        self.crossed = (pdf["cell_i"] != pdf["cell_j"]).to_numpy()
        self.every = self.order.shape[1] < SHARED
        whole = self.order.astype(np.int32)
        # a column a pivot, for long runs of equal comparisons; pivots beyond the list's greatest aren't counted
        self.theirs, self.own = np.ascontiguousarray(whole.T), np.ascontiguousarray(np.where(whole <= (self.list % BASE)[:, None], whole, -1).T)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b): the candidates in small cells, as `candidates` finds them."""
        for a, b in small_pairs(self.edges):
            ok = ~self.crossed[a] | (self.block[a] != self.block[b])
            if not self.every:
                n = np.zeros(len(a), np.int8)
                theirs = [row[b] for row in self.theirs]
                for row in self.own:
                    mine = row[a]
                    for other in theirs:
                        n += mine == other
                ok &= n == SHARED
            if ok.any():
                yield a[ok], b[ok]

    def large(self) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, booleans of `candidates`) of each larger cell."""
        for lo, hi in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            if hi - lo > SMALL:
                yield slice(lo, hi), candidates(self.order[lo:hi], int(self.list[lo]), self.block[lo:hi], bool(self.crossed[lo]))


def by_size(work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None]) -> Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None]:
    """`work` for cells of any sizes of vectors: once for each run of cells of one label and size."""

    def run(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame | None:
        if pdf["size"].iat[0] == pdf["size"].iat[-1] and (pdf["size"] == pdf["size"].iat[0]).all():
            return work(pdf, edges)
        cuts = edges_of(pdf, ["size"])
        found = [out for lo, hi in zip(cuts[:-1], cuts[1:]) if (out := work(pdf.iloc[lo:hi], edges[(edges >= lo) & (edges <= hi)] - lo)) is not None]
        return pd.concat(found, ignore_index=True) if found else None

    return run


def retrieved(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame | None:
    """The rows that have a candidate in their cell."""
    cells_, some = Cells(pdf, edges), np.zeros(len(pdf), bool)
    for a, b in cells_.pairs():
        some[a] = some[b] = True
    for rows, found in cells_.large():
        some[rows] = found.any(axis=1)
    return pdf[some] if some.any() else None


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of pairs that connect what all pairs connect."""
    parent: dict[int, int] = {}
    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        while (up := parent.get(y, y)) != y:
            parent[y] = y = parent.get(up, up)
        if x != y:
            parent[y] = x
            out.append(k)
    return out


def found_links(pdf: pd.DataFrame, edges: np.ndarray, threshold: float) -> pd.DataFrame | None:
    """(u, v, n) of the cells: spanning links, and with v = -1 the copies of what u is linked with."""
    cells_, node, copies = Cells(pdf, edges), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    x = np.concatenate(pdf["unit"].to_numpy()).reshape(len(pdf), -1)
    others, us, vs = np.zeros(len(pdf), np.int64), [], []
    for a, b in cells_.pairs():
        step = max(1, (1 << 21) // x.shape[1])
        near = np.concatenate([np.einsum("ij,ij->i", x[a[at : at + step]], x[b[at : at + step]]) >= threshold for at in range(0, len(a), step)])
        a, b = a[near], b[near]
        np.add.at(others, a, copies[b])
        np.add.at(others, b, copies[a])
        kept = forest(a, b)
        us.append(node[a[kept]])
        vs.append(node[b[kept]])
    for rows, found in cells_.large():
        near = verified(found, x[rows], threshold)
        others[rows] = near @ copies[rows]
        links = np.array(spanning(near), np.int64).reshape(-1, 2)
        us.append(node[rows][links[:, 0]])
        vs.append(node[rows][links[:, 1]])
    some = others > 0
    if not some.any():
        return None
    us.append(node[some])
    zeros = np.zeros(sum(map(len, vs)), np.int64)
    vs.append(np.full(some.sum(), -1))
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "n": np.concatenate([zeros, others[some]])})


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (vec_id, class or null), classes (class, label, vec, copies); equal vectors of a label are one class."""
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    same = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("vec", lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string")))), 256)
    rows = stored(own.withColumn("class", F.when(F.coalesce(usable, F.lit(False)), same)))
    classes = rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    return rows.select("vec_id", "class"), stored(classes.withColumn("node", F.monotonically_increasing_id()))


def described(classes: DataFrame) -> DataFrame:
    """(node, label, copies, size, order, lists, unit) of every class; pivots come from a bounded sample and are broadcast."""
    drawn = classes.select("vec", F.xxhash64("class").alias("h")).orderBy("h", "vec").limit(SAMPLE).toArrow()["vec"].combine_chunks()
    starts, values = drawn.offsets.to_numpy(), drawn.values.to_numpy()
    found = [values[a:b] for a, b in zip(starts[:-1], starts[1:])]
    most = pivots_for(classes.count())
    by_size = {d: spread_pivots(unit(np.array([v for v in found if len(v) == d])), most) for d in sorted({len(v) for v in found})}
    shared = classes.sparkSession.sparkContext.broadcast(by_size)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["vec"].map(len)
            for d, own in pdf.groupby(lengths):
                x = unit(np.stack(own["vec"].to_numpy()))
                order = describe(x, shared.value.get(d, np.empty((0, d))))
                yield pd.DataFrame({"node": own["node"], "label": own["label"], "copies": own["copies"], "size": d, "order": list(order.astype(np.int32)), "lists": list(list_keys(order)), "unit": list(x)})

    return classes.select("node", "label", "copies", "vec").mapInPandas(index, "node long, label long, copies long, size int, order array<int>, lists array<long>, unit array<double>")


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n) between classes (node, label, copies, vec). Rows with v >= 0 are links that connect every component; with
    v = -1 n is the copies of classes that u is linked with, to be summed."""
    members = stored(described(classes))
    listed = members.select("node", "label", "size", "order", F.explode("lists").alias("list"))
    dealt = cells(listed, ["label", "size", "list"], F.xxhash64("node"), BLOCK)

    def verify(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame | None:
        return found_links(pdf, edges, threshold)

    columns = [c.split()[0] for c in MEMBER.split(", ")]
    met = stored(by_cell(dealt.select(*columns), by_size(retrieved), MEMBER))
    return by_cell(met.join(members.select("node", "copies", "unit"), "node").select(*columns, "copies", "unit"), by_size(verify), "u long, v long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; kept vectors have the least id of their component."""
    rows, classes = classes_of(vectors)
    linked = stored(class_links(classes, threshold))
    others = linked.where("v < 0").groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(linked.where("v >= 0").select("u", "v"))
    named = classes.select("class", "node", "copies").join(others, F.col("node") == F.col("u"), "left").drop("u").join(roots, "node", "left")
    named = named.select("class", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = stored(rows.join(named, "class", "left"))
    least = out.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
