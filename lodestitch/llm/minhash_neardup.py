"""MinHash near-duplicates with odd sketches.

A text is the set of its distinct word shingles, as 64-bit hashes. Its MinHash samples (HASHES of
them) serve twice: groups of ROWS samples are band keys that candidates share, and all samples
are folded into an odd sketch, a bitmap of parities: sample k sets off bit hash(k, value). The
bits in which two sketches differ are the samples in which they differ, so the population count of
their XOR estimates the similarity, most precisely near one. Candidates whose estimate is far
below the threshold end there; the others are compared on their full sets.

Texts with the same set are one node, so copies cost one row, and only links between nodes that
are not yet known to be connected are looked for:

1. In each band the node of the least document is its leader. Every other node is a candidate of
   the leader it shares most bands with. Candidates whose odd sketches allow the threshold are
   compared on full sets. This alone joins most groups, however large, with one comparison per
   node; a leader's set goes once to each bounded share of its candidates.
2. What is left are bands that still hold several components. There, all pairs of different
   components meet in square cells of bounded size (a large band takes many cells, spread over
   tasks) and are held against their odd sketches; a pair counts in the first band it shares.
   What leaves a cell are the nodes with a close partner, not the pairs. These nodes meet in the
   same cells once more with their full sets, and each cell emits a spanning set of its links: a
   pair that the cell has connected already is not compared.

So no full set is read but for pairs that share a band and whose sketches are close. No pair of a
band is dropped; a pair at the threshold itself shares no band in one of 190,000 cases
((1 - 0.75^4)^32). The sketch's bound lies 4 standard deviations below the threshold.

Nulls: a null text counts as empty. A text without words has the empty set: it links with nothing
and is its own component. A null id takes part and never names a component that has another id.
Repeated rows share one component. Very long texts count whole. A pair exactly at the threshold (a
tie) is a link. Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cells, components, stored

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Bits of an odd sketch.
BITS = 1024
#: Standard deviations of the estimate that the sketch's bound leaves below the threshold.
MARGIN = 4.0
#: Nodes in a block of a band; a cell holds two blocks at most.
BLOCK = 512
#: 64-bit words of the filter that spares most texts the second exchange.
FILTER_WORDS = 1 << 17

_RNG = np.random.default_rng(20240229)
_MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """The set, ascending: one hash per distinct run of `words` words; a shorter text is one run."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def samples(own: np.ndarray) -> np.ndarray:
    """HASHES MinHash samples of a set."""
    h = mix(own ^ np.uint64(0x5851F42D4C957F2D)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[None, at : at + 4096] * _MULTIPLY + _ADD).min(axis=1), out=least)
    return least


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, HASHES) samples."""
    rows = sampled.astype(np.uint64).reshape(len(sampled), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        keys = mix(keys + rows[:, :, k])
    return keys.astype(np.int64)


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) words of (n, HASHES) samples: the parity of the samples that fall on each bit."""
    place = mix(sampled.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flat = (np.arange(len(sampled), dtype=np.int64)[:, None] * BITS + place.astype(np.int64)).ravel()
    odd = np.bincount(flat, minlength=len(sampled) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sampled), BITS), axis=1).view(np.int64)


def most_different_bits(threshold: float) -> int:
    """Bits in which sketches of sets at the threshold or above differ at most, MARGIN deviations granted."""
    low = threshold - MARGIN * (threshold * (1 - threshold) / HASHES) ** 0.5
    differing = 2 * HASHES * (1 - max(0.0, low))
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** differing)
    return int(expected + 3 * (differing / 4) ** 0.5 * 0.5) + 1


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, same, n_shingles, node binary, bands array<long>, sketch array<long>) of every row; no node for the empty set.

    `same` tells rows of one id apart by their texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                sets = [shingles(t, words) for t in pdf["text"]]
                sampled = np.stack([samples(s) for s in sets])
                keys, sketches = band_keys(sampled), odd_sketches(sampled)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"],
                        "same": pdf["same"],
                        "n_shingles": [len(s) for s in sets],
                        "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "bands": [k if len(s) else None for k, s in zip(keys, sets)],
                        "sketch": [k if len(s) else None for k, s in zip(sketches, sets)],
                    }
                )

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _same().alias("same"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, same long, n_shingles long, node binary, bands array<long>, sketch array<long>").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _same() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def grouped(docs: DataFrame, threshold: float, words: int) -> DataFrame:
    """(doc_id, same, n_shingles, component) of every row; the component is null for the empty set."""
    sig = stored(signatures(docs, words))
    nodes = sig.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles")).alias("doc"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    roots = components(links(docs, stored(nodes), round(100 * threshold), words), "binary").withColumnRenamed("root", "component")
    rows = sig.select("doc_id", "same", "n_shingles", "node").join(roots, sig["node"] == roots["node"], "left").drop(roots["node"])
    # a text that links with nothing is a component of its copies
    return stored(rows.select("doc_id", "same", "n_shingles", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept rows have the least id of their component."""
    rows = grouped(docs, threshold, words)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def sketch_distance(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ: the population count of their XOR."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def links(docs: DataFrame, nodes: DataFrame, percent: int, words: int) -> DataFrame:
    """Verified links (u, v) between nodes that connect every component; not every link inside one."""
    bits = most_different_bits(percent / 100)
    banded = nodes.select("node", "doc", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("doc", "node")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "lead")
    members = stored(banded.join(shared, "band"))

    pairs = members.where("lead.node <> node and " + f"least(doc.n_shingles, lead.doc.n_shingles) * 100 >= greatest(doc.n_shingles, lead.doc.n_shingles) * {percent}")
    pairs = pairs.groupBy("node", F.col("lead.node").alias("other")).agg(F.count(F.lit(1)).alias("n"), F.min("doc.doc_id").alias("d"), F.min("lead.doc.doc_id").alias("o"))
    best = pairs.groupBy("node").agg(F.max(F.struct("n", F.col("other"), "d", "o")).alias("x")).select(F.col("node").alias("u"), F.col("x.other").alias("v"), F.col("x.d").alias("du"), F.col("x.o").alias("dv"))
    by = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    close = best.join(by("u"), "u").join(by("v"), "v").where(sketch_distance(F.col("sketch_u"), F.col("sketch_v")) <= bits)
    first = stored(verified(docs, stored(close.select("u", "v", "du", "dv")), percent, words))

    roots = stored(components(first, "binary"))
    named = members.join(roots, "node", "left").select("band", "node", "doc", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band")
    left = named.join(mixed, "band").join(nodes.select("node", "sketch", "bands"), "node").select("band", "node", "root", F.col("doc.doc_id").alias("doc_id"), F.col("doc.n_shingles").alias("n"), "sketch", "bands")
    dealt = cells(left, ["band"], F.xxhash64("node"), BLOCK)
    near = stored(in_cells(dealt, percent, bits, False))
    sets = node_sets(docs, near.select("doc_id"), words)
    return first.unionByName(in_cells(near.join(sets, "node"), percent, bits, True))


CELL = ["band", "cell_i", "cell_j"]
NODE = "band long, cell_i int, cell_j int, block int, node binary, root binary, doc_id string, n long, sketch array<long>, bands array<long>"


def close_pairs(cell: pd.DataFrame, percent: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(a, [b, ...]) for the rows of a cell: pairs of different components whose first shared band is the
    cell's, whose sizes allow the threshold and whose odd sketches differ in at most `bits` bits."""
    n, band = len(cell), cell["band"].iat[0]
    sketch, bands = np.stack(cell["sketch"].to_numpy()).view(np.uint64), np.stack(cell["bands"].to_numpy())
    size, root = cell["n"].to_numpy(np.int64), pd.factorize(cell["root"])[0]
    block, crossed = cell["block"].to_numpy(), cell["cell_i"].iat[0] != cell["cell_j"].iat[0]
    for a in range(n - 1):
        rest = slice(a + 1, n)
        ok = (root[rest] != root[a]) & (np.minimum(size[rest], size[a]) * 100 >= np.maximum(size[rest], size[a]) * percent)
        if crossed:
            ok &= block[rest] != block[a]
        at = np.flatnonzero(ok) + a + 1
        at = at[np.bitwise_count(sketch[at] ^ sketch[a]).sum(axis=1) <= bits]
        at = at[bands[a][(bands[at] == bands[a]).argmax(axis=1)] == band]
        if len(at):
            yield a, at


def cell_links(cell: pd.DataFrame, percent: int, bits: int) -> list[tuple[int, int]]:
    """Verified links of a cell, a spanning set: pairs that it has connected before are passed over."""
    parent = list(range(len(cell)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[bytes, int] = {}
    for k, root in enumerate(cell["root"]):
        parent[k] = first.setdefault(root, k)
    sets = [set(np.frombuffer(x, np.uint64).tolist()) for x in cell["own"]]
    out = []
    for a, others in close_pairs(cell, percent, bits):
        for b in others.tolist():
            x, y = top(a), top(b)
            if x != y:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[y] = x
                    out.append((a, b))
    return out


def in_cells(dealt: DataFrame, percent: int, bits: int, exact: bool) -> DataFrame:
    """Without `exact` the rows that have a close partner in their cell; with it (and the column own) links (u, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            if len(pdf):
                edges = edges_of(pdf)
                for lo, hi in zip(edges[:-2], edges[1:-1]):  # the last cell may go on in the next batch
                    yield from one(pdf.iloc[lo:hi])
                held = pdf.iloc[edges[-2] :]
        if held is not None:
            yield from one(held)

    def edges_of(pdf: pd.DataFrame) -> list[int]:
        marks = pdf[CELL].to_numpy()
        return [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]

    def one(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(cell) < 2:
            return
        if exact:
            node = cell["node"].to_numpy()
            pairs = [sorted((node[a], node[b])) for a, b in cell_links(cell, percent, bits)]
            if pairs:
                yield pd.DataFrame(pairs, columns=["u", "v"])
        else:
            close = sorted({x for a, others in close_pairs(cell, percent, bits) for x in (a, *others.tolist())})
            if close:
                yield cell.iloc[close]

    columns = [c.split()[0] for c in NODE.split(", ")]
    rows = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).select(*columns, *(["own"] if exact else []))
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    if exact:
        return rows.mapInPandas(run, "u binary, v binary")
    return rows.mapInPandas(run, NODE).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _key(doc_id: Column) -> Column:
    """A null id is an id of its own where texts are found by id."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def node_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, own): the full sets of documents with these ids (doc_id), each node once.

    Only their texts are read again: a blocked Bloom filter of fixed size drops most others in the
    scan, an exact semi-join the rest.
    """
    from .url_filter import bloom_filter, may_contain

    ids = stored(ids.select(_key(F.col("doc_id")).alias("id")).distinct())
    hits = may_contain(bloom_filter(ids, F.col("id"), FILTER_WORDS), F.col("id"), FILTER_WORDS)
    texts = docs.select(_key(F.col("doc_id").cast("bigint")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).where(hits).join(ids, "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "own": [s.tobytes() for s in sets]})

    return stored(texts.select("text").mapInPandas(run, "node binary, own binary").groupBy("node").agg(F.first("own").alias("own")))


def verified(docs: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (u, v, du, dv) whose full sets reach the threshold, as (u, v); du and dv are ids of documents with these sets.

    u is in one pair only; v may be in very many. The u of a v are dealt to shares of about BLOCK, and
    a share gets the set of v once, before theirs.
    """
    sets = node_sets(docs, pairs.select(F.explode(F.array("du", "dv")).alias("doc_id")), words)
    shares = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shares"))
    dealt = stored(pairs.join(shares, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("shares")).alias("share")))
    heads = dealt.select("v", "share").distinct().select(F.col("v").alias("node"), "v", "share", F.lit(0).alias("after"))
    rows = heads.unionByName(dealt.select(F.col("u").alias("node"), "v", "share", F.lit(1).alias("after"))).join(sets, "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.empty(0, np.uint64)
        for pdf in batches:
            out = []
            for node, v, after, own in zip(pdf["node"], pdf["v"], pdf["after"], pdf["own"]):
                own = np.frombuffer(own, np.uint64)
                if not after:
                    head = own
                else:
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(own) - both):
                        out.append((node, v))
            yield pd.DataFrame(out, columns=["u", "v"])

    return rows.repartition("v", "share").sortWithinPartitions("v", "share", "after").mapInPandas(compare, "u binary, v binary")


def keep_one(docs: DataFrame, threshold: float = 0.75, words: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each component: that of its least id, of equal ids the text of the
    least hash, of equal rows one. A null id comes last. A text without words is a component of its own row's id and text.
    """
    rows = grouped(docs, threshold, words)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "same")
    first = rows.where("component is not null").groupBy("component").agg(F.min(row).alias("row")).select("row.*")
    first = first.unionByName(rows.where("component is null").select(row.alias("row")).select("row.*")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), _same().alias("same"))
    once = keyed.join(first, ["none", "id", "same"], "left_semi").dropDuplicates(["none", "id", "same"])
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
