"""Token ids in sorted-string-table shards.

A shard is one file: data blocks of documents in key order, then a sparse index (the last key,
place and size of each block), a Bloom filter over the shard's keys, and a footer of fixed size.
A key is one byte (0: null id, 1: an id) and the id as 8 big-endian bytes with its sign bit
flipped, so keys sort as ids do. Inside a block an entry holds only the bytes of its key that
differ from the key before.

Shards hold ascending ranges of keys in the order of their file names, and a footer names its
shard's first and last key. So a lookup finds the shard by binary search over footers, reads that
shard's filter, and only where it may hold the key its index, finds the block by binary search there,
and reads and walks that one block; all by seeking, no file is read as a whole. How many shards there
are follows from the bytes of text alone, not from settings of the session.

Shards are written by Spark's own text writer (each record is a block as raw bytes, the line
separator a byte between records that the index steps over), so they go through Hadoop's file
systems and the commit protocol: a task that is lost or run twice leaves no partial shard.

Nulls: a null text counts as empty; a null id has the least key. Repeated ids (ties) keep all their
rows, next to each other, in the order of the scan, in several shards if need be. Very long texts are
one entry. Empty tables give no rows. Only the id and text columns are read, so extra columns don't
matter.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import shared_path, stored
from .tokenizing import encoder

MAGIC = b"LSTITCH1"
FOOTER = struct.Struct("<QQQQQQI9s9s8s")  # index at, index size, filter at, filter size, documents, tokens, ordinal, first key, last key, magic
INDEX_ENTRY = struct.Struct("<9sQI")  # last key, place and size of a block
BLOCK_BYTES = 64_000
FILTER_BITS, FILTER_PROBES = 10, 7
#: Text bytes a shard holds about; reading all of a shard back takes its bytes in memory.
SHARD_TEXT_BYTES = 32_000_000
NULL_KEY = b"\x00" + bytes(8)


def key_of(doc_id: int | None) -> bytes:
    return NULL_KEY if doc_id is None else b"\x01" + struct.pack(">Q", (int(doc_id) + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(FILTER_PROBES)]


def make_filter(keys: list[bytes]) -> bytes:
    bits = max(64, len(keys) * FILTER_BITS)
    mask = np.zeros(bits, bool)
    for key in keys:
        mask[_probes(key, bits)] = True
    return struct.pack("<Q", bits) + np.packbits(mask, bitorder="little").tobytes()


def may_hold(filter_bytes: bytes, key: bytes) -> bool:
    bits = struct.unpack_from("<Q", filter_bytes)[0]
    return all(filter_bytes[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits))


def pack_block(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Entries (key, ids as 32-bit bytes) in key order; ids are kept in two bytes each where they fit."""
    ids = np.frombuffer(b"".join(e[1] for e in entries), "<u4")
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    head, before = [struct.pack("<IB", len(entries), 2 if narrow else 4)], b""
    for key, value in entries:
        same = next((i for i, (x, y) in enumerate(zip(key, before)) if x != y), min(len(key), len(before)))
        head.append(struct.pack("<BBI", same, len(key) - same, len(value) // 4) + key[same:])
        before = key
    return zlib.compress(b"".join(head) + ids.astype("<u2" if narrow else "<u4").tobytes(), 1)


def unpack_block(block: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
    raw = zlib.decompress(block)
    n, width = struct.unpack_from("<IB", raw)
    at, key, keys = 5, b"", []
    for _ in range(n):
        same, more, count = struct.unpack_from("<BBI", raw, at)
        key = key[:same] + raw[at + 6 : at + 6 + more]
        at += 6 + more
        keys.append((key, count))
    for key, count in keys:
        yield key, np.frombuffer(raw, f"<u{width}", count, at)
        at += count * width


class ShardWriter:
    """Turns sorted documents into the records of one shard."""

    def __init__(self, ordinal: int):
        self.ordinal, self.at, self.size, self.tokens = ordinal, 0, 0, 0
        self.block: list[tuple[bytes, bytes]] = []
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def _record(self, data: bytes) -> bytes:
        self.at += len(data) + 1  # the separator
        return data

    def _flush(self) -> bytes:
        data = pack_block(self.block)
        self.index.append(INDEX_ENTRY.pack(self.block[-1][0], self.at, len(data)))
        self.block, self.size = [], 0
        return self._record(data)

    def add(self, key: bytes, ids: bytes) -> Iterator[bytes]:
        self.block.append((key, ids))
        self.keys.append(key)
        self.size += len(ids) + len(key)
        self.tokens += len(ids) // 4
        if self.size >= BLOCK_BYTES:
            yield self._flush()

    def close(self) -> Iterator[bytes]:
        if self.block:
            yield self._flush()
        if not self.keys:
            return
        index_at, index = self.at, b"".join(self.index)
        yield self._record(index)
        filter_at, found = self.at, make_filter(self.keys)
        yield self._record(found)
        yield FOOTER.pack(index_at, len(index), filter_at, len(found), len(self.keys), self.tokens, self.ordinal, self.keys[0], self.keys[-1], MAGIC)


class Shard:
    """A shard of `size` bytes, read by its footer; `read(at, n)` gives n of its bytes. Parts are read as they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        end = size - 1  # the writer's separator after the footer
        (self.index_at, self.index_size, self.filter_at, self.filter_size, self.documents, self.tokens, self.ordinal, self.first, self.last, magic) = FOOTER.unpack(read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    @functools.cached_property
    def index(self) -> list[tuple[bytes, int, int]]:
        return list(INDEX_ENTRY.iter_unpack(self.read(self.index_at, self.index_size)))

    @functools.cached_property
    def filter(self) -> bytes:
        return self.read(self.filter_at, self.filter_size)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size in self.index:
            for key, ids in unpack_block(self.read(at, size)):
                yield id_of(key), ids

    def find(self, key: bytes) -> list[np.ndarray]:
        """The ids of every row with this key; [] if there is none."""
        out: list[np.ndarray] = []
        if not self.first <= key <= self.last or not may_hold(self.filter, key):
            return out
        for last, at, size in self.index[bisect.bisect_left([x[0] for x in self.index], key) :]:
            out += [ids for found, ids in unpack_block(self.read(at, size)) if found == key]
            if last > key:
                break
        return out


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode every whole text, append end_id, and write shards in ascending id order below `path`.

    Rows are dealt by ranges of (id, place in the scan), so a repeated id can't fill one task.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, enc = ShardWriter(TaskContext.get().partitionId()), encoder(tokenizer)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"]):
                out.extend(shard.add(key_of(None if doc_id is pd.NA else doc_id), enc.encode(text) + end))
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": list(shard.close())})

    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    # null ids come as their own kind of integer, not as floats
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from write(pdf.assign(doc_id=pd.array([pd.NA if x is None else int(x) for x in pdf["doc_id"]], "Int64")) for pdf in batches)

    dealt.mapInPandas(typed, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, place, doc_id, ids array<int>) of every document, from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                shard, rows, size = Shard.of(data), [], 0
                for place, (doc_id, ids) in enumerate(shard):
                    rows.append((shard.ordinal, place, doc_id, ids.astype("<i4")))
                    size += len(ids)
                    if size > 1 << 20:
                        yield pd.DataFrame(rows, columns=["ordinal", "place", "doc_id", "ids"]).astype({"doc_id": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["ordinal", "place", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    return _files(spark, path).mapInPandas(read, "ordinal int, place long, doc_id long, ids array<int>")


def shards_at(spark: SparkSession, path: str) -> list[Callable[[], Shard]]:
    """The shards below `path` in key order, each opened when it is called. Bytes come by seeking, from any of Hadoop's file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(int(m[1]), x) for x in fs.listStatus(folder) if x.getLen() and (m := re.match(r"part-(\d+)", x.getPath().getName()))]

    def opened(status) -> Shard:
        def read(at: int, n: int) -> bytes:
            stream = fs.open(status.getPath())
            try:
                stream.seek(at)
                return bytes(stream.readNBytes(n))
            finally:
                stream.close()

        return Shard(read, status.getLen())

    return [functools.cache(functools.partial(opened, status)) for _, status in sorted(files, key=lambda x: x[0])]


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of the asked ids, which the driver looks up one by one: for few ids; many are better joined with `read_shards`."""
    shards, rows = shards_at(spark, path), []
    for doc_id in doc_ids:
        key = key_of(doc_id)
        k = bisect.bisect_left(shards, key, key=lambda shard: shard().last)
        while k < len(shards) and shards[k]().first <= key:
            rows += [(doc_id, ids.tolist()) for ids in shards[k]().find(key)]
            k += 1
    return spark.createDataFrame(rows, "doc_id long, ids array<int>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).where("length > 0").select("content")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard), read back from the files; start counts the ids of all documents before."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                shard, rows, start = Shard.of(data), [], 0
                for doc_id, ids in shard:
                    rows.append((shard.ordinal, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pd.DataFrame(rows, columns=["shard", "doc_id", "at", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = stored(_files(spark, path).mapInPandas(read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"))
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return rows.join(starts(sums, "shard", "n"), "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def starts(sums: DataFrame, order: str, value: str, width: int = 1024) -> DataFrame:
    """(order, start): the sum of `value` over all rows of lesser `order`, in two levels, so that no window holds more than `width` rows or one row per `width`."""
    group = F.floor(F.col(order) / width)
    above = sums.groupBy(group.alias("g")).agg(F.sum(value).alias("s"))
    above = above.select("g", F.coalesce(F.sum("s").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("g", group).withColumn("inside", inside).join(above, "g").select(order, (F.col("base") + F.col("inside")).alias("start"))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write `docs` as shards and return the digests read back from them."""
    path = path or shared_path(docs.sparkSession)
    write_shards(docs, path, tokenizer, end_id)
    return digests(docs.sparkSession, path)
