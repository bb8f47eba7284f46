"""URL filters by a blocked Bloom filter and an exact hash join; built-in functions only.

A list holds canonical URLs (host, path): an entry stands for the URLs of its host and of all the
host's subdomains whose path starts with the entry's. Beside the list stand rules of the same form
with a verdict of their own. An entry's key is its host and the first p characters of its path, p
being the greatest power of two (or zero) that the path is long. A URL spells the keys that it may
fit: for each shape in the list (labels of the host, p), its last labels and first characters; so
there are as many shapes as lengths of hosts times the logarithm of the longest path, however
long the list is. Each spelling is looked up in a blocked Bloom filter of the list's keys (each sets
PROBES bits within one 64-bit word), whose size follows the list's count up to MAX_WORDS.

Only possible hits leave the scan: they go to the exact hash join with the list, which removes the
filter's false positives, and of the entries that fit, the longest wins. Pages without a possible
hit are not exchanged. Spark broadcasts the list where its measured size is small, else both sides
are exchanged and large keys split.

Rules are held against the host as it stands in the URL. Listed URLs are held against the canonical
host, in the list as in the pages: without user part, port and one dot at its end.

Nulls: a null URL or one without "://" has an empty host and path, and fits nothing. Entries with
a null in them, or without a host, are left out; of repeated entries the least verdict counts
("allow" before "block"). Two entries that fit one URL and are equally long are the same entry.
Repeated rows are judged each. Empty tables give no rows; an empty list fits nothing. Only the id
and url columns are read, so extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBES = 4
#: Bits of the filter for each key, and its 64-bit words at least and at most (8 MB).
KEY_BITS, MIN_WORDS, MAX_WORDS = 16, 1 << 8, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://", up to "/", "?", "#" or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """PROBES bits of a 64-bit word."""
    h, one = F.xxhash64(F.lit(2), key), F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, 8 * k), F.lit(64)).cast("int")) for k in range(PROBES)]
    return reduce(Column.bitwiseOR, bits)


def bloom_filter(keys: DataFrame, key: Column, words: int) -> Column:
    """The blocked filter of all keys: one array<bigint> of `words` masks, as a scalar subquery."""
    own = keys.where(key.isNotNull()).groupBy(_word(key, words).alias("word")).agg(F.bit_or(_mask(key)).alias("mask"))
    dense = keys.sparkSession.range(words).join(own, F.col("id") == F.col("word"), "left").select("id", F.coalesce("mask", F.lit(0)).alias("mask"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "mask"))), lambda x: x["mask"]).alias("masks")).scalar()


def may_contain(masks: Column, key: Column, words: int) -> Column:
    """False only for keys that the filter was not built from."""
    own = _mask(key)
    return F.get(masks, _word(key, words)).bitwiseAND(own) == own


def canonical_host(host: Column) -> Column:
    """Without user part, port and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def rule_entries(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Entries (host, path, verdict, is_rule) from rules (verdict, host, path)."""
    return spark.createDataFrame([(host, path, verdict, True) for verdict, host, path in rules], ENTRY)


def listed_entries(listed: DataFrame, verdict: str = "block") -> DataFrame:
    """Entries from a table (url) of URLs, with a scheme or without; each is made canonical."""
    url = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("://"), "url"))
    own = listed.where("url is not null").select(canonical_host(host_of(url)).alias("host"), path_of(url).alias("path"))
    return own.select("host", "path", F.lit(verdict).alias("verdict"), F.lit(False).alias("is_rule"))


ENTRY = "host string, path string, verdict string, is_rule boolean"


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def _key(is_rule: Column, host: Column, start: Column) -> Column:
    return F.concat(F.when(is_rule, F.lit("r")).otherwise(F.lit("l")), host, start)


def keyed(entries: DataFrame) -> DataFrame:
    """Usable entries, each once, with labels, start (the p of the key) and key."""
    usable = entries.where("host <> '' and path is not null and verdict is not null and is_rule is not null").groupBy("host", "path", "is_rule").agg(F.min("verdict").alias("verdict"))
    longest = F.length("path")
    start = F.when(longest > 0, F.call_function("shiftleft", F.lit(1), F.length(F.bin(longest.cast("bigint"))) - 1)).otherwise(0)
    out = usable.withColumn("start", start).withColumn("labels", _labels(F.col("host")))
    return out.withColumn("key", _key(F.col("is_rule"), F.col("host"), F.substring("path", F.lit(1), F.col("start"))))


def possible(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, hits, row) of every row; hits are the keys of `listed` (from `keyed`) that the filter lets
    through, row a number of its own."""
    seen = listed.groupBy("is_rule", "labels", "start").agg(F.count(F.lit(1)).alias("n")).collect()
    words = max(MIN_WORDS, min(MAX_WORDS, 1 << (sum(r["n"] for r in seen) * KEY_BITS // 64).bit_length()))
    masks = bloom_filter(listed, F.col("key"), words)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("canonical", canonical_host(F.col("host")))
    hits = []
    for is_rule, labels, n in sorted((r["is_rule"], r["labels"], r["start"]) for r in seen):
        host = F.col("host" if is_rule else "canonical")
        key = _key(F.lit(is_rule), F.substring_index(host, ".", -labels), F.substring("path", 1, n))
        hits.append(F.when((_labels(host) >= labels) & (F.length("path") >= n) & may_contain(masks, key, words), key))
    rows = rows.withColumns({"hits": F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"), "row": F.monotonically_increasing_id()})
    return rows.drop("canonical")


def judge(pages: DataFrame, entries: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row.

    rule: the longest rule that fits, else null. verdict: the rule's; else "block" if a listed URL
    fits (listed), else `otherwise`. entries: (host, path, verdict, is_rule).
    """
    entries = keyed(entries)
    rows = possible(pages, entries)
    # `row >= 0` is always true: a filter that reads it stays above the projection, which is then evaluated once
    none = rows.where((F.size("hits") == 0) & (F.col("row") >= 0)).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"), F.lit(False).alias("listed"))
    some = rows.where((F.size("hits") > 0) & (F.col("row") >= 0)).withColumn("key", F.explode("hits")).drop("hits")
    listed = entries.select("key", F.col("host").alias("e_host"), F.col("path").alias("e_path"), "verdict", "is_rule")
    found = some.join(listed, "key", "left").withColumn("fits", F.coalesce(F.startswith("path", "e_path"), F.lit(False)))
    best = F.max(F.when(F.col("fits") & F.col("is_rule"), F.struct(F.length(F.concat("e_host", "e_path")).alias("n"), F.concat("e_host", "e_path").alias("rule"), "verdict")))
    judged = found.groupBy("row", "page_id", "host", "path").agg(best.alias("best"), F.bool_or(F.col("fits") & ~F.col("is_rule")).alias("listed"))
    judged = judged.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return none.unionByName(judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise(otherwise)).alias("verdict"), "listed"))
