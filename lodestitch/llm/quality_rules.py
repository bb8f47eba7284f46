"""Quality rules by hashed n-gram likelihood ratios; built-in functions only.

Word unigrams and bigrams are counted into BUCKETS hashed buckets, once for the raw corpus (every
document) and once for a trusted target. Texts that are copies or near copies of each other share
the weight of one text in either, so large groups don't move the scores: a text's group is as large
as the number of texts with its least, or with its greatest, five-word hash, whichever is more
common (two MinHash samples). Both counts give a multinomial (smoothed by one count a bucket); a
bucket weighs the logarithm of the target's probability over the raw one's. A document scores the
mean weight of its n-grams, so its length plays no part, and is kept if the score reaches a
threshold. A part of the trusted texts isn't counted: like a good document without a label, these
are in the raw counts only, and the threshold lies below their scores. Before that stand plain
rules: too few words, or most words in repeated three-word windows.

Both counts cover all their documents and whole texts. A document's n-grams are counted within its
task before anything is exchanged, and the weights are one array of fixed size. Trusted texts are
found by id: a blocked Bloom filter of fixed size drops most others in the scan, an exact semi-join
the rest. Texts of groups are found likewise by their two samples, and what they were counted too
much is taken off.

Nulls: a null text counts as empty and fails the plain rules. Rows without an id are judged, and
never trusted. Repeated rows are judged each, and count once together. Very long texts count whole.
A score of exactly the threshold (a tie) is kept. With no trusted document every weight is the
logarithm of a uniform probability over the raw one. Empty tables give no rows. Only the id and text
columns are read, so extra columns don't matter.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .url_filter import bloom_filter, may_contain

BUCKETS = 1 << 14
#: Least mean weight of a kept document, where none is left out; else the greatest such limit.
THRESHOLD = -0.08
#: One trusted text in LEFT_OUT isn't counted; the limit is MARGIN below the score that all but LOST of those documents reach.
LEFT_OUT, LOST, MARGIN = 5, 0.005, 0.05
MIN_WORDS = 50
#: Percent of words in repeated windows above which a document fails.
MAX_REPEATED = 50
WINDOW = 3
#: Words of the runs that tell copies, and what one text counts: shares of it stay whole numbers, so that sums are exact.
RUN, ONE = 5, 1 << 20
FILTER_WORDS = 1 << 17
#: The white space that parts words, as a class of Java's patterns.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def worded(docs: DataFrame) -> DataFrame:
    """Adds __text (never null), __words and __hashes; `docs` keeps its columns."""
    rows = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    flat = F.btrim("__text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("__words", F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, SPACE)))
    return rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))


def ngrams(hashes: Column) -> Column:
    """Hashes of all unigrams and bigrams; the first word pairs with nothing."""
    return F.concat(hashes, F.transform(hashes, lambda h, i: F.xxhash64(F.get(hashes, i - 1), h)))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, own) of docs (text, raw, own): each n-gram as often as the two columns say."""
    # explode_outer: for explode Spark would put a filter on the n-grams' number below, and compute them twice
    grams = worded(docs).select("raw", "own", F.explode_outer(ngrams(F.col("__hashes"))).alias("gram"))
    return grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.sum("raw").alias("raw"), F.sum("own").alias("own"))


def _ids(trusted: DataFrame) -> DataFrame:
    return trusted.select(F.col("doc_id").alias("id")).where("id is not null").distinct()


def _target(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the trusted documents."""
    masks = bloom_filter(ids, F.col("id"), FILTER_WORDS)
    own = docs.select(F.col("doc_id").alias("id"), "text")
    # texts are exchanged at every size, so that disk follows the input: a small table would else be broadcast, a larger one not
    return own.where(F.col("id").isNotNull() & may_contain(masks, F.col("id"), FILTER_WORDS)).join(ids.hint("merge"), "id", "left_semi")


def left_out(text: Column) -> Column:
    """Whether the trusted documents of this text only place the threshold."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(LEFT_OUT)), F.lit(LEFT_OUT)) == 0


def sampled(docs: DataFrame) -> DataFrame:
    """Adds least and most: the extreme hashes of a text's runs of RUN words; of a shorter text its own hash."""
    rows = worded(docs)
    hashes = F.col("__hashes")
    runs = F.transform(F.slice(hashes, RUN, F.greatest(F.size(hashes) - (RUN - 1), F.lit(0))), lambda h, i: F.xxhash64(*[F.get(hashes, i + k) for k in range(RUN - 1)], h))
    own = F.when(F.size(hashes) < RUN, F.array(F.xxhash64("__text"))).otherwise(runs)
    return rows.withColumn("__runs", own).select(*docs.columns, F.array_min("__runs").alias("least"), F.array_max("__runs").alias("most"))


def _surplus(docs: DataFrame) -> DataFrame:
    """(text, n) of texts that have copies: what they weigh less than one text each, as numbers below zero."""
    rows = sampled(docs.select("text"))
    pairs = stored(rows.groupBy("least", "most").agg(F.count(F.lit(1)).alias("n")))
    sizes = [pairs.groupBy(c).agg(F.sum("n").alias(f"{c}_n")) for c in ("least", "most")]
    shared = pairs.join(sizes[0], "least").join(sizes[1], "most").select("least", "most", F.greatest("least_n", "most_n").alias("group")).where("group > 1")
    shared = stored(shared.withColumn("key", F.xxhash64("least", "most")))
    # as in `judge`, a term that is always true keeps filters above the projections of `sampled`
    known = may_contain(bloom_filter(shared, F.col("key"), FILTER_WORDS), F.xxhash64("least", "most"), FILTER_WORDS) & (F.monotonically_increasing_id() >= 0)
    again = rows.withColumn("again", known).where("again")
    return again.join(shared.hint("merge"), ["least", "most"]).select("text", (F.floor(F.lit(ONE) / F.col("group")) - ONE).cast("bigint").alias("n"))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, leave_out: bool = False, target: DataFrame | None = None) -> DataFrame:
    """(bucket, weight), every bucket: the logarithm of the trusted documents' probability over the raw corpus's.

    trusted: (doc_id) of the trusted documents; ids may repeat. leave_out: not the left-out ones of them. target: their
    (id, text), if these are stored already.
    """
    target = stored(_target(docs, _ids(trusted))) if target is None else target
    target = target.where(~left_out(F.col("text"))) if leave_out else target
    one, none = F.lit(ONE).cast("bigint"), F.lit(0).cast("bigint")
    parts = [
        docs.select("text", one.alias("raw"), none.alias("own")), _surplus(docs).select("text", F.col("n").alias("raw"), none.alias("own")),
        target.select("text", none.alias("raw"), one.alias("own")), _surplus(target).select("text", none.alias("raw"), F.col("n").alias("own")),
    ]
    grams = reduce(DataFrame.unionByName, [_counted(part, buckets) for part in parts])
    sums = grams.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own"))
    smooth = lambda c: (F.coalesce(c, F.lit(0)) / F.lit(ONE) + 1).alias(c)
    dense = stored(docs.sparkSession.range(buckets).join(sums, F.col("id") == F.col("bucket"), "left").select(F.col("id").cast("int").alias("bucket"), smooth("raw"), smooth("own")))
    share = lambda c: F.log(F.col(c) / dense.agg(F.sum(c)).scalar())
    return dense.select("bucket", F.round(share("own") - share("raw"), 5).alias("weight"))


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (and __ columns)."""
    rows = worded(docs).withColumn("n_words", F.size("__words").cast("bigint"))
    hashes, n = F.col("__hashes"), F.col("n_words")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("__lines", lines)
    windows = F.transform(F.slice(hashes, WINDOW, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h))
    rows = rows.withColumn("__windows", windows)
    # Most texts repeat no window and end here. In the others (hash, place) are sorted: equal windows are neighbours.
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    rows = rows.withColumn("__sorted", F.when(some, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    words, own = F.col("__words"), F.col("__sorted")

    def same(x: Column, y: Column) -> Column:
        """Neighbours whose windows are the same words; words are compared only where the hashes agree."""
        out = x["h"] == y["h"]
        for k in range(WINDOW):
            out = out & (F.get(words, x["at"] + k) == F.get(words, y["at"] + k))
        return out

    twice = F.filter(own, lambda x, i: F.coalesce(same(x, F.get(own, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(own, i - 1)), F.lit(False)))
    rows = rows.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["at"].cast("bigint"))))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW).cast("bigint"), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW).cast("bigint")))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = (
        rows.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("bigint"))
        .withColumn("n_symbols", F.length(F.regexp_replace("__text", f"[^{SYMBOLS}]+", "")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
        .withColumn("n_repeat_words", covered)
    )
    return rows.withColumn("base_failed", (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEATED))


def constant(weighed: DataFrame, buckets: int = BUCKETS) -> Column:
    """The weights as one constant array of fixed size: a lambda may hold a constant, not a subquery."""
    found = dict(weighed.collect())
    return F.from_json(F.lit(json.dumps([found[b] for b in range(buckets)])), "array<double>")


def mean_weight(table: Column, buckets: int) -> Column:
    """Of the n-grams of __hashes; 0 without any."""
    total = F.aggregate(ngrams(F.col("__hashes")), F.lit(0.0), lambda a, g: a + F.get(table, bucket(g, buckets)))
    return total / F.greatest(2 * F.size("__hashes"), F.lit(1))


def placed(target: DataFrame, table: Column, buckets: int = BUCKETS) -> float:
    """The threshold: what all but LOST of the left-out trusted documents (id, text) reach, less MARGIN, and THRESHOLD at most."""
    out = worded(target.where(left_out(F.col("text")))).where(F.size("__words") >= MIN_WORDS)
    low = out.select(mean_weight(table, buckets).alias("llr")).agg(F.percentile_approx("llr", LOST, 10_000)).first()[0]
    return THRESHOLD if low is None else min(THRESHOLD, low - MARGIN)


def judge(docs: DataFrame, table: Column, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Adds the measures, llr (mean weight of the n-grams, 0 without any) and kept."""
    rows = measures(docs)
    rows = rows.withColumn("llr", mean_weight(table, buckets))
    # The last term is always true and keeps the optimiser from pushing a filter on kept below the
    # projections above: it would copy their expressions into each other without end.
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.monotonically_increasing_id() >= 0))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def _judged(docs: DataFrame, trusted: DataFrame, threshold: float | None) -> tuple[Column, float]:
    """(weights, threshold) over docs (doc_id, text); a threshold of None is placed."""
    target = stored(_target(docs, _ids(trusted)))  # once for both, so that these texts are exchanged once
    table = constant(weights(docs, trusted, leave_out=True, target=target))
    return table, placed(target, table) if threshold is None else threshold


def quality(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, the measures, llr, kept) of every row."""
    own = docs.select("doc_id", "text")
    return judge(own, *_judged(own, trusted, threshold)).select("doc_id", *MEASURES)


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """The kept rows of `docs`, all columns. The measures are those of a nested copy, so columns of the same names stay as they are."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kept = judge(own, *_judged(docs.select("doc_id", "text"), trusted, threshold)).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
