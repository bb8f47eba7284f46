"""Quality classifier: supervised subword embeddings.

A text is the average of the vectors of its words and of the character n-grams of those words,
each found in a table of learned rows by a hash; a softmax layer on the average gives a
probability per label. Both tables are learned together by stochastic gradient descent in numpy.

Labels are learned from a bounded sample of the labelled rows that have a document: those with the
least hash of their id, at most SAMPLE rows and, in that order, at most SAMPLE_BYTES of features
(the first row always counts). So the sample is the same wherever it is drawn; its rows' whole
texts count. Every row of the table is then scored over its whole text. Scoring needs only the
product of both tables (one number per row and label), and a word that was seen before costs one
lookup.

Nulls: a null text counts as empty; an empty text has an average of zero and so the score of the
layer's bias. Rows without an id are scored and never learned from. Labels that are null are left
out; an id with several labels takes their rounded mean, and of an id with several texts the least
is learned from. Repeated rows are scored each, alike. Very long texts count whole. A score of
exactly the threshold (a tie) counts as reached. With no labels at all the score is 0.5. Empty tables
give no rows. Only the id and text columns are read, so extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Labelled rows that are learned from at most.
SAMPLE = 4000
#: Bytes of their features that the task that learns holds at most.
SAMPLE_BYTES = 32_000_000
BUCKETS = 1 << 17
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5)
#: Words whose sums a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 400_000


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, row) for every row of every word: its own and those of its character n-grams, word ends included."""
    shown = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, shown), np.int64, len(shown))
    codes = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner, end = np.repeat(np.arange(len(words)), lengths), np.repeat(np.cumsum(lengths), lengths)
    places = [np.arange(len(words))]
    rows = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % BUCKETS]
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(codes)) + n <= end)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        places.append(owner[at])
        rows.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(places), np.concatenate(rows)


@dataclass
class Model:
    """weights[bucket, label]: what one occurrence adds to a label before averaging."""

    labels: list[int]
    weights: np.ndarray
    bias: np.ndarray


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts) of a whole text, rows ascending."""
    words = text.split()
    times = Counter(words)
    places, rows = buckets_of(list(times))
    counts = np.fromiter(times.values(), np.float64, len(times))[places]
    rows, inverse = np.unique(rows, return_inverse=True)
    return rows.astype(np.int32), np.bincount(inverse, counts, len(rows)).astype(np.float32)


def train(rows: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, dim: int = 16, epochs: int = 8, rate: float = 0.4, seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss, a document at a time, at a falling rate."""
    kinds = sorted(set(labels.tolist()))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((len(kinds), dim), np.float32), np.zeros(len(kinds), np.float32)
    target = np.searchsorted(kinds, labels)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            lr = rate * (1 - step / steps)
            step += 1
            r, share = rows[k], counts[k] / max(1.0, float(counts[k].sum()))
            mean = share @ table[r]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[k]] -= 1
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= 0.1 * lr * p
            table[r] -= (lr * len(r) ** 0.5) * share[:, None] * back[None, :]
    return Model(kinds, table @ out.T, bias.astype(np.float64))


class Scorer(dict):
    """word -> its place in growing tables of sums and counts."""

    def __init__(self, model: Model):
        self.model, self.n = model, 0
        self.sums, self.counts = np.zeros((1024, len(model.labels))), np.zeros(1024)

    def learn(self, words: list[str]) -> None:
        """Enter new words, each once."""
        while self.n + len(words) > len(self.counts):
            self.sums, self.counts = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        places, rows = buckets_of(words)
        own = slice(self.n, self.n + len(words))
        for label in range(len(self.model.labels)):
            self.sums[own, label] = np.bincount(places, self.model.weights[rows, label], len(words))
        self.counts[own] = np.bincount(places, minlength=len(words))
        self.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def probabilities(self, text: str) -> np.ndarray:
        if self.n > CACHE_WORDS:
            self.clear()
            self.n = 0
        words = text.split()
        if new := list(dict.fromkeys(w for w in words if w not in self)):
            self.learn(new)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        z = self.model.bias + self.sums[at].sum(axis=0) / max(1.0, self.counts[at].sum())
        p = np.exp(z - z.max())
        return p / p.sum()


_SCORERS: dict[str, Scorer] = {}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, usable: Column | None = None, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learn from at most `sample` labelled rows, and `most_bytes` of features, among those `usable` that have a document; None if there is none.

    Only that bounded sample of labels is broadcast; its features meet in one task, and the driver gets the model alone.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).alias("y")).where("id is not null and y is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    there = docs.select(F.col("doc_id").cast("bigint").alias("id"))
    drawn = known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not drawn:
        return None
    chosen = spark.createDataFrame([(int(r["id"]), int(r["y"])) for r in drawn], "id long, y int")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # one row per id, however often it comes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [text_features(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "rows": [f[0].tobytes() for f in found], "counts": [f[1].tobytes() for f in found]})

    found = stored(texts.mapInPandas(run, "id long, y int, rows binary, counts binary"))
    size = dict(found.select("id", F.length("rows") + F.length("counts")).collect())
    spent = np.cumsum([size[r["id"]] for r in drawn])
    taken = [r["id"] for k, r in enumerate(drawn) if not k or spent[k] <= most_bytes]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches), ignore_index=True).sort_values("id")
        model = train([np.frombuffer(r, np.int32) for r in got["rows"]], [np.frombuffer(c, np.float32) for c in got["counts"]], got["y"].to_numpy())
        yield pd.DataFrame({"labels": [model.labels], "weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()]})

    # one task learns: the features would else pass the driver, as bytes and as rows
    bounded = found.join(F.broadcast(spark.createDataFrame([(i,) for i in taken], "id long")), "id", "left_semi").coalesce(1)
    r = bounded.mapInPandas(learn, "labels array<int>, weights binary, bias binary").first()
    return Model(list(r["labels"]), np.frombuffer(r["weights"], np.float32).reshape(BUCKETS, -1), np.frombuffer(r["bias"], np.float64))


def score(docs: DataFrame, model: Model | None, text: str = "text", positive: int = 1) -> Column:
    """The probability of the label `positive` for the whole text, as a column of `docs`."""
    if model is None or positive not in model.labels:
        return F.lit(0.5 if model is None else 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = model.labels.index(positive)
    name = f"{id(shared)}-{zlib.crc32(model.weights.tobytes())}"

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for texts in batches:
            yield pd.Series([float(scorer.probabilities(t)[place]) for t in texts], dtype="float64")

    return run(F.coalesce(F.col(text), F.lit("")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows never learned from: those with crc32 of the id as text divisible by `folds`, and rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels, usable=~held_out(F.col("id")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold."""
    model = fit(docs, labels, usable=~held_out(F.col("id")))
    return docs.where(score(docs, model) >= threshold)
