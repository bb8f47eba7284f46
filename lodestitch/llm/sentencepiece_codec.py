"""SentencePiece encoding and decoding by a single-pass Viterbi.

An Aho-Corasick automaton over all pieces reads a segment once; at each position its output links
name every piece that ends there, longest first, and each relaxes the best score of its end by the
best score of its start plus its own. Following the best pieces back gives the segmentation of the
highest total score. A character that no piece covers costs UNKNOWN below the least score and is
written as its bytes (or as the unknown piece where the vocabulary has no bytes).

Spaces become U+2581 and one is put in front, as SentencePiece does. A text is cut into segments
where a U+2581 follows another character. No piece of the vocabulary reaches over such a cut (the
codec checks that), so the best segmentation of a text is that of its segments in order, a
segment seen before costs one lookup, and texts of any length need bounded memory.

Scores are log-probabilities. A model file of merges holds ranks instead (0, -1, -2, ... in the order
of merging, which is about that of frequency); those become log-probabilities by Zipf's law, a
piece of rank r having a probability in proportion to 1 / (r + ZIPF). Nothing is trained.

The text is taken as it is: no normaliser of the model file is applied, so decoding inverts encoding
for every text where the vocabulary has byte pieces. Of equal scores (ties) the piece found first at an
end, the longest, wins. A long text without spaces is one segment: it isn't kept, and needs about 20
bytes a character while it is encoded.

Nulls: a null text counts as empty and has no pieces. Repeated rows are encoded each. Empty tables
give no rows. Only the id and text columns are read, so extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: What an uncovered character scores below the least piece.
UNKNOWN = 10.0
#: Added to ranks: the first ranks' frequencies are flatter than 1 / r (Mandelbrot's form of the law).
ZIPF = 2.7
#: Segments whose ids a worker keeps, and their characters at most.
CACHE_SEGMENTS, CACHE_CHARS = 400_000, 64
#: Characters of a segment beyond which its tables are flat arrays.
LONG = 1 << 12
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CODECS: dict[str, "Codec"] = {}


class Codec(dict):
    """segment -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kinds normal, unknown, control, byte."""
        import ahocorasick

        self.texts = [p for p, _, _ in pieces]
        self.bytes = {int(p[3:-1], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.shown = [bytes([self.byte_of[k]]) if k in self.byte_of else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for k, p in enumerate(self.texts)]
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.automaton = ahocorasick.Automaton()
        normal = [(p, s, k) for k, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        for p, s, k in normal:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {k} reaches over a word's start")
            self.automaton.add_word(p, (len(p), s, k))
        self.automaton.make_automaton()
        self.least = min(s for _, s, _ in normal) - UNKNOWN

    def viterbi(self, segment: str) -> list[tuple[int, int, int]]:
        """(start, end, id or -1) of the best pieces; -1 for a character of no piece."""
        n, low, least = len(segment), float("-inf"), self.least
        flat = n > LONG  # lists are faster, arrays smaller
        best = array("d", [low]) * (n + 1) if flat else [low] * (n + 1)
        came, via = (array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)) if flat else ([0] * (n + 1), [-1] * (n + 1))
        best[0], reached = 0.0, 0
        for last, (length, score, k) in self.automaton.iter(segment):
            while reached < last:  # positions before have all their pieces: one uncovered character may still reach them
                reached += 1
                if best[reached] < (step := best[reached - 1] + least):
                    best[reached], came[reached], via[reached] = step, reached - 1, -1
            end = last + 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], came[end], via[end] = total, end - length, k
        while reached < n:
            reached += 1
            if best[reached] < (step := best[reached - 1] + least):
                best[reached], came[reached], via[reached] = step, reached - 1, -1
        out, at = [], n
        while at:
            out.append((came[at], at, via[at]))
            at = came[at]
        return out[::-1]

    def __missing__(self, segment: str) -> bytes:
        ids: list[int] = []
        for start, end, k in self.viterbi(segment):
            if k >= 0:
                ids.append(k)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in segment[start:end].encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        found = np.array(ids, "<u4").tobytes()
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE_SEGMENTS:
                self.clear()
            self[segment] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        first, *rest = text.split(SPACE)  # a U+2581 of the text itself is written as its bytes
        parts = [b"".join(map(self.__getitem__, _SEGMENT.findall(SPACE + first.replace(" ", SPACE))))]
        for part in rest:
            parts.append(np.array([self.bytes.get(b, self.unknown) for b in SPACE.encode()], "<u4").tobytes())
            parts.extend(map(self.__getitem__, _SEGMENT.findall(part.replace(" ", SPACE))))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def log_probabilities(scores: list[float]) -> list[float]:
    """Of pieces, from their scores: these, or where they are ranks (whole numbers, hardly one of them twice) those of Zipf's law."""
    if not all(s == int(s) for s in scores) or len(set(scores)) < 0.9 * len(scores):
        return scores
    shares = [1 / (ZIPF - s) for s in scores]
    total = sum(shares)
    return [math.log(x / total) for x in shares]


def load(path: str) -> Codec:
    """The codec of a SentencePiece model file, one per Python worker."""
    if path not in _CODECS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "byte" if sp.is_byte(i) else "normal"
        kinds = [kind(i) for i in range(sp.get_piece_size())]
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        scores = dict(zip(normal, log_probabilities([sp.get_score(i) for i in normal])))
        _CODECS[path] = Codec([(sp.id_to_piece(i), scores.get(i, 0.0), k) for i, k in enumerate(kinds)])
    return _CODECS[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load(model)
        for texts in batches:
            yield pd.Series([np.frombuffer(codec.encode(t), "<i4") for t in texts])

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("ids"))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load(model)
        for rows in batches:
            yield pd.Series([codec.decode(np.asarray(ids)) for ids in rows])

    return encoded.select("doc_id", run(F.coalesce("ids", F.array().cast("array<int>"))).alias("text"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32): every whole text encoded, and decoded from the ids."""

    @F.pandas_udf("n_pieces long, ids_crc32 long, decoded_crc32 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = load(model)
        for texts in batches:
            rows = []
            for t in texts:
                ids = codec.encode(t)
                back = codec.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_crc32"])

    rows = docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("x"))
    return rows.select("doc_id", "x.n_pieces", "x.ids_crc32", "x.decoded_crc32")
