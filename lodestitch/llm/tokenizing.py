"""Encoding with the tokenizers library, fast enough for whole corpora.

Most of the library's time goes into its normaliser and its splitter, not into BPE. A vocabulary
of `WORDS` kind splits a text into pieces that are encoded independently of each other, so the
ids of a text are the ids of its pieces in order, and a piece seen before needs no encoding. Texts
of printable ASCII and Latin-1 letters are split here and their new pieces encoded by the
library's model; any other text, and any that may hold one of the file's added tokens, goes
through the library whole, as it comes: an added token in a text gives that token's id. Tests
hold both against the library's own result.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: What the shortcut below relies on; a tokenizer file with other settings is always used whole.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAFE = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
#: Pieces kept at most; beyond it the cache starts anew.
CACHE_PIECES = 500_000

_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        #: Lower-cased: some added tokens are looked for after the normaliser.
        self.added = [t["content"].lower() for t in shape.get("added_tokens", [])]
        pre = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.splits = (
            [n.get("type") for n in (shape.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0].get("pattern", {}).get("Regex") == WORD_PATTERN
        )

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, without special tokens, as little-endian unsigned 32-bit bytes."""
        if self.splits and SAFE.fullmatch(text):
            low = text.lower()
            if not any(token in low for token in self.added):
                return b"".join(map(self.__getitem__, PIECE.findall(low)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One per Python worker and file, so that its cache serves all the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
