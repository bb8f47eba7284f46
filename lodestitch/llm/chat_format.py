"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only
its own text is trainable. A conversation whose last turn is not the assistant's gets one more
row that trains nothing, so that the output holds every turn.

A turn is written as MARKS[0] role MARKS[1] text MARKS[2]. Control strings inside roles and texts
are broken by a backslash after their first character, and backslashes are doubled; so a control
string in the output is always a mark, and removing each first backslash gives the text back.

Turns stream through a task in order: what is held is one conversation's text so far. The examples
of a conversation of n turns hold about n^2 / 2 turns; that is what the method yields, and each
leaves the task before the next is made.

Order: turn (nulls first), then role, then text. Nulls: a null text or role counts as empty; rows
with a null conv_id are one conversation. Repeated rows are turns of their own. Empty tables give
no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<s>", "</s>"
MARKS = ("<|turn|>", "<|says|>", END)
#: Strings that this or other public chat templates give a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|says|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(MARKS[0]) + "(.*?)" + re.escape(MARKS[1]) + "(.*?)" + re.escape(MARKS[2]), re.S)

EXAMPLE = "conv_id long, example int, n_turns long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    out = text.replace("\\", "\\\\")
    while True:  # a break can't complete another control string, but two may overlap
        broken = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], out)
        if broken == out:
            return out
        out = broken


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted text; start and end place the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text, len(START))]


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order."""
    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _expand(batches: Iterator[pd.DataFrame], target: str) -> Iterator[tuple]:
    """(conv_id as text or None, example, turns, text, loss start, loss end), one at a time."""
    now, parts, size, example, turns, open_ = object(), [START], len(START), 0, 0, False

    def rest():
        if open_:
            yield (now, example, turns, "".join(parts), None, None)

    for pdf in batches:
        for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
            conv = None if conv is None or conv != conv else conv
            if conv != now:
                yield from rest()
                now, parts, size, example, turns, open_ = conv, [START], len(START), 0, 0, False
            head, body = MARKS[0] + escape(role) + MARKS[1], escape(text)
            parts += [head, body, MARKS[2]]
            start, turns = size + len(head), turns + 1
            size = start + len(body) + len(MARKS[2])
            open_ = role != target
            if not open_:
                whole = "".join(parts)
                parts = [whole]
                yield (now, example, turns, whole, start, start + len(body))
                example += 1
    yield from rest()


def examples(turns: DataFrame, target: str = "assistant", batch_chars: int = 4_000_000) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end): the formatted examples; the loss mask is the
    characters loss_start (included) to loss_end (not), null in a row that trains nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in _expand(batches, target):
            rows.append(row)
            size += len(row[3])
            if size >= batch_chars:
                yield _frame(rows)
                rows, size = [], 0
        yield _frame(rows)

    return _in_order(turns).mapInPandas(run, EXAMPLE)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "text", "loss_start", "loss_end"])
    ids = pd.array([None if x is None else int(x) for x in out["conv_id"]], "Int64")
    return out.assign(conv_id=ids, loss_start=out["loss_start"].astype("Int64"), loss_end=out["loss_end"].astype("Int64"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples) of each conversation, from its formatted examples alone.

    Every example is parsed; an example's own turn gives the loss text under its mask, and the last
    row of a conversation gives its turns. Rows of a conversation come together and in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = object(), None

        def done():
            if seen is not None:
                turns = parse(seen["text"])
                told = hashlib.sha256()
                for role, text, _, _ in turns:
                    told.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                yield pd.DataFrame(
                    [(now, len(turns), told.hexdigest(), seen["loss"], seen["hash"].hexdigest(), seen["chars"], seen["n"])],
                    columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"],
                )

        for pdf in batches:
            for conv, text, start, end in zip(pdf["conv_id"], pdf["text"], pdf["loss_start"], pdf["loss_end"]):
                conv = None if conv is None or conv != conv else conv
                if seen is None or conv != now:
                    yield from done()
                    now, seen = conv, {"text": "", "loss": 0, "hash": hashlib.sha256(), "chars": 0, "n": 0}
                seen["text"], seen["chars"] = text, seen["chars"] + len(text)
                if start == start and start is not None:
                    loss = unescape(text[int(start) : int(end)])
                    seen["loss"], seen["n"] = seen["loss"] + len(loss), seen["n"] + 1
                    seen["hash"].update(loss.encode("utf-8", "surrogatepass"))
        yield from done()

    rows = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "example", "text", "loss_start", "loss_end")
    out = rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
    return out.withColumn("conv_id", F.col("conv_id").cast("bigint"))
