"""What Spark has no function for: Unicode forms, accents, casefolding. Arrow UDFs that only non-ASCII rows reach."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Java classes equal to Python's \w, \s and a combining mark.
WORD, GAP, MARK = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}", r"\p{M}"
#: Python's \b, without Java's own idea of it.
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
#: Blocks of combining marks that accent folding drops.
ACCENT_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))


def pattern(text: str) -> str:
    r"""A Python pattern (with \b, \s, \w) as a Java one with the same matches, ignoring case."""
    return "(?iu)" + text.replace(r"\b", EDGE).replace(r"[^\w\s]", f"[^{WORD}{GAP}]").replace(r"\s", f"[{GAP}]")


def quick(rule: str, first: str = "") -> str:
    r"""`pattern` of a rule that begins with \b and one of the characters `first` (by default the letters after its brackets and bars):
    the same matches, but most places are passed over by one look at a character."""
    first = first or "".join(sorted({x for c in re.findall(r"[(|]([a-z])", rule) for x in c + c.upper() + {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}.get(c, "")}))
    return f"(?=[{first}])(?<![{WORD}])" + pattern(rule.removeprefix(r"\b"))


_ACCENTS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ACCENT_BLOCKS) + "]+")


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", text)))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def _where_needed(text: Column, udf, plain: Column) -> Column:
    """`plain` for ASCII texts; the UDF sees a null in their place."""
    ascii_ = text.rlike(r"\A[\x00-\x7F]*\z")
    return F.coalesce(udf(F.when(~ascii_, text)), plain)


def nfkc(text: Column) -> Column:
    """NFKC without control characters; null gives ''."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(_where_needed(text, _nfkc, text), CONTROLS, "")


def nfkc_casefold(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return _where_needed(text, _nfkc_casefold, F.lower(text))


def fold_accents(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return _where_needed(text, _fold, text)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"[{GAP}]+", " "))


def tokens(text: Column) -> Column:
    """Tokens of a text collapsed before; none for ''."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
