"""Scripts of India: detection and romanisation, from one offset table, with built-in functions only.

The seven scripts lie in blocks of 128 code points with a common layout, so a letter's Latin value
is a matter of its place in the block, but for the exceptions named here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block starts, in the order in which detection looks at them.
BLOCKS = {"devanagari": 0x0900, "bengali": 0x0980, "gujarati": 0x0A80, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00}
#: Latin values by place in the block.
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0B: "ri", 0x0E: "e", 0x0F: "ee", 0x10: "ai", 0x12: "o", 0x13: "oo", 0x14: "au"}
SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x43: "ri", 0x46: "e", 0x47: "ee", 0x48: "ai", 0x4A: "o", 0x4B: "oo", 0x4C: "au"}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng",
    0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n",
    0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m",
    0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
}
#: Latin values that a script has besides the common ones, or instead of them, by place in its block.
OWN_VOWELS = {
    "devanagari": {0x0F: "e", 0x13: "o"},
    "bengali": {0x0F: "e", 0x13: "o"},
    "gujarati": {0x0F: "e", 0x13: "o"},
}
OWN_SIGNS = {
    "devanagari": {0x47: "e", 0x4B: "o"},
    "bengali": {0x47: "e", 0x4B: "o"},
    "gujarati": {0x47: "e", 0x4B: "o"},
}
OWN_CONSONANTS = {
    "devanagari": {0x58: "q", 0x59: "kh", 0x5A: "gh", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f"},
    "bengali": {0x5C: "r", 0x5D: "rh", 0x5F: "y"},
    "tamil": {0x29: "n", 0x34: "zh"},
    "malayalam": {0x34: "zh"},
}
MARKS = {
    "devanagari": {0x01: "n", 0x02: "m", 0x03: "h", 0x3C: ""},
    "bengali": {0x01: "n", 0x02: "ng", 0x03: "h", 0x3C: ""},
    "gujarati": {0x01: "n", 0x02: "m", 0x03: "h", 0x3C: ""},
    "tamil": {0x02: "m", 0x03: "h"},
    "telugu": {0x01: "n", 0x02: "m", 0x03: "h"},
    "kannada": {0x02: "m", 0x03: "h"},
    "malayalam": {0x02: "m", 0x03: "h"},
}
#: Common places that have no value in a script.
LACKING = {
    "bengali": {0x0E, 0x12, 0x31, 0x33, 0x35, 0x46, 0x4A},
    "gujarati": {0x0E, 0x12, 0x31, 0x46, 0x4A},
    "tamil": {0x0B, 0x16, 0x17, 0x18, 0x1B, 0x1D, 0x20, 0x21, 0x22, 0x25, 0x26, 0x27, 0x2B, 0x2C, 0x2D, 0x43},
}
VIRAMA = 0x4D


def table(common: dict[int, str], own: dict[str, dict[int, str]]) -> dict[str, str]:
    """Character -> Latin value in all scripts, of a kind's common values and those of its scripts."""
    out = {}
    for script, start in BLOCKS.items():
        shared = {place: value for place, value in common.items() if place not in LACKING.get(script, set())}
        out |= {chr(start + place): value for place, value in (shared | own.get(script, {})).items()}
    return out


def _class(chars) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in sorted(chars))


def romanize(text: Column) -> Column:
    """A consonant carries an "a" unless a sign or the virama follows; every known character then becomes its Latin value."""
    viramas = [chr(b + VIRAMA) for b in BLOCKS.values()]
    consonants, signs = table(CONSONANTS, OWN_CONSONANTS), table(SIGNS, OWN_SIGNS)
    voiced = F.regexp_replace(text, f"([{_class(consonants)}])(?![{_class([*signs, *viramas])}])", "$1a")
    values = {**table(VOWELS, OWN_VOWELS), **signs, **consonants, **table({}, MARKS), **dict.fromkeys(viramas, "")}
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    letters = F.transform(F.regexp_extract_all(voiced, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(text.rlike(f"[{_class(values)}]"), F.array_join(letters, "")).otherwise(text)


def script(text: Column) -> Column:
    """The first script with 30 % of the letters; else Latin if it has a letter of it; else the script with most; else Latin."""
    counts = {s: F.regexp_count(text, F.lit(f"[\\p{{L}}&&[\\x{{{b:X}}}-\\x{{{b + 0x7F:X}}}]]")) for s, b in BLOCKS.items()}
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    out = F.when(letters == 0, "latin")
    for s, n in counts.items():
        out = out.when((n > 0) & (n * 10 >= letters * 3), s)
    out = out.when(text.rlike(r"[A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}&&\p{L}]"), "latin")
    most = F.greatest(*counts.values())
    for s, n in counts.items():
        out = out.when((most > 0) & (n == most), s)
    return F.when(text.rlike(r"\A[\x00-\x7F]*\z"), "latin").otherwise(out.otherwise("latin"))
