"""Text functions of the linkage: names, addresses, countries, tokens, n-grams, phonetic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .indic import romanize, script
from .unicode import GAP, WORD, fold_accents, nfkc, nfkc_casefold, pattern, quick, tokens

#: A formal prefix, and legal forms in the order in which they are mapped.
PREFIX = r"^(m/s|messrs|the|shree|sri)\b\s*"
LEGAL_FORMS = (
    (r"\b(pvt\.?\s*ltd\.?|private\s+limited)\b", "private limited"),
    (r"\b(l\.?l\.?c\.?|limited\s+liability\s+co(mpany)?)\b", "llc"),
    (r"\b(l\.?l\.?p\.?|limited\s+liability\s+partnership)\b", "llp"),
    (r"\b(inc\.?|incorporated)\b", "inc"),
    (r"\b(corp\.?|corporation)\b", "corp"),
    (r"\b(ltd\.?|limited)\b", "ltd"),
    (r"\b(co\.?|company)\b", "company"),
    (r"\b(s\.?a\.?s\.?u\.?|societe\s+par\s+actions\s+simplifiee\s+unipersonnelle)\b", "sasu"),
    (r"\b(s\.?a\.?s\.?|societe\s+par\s+actions\s+simplifiee)\b", "sas"),
    (r"\b(e\.?u\.?r\.?l\.?|entreprise\s+unipersonnelle\s+a\s+responsabilite\s+limitee)\b", "eurl"),
    (r"\b(s\.?a\.?r\.?l\.?|societe\s+a\s+responsabilite\s+limitee)\b", "sarl"),
    (r"\b(s\.?c\.?i\.?|societe\s+civile\s+immobiliere)\b", "sci"),
    (r"\b(s\.?n\.?c\.?|societe\s+en\s+nom\s+collectif)\b", "snc"),
    (r"\b(s\.?c\.?|societe\s+civile)\b", "sc"),
    (r"\b(s\.?a\.?|societe\s+anonyme)\b", "sa"),
    (r"\b(gmbh|ag|bv|nv|sp\s*z\s*o\s*o)\b", "$1"),
)
#: Words of an address.
LANDMARK = r"\b(near|opp|opposite|behind|beside|adj|adjacent|next\s+to|in\s+front\s+of)\b"
CEDEX = r"\bcedex(?:\s+[0-9]{1,3})?\b"
BOX = r"\b(bo[iî]te\s+postale|b\.?p\.?)\b"
ORDINAL = r"\b([0-9]+)\s*(?:[eè]me|er|[eè]re|e)\b"
PIN, ZIP, FIVE = r"\b([1-9][0-9]{5})\b", r"\b([0-9]{5}(?:-[0-9]{4})?)\b", r"\b([0-9]{5})\b"
ABBREVIATIONS = (
    (r"\b(rd\.?|rd)\b", "road"),
    (r"\b(st\.?|str\.?)\b", "street"),
    (r"\b(ave\.?|av\.?)\b", "avenue"),
    (r"\b(blvd\.?|bvd\.?)\b", "boulevard"),
    (r"\b(bldg\.?|build\.?)\b", "building"),
    (r"\b(apt\.?|suite|ste\.?)\b", "suite"),
    (r"\b(flr\.?|fl\.?)\b", "floor"),
    (r"\b(opp\.?)\b", "opposite"),
    (r"\b(nr\.?)\b", "near"),
    (r"\b(dept\.?)\b", "department"),
    (r"\b(sq\.?)\b", "square"),
    (r"\b(dr\.?)\b", "drive"),
    (r"\b(ln\.?)\b", "lane"),
    (r"\b(pl\.?)\b", "place"),
    (r"\b(ct\.?)\b", "court"),
    (r"\b(pkwy\.?|pky\.?)\b", "parkway"),
    (r"\b(hwy\.?)\b", "highway"),
)
NO_ADDRESS = ("", "nan", "null", "none")
#: Labels of countries; any other country is an open label.
COUNTRIES = {
    "india": "India", "in": "India", "ind": "India", "us": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "france": "France", "fr": "France", "fra": "France",
}
#: Letters of a phonetic key.
PHONETIC_DIGRAPHS = (("ph", "f"), ("ck", "k"), ("sh", "s"), ("ch", "c"), ("th", "t"))
PHONETIC_GROUPS = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
PHONETIC_INITIALS = {"c": "k", "q": "k", "j": "g", "b": "p", "v": "f", "w": "f", "d": "t", "z": "s", "x": "s"}
#: Words without weight when two names are compared as legal variants.
LEGAL_WORDS = (
    "corp", "corporation", "pvt", "private", "ltd", "limited", "inc", "incorporated", "llc", "co", "company", "plc", "gmbh", "sarl",
    "sa", "sas", "bv", "and", "the",
)


def normalize_raw(text: Column) -> Column:
    """NFKC, casefolded, letters, numbers and marks kept, all else one space."""
    return F.btrim(F.regexp_replace(nfkc_casefold(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def raw_tokens(normalized: Column) -> Column:
    """Distinct tokens of two characters or more of a normalised text, in order."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) >= 2))


def word_set(text: Column) -> Column:
    """Distinct runs of letters and numbers, lower-cased; marks part words here."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def normalize_country(country: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    plain = F.btrim(F.regexp_replace(country, rf"\A[{GAP}]+|[{GAP}]+\z", ""))
    # a capital after every character that is no letter, as titles have it
    titled = F.array_join(F.transform(F.regexp_extract_all(F.lower(plain), F.lit(r"(?s)\p{L}+|[^\p{L}]+"), F.lit(0)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    named = F.coalesce(F.try_element_at(known, F.lower(plain)), F.when(F.length(plain) > 2, titled).otherwise(F.upper(plain)))
    return F.when(F.coalesce(country, F.lit("")) == "", "Unknown").otherwise(named)


def _clean(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"[^{WORD}]+", " "))


def _mapped(text: Column, rules) -> Column:
    """Every rule in turn; a text that none of them fits is looked through once, not once a rule."""
    out = text
    for rule, value in rules:
        out = F.regexp_replace(out, quick(rule), f" {value} ")
    some = "|".join(rule.removeprefix(r"\b").removesuffix(r"\b") for rule, _ in rules)
    return F.when(text.rlike(quick(rf"\b(?:{some})\b")), out).otherwise(text)


def _spelled(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))


def once(df, **columns: Column):
    """Adds columns that are evaluated once a row, however often they are read: one row is generated for each row, and Spark doesn't
    copy expressions over a generator into each of their readers, as it does from one projection to the next."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_name(df, raw: str, prefix: str = ""):
    """Adds {prefix}normalized_name, romanized_name, accent_folded_name, source_script and name_tokens (repeats kept)."""
    p = lambda c: prefix + c
    df = once(df, __spelled=_spelled(nfkc(F.col(raw))))
    df = once(df, **{p("source_script"): script(F.col("__spelled")), "__name": F.regexp_replace("__spelled", pattern(PREFIX), "")})
    latin = F.col(p("source_script")) == "latin"
    df = once(df, __folded=F.lower(fold_accents(F.col("__name"))), __roman=F.when(~latin, romanize(F.col("__name"))))
    df = once(df, **{p("accent_folded_name"): _clean(_mapped(F.col("__folded"), LEGAL_FORMS)), "__latin": F.regexp_replace(_spelled(F.lower(fold_accents(F.col("__roman")))), pattern(PREFIX), "")})
    df = once(df, **{p("romanized_name"): F.when(latin, F.col(p("accent_folded_name"))).otherwise(_clean(_mapped(F.col("__latin"), LEGAL_FORMS))), p("normalized_name"): _clean(F.lower("__name"))})
    return df.withColumn(p("name_tokens"), tokens(F.col(p("romanized_name")))).drop("__spelled", "__name", "__folded", "__roman", "__latin")


def with_address(df, raw: str, country: str, prefix: str = ""):
    """Adds {prefix}normalized_address, address_tokens, is_empty_address, has_landmark_ref, is_cedex and postal_code (null if none)."""
    p = lambda c: prefix + c
    none = F.lower(F.btrim(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), rf"\A[{GAP}]+|[{GAP}]+\z", ""))).isin(*NO_ADDRESS)
    df = once(df, __plain=nfkc(F.col(raw)))
    df = once(df, __plain_text=F.when(none, "").otherwise(F.lower(fold_accents(F.col("__plain")))))
    df = df.withColumn(p("has_landmark_ref"), F.col("__plain_text").rlike(quick(LANDMARK))).withColumn(p("is_cedex"), F.col("__plain_text").rlike(quick(CEDEX, "cC")))
    df = once(df, __text=F.regexp_replace(F.regexp_replace("__plain_text", quick(BOX), " bp "), quick(ORDINAL, "0-9"), " $1 "))
    found = lambda rule: F.nullif(F.regexp_extract("__text", quick(rule, "0-9"), 1), F.lit(""))
    named = F.upper(F.btrim(F.coalesce(F.col(country), F.lit(""))))
    postal = F.when(named == "INDIA", found(PIN)).when(named == "FRANCE", found(FIVE)).when(named == "US", F.substring(found(ZIP), 1, 5)).otherwise(F.coalesce(found(PIN), found(FIVE)))
    df = once(df.withColumn(p("postal_code"), postal), **{p("normalized_address"): _clean(_mapped(F.col("__text"), ABBREVIATIONS))})
    return df.withColumn(p("is_empty_address"), F.col(p("normalized_address")) == "").withColumn(p("address_tokens"), tokens(F.col(p("normalized_address")))).drop("__plain", "__plain_text", "__text")


def phonetic_token(token: Column) -> Column:
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    for a, b in PHONETIC_DIGRAPHS:
        letters = F.replace(letters, F.lit(a), F.lit(b))
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    digit = {c: d for d, chars in PHONETIC_GROUPS.items() for c in chars}
    codes = F.translate(letters, alphabet, "".join(digit.get(c, "0") for c in alphabet))
    # runs first, then vowels: a vowel between two letters of a group lets the second count again
    codes = F.replace(F.substring(F.regexp_replace(codes, r"(\d)\1+", "$1"), 2, 1 << 30), F.lit("0"), F.lit(""))
    first = F.translate(F.substring(letters, 1, 1), "".join(PHONETIC_INITIALS), "".join(PHONETIC_INITIALS.values()))
    return F.substring(F.concat(first, codes), 1, 8)


def phonetic_name(text: Column) -> Column:
    """Sorted distinct keys of two characters or more."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, " "), phonetic_token), lambda k: F.length(k) >= 2))), " ")


def character_ngrams(text: Column, limit: int = 48) -> Column:
    """Distinct trigrams of each token between ^ and $, the first `limit`."""
    grams = F.transform(tokens(text), lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(F.concat(F.lit("^"), t, F.lit("$")), i, F.lit(3))))
    return F.slice(F.array_distinct(F.flatten(grams)), 1, limit)


def encode_gram(gram: Column) -> Column:
    """"g" and six hex digits per character."""
    return F.concat(F.lit("g"), F.array_join(F.transform(F.regexp_extract_all(gram, F.lit("(?s)."), F.lit(0)), lambda c: F.lower(F.lpad(F.substring(F.hex(F.encode(c, "UTF-32")), -6, 6), 6, "0"))), ""))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longest)


def script_class(name: Column) -> Column:
    """indic, accented_latin, latin or other, by the letters of a name."""
    indic = "".join(f"\\x{{{b:X}}}-\\x{{{b + 0x7F:X}}}" for b in (0x0900, 0x0980, 0x0A80, 0x0B80, 0x0C00, 0x0C80, 0x0D00))
    return F.when(name.rlike(f"[{indic}]"), "indic").when(name.rlike(r"[\p{L}&&[^\x00-\x7F]]"), "accented_latin").when(name.rlike("[A-Za-z]"), "latin").otherwise("other")


def is_legal_variant(a: Column, b: Column) -> Column:
    """The same words but for legal ones, at least one, and not the same name."""
    legal = F.array(*[F.lit(w) for w in LEGAL_WORDS])
    x, y = (F.array_sort(F.array_except(word_set(c), legal)) for c in (a, b))
    return (F.size(x) > 0) & (x == y) & (F.lower(a) != F.lower(b))


def overlap_bucket(value: Column) -> Column:
    return F.when(value <= 0, "none").when(value < 0.3, "low").when(value < 0.7, "mid").otherwise("high")


def bucket_name(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")


def list_length(field: Column) -> Column:
    return F.when(F.btrim(F.coalesce(field, F.lit(""))) == "", 0).otherwise(F.size(F.split(field, ",")))


def source_of(entity_id: Column) -> Column:
    """The source an id names by its prefix; '' if none."""
    out = F.when(entity_id.rlike("^(S1-|1-)"), "source1")
    return out.when(entity_id.rlike("^(S2-|2-)"), "source2").when(entity_id.rlike("^(S3-|3-)"), "source3").otherwise("")


def postal_flags(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """equal, conflict, missing as 0.0 or 1.0."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    missing = (x == "") | (y == "")
    one = lambda c: c.cast("int").cast("double")
    return one(~missing & (x == y)), one(~missing & (x != y)), one(missing)


