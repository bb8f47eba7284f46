"""Queries of the linkage, one or more for each operator of the inventory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indic, similarity, text
from ..functions.unicode import fold_accents, nfkc
from ..operators import artifacts, decide, difficulty, features, index, metrics, model, represent, retrieve, select, sinks, splits, tokens, validate
from ..schema import MISSES, TRUTH
from ..sources import tables
from ..storage import shared_path
from . import fixtures, linkage
from .sql import JACCARD, RATIO, SUMMARY, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rows_sql(rows: list[tuple], columns: str) -> str:
    """A VALUES table; text quoted, None as null."""
    one = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({columns})"


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.RECORDS, "entity_id string, business_name string, business_address string, country string")


C = linkage.corpus


def no_tokens() -> Column:
    """An empty array of strings; a function, since a column needs a session and this module is imported before there is one."""
    return F.array().cast("array<string>")


# -- sources


@query("src_01_entity_view", with_tables("select entity_id, business_name, business_address, country from ents", "ents"))
def src_01(spark, d):
    return C(spark, d).records


@query("src_02_requested_ids", with_tables("select entity_id, business_name from ents where source = 'S1'", "ents"))
def src_02(spark, d):
    """All queries, requested by a file of ids that is written and read back."""
    c, at = C(spark, d), shared_path(spark)
    artifacts.write_ids(c.queries, at, "entity_id")
    return tables.only_ids(c.queries, tables.read_ids(spark, at)).select("entity_id", "business_name")


_FLAT = "replace(replace(replace({0}, chr(9), ' '), chr(13), ' '), '\"', ' ')"


@query("src_03_tsv_records", with_tables(f"select entity_id, {_FLAT.format('business_name')} as business_name, {_FLAT.format('business_address')} as business_address, country from ents", "ents"))
def src_03(spark, d):
    """All records, written as TSV and read back by the strict scan; tabs and quotes in texts become spaces first."""
    at, flat = shared_path(spark), lambda c: F.translate(c, '\t\r"', "   ").alias(c)
    sinks.write_tsv(C(spark, d).records.select("entity_id", flat("business_name"), flat("business_address"), "country"), at, ["entity_id"])
    return tables.read_records(spark, at, "plain")


@query("src_05_truth_file", with_tables("select s1, array_to_string(targets, ',') as targets, len(targets) as n from truth", "truth"))
def src_05(spark, d):
    """Truth, written as TSV and read back for exactly the queries."""
    c, at = C(spark, d), shared_path(spark)
    sinks.write_tsv(sinks.matching_rows(c.truth.withColumnRenamed("targets", "predicted")), at, ["source1_entity_id"])
    back = tables.read_truth(spark, at, c.queries.select("entity_id"))
    return back.select("s1", F.array_join(F.array_sort("targets"), ",").alias("targets"), F.size("targets").alias("n"))


@query("src_16_token_resource", with_tables("", "ents").rstrip() + ", docs as (select case country when 'fr' then 'France' else upper(country) end as country, list_distinct(list_filter(string_split(business_name, ' '), lambda t: t <> '')) as t from ents), own as (select country, unnest(t) as token from docs), counted as (select country, token, count(*) as df from own group by 1, 2 union all select 'global', token, count(*) from own group by 2), sizes as (select country, count(*) as n from docs group by 1 union all select 'global', count(*) from docs) select country, token, round(ln((1.0 + n) / (1.0 + df)) + 1, 4) as idf from counted join sizes using (country)")
def src_16(spark, d):
    """Token statistics of names, saved and loaded again."""
    at = shared_path(spark)
    docs = C(spark, d).records.select(text.normalize_country(F.col("country")).alias("country"), F.filter(F.split("business_name", " "), lambda t: t != "").alias("t"))
    found = tokens.idf(docs, "t")
    artifacts.save_resource(found, found, found.where("is_boilerplate"), at)
    return artifacts.load_resource(spark, at)[0]


@query("src_04_truth", with_tables("select s1, array_to_string(targets, ',') as targets, len(targets) as n from truth", "truth"))
def src_04(spark, d):
    return C(spark, d).truth.select("s1", F.array_join("targets", ",").alias("targets"), F.size("targets").alias("n"))


@query("src_09_id_lists", with_tables("select s1, case when n > d then 'repeated id' when n > ok then 'foreign prefix' end as fault, d::bigint as n from (select s1, len(x) as n, len(list_distinct(x)) as d, len(list_filter(x, lambda i: regexp_matches(i, '^S[23]-'))) as ok from (select s1, list(cand order by cand) as x from (select s1, cand from selected union all select s1, s1 from selected where right(s1, 1) = '3' union all select s1, cand from selected where right(s1, 1) = '6') group by 1))", "selected"))
def src_09(spark, d):
    """Candidate lists; those of queries that end in 3 get the query itself, of those that end in 6 every id twice: faults to be found."""
    chosen = linkage.kept(select.select(linkage.raw_ranked(C(spark, d)), linkage.CAP).select("s1", "cand"))
    ends = lambda x: chosen.where(F.col("s1").endswith(x))
    rows = chosen.unionByName(ends("3").select("s1", F.col("s1").alias("cand"))).unionByName(ends("6"))
    lists = rows.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_list("cand")), ",").alias("ids"))
    return lists.select("s1", tables.id_list_fault(F.col("ids"), True).alias("fault"), F.size(tables.ids_of(F.col("ids"))).cast("bigint").alias("n"))


@query("src_12_train_records", with_tables("select e.country, case when n = 0 then '0' when n = 1 then '1' when n <= 3 then '2-3' when n <= 5 then '4-5' else '6+' end as bucket, count(*) as n from (select s1, len(targets) as n from truth) t join ents e on e.entity_id = t.s1 group by 1, 2", "truth", "ents"))
def src_12(spark, d):
    c = C(spark, d)
    return splits.strata(tables.train_records(c.queries, c.truth)).groupBy("country", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("src_13_owners", with_tables("select cand as target, max(s1) as s1 from links group by 1", "links"))
def src_13(spark, d):
    return tables.owners(C(spark, d).truth)


@query("src_07_merged_candidates", with_tables("select s1, cand, rank, source as target_source from selected", "selected"))
def src_07(spark, d):
    c = C(spark, d)
    chosen = linkage.kept(select.select(linkage.raw_ranked(c), linkage.CAP))
    return tables.merged_candidates(select.wide(chosen, c.queries), sinks.provenance_rows(chosen)).select("s1", "cand", "rank", "target_source")


@query("src_08_collected_ids", with_tables("select 'candidate' as side, count(distinct cand) as n from selected union all select 'query', count(*) from ents where source = 'S1'", "selected", "ents"))
def src_08(spark, d):
    c = C(spark, d)
    left, right = tables.collect_ids(select.wide(select.select(linkage.raw_ranked(c), linkage.CAP), c.queries))
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(right, "candidate").unionByName(n(left, "query"))


# -- representation


def golden(spark: SparkSession, rows: DataFrame, known: list[tuple], columns: str) -> DataFrame:
    """Rows of the corpus, and rows with published results besides."""
    return rows.unionByName(spark.createDataFrame(known, columns))


_FORMS = [("a", "Cafe\x07 1", "Cafe 1"), ("b", "ﬁle", "file"), ("c", "ＡＢＣ", "ABC"), ("d", None, "")]


@query("nrm_01_nfkc", with_tables("select entity_id, nfc_normalize(regexp_replace(business_name, '[\\x00-\\x1f\\x7f]', '', 'g')) as name from ents union all select * from " + rows_sql([(k, v) for k, _, v in _FORMS], "entity_id, name"), "ents"))
def nrm_01(spark, d):
    """The corpus holds no compatibility forms, so NFC is its NFKC; the rows besides do."""
    rows = golden(spark, C(spark, d).records.select("entity_id", F.col("business_name").alias("t")), [(k, t) for k, t, _ in _FORMS], "entity_id string, t string")
    return rows.select("entity_id", nfkc(F.col("t")).alias("name"))


@query("nrm_02_script", with_tables("select entity_id, case when regexp_matches(business_name, '[\\x{0900}-\\x{0D7F}]') then 'of India' else 'latin' end as script from ents union all select * from " + rows_sql([(r[0], r[5]) for r in fixtures.CANONICAL], "entity_id, script"), "ents"))
def nrm_02(spark, d):
    rows = C(spark, d).records.select("entity_id", "business_name").unionByName(fixture(spark).select("entity_id", "business_name"))
    return rows.select("entity_id", indic.script(F.col("business_name")).alias("script"))


@query("nrm_03_fold_accents", with_tables("select entity_id, strip_accents(business_name) as folded from ents", "ents"))
def nrm_03(spark, d):
    return C(spark, d).records.select("entity_id", fold_accents(F.col("business_name")).alias("folded"))


@query("nrm_04_country", with_tables("select entity_id, case when country = '' then 'Unknown' when lower(trim(country)) in ('fr', 'fra', 'france') then 'France' when lower(trim(country)) in ('in', 'ind', 'india') then 'India' when lower(trim(country)) in ('us', 'usa') then 'US' else upper(trim(country)) end as country from ents", "ents"))
def nrm_04(spark, d):
    """Languages of two letters stand in for countries: those that name a known one, and open labels."""
    return C(spark, d).records.select("entity_id", text.normalize_country(F.col("country")).alias("country"))


_MAP = "case {0} when 'incorporated' then 'inc' when 'corporation' then 'corp' when 'limited' then 'ltd' when 'co' then 'company' else {0} end"
_FOLDED = r"array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(strip_accents(regexp_replace(replace(replace({0}, '&', ' and '), '+', ' and '), '^(?i)(m/s|messrs|the|shree|sri)\b\s*', ''))), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> ''), lambda t: " + _MAP.format("t").replace("{", "{{").replace("}", "}}") + "), ' ')"
_PLAIN = r"trim(regexp_replace(lower(regexp_replace(replace(replace({0}, '&', ' and '), '+', ' and '), '^(?i)(m/s|messrs|the|shree|sri)\b\s*', '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_ABBREVIATED = {"rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bvd": "boulevard", "bldg": "building", "build": "building", "apt": "suite", "ste": "suite", "flr": "floor", "fl": "floor", "opp": "opposite", "nr": "near", "dept": "department", "sq": "square", "dr": "drive", "ln": "lane", "pl": "place", "ct": "court", "pkwy": "parkway", "pky": "parkway", "hwy": "highway"}
_ADDRESS = r"array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> ''), lambda t: case t " + " ".join(f"when '{a}' then '{b}'" for a, b in _ABBREVIATED.items()) + " else t end), ' ')"


@query("nrm_05_normalize_name", with_tables(f"select entity_id, {_PLAIN.format('business_name')} as normalized_name, {_FOLDED.format('business_name')} as romanized_name, 'latin' as source_script from ents", "ents"))
def nrm_05(spark, d):
    return text.with_name(C(spark, d).records, "business_name").select("entity_id", "normalized_name", "romanized_name", "source_script")


@query("nrm_05_names_of_three_countries", "select entity_id, romanized_name, source_script from " + rows_sql([(r[0], r[4], r[5]) for r in fixtures.CANONICAL], "entity_id, romanized_name, source_script"))
def nrm_05f(spark, d):
    return represent.canonical(fixture(spark)).select("entity_id", "romanized_name", "source_script")


@query("nrm_06_normalize_address", with_tables(f"select entity_id, {_ADDRESS.format('business_address')} as normalized_address, {_ADDRESS.format('business_address')} = '' as is_empty_address from ents", "ents"))
def nrm_06(spark, d):
    return text.with_address(C(spark, d).records, "business_address", "country").select("entity_id", "normalized_address", "is_empty_address")


@query("nrm_06_addresses_of_three_countries", "select entity_id, normalized_address, postal_code from " + rows_sql([(r[0], r[6], r[7]) for r in fixtures.CANONICAL], "entity_id, normalized_address, postal_code"))
def nrm_06f(spark, d):
    return represent.canonical(fixture(spark)).select("entity_id", "normalized_address", "postal_code")


_ROMAN = [("भारत", "bhaarata"), ("नमस्ते", "namaste"), ("தமிழ்", "tamizh"), ("ABC 123 !@# 🚀 XYZ", "ABC 123 !@# 🚀 XYZ")]


@query("nrm_07_romanize", with_tables(f"select business_name as raw, business_name as roman from ents where not regexp_matches(business_name, '[\\x{{0900}}-\\x{{0D7F}}]') union all select raw, roman from {rows_sql(_ROMAN, 'raw, roman')}", "ents"))
def nrm_07(spark, d):
    """Names without a letter of these scripts stay as they are; the rows besides have some."""
    rows = golden(spark, C(spark, d).records.select(F.col("business_name").alias("raw")), [(a,) for a, _ in _ROMAN], "raw string")
    return rows.select("raw", indic.romanize(F.col("raw")).alias("roman"))


@query("nrm_08_normalize_raw", with_tables("select entity_id, name, address from norm", "norm"))
def nrm_08(spark, d):
    return C(spark, d).records.select("entity_id", text.normalize_raw(F.col("business_name")).alias("name"), text.normalize_raw(F.col("business_address")).alias("address"))


@query("nrm_09_raw_tokens", with_tables("select entity_id, field, string_agg(token, ' ' order by token) as tokens, count(*) as n from toks group by 1, 2", "toks"))
def nrm_09(spark, d):
    rows = C(spark, d).records
    out = None
    for field, column in (("name", "business_name"), ("address", "business_address")):
        t = text.raw_tokens(text.normalize_raw(F.col(column)))
        one = rows.select("entity_id", F.lit(field).alias("field"), F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).cast("bigint").alias("n")).where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query("nrm_10_word_set", with_tables("select entity_id, array_to_string(list_sort(words), ' ') as words, len(words) as n from wordy", "wordy"))
def nrm_10(spark, d):
    w = text.word_set(F.col("business_name"))
    return C(spark, d).records.select("entity_id", F.array_join(F.array_sort(w), " ").alias("words"), F.size(w).alias("n"))


@query("nrm_11_script_class", with_tables(r"select entity_id, case when regexp_matches(business_name, '[^\x00-\x7F]') and len(regexp_extract_all(business_name, '\p{L}')) > len(regexp_extract_all(business_name, '[A-Za-z]')) then 'accented_latin' when regexp_matches(business_name, '[A-Za-z]') then 'latin' else 'other' end as class from ents", "ents"))
def nrm_11(spark, d):
    return C(spark, d).records.select("entity_id", text.script_class(F.col("business_name")).alias("class"))


_CONTENT = "list_sort(list_filter({0}.words, lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in text.LEGAL_WORDS) + "], w)))"


@query("nrm_12_legal_variant", with_tables(f"select s.s1, s.cand, len({_CONTENT.format('a')}) > 0 and {_CONTENT.format('a')} = {_CONTENT.format('b')} and lower(a.business_name) <> lower(b.business_name) as variant from selected s join wordy a on a.entity_id = s.s1 join wordy b on b.entity_id = s.cand", "selected", "wordy"))
def nrm_12(spark, d):
    c = C(spark, d)
    names = lambda key, to: c.records.select(F.col("entity_id").alias(key), F.col("business_name").alias(to))
    both = select.select(linkage.raw_ranked(c), linkage.CAP).join(names("s1", "x"), "s1").join(names("cand", "y"), "cand")
    return both.select("s1", "cand", text.is_legal_variant(F.col("x"), F.col("y")).alias("variant"))


@query("nrm_13_overlap_bucket", with_tables("select s1, cand, case when j <= 0 then 'none' when j < 0.3 then 'low' when j < 0.7 then 'mid' else 'high' end as bucket from (select s.s1, s.cand, " + JACCARD.format("a.words", "b.words", "0.0") + " as j from selected s join wordy a on a.entity_id = s.s1 join wordy b on b.entity_id = s.cand)", "selected", "wordy"))
def nrm_13(spark, d):
    c = C(spark, d)
    words = c.records.select("entity_id", text.word_set(F.col("business_name")).alias("w"))
    chosen = select.select(linkage.raw_ranked(c), linkage.CAP)
    both = chosen.join(words.select(F.col("entity_id").alias("s1"), F.col("w").alias("a")), "s1").join(words.select(F.col("entity_id").alias("cand"), F.col("w").alias("b")), "cand")
    return both.select("s1", "cand", text.overlap_bucket(text.jaccard(F.col("a"), F.col("b"), 0.0)).alias("bucket"))


#: Trigrams of a name's tokens, repeats and all; ORDERED takes the first 48 different ones of such a column.
_GRAMS = "flatten(list_transform(list_filter(string_split({0}, ' '), lambda t: t <> ''), lambda t: list_transform(range(1, length(t) + 1), lambda i: substr('^' || t || '$', i, 3))))"
_ORDERED = "list_filter({0}, lambda g, i: list_position({0}, g) = i)[1:48]"


@query("nrm_14_character_ngrams", with_tables(f"select entity_id, len(g) as n, array_to_string(g, ' ') as grams from (select entity_id, {_ORDERED.format('every')} as g from (select entity_id, {_GRAMS.format('name')} as every from norm))", "norm"))
def nrm_14(spark, d):
    g = text.character_ngrams(text.normalize_raw(F.col("business_name")))
    return C(spark, d).records.select("entity_id", F.size(g).alias("n"), F.array_join(g, " ").alias("grams"))


@query("nrm_15_encode_gram", with_tables(f"select gram, 'g' || array_to_string(list_transform(string_split(gram, ''), lambda c: printf('%06x', unicode(c))), '') as code from (select distinct unnest({_GRAMS.format('name')}) as gram from norm)", "norm"))
def nrm_15(spark, d):
    grams = C(spark, d).records.select(F.explode(text.character_ngrams(text.normalize_raw(F.col("business_name")), 1 << 20)).alias("gram")).distinct()
    return grams.select("gram", text.encode_gram(F.col("gram")).alias("code"))


def _phonetic(t: str) -> str:
    """The phonetic key in SQL: digraphs, letters to digits, runs, vowels out, mapped initial."""
    letters = f"regexp_replace(lower({t}), '[^a-z]', '', 'g')"
    for a, b in text.PHONETIC_DIGRAPHS:
        letters = f"replace({letters}, '{a}', '{b}')"
    digit = {c: k for k, chars in text.PHONETIC_GROUPS.items() for c in chars}
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    codes = f"translate({letters}, '{alphabet}', '{''.join(digit.get(c, '0') for c in alphabet)}')"
    for k in "0123456":
        codes = f"regexp_replace({codes}, '{k}+', '{k}', 'g')"
    first = f"translate({letters}[1:1], '{''.join(text.PHONETIC_INITIALS)}', '{''.join(text.PHONETIC_INITIALS.values())}')"
    return f"substr({first} || replace(substr({codes}, 2), '0', ''), 1, 8)"


@query("nrm_16_phonetic_token", with_tables(f"select distinct token, {_phonetic('token')} as key from toks where field = 'name'", "toks"))
def nrm_16(spark, d):
    t = C(spark, d).records.select(F.explode(text.raw_tokens(text.normalize_raw(F.col("business_name")))).alias("token")).distinct()
    return t.select("token", text.phonetic_token(F.col("token")).alias("key"))


_PHONETIC_NAME = "array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({0}, ' '), lambda t: " + _phonetic("t").replace("{", "{{").replace("}", "}}") + "), lambda k: length(k) >= 2))), ' ')"


@query("nrm_17_phonetic_name", with_tables(f"select entity_id, {_PHONETIC_NAME.format('name')} as phonetic from norm", "norm"))
def nrm_17(spark, d):
    return C(spark, d).records.select("entity_id", text.phonetic_name(text.normalize_raw(F.col("business_name"))).alias("phonetic"))


@query("nrm_18_canonical_view", with_tables(f"select e.entity_id, n.name as raw_name, {_PLAIN.format('e.business_name')} as normalized_name, {_FOLDED.format('e.business_name')} as accent_name, {_ADDRESS.format('e.business_address')} as normalized_address, '' as postal_code, {_PHONETIC_NAME.format(_FOLDED.format('e.business_name'))} as phonetic_name from ents e join norm n using (entity_id)", "ents", "norm"))
def nrm_18(spark, d):
    return represent.canonical_view(C(spark, d).records).select("entity_id", "raw_name", "normalized_name", "accent_name", "normalized_address", "postal_code", "phonetic_name")


@query("nrm_19_canonical", with_tables(f"select entity_id, 'source' || substr(entity_id, 2, 1) as source, case country when 'fr' then 'France' else upper(country) end as country, {_FOLDED.format('business_name')} as accent_folded_name, {_ADDRESS.format('business_address')} as normalized_address, '2.0.0' as normalizer_version from ents", "ents"))
def nrm_19(spark, d):
    return represent.canonical(C(spark, d).records).select("entity_id", "source", "country", "accent_folded_name", "normalized_address", "normalizer_version")


@query("nrm_20_canonical_any", with_tables(f"select entity_id, {_FOLDED.format('business_name')} as accent_folded_name from ents", "ents"))
def nrm_20(spark, d):
    rows = C(spark, d).records.select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")
    return represent.canonical_any(rows).select("entity_id", "accent_folded_name")


@query("nrm_22_list_length", with_tables("select e.entity_id as s1, count(s.cand) as n from ents e left join selected s on s.s1 = e.entity_id where e.source = 'S1' group by 1", "ents", "selected"))
def nrm_22(spark, d):
    c = C(spark, d)
    lists = select.wide(select.select(linkage.raw_ranked(c), linkage.CAP), c.queries)
    return lists.select(F.col("source1_entity_id").alias("s1"), text.list_length(F.col("candidate_entity_ids")).cast("bigint").alias("n"))


@query("nrm_23_percentile", with_tables("select quantile_disc(width, 0.5) as p50, quantile_disc(width, 0.95) as p95, quantile_disc(width, 0.99) as p99 from per", "per"))
def nrm_23(spark, d):
    e = entities(C(spark, d))
    at = lambda q, name: F.expr(f"cast(percentile_disc({q}) within group (order by width) as int)").alias(name)
    return e.agg(at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99"))


@query("nrm_24_metaphone", "select word, code from " + rows_sql([("knight", "NT"), ("thumb", "0M"), ("phone", "FN"), ("school", "SKL"), ("wright", "RT")], "word, code"))
def nrm_24(spark, d):
    words = spark.createDataFrame([(w,) for w in ("knight", "thumb", "phone", "school", "wright")], "word string")
    return words.select("word", similarity.metaphone_name("word").alias("code"))


# -- token statistics


def _idf_sql(tokens_of: str) -> str:
    return f"""with docs as (select country, {tokens_of} as t from norm), own as (select country, unnest(t) as token from docs),
counted as (select country, token, count(*) as df from own group by 1, 2 union all select 'global', token, count(*) from own group by 2),
sizes as (select country, count(*) as n from docs group by 1 union all select 'global', count(*) from docs)
select country, token, df, n, round(ln((1.0 + n) / (1.0 + df)) + 1, 4) as idf, df::double / n >= 0.01 as is_boilerplate from counted join sizes using (country)"""


_TOKENS_SQL = "list_distinct(list_filter(string_split(name, ' '), lambda t: length(t) >= 2))"


def _token_docs(spark, d) -> DataFrame:
    return C(spark, d).records.select("entity_id", "country", text.raw_tokens(text.normalize_raw(F.col("business_name"))).alias("t"))


@query("tok_01_idf", with_tables("", "norm").rstrip() + ", " + _idf_sql(_TOKENS_SQL)[5:])
def tok_01(spark, d):
    return tokens.idf(_token_docs(spark, d), "t")


@query("tok_02_weighed_tokens", with_tables("", "norm").rstrip() + ", res as (" + _idf_sql(_TOKENS_SQL) + ") select n.entity_id, round(sum(coalesce(r.idf, g.idf, 10.0)), 4) as weight from (select entity_id, country, unnest(" + _TOKENS_SQL + ") as token from norm) n left join res r on r.country = n.country and r.token = n.token left join res g on g.country = 'global' and g.token = n.token group by 1")
def tok_02(spark, d):
    docs = _token_docs(spark, d)
    own = docs.select("entity_id", "country", F.explode("t").alias("token"))
    return tokens.weighed(own, tokens.idf(docs, "t")).groupBy("entity_id").agg(F.round(F.sum("idf"), 4).alias("weight"))


@query("tok_03_boilerplate", with_tables("", "norm").rstrip() + ", res as (" + _idf_sql(_TOKENS_SQL) + ") select n.entity_id, count(*) filter (r.is_boilerplate) as n from (select entity_id, country, unnest(" + _TOKENS_SQL + ") as token from norm) n join res r on r.country = n.country and r.token = n.token group by 1")
def tok_03(spark, d):
    docs = _token_docs(spark, d)
    own = docs.select("entity_id", "country", F.explode("t").alias("token"))
    return tokens.flagged(own, tokens.idf(docs, "t")).groupBy("entity_id").agg(F.sum(F.col("is_boilerplate").cast("bigint")).alias("n"))


_MINED = f"""docs as (select case country when 'fr' then 'France' else 'US' end as country, list_distinct(list_filter(string_split({_FOLDED.format('business_name')}, ' '), lambda t: t <> '')) as n, list_distinct(list_filter(string_split({_ADDRESS.format('business_address')}, ' '), lambda t: t <> '')) as a from ents),
own as (select 'n' as field, country, unnest(n) as token from docs union all select 'a', country, unnest(a) from docs),
counted as (select field, country, token, count(*) as df from own group by 1, 2, 3 union all select field, 'global', token, count(*) from own group by 1, 3),
sizes as (select country, count(*) as n from docs group by 1 union all select 'global', count(*) from docs)"""


@query("tok_04_mined_boilerplate", with_tables("", "ents").rstrip() + ", " + _MINED + " select distinct country, token from counted join sizes using (country) where df::double / n >= 0.01")
def tok_04(spark, d):
    return tokens.mine(represent.canonical(C(spark, d).records))[2]


@query("tok_05_frequencies", with_tables("select country, source, token, df from dfs", "dfs"))
def tok_05(spark, d):
    return index.build_raw(C(spark, d).targets).df


# -- index and retrieval


@query("idx_01_raw_index", with_tables("select n.country, n.source, count(*) as records, (select count(*) from toks t where t.country = n.country and t.source = n.source) as postings from norm n where n.source <> 'S1' group by 1, 2", "norm", "toks"))
def idx_01(spark, d):
    i = index.build_raw(C(spark, d).targets)
    n = lambda df, name: df.groupBy("country", "source").agg(F.count(F.lit(1)).alias(name))
    return n(i.records, "records").join(n(i.postings, "postings"), ["country", "source"])


@query("idx_05_comparison_space", with_tables("select pairs from space", "space"))
def idx_05(spark, d):
    c = C(spark, d)
    return index.comparison_space(c.queries, c.targets)


@query("idx_06_entity_scripts", with_tables("select entity_id, 'latin' as source_script from ents where source <> 'S1' union all select 'S2-none', 'unknown'", "ents"))
def idx_06(spark, d):
    c = C(spark, d)
    ids = c.targets.select(text.normalize_country(F.col("country")).alias("country"), "entity_id").unionByName(spark.createDataFrame([("US", "S2-none")], "country string, entity_id string"))
    view = represent.canonical_view(c.targets)
    return index.entity_scripts(index.Index(view, view, view), ids).select("entity_id", "source_script")


@query("ret_01_exact", with_tables("select s1, source, cand, channel from exact", "exact"))
def ret_01(spark, d):
    c = C(spark, d)
    return retrieve.exact(retrieve.raw_queries(c.queries), index.build_raw(c.targets).records, {"exact_name": "name", "exact_address": "address"}, retrieve.POOL)


@query("ret_03_rare_fields", with_tables("select s1, source, cand, channel, round(score, 6) as score from rare", "rare"))
def ret_03(spark, d):
    c = C(spark, d)
    q = retrieve.raw_queries(c.queries)
    own = [index.tagged(F.col(f"{f}_tokens"), channel=f"{f}_token", field=f) for f in ("name", "address")]
    t = q.select("s1", "country", F.explode(F.flatten(F.array(*own))).alias("t")).select("s1", "country", "t.*")
    found = retrieve.by_channel(retrieve.rare(t, index.build_raw(c.targets), {"name_token": 120, "address_token": 120}, retrieve.RARE))
    return found.withColumn("score", F.round("score", 6))


@query("ret_04_raw_candidates", with_tables("select s1, cand, source, exact_name, exact_address, name_token, address_token, round(score, 6) as score from found", "found"))
def ret_04(spark, d):
    c = C(spark, d)
    return retrieve.raw_candidates(c.queries, index.build_raw(c.targets)).withColumn("score", F.round("score", 6))


_VIEW = f"""view as (select * exclude (every), {_ORDERED.format('every')} as name_ngrams from (select *, {_GRAMS.format('accent_name')} as every from (select e.entity_id, e.source, case e.country when 'fr' then 'France' else upper(e.country) end as country, n.name as raw_name, n.address as raw_address, {_PLAIN.format('e.business_name')} as normalized_name,
 {_FOLDED.format('e.business_name')} as accent_name, {_ADDRESS.format('e.business_address')} as normalized_address from ents e join norm n using (entity_id)))),
vals as (select entity_id, country, source, unnest([{{'c': 'raw_name_exact', 'v': raw_name}}, {{'c': 'raw_address_exact', 'v': raw_address}}, {{'c': 'canonical_name_exact', 'v': normalized_name}}, {{'c': 'accent_name_exact', 'v': accent_name}},
 {{'c': 'canonical_address_exact', 'v': normalized_address}}, {{'c': 'romanized_exact', 'v': accent_name}}, {{'c': 'phonetic_exact', 'v': {_PHONETIC_NAME.format('accent_name')}}}]) as x from view),
pools as (select * from (select *, row_number() over (partition by country, source, x.c, x.v order by entity_id) as rn from vals where source <> 'S1' and x.v <> '') where rn <= 250),
xhits as (select q.entity_id as s1, p.source, p.entity_id as cand, q.x.c as channel from vals q join pools p on p.country = q.country and p.x.c = q.x.c and p.x.v = q.x.v where q.source = 'S1')"""


@query("ret_05_canonical_exact", with_tables("", "ents", "norm").rstrip() + ", " + _VIEW + " select s1, source, cand, channel from xhits")
def ret_05(spark, d):
    c = C(spark, d)
    view = linkage.views(c)
    return retrieve.exact(view.where("entity_id like 'S1-%'").withColumnRenamed("entity_id", "s1"), view.join(c.targets.select("entity_id", "source"), "entity_id"), index.EXACT, retrieve.EXACT_POOL)


def _gathered(name: str) -> str:
    """Tokens of the view by channel: query side and target side."""
    words = lambda v, least=1: f"list_distinct(list_filter(string_split({v}, ' '), lambda t: length(t) >= {least}))"
    if name == "queries":
        own = {"raw_name_token": ("raw_name", words("raw_name", 2)), "raw_address_token": ("raw_address", words("raw_address", 2)), "canonical_name_token": ("normalized_name", words("accent_name")), "canonical_address_token": ("normalized_address", words("normalized_address")), "romanized_token": ("romanized_name", words("accent_name")), "romanized_ngram": ("name_ngrams", "name_ngrams")}
    else:
        own = {"raw_name": ("raw_name", words("raw_name")), "raw_address": ("raw_address", words("raw_address")), "normalized_name": ("normalized_name", words("normalized_name")), "normalized_address": ("normalized_address", words("normalized_address")), "romanized_name": ("romanized_name", words("accent_name")), "name_ngrams": ("name_ngrams", "name_ngrams")}
    return " union all ".join(f"select entity_id, country, source, '{c}' as channel, '{f}' as field, unnest({t}) as token from view" for c, (f, t) in own.items())


def _token_channels(asked: str = "true") -> str:
    """The token channels of the view, over the query tokens that meet a condition."""
    return f"""posts as ({_gathered('targets')}), d as (select country, source, token, count(distinct entity_id) as df from posts where source <> 'S1' group by 1, 2, 3),
asks as (select * from ({_gathered('queries')}) where {asked}), picks as (select * from (select q.entity_id as s1, d.source, q.country, q.channel, q.field, q.token, d.df, row_number() over (partition by q.entity_id, d.source, q.channel order by d.df, q.token) as rn
 from asks q join d on d.country = q.country and d.token = q.token where q.source = 'S1' and d.df <= case q.channel when 'romanized_ngram' then 400 else 250 end) where rn <= 4),
thits as (select p.s1, p.source, t.entity_id as cand, p.channel, round(sum(1 / log2(p.df + 2)), 9) as score from picks p join posts t on t.country = p.country and t.source = p.source and t.field = p.field and t.token = p.token group by 1, 2, 3, 4)"""


@query("idx_02_canonical_index", with_tables("", "ents", "norm").rstrip() + ", " + _VIEW + f", posts as ({_gathered('targets')}) select country, source, field, count(*) as postings from posts where source <> 'S1' group by 1, 2, 3")
def idx_02(spark, d):
    i = index.build_canonical(C(spark, d).targets)
    return i.postings.groupBy("country", "source", "field").agg(F.count(F.lit(1)).alias("postings"))


@query("ret_06_canonical_rare_tokens", with_tables("", "ents", "norm").rstrip() + ", " + _VIEW + ", " + _token_channels() + " select s1, source, cand, channel, round(score, 6) as score from thits")
def ret_06(spark, d):
    c = C(spark, d)
    view = linkage.views(c)
    idx = index.index_views(view.join(c.targets.select("entity_id", "source"), "entity_id"))
    return retrieve.canonical_candidates_of_tokens(view.where("entity_id like 'S1-%'"), idx).withColumn("score", F.round("score", 6))


#: All fourteen channels: boilerplate out of the query's words, candidates with their channels and score.
_FOUND = f"""{_VIEW}, boil as (select token from (select unnest(list_distinct(list_filter(string_split(accent_name, ' '), lambda t: t <> ''))) as token from view) group by 1 having count(*) >= 0.05 * (select count(*) from view)
 union select token from (select unnest(list_distinct(list_filter(string_split(normalized_address, ' '), lambda t: t <> ''))) as token from view) group by 1 having count(*) >= 0.05 * (select count(*) from view)),
{_token_channels("channel = 'romanized_ngram' or token not in (select token from boil)")},
found14 as (select s1, cand, source, list_sort(list(channel)) as channels, round(sum(score), 9) as score from (select s1, cand, source, channel, score from thits union all select s1, cand, source, channel, 0.0::double from xhits) group by 1, 2, 3)"""
_WEIGHED = "list_transform(channels, lambda c: case c " + " ".join(f"when '{c}' then {w}::double" for c, w in retrieve.CHANNELS.items()) + " end)"
_PROVENANCE = "array_to_string(list_filter([" + ", ".join(f"'{c}'" for c in retrieve.CHANNELS) + "], lambda c: list_contains(channels, c)), ',')"


def _ranked14(of: str) -> str:
    return f"select *, row_number() over (partition by s1 order by list_max({_WEIGHED}) desc, round(list_sum({_WEIGHED}), 6) desc, len(channels) desc, score desc, cand) as rank from ({of})"


def _only14(prefix: str, has: bool = True) -> str:
    return f"select * from (select * exclude (channels), list_filter(channels, lambda c: {'' if has else 'not '}starts_with(c, '{prefix}')) as channels from found14) where len(channels) > 0"


def _selected14(of: str) -> str:
    """Capped selection with floors of 2 and a quota of 10 for those that rescue channels alone found."""
    rescue = "len(list_filter(channels, lambda c: c not in (" + ", ".join(f"'{c}'" for c in retrieve.RESCUE) + "))) = 0"
    return f"""select * exclude (rank), row_number() over (partition by s1 order by rank) as rank from (select *, row_number() over (partition by s1 order by prio, rank) as place from
 (select *, row_number() over (partition by s1, rescue order by prio, rank) as rq from (select *, {rescue} as rescue, case when sn <= 2 then case source when 'S2' then 0 else 1 end else 2 end as prio
 from (select *, row_number() over (partition by s1, source order by rank) as sn from ({of})))) where not rescue or rq <= 10) where place <= 50"""


def _with14(query: str, *names: str) -> str:
    return with_tables("", "ents", "norm", *names).rstrip() + ", " + _FOUND + " " + query


@query("ret_08_channel_candidates", _with14(f"select s1, cand, source, {_PROVENANCE} as channels, round(score, 6) as score, rank from ({_ranked14('from found14')})"))
def ret_08(spark, d):
    return linkage.canonical_ranked(C(spark, d)).select("s1", "cand", "source", select.provenance_channels(F.col("channels")).alias("channels"), F.round("score", 6).alias("score"), "rank")


@query("ret_09_raw_channels_only", _with14(f"select s1, cand, {_PROVENANCE} as channels, rank from ({_ranked14(_only14('raw_'))})"))
def ret_09(spark, d):
    only = retrieve.only_channels(linkage.canonical_ranked(C(spark, d)).drop("rank"), [c for c in retrieve.CHANNELS if c.startswith("raw_")])
    return select.rank_channels(only).select("s1", "cand", select.provenance_channels(F.col("channels")).alias("channels"), "rank")


_NEIGHBOURS = "posted as (select entity_id as cand, country, words, token, row_number() over (partition by token order by entity_id) as place, count(*) over (partition by token) as df from (select *, unnest(words) as token from wordy where source <> 'S1')), near as (select distinct q.entity_id as s1, p.cand, " + JACCARD.format("q.words", "p.words", "0.0") + " as j from (select *, unnest(words) as token from wordy where source = 'S1') q join posted p on p.token = q.token and p.country = q.country where p.df <= 200 and p.place <= 50)"


@query("ret_10_token_neighbours", with_tables("", "wordy").rstrip() + ", " + _NEIGHBOURS + " select s1, cand, round(j, 6) as jaccard from near")
def ret_10(spark, d):
    c = C(spark, d)
    w = c.records.select("entity_id", "country", text.word_set(F.col("business_name")).alias("words"))
    found = retrieve.token_neighbours(w.where("entity_id like 'S1-%'").withColumnRenamed("entity_id", "s1"), w.where("entity_id not like 'S1-%'"))
    return found.withColumn("jaccard", F.round("jaccard", 6))


# -- ranking and selection


@query("rnk_01_raw_rank", with_tables("select s1, cand, rank from ranked", "ranked"))
def rnk_01(spark, d):
    return linkage.raw_ranked(C(spark, d)).select("s1", "cand", "rank")


_STRONGEST = "list_filter([" + ", ".join(f"'{c}'" for c in sorted(retrieve.CHANNELS, key=lambda c: (-retrieve.CHANNELS[c], list(retrieve.CHANNELS).index(c)))) + "], lambda c: list_contains(channels, c))[1]"


@query("rnk_03_provenance", _with14(f"select s1, cand, {_PROVENANCE} as provenance, {_STRONGEST} as strongest, len(list_filter(channels, lambda c: c not in ('postal_exact', 'romanized_ngram', 'phonetic_exact'))) = 0 as rescue from found14"))
def rnk_03(spark, d):
    rows = linkage.canonical_ranked(C(spark, d))
    return rows.select("s1", "cand", select.provenance_channels(F.col("channels")).alias("provenance"), select.strongest_channel(F.col("channels")).alias("strongest"), select.rescue_only(F.col("channels")).alias("rescue"))


@query("sel_01_capped", with_tables("select s1, cand, rank from selected", "selected"))
def sel_01(spark, d):
    return select.select(linkage.raw_ranked(C(spark, d)), linkage.CAP, linkage.FLOOR).select("s1", "cand", "rank")


@query("sel_02_rescue_quota", _with14(f"select s1, cand, rank from ({_selected14(_ranked14('from found14'))})"))
def sel_02(spark, d):
    return select.select(linkage.canonical_ranked(C(spark, d)), linkage.CAP, linkage.FLOOR, linkage.QUOTA).select("s1", "cand", "rank")


_SWEEP = [5, 10, 20, 50]


@query("sel_04_cap_sweep", with_tables(f"select cap, count(*) as pairs, count(l.cand) as links from (select unnest({_SWEEP}) as cap) c join (select * from placed) p on p.place <= c.cap left join links l on l.s1 = p.s1 and l.cand = p.cand group by 1", "placed", "links"))
def sel_04(spark, d):
    c = C(spark, d)
    ranked = linkage.kept(linkage.raw_ranked(c))
    links = c.links.withColumn("hit", F.lit(1))
    return select.sweep(ranked, _SWEEP).join(links, ["s1", "cand"], "left").groupBy("cap").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("links"))


@query("sel_03_choose_cap", with_tables(f"""points as (select cap, count(*) as pairs, count(l.cand) as links from (select unnest({_SWEEP}) as cap) c join placed p on p.place <= c.cap left join links l on l.s1 = p.s1 and l.cand = p.cand group by 1),
steps as (select *, links - lag(links) over (order by cap) as dl, pairs - lag(pairs) over (order by cap) as dp from points)
select max(cap) as cap from steps where cap < (select coalesce(min(cap), 1000000) from steps where dl <= 0 or dp > 100 * dl)""", "placed", "links").replace("\npoints as", ",\npoints as"))
def sel_03(spark, d):
    return select.choose_cap(sel_04(spark, d).select("cap", "links", "pairs"))


# -- sinks


@query("snk_01_candidate_lists", with_tables("select e.entity_id as source1_entity_id, coalesce(string_agg(s.cand, ',' order by s.rank), '') as candidate_entity_ids from ents e left join selected s on s.s1 = e.entity_id where e.source = 'S1' group by 1", "ents", "selected"))
def snk_01(spark, d):
    c = C(spark, d)
    return select.wide(select.select(linkage.raw_ranked(c), linkage.CAP), c.queries)


@query("snk_02_provenance", with_tables("select s1 as source1_entity_id, cand as candidate_entity_id, source as target_source, concat_ws(',', case exact_name when 1 then 'exact_name' end, case exact_address when 1 then 'exact_address' end, case name_token when 1 then 'name_token' end, case address_token when 1 then 'address_token' end) as provenance, rank, exact_name, exact_address, name_token, address_token from selected", "selected"))
def snk_02(spark, d):
    return sinks.provenance_rows(select.select(linkage.raw_ranked(C(spark, d)), linkage.CAP)).drop("retrieval_score")


@query("snk_04_matching_rows", with_tables("select s1 as source1_entity_id, array_to_string(targets, ',') as matched_entity_ids from truth", "truth"))
def snk_04(spark, d):
    return sinks.matching_rows(C(spark, d).truth.withColumnRenamed("targets", "predicted"))


@query("snk_06_content_hash", with_tables("""select sha256(string_agg(line, chr(10) order by line)) as sha256 from (select substr(h, 1, 2) || ':' || sum(('0x' || substr(h, 3, 12))::bigint)::varchar || ':' || count(*) as line
 from (select sha256(concat_ws(chr(9), entity_id, business_name, business_address, country)) as h from ents) group by substr(h, 1, 2))""", "ents"))
def snk_06(spark, d):
    return sinks.content_hash(C(spark, d).records, ["entity_id", "business_name", "business_address", "country"])


@query("snk_09_gold_slice", with_tables("select t.s1, len(t.targets) as n from truth t", "truth"))
def snk_09(spark, d):
    c = C(spark, d)
    return sinks.gold_slice(c.truth, c.queries.select(F.col("entity_id").alias("s1"))).select("s1", F.size("targets").alias("n"))


@query("snk_03_miss_file", with_tables("""select s1 as source1_entity_id, array_to_string(truth_list, ',') as truth_entity_ids, array_to_string(list_sort(m), ',') as missed_truth_ids, case when len(m) = 0 then 'complete' else 'miss' end as status
 from (select t.s1, t.targets as truth_list, list_filter(t.targets, lambda x: not list_contains(coalesce(k.cands, []), x)) as m from truth t left join kept k on k.s1 = t.s1)""", "truth", "kept"))
def snk_03(spark, d):
    """The miss audit, written under its header and read back."""
    c, at = C(spark, d), shared_path(spark)
    ranked = linkage.kept(linkage.raw_ranked(c))
    artifacts.write_misses(metrics.misses(ranked, select.select(ranked, linkage.CAP), c.truth), at)
    return tables.read_tsv(spark, at, MISSES, "plain").select("source1_entity_id", "truth_entity_ids", "missed_truth_ids", "status")


# -- metrics


def entities(c: linkage.Corpus) -> DataFrame:
    return metrics.per_entity(select.select(linkage.raw_ranked(c), linkage.CAP, linkage.FLOOR), c.truth)


@query("met_01_recall_and_width", with_tables(f"select {SUMMARY}, (select pairs from space) as space, round(1 - sum(width) / (select pairs from space)::double, 9) as reduction_ratio, round((select pairs from space)::double / nullif(sum(width), 0), 6) as reduction_factor from per", "per", "space"))
def met_01(spark, d):
    c = C(spark, d)
    return metrics.summary(entities(c), index.comparison_space(c.queries, c.targets))


@query("met_03_entity_recall", with_tables(f"select s1, {RATIO.format('hit_n', 'truth_n')} as recall from per", "per"))
def met_03(spark, d):
    return entities(C(spark, d)).select("s1", F.round(metrics.entity_recall(F.col("hit_n"), F.col("truth_n")), 6).alias("recall"))


_ORDER = "case channel " + " ".join(f"when '{c}' then {k}" for k, c in enumerate(retrieve.CHANNELS)) + " end"


@query("met_04_channel_hits", _with14(f"select channel, count(*) as hits, sum((place = lo)::int)::bigint as incremental from (select *, min(place) over (partition by s1, cand) as lo from (select s1, cand, channel, {_ORDER} as place from (select f.s1, f.cand, unnest(f.channels) as channel from found14 f join links l on l.s1 = f.s1 and l.cand = f.cand))) group by 1", "links"))
def met_04(spark, d):
    c = C(spark, d)
    return metrics.channel_hits(linkage.canonical_ranked(c), c.truth)


@query("met_05_misses", with_tables("""select s1, truth_ids, missed_ids, case when missed_ids = '' then 'complete' else 'miss' end as status,
 case when missed_ids = '' then 'complete' when lost = 0 then 'cap_truncation' when nf = 0 then 'no_retrieval_evidence' when cut > 0 then 'mixed_cap_and_no_evidence' else 'no_retrieval_evidence_for_truth' end as reason
 from (select t.s1, array_to_string(t.targets, ',') as truth_ids, array_to_string(list_sort(m), ',') as missed_ids, len(list_intersect(m, f)) as cut, len(m) - len(list_intersect(m, f)) as lost, len(f) as nf
 from (select t.s1, t.targets, list_filter(t.targets, lambda x: not list_contains(coalesce(k.cands, []), x)) as m, coalesce(g.f, []) as f from truth t left join kept k on k.s1 = t.s1 left join (select s1, list(cand) as f from found group by 1) g on g.s1 = t.s1) t)""", "truth", "kept", "found"))
def met_05(spark, d):
    c = C(spark, d)
    ranked = linkage.kept(linkage.raw_ranked(c))
    return metrics.misses(ranked, select.select(ranked, linkage.CAP), c.truth).drop("candidate_ids")


@query("met_06_slices", with_tables("""select 'country' as slice, e.country as value, count(*) as entities, round(coalesce(sum(hit_n) / nullif(sum(truth_n), 0)::double, 1.0), 6) as link_recall, round(avg(width), 6) as width_mean from per p join ents e on e.entity_id = p.s1 group by 2
 union all select 'cardinality', case when truth_n = 0 then '0' when truth_n = 1 then '1' when truth_n <= 3 then '2-3' when truth_n <= 5 then '4-5' else '6+' end, count(*), round(coalesce(sum(hit_n) / nullif(sum(truth_n), 0)::double, 1.0), 6), round(avg(width), 6) from per group by 2""", "per", "ents"))
def met_06(spark, d):
    c = C(spark, d)
    labels = metrics.truth_bucket(c.truth).join(c.queries.select(F.col("entity_id").alias("s1"), "country"), "s1")
    return metrics.sliced(entities(c), labels)


def _variant(name: str, of: str) -> str:
    """The summary of a variant's selection."""
    per = f"""select t.s1, coalesce(len(k.cands), 0) as width, len(t.targets) as truth_n, len(list_intersect(coalesce(k.cands, []), t.targets)) as hit_n,
 len(list_filter(t.targets, lambda x: starts_with(x, 'S2'))) as truth_s2, len(list_filter(t.targets, lambda x: starts_with(x, 'S3'))) as truth_s3,
 len(list_filter(list_intersect(coalesce(k.cands, []), t.targets), lambda x: starts_with(x, 'S2'))) as hit_s2, len(list_filter(list_intersect(coalesce(k.cands, []), t.targets), lambda x: starts_with(x, 'S3'))) as hit_s3
 from truth t left join (select s1, list(cand) as cands from ({_selected14(_ranked14(of))}) group by 1) k on k.s1 = t.s1"""
    return f"select '{name}' as variant, {SUMMARY} from ({per})"


@query("met_07_variants", _with14(" union all ".join([_variant("union", "from found14"), _variant("raw_only", _only14("raw_")), _variant("canonical_only", _only14("raw_", False))]), "truth"))
def met_07(spark, d):
    c = C(spark, d)
    found = linkage.kept(linkage.canonical_ranked(c).drop("rank"))
    groups = {"union": list(retrieve.CHANNELS), "raw_only": [x for x in retrieve.CHANNELS if x.startswith("raw_")], "canonical_only": [x for x in retrieve.CHANNELS if not x.startswith("raw_")]}
    out = None
    for name, channels in groups.items():
        chosen = select.select(select.rank_channels(retrieve.only_channels(found, channels)), linkage.CAP, linkage.FLOOR, linkage.QUOTA)
        one = metrics.summary(metrics.per_entity(chosen, c.truth)).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("met_08_bootstrap")
def met_08(spark, d):
    """The paired difference of a query's recall: canonical channels against raw ones, at the same cap."""
    c = C(spark, d)
    recall = lambda e, name: e.select("s1", metrics.entity_recall(F.col("hit_n"), F.col("truth_n")).alias(name))
    challenger = metrics.per_entity(select.select(linkage.canonical_ranked(c), linkage.CAP, linkage.FLOOR, linkage.QUOTA), c.truth)
    both = recall(entities(c), "old").join(recall(challenger, "new"), "s1")
    return metrics.bootstrap(both.select("s1", (F.col("new") - F.col("old")).alias("delta")))


_POINTS = f"""points as (select 'cap ' || cap as name, count(l.cand) / (select count(*) from links)::double as recall, count(*) / (select count(*) from ents where source = 'S1')::double as width
 from (select unnest({_SWEEP}) as cap) c join placed p on p.place <= c.cap left join links l on l.s1 = p.s1 and l.cand = p.cand group by cap)"""


@query("met_09_pareto", with_tables("", "placed", "links").rstrip() + ", " + _POINTS + " select name, round(recall, 9) as recall, round(width, 9) as width from points p where not exists (select 1 from points q where q.recall >= p.recall and q.width <= p.width and (q.recall > p.recall or q.width < p.width))")
def met_09(spark, d):
    """The front of the cap sweep: link recall against pairs a query."""
    c = C(spark, d)
    links = c.links.agg(F.count(F.lit(1))).scalar()
    points = linkage.kept(sel_04(spark, d).select(F.concat(F.lit("cap "), "cap").alias("name"), (F.col("links") / links).alias("recall"), (F.col("pairs") / c.queries.agg(F.count(F.lit(1))).scalar()).alias("width")))
    return metrics.pareto(points).select("name", F.round("recall", 9).alias("recall"), F.round("width", 9).alias("width"))


_F05 = "case when len(p) = 0 and len(t) = 0 then 1.0 when len(list_intersect(p, t)) = 0 then 0.0 else 1.25 * (len(list_intersect(p, t)) / len(p)::double) * (len(list_intersect(p, t)) / len(t)::double) / (0.25 * len(list_intersect(p, t)) / len(p)::double + len(list_intersect(p, t)) / len(t)::double) end"
_EXACT_NAMES = "(select t.s1, t.targets as t, coalesce(e.p, []) as p from truth t left join (select s1, list(distinct cand) as p from exact where channel = 'exact_name' group by 1) e on e.s1 = t.s1)"


def _by_name(c: linkage.Corpus) -> DataFrame:
    """A plain predictor: every target of the same normalised name."""
    found = retrieve.exact(retrieve.raw_queries(c.queries), index.build_raw(c.targets).records, {"exact_name": "name"}, retrieve.POOL)
    lists = found.groupBy("s1").agg(F.collect_set("cand").alias("predicted"))
    return c.truth.select("s1").join(lists, "s1", "left").select("s1", F.coalesce("predicted", no_tokens()).alias("predicted"))


@query("met_11_entity_f05", with_tables(f"select s1, round({_F05}, 6) as f05 from {_EXACT_NAMES}", "truth", "exact"))
def met_11(spark, d):
    c = C(spark, d)
    return _by_name(c).join(c.truth, "s1").select("s1", F.round(metrics.f05(F.col("predicted"), F.col("targets")), 6).alias("f05"))


@query("met_12_macro_f05", with_tables(f"select round(avg({_F05}), 9) as macro_f05 from {_EXACT_NAMES}", "truth", "exact"))
def met_12(spark, d):
    c = C(spark, d)
    return metrics.macro_f05(_by_name(c), c.truth)


@query("met_13_predict_nothing", with_tables("select round(avg((len(targets) = 0)::int), 9) as macro_f05 from truth", "truth"))
def met_13(spark, d):
    return metrics.predict_nothing(C(spark, d).truth)


@query("met_14_country_counts", with_tables("select country, count(*) as n from ents group by 1", "ents"))
def met_14(spark, d):
    return C(spark, d).records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


# -- features, model, decision


def _raw_features(spark, d) -> DataFrame:
    c = C(spark, d)
    return features.raw_features(select.select(linkage.raw_ranked(c), linkage.CAP), c.records)


_NAMED = "(select entity_id, name, address, list_distinct(list_filter(string_split(name, ' '), lambda t: length(t) >= 2)) as nt, list_distinct(list_filter(string_split(address, ' '), lambda t: length(t) >= 2)) as ad from norm)"


@query("fea_01_raw_features", with_tables(f"select s.s1, s.cand, round({JACCARD.format('l.nt', 'r.nt', '1.0')}, 6) as name_jaccard, round(case when greatest(length(l.name), length(r.name)) = 0 then 1.0 else least(length(l.name), length(r.name)) / greatest(length(l.name), length(r.name))::double end, 6) as name_length_ratio, round({JACCARD.format('l.ad', 'r.ad', '1.0')}, 6) as address_jaccard, (r.address = '')::int::double as candidate_address_empty, s.rank::double as retrieval_rank, s.exact_name::double as exact_name, (s.source = 'S3')::int::double as src_is_s3 from selected s join {_NAMED} l on l.entity_id = s.s1 join {_NAMED} r on r.entity_id = s.cand", "selected", "norm"))
def fea_01(spark, d):
    f = _raw_features(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("s1", "cand", r("name_jaccard"), r("name_length_ratio"), r("address_jaccard"), "candidate_address_empty", "retrieval_rank", "exact_name", "src_is_s3")


@query("fea_03_jaro_winkler", with_tables("select s.s1, s.cand, round(jaro_winkler_similarity(l.name, r.name), 6) as jw from selected s join norm l on l.entity_id = s.s1 join norm r on r.entity_id = s.cand where regexp_full_match(l.name, '[ -~]+') and regexp_full_match(r.name, '[ -~]+')", "selected", "norm"))
def fea_03(spark, d):
    c = C(spark, d)
    own = c.records.select("entity_id", text.normalize_raw(F.col("business_name")).alias("n")).where(F.col("n").rlike(r"\A[ -~]+\z"))
    pairs = select.select(linkage.raw_ranked(c), linkage.CAP).select("s1", "cand")
    pairs = pairs.join(own.select(F.col("entity_id").alias("s1"), F.col("n").alias("l")), "s1").join(own.select(F.col("entity_id").alias("cand"), F.col("n").alias("r")), "cand")
    return pairs.select("s1", "cand", F.round(similarity.jaro_winkler("l", "r"), 6).alias("jw"))


@query("fea_03_jaro_winkler_all")
def fea_03_all(spark, d):
    """All selected pairs, by code points; the SQL of fea_03_jaro_winkler compares bytes and holds for ASCII names only."""
    c = C(spark, d)
    own = c.records.select("entity_id", text.normalize_raw(F.col("business_name")).alias("n"))
    pairs = select.select(linkage.raw_ranked(c), linkage.CAP).select("s1", "cand")
    pairs = pairs.join(own.select(F.col("entity_id").alias("s1"), F.col("n").alias("l")), "s1").join(own.select(F.col("entity_id").alias("cand"), F.col("n").alias("r")), "cand")
    return pairs.select("s1", "cand", F.round(similarity.jaro_winkler("l", "r"), 6).alias("jw"))


@query("fea_04_raw_feature_rows")
def fea_04(spark, d):
    return _raw_features(spark, d)


_POSTAL = [("a", "-", None, "12345", 0.0, 0.0, 1.0), ("b", "-", "12345", "99999", 0.0, 1.0, 0.0), ("c", "-", "1", "1", 1.0, 0.0, 0.0)]
_CODE = "coalesce(case country when 'fr' then nullif(regexp_extract({0}.address, '(^| )([0-9]{{5}})( |$)', 2), '') else coalesce(nullif(regexp_extract({0}.address, '(^| )([1-9][0-9]{{5}})( |$)', 2), ''), nullif(regexp_extract({0}.address, '(^| )([0-9]{{5}})( |$)', 2), '')) end, '')"


@query("fea_06_postal_flags", with_tables(f"select s1, cand, (x <> '' and x = y)::int::double as e, (x <> '' and y <> '' and x <> y)::int::double as c, (x = '' or y = '')::int::double as m from (select s.s1, s.cand, {_CODE.format('l').replace('country', 'l.country')} as x, {_CODE.format('r').replace('country', 'r.country')} as y from selected s join norm l on l.entity_id = s.s1 join norm r on r.entity_id = s.cand) union all select s1, cand, e::double, c::double, m::double from " + rows_sql([(k, z, e, c, m) for k, z, _, _, e, c, m in _POSTAL], "s1, cand, e, c, m"), "selected", "norm"))
def fea_06(spark, d):
    """Selected pairs by the postal codes of their canonical records, and rows with codes besides: the corpus has none."""
    c = C(spark, d)
    codes = represent.canonical(c.records).select("entity_id", "postal_code")
    pairs = select.select(linkage.raw_ranked(c), linkage.CAP).select("s1", "cand")
    pairs = pairs.join(codes.select(F.col("entity_id").alias("s1"), F.col("postal_code").alias("x")), "s1").join(codes.select(F.col("entity_id").alias("cand"), F.col("postal_code").alias("y")), "cand")
    e, conflict, m = text.postal_flags(F.col("x"), F.col("y"))
    return golden(spark, pairs.select("s1", "cand", "x", "y"), [r[:4] for r in _POSTAL], "s1 string, cand string, x string, y string").select("s1", "cand", e.alias("e"), conflict.alias("c"), m.alias("m"))


@query("fea_07_canonical_features")
def fea_07(spark, d):
    c = C(spark, d)
    records = linkage.kept(represent.canonical(c.records))
    names, addresses, _ = tokens.mine(records)
    pairs = linkage.kept(select.select(linkage.raw_ranked(c), linkage.CAP, linkage.FLOOR).select("s1", "cand"))
    return features.canonical_features(pairs, records, names, addresses)


@query("mdl_01_gbt_probabilities")
def mdl_01(spark, d):
    scored, _ = linkage.matched(C(spark, d))
    return scored.select("s1", "cand", F.round("prob", 6).alias("prob"))


@query("mdl_04_holdout")
def mdl_04(spark, d):
    c = C(spark, d)
    rows = splits.strata(tables.train_records(c.queries, c.truth))
    return model.holdout(rows)


def _scored(c: linkage.Corpus) -> DataFrame:
    """Name Jaccards as probabilities: a score that SQL has too."""
    f = features.raw_features(select.select(linkage.raw_ranked(c), linkage.CAP), c.records)
    return f.select("s1", "cand", F.round("name_jaccard", 6).alias("prob"))


_SCORED = f"(select s.s1, s.cand, round({JACCARD.format('l.nt', 'r.nt', '1.0')}, 6) as prob from selected s join {_NAMED} l on l.entity_id = s.s1 join {_NAMED} r on r.entity_id = s.cand)"
_AT = f"(select t.s1, t.targets as t, coalesce(k.p, []) as p, t.threshold from (select s1, targets, unnest(range(101)) / 100.0::double as threshold from truth) t left join (select g.threshold, x.s1, list(x.cand) as p from {_SCORED} x join (select unnest(range(101)) / 100.0::double as threshold) g on x.prob + 1e-9 >= g.threshold group by 1, 2) k on k.s1 = t.s1 and k.threshold = t.threshold)"


@query("dec_01_kept", with_tables(f"select t.s1, coalesce(string_agg(x.cand, ',' order by x.prob desc, x.cand), '') as predicted from truth t left join (select * from {_SCORED} where prob >= 0.5) x on x.s1 = t.s1 group by 1", "truth", "selected", "norm"))
def dec_01(spark, d):
    c = C(spark, d)
    return decide.kept(_scored(c), c.truth, 0.5).select("s1", F.array_join("predicted", ",").alias("predicted"))


@query("dec_02_macro_by_threshold", with_tables(f"select threshold, round(avg({_F05}), 9) as macro_f05 from {_AT} group by 1", "truth", "selected", "norm"))
def dec_02(spark, d):
    c = C(spark, d)
    return decide.by_threshold(_scored(c), c.truth)


@query("dec_03_choose_threshold", with_tables(f"select threshold, round(avg({_F05}), 9) as macro_f05 from {_AT} group by 1 order by 2 desc, 1 desc limit 1", "truth", "selected", "norm"))
def dec_03(spark, d):
    c = C(spark, d)
    return decide.choose_threshold(_scored(c), c.truth)


# -- splits, difficulty, slices, validation


def _strata(spark, d) -> DataFrame:
    c = C(spark, d)
    return splits.strata(tables.train_records(c.queries, c.truth))


_STRATA = "(select e.country, case when n = 0 then '0' when n = 1 then '1' when n <= 3 then '2-3' when n <= 5 then '4-5' else '6+' end as bucket, count(*) as n from (select s1, len(targets) as n from truth) t join ents e on e.entity_id = t.s1 group by 1, 2)"


@query("spl_01_allocate", with_tables(f"select country, bucket, n, n * 10 // 100 as report, (base + (place <= 40 - sum(base) over ())::int)::bigint as loop, (n - n * 10 // 100 - (base + (place <= 40 - sum(base) over ())::int))::bigint as fit from (select *, row_number() over (order by rest desc, country, bucket) as place from (select *, (40 * n) // (sum(n) over ())::bigint as base, (40 * n) % (sum(n) over ())::bigint as rest from {_STRATA}))", "truth", "ents"))
def spl_01(spark, d):
    return splits.allocate(_strata(spark, d), 40)


@query("spl_02_assign")
def spl_02(spark, d):
    rows = linkage.kept(_strata(spark, d))
    return splits.assign(rows, splits.allocate(rows, 10)).groupBy("country", "bucket", "split").agg(F.count(F.lit(1)).alias("n"))


@query("spl_05_draw")
def spl_05(spark, d):
    return splits.draw(linkage.kept(_strata(spark, d)), 30)


_SCRIPT = r"case when regexp_matches({0}, '[^\x00-\x7F]') and len(regexp_extract_all({0}, '\p{{L}}')) > len(regexp_extract_all({0}, '[A-Za-z]')) then 'accented_latin' when regexp_matches({0}, '[A-Za-z]') then 'latin' else 'other' end"


@query("dif_01_eligible", with_tables("", "wordy", "truth", "links").rstrip() + ", " + _NEIGHBOURS + f""", who as (select cand, max(s1) as owner from links group by 1),
m as (select n.s1, n.cand, n.j, case when w.owner is null then 'unmatched_distractor_near_miss' else 'stolen_neighborhood_near_miss' end as kind
 from near n join truth t on t.s1 = n.s1 left join who w on w.cand = n.cand where len(t.targets) > 0 and not list_contains(t.targets, n.cand) and n.j >= 0.5 and (w.owner is null or w.owner <> n.s1)),
p as (select l.s1, l.cand, {JACCARD.format('a.words', 'b.words', '0.0')} as j, {JACCARD.format('a.places', 'b.places', '0.0')} as aj, {_SCRIPT.format('b.business_name')} as cls, trim(b.business_address) = '' as blank,
 len({_CONTENT.format('a')}) > 0 and {_CONTENT.format('a')} = {_CONTENT.format('b')} and lower(a.business_name) <> lower(b.business_name) as variant from links l join wordy a on a.entity_id = l.s1 join wordy b on b.entity_id = l.cand),
alone as (select t.s1, n.cand, coalesce(n.j, 0.0) as j from truth t left join (select s1, cand, j from (select *, row_number() over (partition by s1 order by j desc, cand) as place from near) where place = 1) n on n.s1 = t.s1 where len(t.targets) = 0)
select s1, cand as related, 'easy_latin' as kind from p where cls = 'latin' and j >= 0.7 and not blank and aj >= 0.3 union all select s1, cand, 'legal_suffix' from p where variant union all select s1, cand, 'low_overlap' from p where j <= 0.1
 union all select s1, cand, 'accented_latin' from p where cls = 'accented_latin' union all select s1, cand, 'empty_address_match' from p where blank
 union all select s1, array_to_string(targets, ','), 'multi_id' from truth where len(targets) in (4, 5)
 union all select s1, cand, kind from (select *, row_number() over (partition by s1, kind order by j desc, cand) as place from m) where place = 1
 union all select s1, case when cand is not null and j >= 0.5 then cand else '' end, case when cand is not null and j >= 0.5 then 'singleton_lookalike' else 'singleton_isolated' end from alone where cand is not null and j >= 0.5 or j <= 0.1""")
def dif_01(spark, d):
    """Every kind; the records hold no script of India, so that one has no rows."""
    c = C(spark, d)
    return difficulty.eligible(c.records, c.truth).select("s1", "related", "kind")


@query("dif_02_pack")
def dif_02(spark, d):
    c = C(spark, d)
    return difficulty.pack(linkage.kept(difficulty.eligible(c.records, c.truth)))


@query("slc_01_slices", with_tables("""select t.s1, case when e.country in ('US', 'India', 'France') then e.country else 'OTHER' end as country, len(t.targets) = 0 as singleton,
 case when len(t.targets) = 0 then '0' when len(t.targets) = 1 then '1' when len(t.targets) <= 3 then '2-3' when len(t.targets) <= 5 then '4-5' else '6+' end as gold_list_bucket,
 coalesce((select bool_or(trim(x.business_address) = '') from links l join ents x on x.entity_id = l.cand where l.s1 = t.s1), false) as target_empty_address,
 case when a > 0 and b > 0 then 'both' when a > 0 then 's2_only' when b > 0 then 's3_only' else 'none' end as source_composition
 from (select s1, targets, len(list_filter(targets, lambda x: starts_with(x, 'S2'))) as a, len(list_filter(targets, lambda x: starts_with(x, 'S3'))) as b from truth) t join ents e on e.entity_id = t.s1""", "truth", "ents", "links"))
def slc_01(spark, d):
    c = C(spark, d)
    return difficulty.slices(c.records, c.truth).select("s1", "country", "singleton", "gold_list_bucket", "target_empty_address", "source_composition")


@query("slc_02_prediction_slices")
def slc_02(spark, d):
    c = C(spark, d)
    return difficulty.slices(c.records, c.truth, _by_name(c))


@query("val_01_subset", with_tables("select t.s1, array_to_string(list_sort(list_filter(t.targets, lambda x: not list_contains(coalesce(k.cands, []), x))), ',') as extra from truth t left join kept k on k.s1 = t.s1 where len(list_filter(t.targets, lambda x: not list_contains(coalesce(k.cands, []), x))) > 0", "truth", "kept"))
def val_01(spark, d):
    c = C(spark, d)
    wide = select.wide(select.select(linkage.raw_ranked(c), linkage.CAP), c.queries).select(F.col("source1_entity_id").alias("s1"), F.col("candidate_entity_ids").alias("ids"))
    bad = validate.not_subset(c.truth.select("s1", F.array_join("targets", ",").alias("ids")), wide)
    return bad.select("s1", F.array_join(F.array_sort(F.split("extra", ",")), ",").alias("extra"))


_SPOILT = """rows as (select s1, array_to_string(targets, ',') as ids from truth where not ends_with(s1, '7') union all select s1, s1 from truth where ends_with(s1, '3') union all select s1, 'X-' || s1 from truth where ends_with(s1, '6') union all select 'S1-none', ''),
items as (select s1, unnest(string_split(ids, ',')) as o from rows where trim(ids) <> ''),
faults as (select 'duplicate_row' as rule, s1 as o from rows group by s1 having count(*) > 1 union all select distinct 'self_match', o from items where starts_with(o, 'S1-') union all select distinct 'wrong_prefix', o from items where starts_with(o, 'X-')
 union all select 'missing_entity', s1 from truth where s1 not in (select s1 from rows) union all select 'unexpected_entity', 'S1-none')"""


@query("val_02_violations", with_tables("", "truth").rstrip() + ", " + _SPOILT + " select rule, count(*) as offenders, (select string_agg(o, ', ' order by o) from (select o from faults g where g.rule = f.rule order by o limit 5)) as examples from faults f group by rule")
def val_02(spark, d):
    """The rules over a file of all matches with faults put in: queries left out, rows again, queries and foreign ids as matches."""
    c, at = C(spark, d), shared_path(spark)
    own = c.truth.select("s1", F.array_join("targets", ",").alias("ids"))
    ends = lambda x: F.col("s1").endswith(x)
    spoilt = own.where(~ends("7")).unionByName(own.where(ends("3")).select("s1", F.col("s1").alias("ids"))).unionByName(own.where(ends("6")).select("s1", F.concat(F.lit("X-"), "s1").alias("ids")))
    spoilt = spoilt.unionByName(spark.createDataFrame([("S1-none", "")], "s1 string, ids string"))
    sinks.write_tsv(spoilt.select(*[F.col(a).alias(b) for a, b in zip(("s1", "ids"), TRUTH)]), at, [TRUTH[0]])
    rows = tables.read_tsv(spark, at, TRUTH, "plain").select(F.col(TRUTH[0]).alias("s1"), F.col(TRUTH[1]).alias("ids"), F.lit(True).alias("tabbed"))
    return validate.report(validate.violations(rows, c.truth.select("s1"), c.targets))


@query("orc_01_end_to_end")
def orc_01(spark, d):
    c = C(spark, d)
    predictions = linkage.decided(c)
    return metrics.macro_f05(predictions, c.truth)


