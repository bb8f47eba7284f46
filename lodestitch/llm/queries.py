"""Queries of the operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_neardup, minhash_neardup, packing, quality_classifier, quality_rules, sentencepiece_codec, sharding, token_files, url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED = ["cheap-pills.example.com/", "casino-win.example.com/", "free-bets.example.com/"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target of the quality rules: documents labelled good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = url_filter.listed_entries(spark.createDataFrame([(u,) for u in LISTED], "url string"))
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_entries(spark, RULES).unionByName(listed))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.examples(turns))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(8))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_url_filter, op3_sentencepiece, op4_chat_format, op5_sharding, op6_quality_rules, op7_embedding_neardup, op8_best_fit_packing, op9_minhash_neardup, op10_token_files)}



def _escaped(text: str) -> str:
    """The escaping of control strings in SQL."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in sorted(chat_format.CONTROL, key=len, reverse=True):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_SAID = "</s>[INST] ok [/INST]"
_PARTS = r"'(?s)://([^/?#]*)([^?#]*)'"


def _crc_entry(k: int) -> int:
    """An entry of the table of CRC-32, from its polynomial."""
    for _ in range(8):
        k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
    return k


def _draw(level: str, child: int, weight: float) -> str:
    return f"-ln((('0x' || substr(md5('{level}{child}:' || key), 1, 13))::bigint + 0.5) / {1 << 52}::double) / {weight}::double"


def _sharded() -> str:
    """shard and grown_shard of a key: the least draw among regions, then racks, then shards."""
    leaves = sharding.tree(8)
    first = lambda level, a, b, weight, x, y: f"case when {_draw(level, a, weight)} <= {_draw(level, b, weight)} then {x} else {y} end"
    rack = lambda k: first("shard", 2 * k, 2 * k + 1, 1, 2 * k, 2 * k + 1)
    region = lambda k: first("rack", 2 * k, 2 * k + 1, 2, rack(2 * k), rack(2 * k + 1))
    assert [(x.region, x.rack, x.weight) for x in leaves] == [(s // 4, s // 2, 1.0) for s in range(8)]
    return f"{first('region', 0, 1, 4, region(0), region(1))} as shard, {_draw('region', 2, 1)} < least({_draw('region', 0, 4)}, {_draw('region', 1, 4)}) as moves"


#: Least node reachable from each by links(u, v), itself included.
_REACHED = "reached as (select id, id as root from nodes union select r.id, l.v from reached r join links l on l.u = r.root), comp as (select id, min(root) as component_id from reached group by 1)"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op2_url_filter": f"""
with entries(host, path, verdict, is_rule) as (values {", ".join(f"('{h}', '{p}', '{v}', true)" for v, h, p in RULES)}, {", ".join(f"('{u.partition('/')[0]}', '/{u.partition('/')[2]}', 'block', false)" for u in LISTED)}),
parted as (select row_number() over () as r, page_id, translate(coalesce(regexp_extract(url, {_PARTS}, 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host, coalesce(regexp_extract(url, {_PARTS}, 2), '') as path from pages),
hosts as (select *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]$', '') as canonical from parted),
fits as (select p.r, e.host || e.path as url, e.verdict, e.is_rule, row_number() over (partition by p.r, e.is_rule order by length(e.host || e.path) desc) as k
         from hosts p join entries e on (case when e.is_rule then p.host else p.canonical end = e.host or suffix(case when e.is_rule then p.host else p.canonical end, '.' || e.host)) and starts_with(p.path, e.path))
select p.page_id, p.host, p.path, f.url as rule, coalesce(f.verdict, case when l.r is not null then 'block' else 'allow' end) as verdict, l.r is not null as listed
from parted p left join fits f on f.r = p.r and f.is_rule and f.k = 1 left join fits l on l.r = p.r and not l.is_rule and l.k = 1
""",
    "op4_chat_format": f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '{_SAID}' union all select -7, 1, 'assistant', '{_SAID}'),
sized as (select *, sum({len("".join(chat_format.MARKS))} + length({_escaped("role")}) + length({_escaped("text")})) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) + {len(chat_format.START)} as upto,
 row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as back from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 sum(case when role = 'assistant' or back = 1 then upto else 0 end)::bigint as formatted_chars, count(*) filter (role = 'assistant') as n_examples from sized group by conv_id
""",
    "op5_sharding": f"""
with recursive tab as (select [{", ".join(str(_crc_entry(k)) for k in range(256))}]::bigint[] as t), raw as (select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, 'null') as key from documents),
sized as (select doc_id, key, strlen(text) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32 from raw, tab),
dealt as (select *, {_sharded()} from sized)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id nulls first) - 1 as slot, (case when moves then 8 else shard end)::int as grown_shard from dealt
""",
    "op7_embedding_neardup": f"""
with recursive own as (select vec_id as id, label, embedding::double[] as v from embeddings),
usable as (select * from own where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
nodes as (select id from own),
links as (select a.id as u, b.id as v from usable a join usable b on a.label = b.label and a.id <> b.id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98), {_REACHED}
select c.id as vec_id, (select count(*) from links l where l.u = c.id) as n_links, component_id, c.id = component_id as kept from comp c
""",
    "op9_minhash_neardup": f"""
with recursive worded as (select doc_id as id, {_WORDS} as w from documents),
sets as (select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from worded),
every as (select id, len(s) as n, unnest(s) as x from sets), runs as (select id, n, x from (select *, count(*) over (partition by x) as df from every) where df > 1), nodes as (select id from sets),
links as (select a.id as u, b.id as v from runs a join runs b on a.x = b.x and a.id <> b.id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by a.id, b.id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))), {_REACHED}
select s.id as doc_id, len(s.s)::bigint as n_shingles, component_id, s.id = component_id as kept from sets s join comp c on c.id = s.id
""",
}
