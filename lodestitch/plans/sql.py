"""The linkage's queries in DuckDB SQL: common tables, shared by the queries that need them."""

from __future__ import annotations

ID = "'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::varchar, 8, '0')"
NORMAL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
WORDS = r"list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> ''))"
JACCARD = "case when len({0}) = 0 and len({1}) = 0 then {2} else len(list_intersect({0}, {1}))::double / len(list_distinct(list_concat({0}, {1}))) end"

CTES = {
    "ents": f"""select {ID} as entity_id, array_to_string((string_split(split_part(text, chr(10), 1), ' '))[1:12], ' ') as business_name,
        split_part(text, chr(10), 2) as business_address, lang as country, 'S' || (doc_id % 3 + 1) as source, text from documents""",
    "norm": f"""select entity_id, country, source, {NORMAL.format("business_name")} as name, {NORMAL.format("business_address")} as address from ents""",
    "toks": """select entity_id, country, source, field, unnest(list_distinct(list_filter(string_split(v, ' '), lambda t: length(t) >= 2))) as token
        from (select entity_id, country, source, 'name' as field, name as v from norm union all select entity_id, country, source, 'address', address from norm)""",
    "dfs": "select country, source, token, count(distinct entity_id) as df from toks where source <> 'S1' group by all",
    "chosen": """select * from (select q.entity_id as s1, d.source, q.country, q.field, q.token, d.df,
        row_number() over (partition by q.entity_id, d.source, q.field order by d.df, q.token) as rn
        from toks q join dfs d on d.country = q.country and d.token = q.token where q.source = 'S1' and d.df <= 120) where rn <= 3""",
    "rare": """select c.s1, c.source, t.entity_id as cand, c.field || '_token' as channel, round(sum(1 / log2(c.df + 2)), 9) as score
        from chosen c join toks t on t.country = c.country and t.source = c.source and t.field = c.field and t.token = c.token group by all""",
    "values_": "select entity_id, country, source, 'exact_name' as channel, name as v from norm where name <> '' union all select entity_id, country, source, 'exact_address', address from norm where address <> ''",
    "pool": "select * from (select *, row_number() over (partition by country, source, channel, v order by entity_id) as rn from values_ where source <> 'S1') where rn <= 120",
    "exact": "select q.entity_id as s1, p.source, p.entity_id as cand, q.channel from values_ q join pool p on p.country = q.country and p.channel = q.channel and p.v = q.v where q.source = 'S1'",
    "found": """select s1, cand, source, max((channel = 'exact_name')::int) as exact_name, max((channel = 'exact_address')::int) as exact_address,
        max((channel = 'name_token')::int) as name_token, max((channel = 'address_token')::int) as address_token, round(sum(score), 9) as score
        from (select s1, cand, source, channel, 0.0::double as score from exact union all select s1, cand, source, channel, score from rare) group by all""",
    "ranked": "select *, row_number() over (partition by s1 order by exact_name + exact_address desc, name_token + address_token desc, score desc, cand) as rank from found",
    "prio": """select *, case when sn <= 2 then case source when 'S2' then 0 else 1 end else 2 end as prio
        from (select *, row_number() over (partition by s1, source order by rank) as sn from ranked)""",
    "placed": "select *, row_number() over (partition by s1 order by prio, rank) as place from prio",
    "selected": "select s1, cand, source, exact_name, exact_address, name_token, address_token, score, row_number() over (partition by s1 order by rank) as rank from placed where place <= 50",
    "keys": f"select entity_id, country, source, md5({NORMAL.format('text')}) as k from ents",
    "links": "select q.entity_id as s1, t.entity_id as cand from keys q join keys t on t.country = q.country and t.k = q.k and t.source <> 'S1' where q.source = 'S1'",
    "truth": "select e.entity_id as s1, list_filter(list(l.cand order by l.cand), lambda x: x is not null) as targets from ents e left join links l on l.s1 = e.entity_id where e.source = 'S1' group by 1",
    "kept": "select s1, list(cand) as cands from selected group by 1",
    "per": """select t.s1, coalesce(len(k.cands), 0) as width, len(t.targets) as truth_n, len(list_intersect(coalesce(k.cands, []), t.targets)) as hit_n,
        len(list_filter(t.targets, lambda x: starts_with(x, 'S2'))) as truth_s2, len(list_filter(t.targets, lambda x: starts_with(x, 'S3'))) as truth_s3,
        len(list_filter(list_intersect(coalesce(k.cands, []), t.targets), lambda x: starts_with(x, 'S2'))) as hit_s2,
        len(list_filter(list_intersect(coalesce(k.cands, []), t.targets), lambda x: starts_with(x, 'S3'))) as hit_s3 from truth t left join kept k on k.s1 = t.s1""",
    "space": "select sum(q.n * t.n)::bigint as pairs from (select country, count(*) as n from ents where source = 'S1' group by 1) q join (select country, count(*) as n from ents where source <> 'S1' group by 1) t using (country)",
    "wordy": f"select entity_id, country, source, business_name, business_address, {WORDS.format('business_name')} as words, {WORDS.format('business_address')} as places from ents",
}
NEEDS = {
    "norm": ["ents"], "toks": ["norm"], "dfs": ["toks"], "chosen": ["toks", "dfs"], "rare": ["chosen", "toks"], "values_": ["norm"], "pool": ["values_"], "exact": ["values_", "pool"], "found": ["exact", "rare"],
    "ranked": ["found"], "prio": ["ranked"], "placed": ["prio"], "selected": ["placed"], "keys": ["ents"], "links": ["keys"], "truth": ["ents", "links"], "kept": ["selected"], "per": ["truth", "kept"], "space": ["ents"], "wordy": ["ents"],
}


def with_tables(query: str, *names: str) -> str:
    """The query after the common tables it names and those they need, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as (select * from ({CTES[n]}))" for n in order) + ("\n" + query if query else "")


RATIO = "round(coalesce({0} / nullif({1}, 0)::double, 1.0), 6)"
SUMMARY = f"""count(*) as entities, sum(truth_n)::bigint as truth_links, sum(hit_n)::bigint as recovered_links, {RATIO.format("sum(hit_n)", "sum(truth_n)")} as link_recall,
    {RATIO.format("sum((truth_n > 0 and hit_n > 0)::int)", "sum((truth_n > 0)::int)")} as any_hit_recall, {RATIO.format("sum((truth_n > 0 and hit_n = truth_n)::int)", "sum((truth_n > 0)::int)")} as complete_recall,
    round(avg(width), 6) as width_mean, quantile_disc(width, 0.95) as width_p95, quantile_disc(width, 0.99) as width_p99, max(width) as width_max, sum(width)::bigint as pairs,
    round(avg((width = 0)::int), 6) as empty_rate, {RATIO.format("sum(hit_s2)", "sum(truth_s2)")} as recall_s2, {RATIO.format("sum(hit_s3)", "sum(truth_s3)")} as recall_s3"""
