import os
import subprocess
import sys
from collections import Counter

import __spark_entry__
import pytest
from pyspark.sql import functions as F

FAST = ["src_01_entity_view", "nrm_09_raw_tokens", "tok_05_frequencies", "ret_04_raw_candidates", "snk_01_candidate_lists", "met_12_macro_f05", "val_02_violations"]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tiny}/documents.parquet')")
    df = __spark_entry__.queries()[name](spark, tiny)
    got = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_and_sql_are_there_without_a_session():
    home = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=home, env={**os.environ, "PYTHONPATH": home}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert [int(n) for n in said.stdout.split()[-2:]] == [len(__spark_entry__.queries()), len(__spark_entry__.oracle_sql())]


def plain_jaro_winkler(a, b):
    """By code points, from the definition: matches by flags on both sides, then the order of the matched characters."""
    if a == b:
        return 1.0
    reach, used, hit = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(len(b)) if abs(i - j) <= reach and j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hit.append(c)
    if not hit:
        return 0.0
    m, swapped = len(hit), sum(x != b[j] for x, j in zip(hit, sorted(used))) // 2
    score = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return score + same * 0.1 * (1 - score) if score > 0.7 else score


def test_jaro_winkler_covers_names_with_accents(spark, tmp_path):
    lines = ["caf\u00e9 d\u00fcrer stra\u00dfe", "caf\u00e9 durer stra\u00dfe", "caf\u00e9 d\u00fcrre nord", "ni\u00f1o caf\u00e9 sur", "plain cafe line"]
    spark.createDataFrame([(k, lines[k % 5], "fr", "x", 20) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from lodestitch.functions.text import normalize_raw
    from lodestitch.operators import select
    from lodestitch.plans import linkage

    c = linkage.corpus(spark, str(tmp_path))
    names = {r[0]: r[1] for r in c.records.select("entity_id", normalize_raw(F.col("business_name"))).collect()}
    pairs = {(r.s1, r.cand) for r in select.select(linkage.raw_ranked(c), linkage.CAP).collect()}
    got = {(r.s1, r.cand): r.jw for r in __spark_entry__.queries()["fea_03_jaro_winkler_all"](spark, str(tmp_path)).collect()}
    assert set(got) == pairs and any(not (names[a] + names[b]).isascii() for a, b in pairs)
    assert all(v == pytest.approx(plain_jaro_winkler(names[a], names[b]), abs=1e-6) for (a, b), v in got.items())


def test_canonical_features_cover_the_candidates_of_the_matching_path(spark, tmp_path):
    spark.createDataFrame([(k, "same shop line", "fr", "x", 14) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from lodestitch.operators import select
    from lodestitch.plans import linkage

    pairs = sorted((r.s1, r.cand) for r in select.select(linkage.raw_ranked(linkage.corpus(spark, str(tmp_path))), linkage.CAP, linkage.FLOOR).collect())
    got = sorted((r.s1, r.cand) for r in __spark_entry__.queries()["fea_07_canonical_features"](spark, str(tmp_path)).select("s1", "cand").collect())
    assert got == pairs and max(Counter(s1 for s1, _ in pairs).values()) > 10
