import pytest
from pyspark.sql import functions as F

from lodestitch.operators import decide, difficulty, features, index, metrics, model, retrieve, select, sinks, splits, tokens, validate
from lodestitch.operators.represent import canonical_view
from lodestitch.sources import tables

RECORD = "entity_id string, business_name string, business_address string, country string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def split(df):
    return tables.by_source(df)


def test_raw_candidates(spark):
    q, t = split(records(spark, [("S2-1", "Alpha Labs", "1 Main St", "US"), ("S2-2", "Alpha Labs", "1 Main St", "France"), ("S3-1", "Alpha Laboratory", "1 Main St", "US"), ("S1-1", "ALPHA LABS", "1 Main St", "US"), ("S1-2", "Sans Correspondance", "Rue Vide", "France")]))
    i = index.build_raw(t)
    assert i.records.count() == 3
    chosen = select.select(select.rank_raw(retrieve.raw_candidates(q, i)), 50)
    rows = {r[0]: r[1] for r in select.wide(chosen, q).collect()}
    assert rows["S1-2"] == "" and "S2-1" in rows["S1-1"].split(",") and "S2-2" not in rows["S1-1"]


def test_canonical_channels(spark):
    q, t = split(records(spark, [
        ("S2-1", "taataa kamsaltemsee", "Mumbai 400001", "India"), ("S2-2", "Catarina Atelier", "12 Rue Paix 75001", "France"), ("S2-3", "Wrong Country", "12 Rue Paix 75001", "US"), ("S3-1", "Qatar Trading", "Doha", "India"),
        ("S1-1", "टाटा कंसल्टेंसी", "Mumbai 400001", "India"), ("S1-2", "Katarina Atelier", "", "France"), ("S1-3", "Katar Trading", "", "India"),
    ]))
    found = {(r.s1, r.cand): set(r.channels) for r in retrieve.canonical_candidates(canonical_view(q), index.build_canonical(t)).collect()}
    assert "romanized_exact" in found["S1-1", "S2-1"] and ("S1-1", "S2-3") not in found
    assert "romanized_ngram" in found["S1-2", "S2-2"] and "phonetic_exact" in found["S1-3", "S3-1"]


def test_select_caps_floors_and_quota(spark):
    rows = spark.createDataFrame([("q", "S2-1", "S2", ["canonical_name_exact"], 1.0), ("q", "S2-2", "S2", ["romanized_ngram"], 1.0), ("q", "S3-1", "S3", ["phonetic_exact"], 1.0)], "s1 string, cand string, source string, channels array<string>, score double")
    ranked = select.rank_channels(rows)
    assert [r.cand for r in select.select(ranked, 50, 2, 1).orderBy("rank").collect()] == ["S2-1", "S2-2"]
    assert select.select(ranked, 0).count() == 0
    with pytest.raises(ValueError):
        select.select(ranked, -1)


def greedy(rows, cap, floor, quota):
    """A plain model: floors of S2 and S3 first, then by rank; rescue-only rows up to a quota."""
    out, rescued = [], 0
    order = [r for s in ("S2", "S3") for r in [x for x in rows if x[1] == s][:floor]]
    for r in order + [x for x in rows if x not in order]:
        if len(out) < cap and (not r[2] or rescued < quota):
            out.append(r)
            rescued += r[2]
    return {r[0] for r in out}


def test_select_matches_a_greedy_model(spark):
    import random

    rng = random.Random(1)
    data, want = [], {}
    for q in range(40):
        n = rng.randrange(1, 12)
        rescue = rng.randrange(n + 1)
        rows = [(f"c{q}-{k}", rng.choice(["S2", "S3"]), k >= rescue) for k in range(n)]
        want[f"q{q}"] = greedy(rows, 5, 2, 2)
        data += [(f"q{q}", c, s, ["postal_exact" if r else "raw_name_exact"], k + 1) for k, (c, s, r) in enumerate(rows)]
    got = select.select(spark.createDataFrame(data, "s1 string, cand string, source string, channels array<string>, rank int"), 5, 2, 2).groupBy("s1").agg(F.collect_set("cand").alias("x")).collect()
    assert {r.s1: set(r.x) for r in got} == want


def test_choose_cap_and_pareto(spark):
    assert select.choose_cap(spark.createDataFrame([(5, 100, 500), (10, 110, 600), (20, 111, 800)], "cap int, links int, pairs int")).first()[0] == 10
    points = spark.createDataFrame([("a", 0.8, 10.0), ("b", 0.7, 12.0), ("c", 0.9, 20.0)], "name string, recall double, width double")
    assert {r.name for r in metrics.pareto(points).collect()} == {"a", "c"}


def test_bootstrap():
    a = metrics.bootstrap_exact([0.0] * 3, [1.0] * 3)
    assert a["promote"] and a == metrics.bootstrap_exact([0.0] * 3, [1.0] * 3)
    with pytest.raises(ValueError):
        metrics.bootstrap_exact([0.0], [1.0], 10)


@pytest.mark.parametrize("p, t, want", [(["S2-1", "S2-2", "S3-1"], ["S2-1", "S3-1"], 5 / 7), ([], [], 1), (["S2-1"], [], 0), (["S2-1"], ["S2-2"], 0), (["S2-1", "S2-2"], ["S2-1", "S2-2", "S2-3"], 10 / 11)])
def test_f05(spark, p, t, want):
    rows = spark.createDataFrame([(p, t)], "p array<string>, t array<string>")
    assert rows.select(metrics.f05(F.col("p"), F.col("t"))).first()[0] == pytest.approx(want)


def test_threshold_ties_go_up(spark):
    scored = spark.createDataFrame([("q", "S2-1", 0.4)], "s1 string, cand string, prob double")
    truth = spark.createDataFrame([("q", [])], "s1 string, targets array<string>")
    best = decide.choose_threshold(scored, truth).first()
    assert (best.threshold, best.macro_f05) == (1.0, 1.0)
    more = spark.createDataFrame([("q", "S2-1", 0.2), ("q", "S3-2", 0.9)], "s1 string, cand string, prob double")
    assert decide.kept(more, truth, 0.5).first().predicted == ["S3-2"]


def test_idf_and_boilerplate(spark):
    docs = spark.createDataFrame([("India", ["reliance", "limited"]), ("India", ["tata", "limited"]), ("India", ["limited"]), ("US", ["acme"])], "country string, t array<string>")
    rows = {(r.country, r.token): r for r in tokens.idf(docs, "t", 0.5).collect()}
    assert rows["India", "limited"].is_boilerplate and not rows["India", "reliance"].is_boilerplate
    assert rows["India", "limited"].idf < rows["India", "reliance"].idf and rows["global", "limited"].n == 4


def test_largest_remainder(spark):
    sizes = spark.createDataFrame([("India", "0", 10), ("India", "1", 3), ("US", "6+", 7)], "country string, bucket string, n bigint")
    got = splits.largest_remainder(sizes, 11).collect()
    assert sum(r["take"] for r in got) == 11 and all(r["take"] <= r["n"] for r in got)


def test_splits_hold_every_query_once(spark):
    rows = spark.createDataFrame([(f"S1-{k}", "US", "0") for k in range(40)], "s1 string, country string, bucket string")
    allocation = splits.allocate(rows, 5)
    splits.check_allocation(allocation)
    assigned = splits.assign(rows, allocation)
    splits.check(assigned, rows)
    assert {r["split"]: r["count"] for r in assigned.groupBy("split").count().collect()} == {"report": 4, "loop": 5, "fit": 31}
    with pytest.raises(ValueError):
        splits.draw(rows, 41)
    with pytest.raises(ValueError):
        splits.assert_disjoint(rows, rows)
    assert model.holdout(rows).count() == 8


def test_tsv_round_trip_keeps_empty_lists(spark, tmp_path):
    rows = spark.createDataFrame([("S1-b", []), ("S1-a", ["S3-1", "S2-2"])], "s1 string, predicted array<string>")
    path = str(tmp_path / "m")
    sinks.write_tsv(sinks.matching_rows(rows).coalesce(1), path, ["source1_entity_id"])
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert "S1-b\t" in lines and "S1-a\tS3-1,S2-2" in lines
    with pytest.raises(tables.SourceError):
        sinks.matching_rows(spark.createDataFrame([("S1-a", ["S2-1", "S2-1"])], "s1 string, predicted array<string>"))


def test_tsv_round_trip_keeps_white_space_at_the_ends(spark, tmp_path):
    rows = [("S1-1", " token =  5f ", "a\\", "fr"), ("S1-2", "\u00a0b\u00a0", "  ", "fr "), ("S1-3", "", "#c \\ d", " ")]
    path = str(tmp_path / "r")
    sinks.write_tsv(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), path, ["entity_id"])
    assert sorted(map(tuple, tables.read_records(spark, path, "plain").collect())) == rows


def test_readers_refuse_other_headers(spark, tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a\tb"\t\tUS\n')
    r = tables.read_records(spark, str(f)).first()
    assert (r.business_name, r.business_address) == ("a\tb", "")
    f.write_text("id\tname\n1\t2\n")
    with pytest.raises(tables.SourceError):
        tables.read_records(spark, str(f))


def test_index_round_trip(spark, tmp_path):
    _, t = split(records(spark, [("S2-1", "Alpha Labs", "1 Main St", "US")]))
    i = index.build_raw(t)
    i.save(str(tmp_path / "i"))
    assert index.load(spark, str(tmp_path / "i")).postings.count() == i.postings.count()


def test_subset(spark):
    ids = "s1 string, ids string"
    c = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], ids)
    assert validate.verify_subset(spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], ids), c) == 2
    with pytest.raises(ValueError):
        validate.verify_subset(spark.createDataFrame([("S1-1", "S2-9"), ("S1-2", "")], ids), c)


def test_slice_schema():
    document = difficulty.slice_document()
    difficulty.validate_slices(document)
    assert difficulty.slice_hash(document) == difficulty.slice_hash(difficulty.slice_document())
    document["slices"][0].pop("level")
    with pytest.raises(ValueError):
        difficulty.validate_slices(document)


def test_raw_feature_row(spark):
    rec = records(spark, [("S1-1", "Acme Corp", "1 St", "US"), ("S3-1", "Acme Corporation", "", "US")])
    pairs = spark.createDataFrame([("S1-1", "S3-1", "S3", 1, 0.5, 0, 0, 1, 0)], "s1 string, cand string, source string, rank int, score double, exact_name int, exact_address int, name_token int, address_token int")
    row = features.raw_features(pairs, rec).first()
    assert len(features.RAW_FEATURES) == 12 and row.candidate_address_empty == 1.0 and row.src_is_s3 == 1.0


def test_no_cartesian_product(spark, tiny):
    from lodestitch.plans import linkage

    plan = linkage.raw_ranked(linkage.corpus(spark, tiny))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_idf_overlap_matches_a_plain_model(spark):
    from lodestitch.operators import features

    docs = spark.createDataFrame([("a", "fr", ["x", "y", "x"]), ("b", "fr", ["y", "z"]), ("c", "fr", [])], "entity_id string, country string, t array<string>")
    known = spark.createDataFrame([("fr", "y", 2.5), ("global", "x", 1.25)], "country string, token string, idf double")
    w = {r.entity_id: r.w for r in features.weighed_lists(docs, "t", known, "w").collect()}
    assert {k: sorted(v) for k, v in w.items()} == {"a": ["x 1.25", "y 2.5"], "b": ["y 2.5", "z 10.0"]}
    pairs = spark.createDataFrame([(w["a"], w["b"]), (None, w["b"]), (None, None)], "l array<string>, r array<string>")
    assert [r[0] for r in pairs.select(features.idf_overlap(F.col("l"), F.col("r"))).collect()] == [round(2.5 / 13.75, 9), 0.0, 1.0]


def test_pairs_are_compared_once_for_training_and_decisions(spark, tiny):
    from lodestitch.plans import linkage

    scored, rows = linkage.matched(linkage.corpus(spark, tiny), 1)
    assert rows.storageLevel.useMemory and rows.storageLevel.useDisk and scored.storageLevel.useMemory
    plan = scored._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "parquet" not in plan.split("InMemoryRelation")[0]
    assert scored.count() == rows.count() == scored.select("s1", "cand").distinct().count() > 0
