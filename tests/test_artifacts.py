import json
import random

import pytest
from pyspark.sql import functions as F

from lodestitch import cli
from lodestitch.operators import artifacts, difficulty, index, metrics, model, splits, tokens
from lodestitch.sources import tables

RECORD = "entity_id string, business_name string, business_address string, country string"


def strata(spark, n=240):
    rng = random.Random(4)
    return spark.createDataFrame([(f"S1-{k:04d}", rng.choice(["US", "US", "France"]), rng.choice(["0", "1", "2-3"])) for k in range(n)], "s1 string, country string, bucket string")


def test_split_is_written_read_back_and_guarded(spark, tmp_path):
    rows = strata(spark)
    allocation = splits.allocate(rows, 30)
    assigned = splits.assign(rows, allocation)
    manifest = artifacts.write_split(assigned, allocation, f"{tmp_path}/split")
    assert manifest["counts"]["loop"] == 30 and sum(manifest["counts"].values()) == 240
    back = {r.s1: r.split for r in artifacts.read_split(spark, f"{tmp_path}/split").collect()}
    assert back == {r.s1: r.split for r in assigned.collect()}
    page = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/split/SPLIT.md").collect())
    assert "| loop | 30 |" in page and "| France | 0 |" in page
    ids = [r[0] for r in spark.read.text(f"{tmp_path}/split/loop_ids").collect()]
    assert sorted(ids) == sorted(k for k, v in back.items() if v == "loop")
    artifacts.write_ids(rows.limit(3), f"{tmp_path}/other")
    artifacts.replace(spark, f"{tmp_path}/other", f"{tmp_path}/split/loop_ids")
    with pytest.raises(tables.SourceError):
        artifacts.read_split(spark, f"{tmp_path}/split")


def test_assignment_and_draw_match_a_plain_model(spark):
    rows = strata(spark)
    own = {}
    for r in rows.select("s1", "country", "bucket", F.xxhash64("s1", F.lit(42)).alias("h")).collect():
        own.setdefault((r.country, r.bucket), []).append((r.h, r.s1))
    total = sum(map(len, own.values()))

    def shares(of):
        base = {k: of * len(v) // total for k, v in own.items()}
        for k in sorted(own, key=lambda k: (-(of * len(own[k]) % total), k))[: of - sum(base.values())]:
            base[k] += 1
        return base

    loop = shares(25)
    got = {r.s1: r.split for r in splits.assign(rows, splits.allocate(rows, 25)).collect()}
    for key, ids in own.items():
        report = len(ids) * 10 // 100
        want = ["report"] * report + ["loop"] * loop[key] + ["fit"] * (len(ids) - report - loop[key])
        assert [got[s] for _, s in sorted(ids)] == want
    drawn = {r.s1 for r in splits.draw(rows, 50).collect()}
    assert drawn == {s for key, n in shares(50).items() for _, s in sorted(own[key])[:n]}
    held = {r.s1 for r in model.holdout(rows).collect()}
    assert held == {s for ids in own.values() for _, s in sorted(ids)[: len(ids) // 5]}


def test_sample_and_resource_round_trip(spark, tmp_path):
    rows = strata(spark)
    meta = artifacts.write_sample(rows.limit(7), f"{tmp_path}/sample", seed=42)
    assert meta["count"] == 7 and artifacts.read_json(spark, f"{tmp_path}/sample/meta") == meta
    docs = spark.createDataFrame([("US", ["a", "b"]), ("US", ["a"]), ("France", ["é"])], "country string, t array<string>")
    idf = tokens.idf(docs, "t", 0.9)
    artifacts.save_resource(idf, idf, idf.where("is_boilerplate"), f"{tmp_path}/res")
    names, _, boiler = artifacts.load_resource(spark, f"{tmp_path}/res")
    assert sorted(map(tuple, names.collect())) == sorted(map(tuple, idf.select("country", "token", "idf").collect()))
    assert sorted(map(tuple, boiler.collect())) == [("France", "é"), ("US", "a")]


def test_pack_is_greedy_over_kinds(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"S1-{rng.randrange(40):03d}", f"S2-{k}", rng.choice(difficulty.KINDS), "na", f"r{k}") for k in range(150)]
    got = difficulty.pack(spark.createDataFrame(rows, "s1 string, related string, kind string, bucket string, reason string"), 3)
    used, want = set(), []
    for kind in difficulty.KINDS:
        first = {}
        for s1, related, k, bucket, reason in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4])):
            if k == kind and s1 not in used:
                first.setdefault(s1, (s1, related, kind, bucket, reason))
        picked = [first[s] for s in sorted(first)[:3]]
        used |= {p[0] for p in picked}
        want += picked
    assert sorted(map(tuple, got.collect())) == sorted(want)
    manifest = artifacts.write_pack(got, f"{tmp_path}/pack")
    assert manifest["rows"] == len(want) and artifacts.read_json(spark, f"{tmp_path}/pack/manifest") == manifest
    assert tables.read_tsv(spark, f"{tmp_path}/pack/pack", ["source1_entity_id", "related_entity_ids", "kind", "overlap_bucket", "reason"], "plain").count() == len(want)


def test_prediction_slices_match_a_plain_model(spark):
    records = [("S1-1", "a", "x", "US"), ("S1-2", "b", "y", "US"), ("S1-3", "c", "", "France"), ("S2-1", "a", "", "US"), ("S3-1", "a", "z", "France"), ("S2-9", "q", "z", "US")]
    truth = {"S1-1": ["S2-1"], "S1-2": ["S3-1"], "S1-3": []}
    predicted = {"S1-1": ["S2-1", "S3-1"], "S1-2": ["S2-9"], "S1-3": []}
    frame = lambda d, name: spark.createDataFrame([(k, v) for k, v in d.items()], f"s1 string, {name} array<string>")
    got = {r.s1: r for r in difficulty.slices(spark.createDataFrame(records, RECORD), frame(truth, "targets"), frame(predicted, "predicted")).collect()}
    country, owned = {r[0]: r[3] for r in records}, {x for t in truth.values() for x in t}
    for s1, mine in predicted.items():
        false = [x for x in mine if x not in truth[s1]]
        kind = "stolen_id" if any(x in owned for x in false) else "unmatched_distractor" if false else "none"
        size = "longer" if len(mine) > len(truth[s1]) else "equal" if len(mine) == len(truth[s1]) else "shorter"
        assert (got[s1].false_id_type, got[s1].predicted_vs_gold_length) == (kind, size)
        assert got[s1].cross_country_prediction == any(country[x] != country[s1] for x in mine)


def test_paired_bootstrap_brackets_the_difference(spark):
    rng = random.Random(1)
    deltas = [rng.choice([0.0, 0.1, 0.2]) for _ in range(300)]
    exact = metrics.bootstrap_exact([0.0] * 300, deltas)
    got = metrics.bootstrap(spark.createDataFrame([(f"S1-{k}", x) for k, x in enumerate(deltas)], "s1 string, delta double")).first()
    assert got.delta == pytest.approx(exact["delta"]) and got.promote and exact["promote"]
    assert got.lower == pytest.approx(exact["lower"], abs=0.005) and got.upper == pytest.approx(exact["upper"], abs=0.005)


def test_capacity_is_projected_in_proportion(spark):
    m = artifacts.measured(lambda: spark.range(50), 10)
    assert m["pair_rows"] == 50 and m["entities"] == 10
    p = artifacts.projected({**m, "seconds_per_entity": 0.2}, 1000, {"seconds_per_entity": 0.1})
    assert (p["projected_seconds"], p["over_before"]) == (200.0, 2.0)


def written(path, header, rows):
    path.write_text("\t".join(header) + "\n" + "".join("\t".join(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_files_are_scored_and_validated(spark, tmp_path):
    head = ["source1_entity_id", "matched_entity_ids"]
    truth = written(tmp_path / "truth.tsv", head, [("S1-1", "S2-1"), ("S1-2", "")])
    good = written(tmp_path / "good.tsv", head, [("S1-1", "S2-1"), ("S1-2", "S3-4")])
    assert artifacts.score_files(spark, good, truth) == {"macro_f05": 0.5, "predict_nothing": 0.5, "entities": 2}
    with pytest.raises(tables.SourceError):
        artifacts.score_files(spark, written(tmp_path / "bad.tsv", head, [("S1-1", "S2-1,S2-1"), ("S1-2", "")]), truth)
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    lists = written(tmp_path / "cands.tsv", ["source1_entity_id", "candidate_entity_ids"], [("S1-1", "S2-1,S2-2"), ("S1-2", "S2-2")])
    assert artifacts.validate_files(spark, good, required, None, lists) == ([], ["not_among_candidates: 1"])
    wrong = written(tmp_path / "wrong.tsv", head, [("S1-1", "S1-2"), ("S1-9", "")])
    errors, _ = artifacts.validate_files(spark, wrong, required)
    assert errors == ["missing_entity: 1 (S1-2)", "self_match: 1 (S1-2)", "unexpected_entity: 1 (S1-9)"]
    assert artifacts.validate_files(spark, written(tmp_path / "csv.tsv", ["a,b"], []), required) == (["header: comma-separated"], [])


def test_commands_build_once_and_generate(spark, tmp_path, capsys):
    head = ["entity_id", "business_name", "business_address", "country"]
    s1 = written(tmp_path / "s1.tsv", head, [("S1-1", "Alpha Labs", "1 Main St", "US"), ("S1-2", "No Such", "", "US"), ("S1-3", "Beta", "", "US")])
    s2 = written(tmp_path / "s2.tsv", head, [("S2-1", "Alpha Labs", "1 Main St", "US"), ("S2-2", "Beta Works", "9 Side Rd", "US")])
    s3 = written(tmp_path / "s3.tsv", head, [("S3-1", "alpha  labs", "", "US")])
    ids, truth = tmp_path / "ids.txt", written(tmp_path / "truth.tsv", ["source1_entity_id", "matched_entity_ids"], [("S1-1", "S2-1,S3-1"), ("S1-2", ""), ("S1-3", "S2-2")])
    ids.write_text("S1-1\nS1-2\n")
    for kind in ("", "canonical-"):
        at, out = f"{tmp_path}/{kind}index", f"{tmp_path}/{kind}out"
        cli.main([f"{kind}build-index", "--targets", s2, s3, "--index", at], spark)
        before = artifacts.read_json(spark, f"{at}/built")
        cli.main([f"{kind}build-index", "--targets", s2, s3, "--index", at], spark)  # found, and left as it is
        assert artifacts.read_json(spark, f"{at}/built") == before
        report = cli.main([f"{kind}generate", "--index", at, "--queries", s1, "--output", out, "--ids", str(ids), "--truth", truth, "--sweep"], spark)
        assert report["queries"] == 2 and report["metrics"]["link_recall"] == 1.0 and report["sweep"][0]["cap"] == 5
        rows = {r[0]: r[1] for r in tables.read_tsv(spark, f"{out}/candidates", ["source1_entity_id", "candidate_entity_ids"], "plain").collect()}
        assert set(rows) == {"S1-1", "S1-2"} and {"S2-1", "S3-1"} <= set(rows["S1-1"].split(",")) and rows["S1-2"] == ""
    with pytest.raises(ValueError):
        cli.main(["generate", "--index", at, "--queries", s1, "--output", out, "--truth", truth], spark)
    assert json.loads(capsys.readouterr().out.strip().split("\n}\n")[0] + "\n}")


def test_frozen_rows_are_replaced_only_by_the_same(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    sha = artifacts.sinks.content_hash(rows, ["k", "n"]).first()["sha256"]
    path = f"{tmp_path}/frozen"
    assert artifacts.ensure_rows(spark, path, sha, lambda: rows, ["k", "n"]).count() == 2
    assert artifacts.ensure_rows(spark, path, sha, lambda: rows.limit(0), ["k", "n"]).count() == 2  # not made again
    with pytest.raises(tables.SourceError):
        artifacts.ensure_rows(spark, f"{tmp_path}/new", sha, lambda: rows.limit(1), ["k", "n"])


def test_index_is_stored_by_country_and_source(spark, tmp_path):
    targets = spark.createDataFrame([("S2-1", "Alpha Labs", "x", "US", "S2"), ("S3-1", "Beta", "y", "France", "S3")], RECORD + ", source string")
    idx = index.build_raw(targets)
    idx.save(f"{tmp_path}/i")
    back = index.load(spark, f"{tmp_path}/i")
    for a, b in ((idx.postings, back.postings), (idx.df, back.df)):
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()))
    assert "PartitionFilters: [isnotnull(country" in spark.read.parquet(f"{tmp_path}/i/postings").where("country = 'US'")._jdf.queryExecution().executedPlan().toString()
