"""Commands: build an index of targets, and generate candidates of queries from it, over raw or canonical fields.

    python -m lodestitch.cli build-index --targets S2.tsv S3.tsv --index DIR
    python -m lodestitch.cli generate --index DIR --queries S1.tsv --output DIR [--ids IDS] [--truth TRUTH] [--cap 50]
    python -m lodestitch.cli canonical-build-index ...    python -m lodestitch.cli canonical-generate ... [--quota 10]
"""

from __future__ import annotations

import argparse
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import artifacts, index, metrics, retrieve, select, sinks
from .operators.represent import canonical_view
from .session import session
from .sources.tables import only_ids, read_ids, read_records, read_truth

SWEEP, QUOTAS = [5, 10, 20, 30, 50, 100], [0, 5, 10, 20]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestitch", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    for kind in ("", "canonical-"):
        build = commands.add_parser(f"{kind}build-index")
        build.add_argument("--targets", nargs="+", required=True, help="TSV files of S2 and S3 records")
        build.add_argument("--index", required=True)
        run = commands.add_parser(f"{kind}generate")
        for name in ("--index", "--queries", "--output"):
            run.add_argument(name, required=True)
        run.add_argument("--ids", help="a file of requested ids")
        run.add_argument("--truth", help="a file of matches; needs --ids, so that no truth outside the split is read")
        run.add_argument("--cap", type=int, default=50)
        run.add_argument("--floor", type=int, default=2)
        run.add_argument("--sweep", action="store_true", help="report recall and width under several caps")
        if kind:
            run.add_argument("--quota", type=int, default=10)
    return out


def targets_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [read_records(spark, p) for p in paths])
    return rows.withColumn("source", F.substring("entity_id", 1, 2))


def build_index(spark: SparkSession, paths: list[str], at: str, canonical: bool) -> dict:
    idx = artifacts.ensure_index(spark, at, targets_of(spark, paths), index.build_canonical if canonical else index.build_raw)
    return {"index": at, "records": idx.records.count(), "postings": idx.postings.count()}


def generate(spark: SparkSession, args: argparse.Namespace, canonical: bool) -> dict:
    """Writes candidates, provenance and, with truth, the miss audit; the report is written and returned."""
    if args.truth and not args.ids:
        raise ValueError("--truth needs --ids")
    ids = read_ids(spark, args.ids) if args.ids else None
    records = read_records(spark, args.queries)
    queries, idx = only_ids(records, ids) if ids is not None else records, index.load(spark, args.index)
    if canonical:
        ranked = select.rank_channels(retrieve.canonical_candidates(canonical_view(queries), idx))
        picked = lambda cap, quota: select.select(ranked, cap, args.floor, quota)
    else:
        ranked = select.rank_raw(retrieve.raw_candidates(queries, idx))
        picked = lambda cap, quota: select.select(ranked, cap, args.floor)
    ranked = ranked.persist()
    quota = args.quota if canonical else None
    chosen = picked(args.cap, quota)
    sinks.write_tsv(select.wide(chosen, queries), f"{args.output}/candidates", ["source1_entity_id"])
    rows = sinks.channel_rows(chosen, idx.records.select("entity_id", "source_script")) if canonical else sinks.provenance_rows(chosen)
    sinks.write_tsv(rows, f"{args.output}/provenance", ["source1_entity_id", "rank"])
    report = {"cap": args.cap, "floor": args.floor, "quota": quota, "queries": queries.count(), "pairs": chosen.count()}
    if args.truth:
        truth = read_truth(spark, args.truth, queries.select("entity_id"))
        score = lambda df: metrics.summary(metrics.per_entity(df, truth)).first().asDict()
        report["metrics"] = score(chosen)
        if args.sweep:
            report["sweep"] = [{"cap": c, "quota": q, **score(picked(c, q))} for c in SWEEP for q in (QUOTAS if canonical else [None])]
        artifacts.write_misses(metrics.misses(ranked, chosen, truth, channels=canonical), f"{args.output}/misses")
    sinks.write_json(spark, json.loads(json.dumps(report, default=str)), f"{args.output}/report")
    ranked.unpersist()
    return report


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark, canonical = spark or session(), args.command.startswith("canonical-")
    out = build_index(spark, args.targets, args.index, canonical) if args.command.endswith("build-index") else generate(spark, args, canonical)
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return out


if __name__ == "__main__":
    main()
