"""Command line: python -m erlink <command>. Paths are anything Spark reads; --s1 and --pool are folders that normalize wrote.

normalize   --records TSV --out DIR                         derived strings, address numbers and rows, by country
candidates  --s1 DIR --pool DIR --out DIR                   candidate pairs with provenance
train       --s1 DIR --pool DIR --truth TSV --out JSON      the linear model and its thresholds
infer       --s1 DIR --pool DIR --model JSON --out DIR      result files of a saved model [--countries A,B] [--smoke N]
shard       --s1 DIR --pool DIR --model JSON --country C --out DIR   one country's files and manifest
consolidate --s1 DIR --shards A,B --root DIR --out DIR      shards into result files [--smoke 1]
check       --s1 DIR --pool DIR --dir DIR                   violations of result files [--smoke 1]
validate    --s1 DIR --dir DIR [--pool DIR]                 findings a submission would fail on
profile     --records TSV [--field F]                       profile of a field, countries and commonest tokens
query       --name Q --tables DIR                           a registered query's rows
sql         --text SQL --tables DIR                         SQL over the fixtures s1, pool, raw_pool, truth, pairs, entities
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

COMMANDS = "normalize candidates train infer shard consolidate check validate profile query sql".split()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="erlink", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    for flag in ("records", "s1", "pool", "truth", "model", "out", "root", "dir", "shards", "country", "countries", "name", "tables", "text"):
        parser.add_argument(f"--{flag}")
    parser.add_argument("--field", default="business_name")
    parser.add_argument("--config", default="D3")
    parser.add_argument("--smoke", type=int, default=0, help="this many S1 per country, evenly spaced; 0: all")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("erlink").getOrCreate()

    from erlink.operators import blocking
    from erlink.operators import profile as R
    from erlink.plans import production as run
    from erlink.plans import registry
    from erlink.sources import readers, sinks

    def say(report: dict) -> int:
        print(json.dumps(report, indent=1, sort_keys=True, default=str))
        return int(report.get("status", "success") != "success" or not report.get("pass", report.get("ok", True)))

    folder = lambda path: readers.read_parquet(spark, path)
    if args.command == "query":
        registry.QUERIES[args.name](spark, args.tables).show(50, truncate=False)
    elif args.command == "sql":
        registry.views(spark, args.tables)
        spark.sql(args.text).show(50, truncate=False)
    elif args.command == "normalize":
        run.normalize(spark, args.records, args.out)
    elif args.command == "profile":
        rows = readers.read_tsv(spark, args.records)
        for table in (R.field_profile(rows, args.field), R.distribution(rows, "country"), R.top_tokens(rows, args.field)):
            table.show(50, truncate=False)
    elif args.command == "candidates":
        s1 = run.pick(folder(args.s1), [args.country] if args.country else None, args.smoke)
        sinks.write_parquet(blocking.candidates(s1, folder(args.pool), blocking.CONFIGS[args.config]), args.out)
    elif args.command == "train":
        truth = readers.truth_edges(readers.read_tsv(spark, args.truth, readers.TRUTH))
        run.train(spark, folder(args.s1), folder(args.pool), truth, args.out, args.config)
    elif args.command == "infer":
        return say(run.run_inference(spark, args.s1, args.pool, args.model, args.out, args.countries.split(",") if args.countries else None, args.smoke, args.config))
    elif args.command == "shard":
        return say(run.run_shard(spark, args.s1, args.pool, args.model, args.country, args.out, args.smoke, args.config))
    elif args.command == "consolidate":
        return say(run.consolidate(spark, args.root, args.shards.split(","), args.s1, args.out, bool(args.smoke)))
    elif args.command == "check":
        return say(run.check_outputs(spark, args.dir, folder(args.s1), folder(args.pool), bool(args.smoke)))
    elif args.command == "validate":
        return say(run.validate_submission(spark, args.dir, folder(args.s1), folder(args.pool) if args.pool else None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
