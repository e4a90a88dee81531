"""python -m tidegrid: list the queries, run some over a data folder, or run a pipeline into a store.

A pipeline prints its manifest as JSON; with --dry-run it only counts what it would write.
"""

from __future__ import annotations

import argparse
import importlib
import json

from tidegrid.operators.market import LATE_SECONDS, VOLATILITY_WINDOW
from tidegrid.plans import catalogue, pipelines, problems, views
from tidegrid.session import make_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidegrid", description=__doc__)
    parser.add_argument("names", nargs="*", help="queries to run; none: list them")
    parser.add_argument("--data", help="folder of the tables")
    parser.add_argument("--out", help="folder for the results, one per query")
    parser.add_argument("--module", action="append", default=[], help="a further module with QUERIES")
    parser.add_argument("--master", help="Spark master, if not set by spark-submit")
    run = parser.add_argument_group("pipelines")
    run.add_argument("--run", choices=("minute", "provider"), help="minute: landed events to minute figures; provider: a daily answer into the raw store")
    run.add_argument("--input", help="the landed file, or the provider's answer")
    run.add_argument("--signals", help="a landed file of external signals")
    run.add_argument("--store", help="folder of the store")
    run.add_argument("--symbol", help="symbol of the provider's answer")
    run.add_argument("--source", default="landed", help="source of rows that name none")
    run.add_argument("--late-seconds", type=int, default=LATE_SECONDS)
    run.add_argument("--window", type=int, default=VOLATILITY_WINDOW)
    run.add_argument("--dry-run", action="store_true")
    args = parser.parse_args()
    if args.run:
        if not args.input or not args.store or args.run == "provider" and not args.symbol:
            parser.error("--input and --store are needed, and --symbol for a provider")
        spark = make_session(master=args.master)
        if args.run == "minute":
            print(json.dumps(pipelines.run_minute(spark, args.input, args.store, args.source, args.signals, args.dry_run, late_seconds=args.late_seconds, window=args.window)))
        else:
            with open(args.input, "rb") as f:
                print(json.dumps({"new": pipelines.ingest_provider(spark, f.read(), args.symbol, args.source, args.store)}))
        return
    queries = problems.QUERIES | catalogue.QUERIES | views.QUERIES
    for name in args.module:
        queries |= importlib.import_module(name).QUERIES
    if not args.names:
        print("\n".join(queries))
        return
    if unknown := [n for n in args.names if n not in queries]:
        parser.error("no such query: " + ", ".join(unknown))
    if not args.data or not args.out:
        parser.error("--data and --out are needed to run queries")
    spark = make_session(master=args.master)
    for name in args.names:
        queries[name](spark, args.data).write.mode("overwrite").parquet(f"{args.out}/{name}")
        print(name, spark.read.parquet(f"{args.out}/{name}").count(), flush=True)


if __name__ == "__main__":
    main()
