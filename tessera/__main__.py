"""python -m tessera list | run QUERY SF_DIR [OUT]: the registered queries from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.plans import catalogue, streams


def main(argv: list[str] | None = None) -> None:
    known = catalogue.QUERIES | streams.QUERIES
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(known))
    run.add_argument("sf_dir")
    run.add_argument("out", nargs="?", help="a folder for Parquet; without one, twenty rows are shown")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(known)))
        return
    spark = SparkSession.builder.appName(f"tessera {args.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = known[args.query](spark, args.sf_dir)
    df.write.parquet(args.out) if args.out else df.show()


if __name__ == "__main__":
    main()
