"""Command line: ``python -m railweave.cli area|transit|paths ...``."""

from __future__ import annotations

import argparse
import json


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="railweave", description="Transport networks on Spark")
    does = parser.add_subparsers(dest="command", required=True)
    area = does.add_parser("area", help="find a municipality in a Parquet list of boundaries")
    area.add_argument("boundaries")
    area.add_argument("name", nargs="?")
    area.add_argument("--code")
    area.add_argument("--province", type=int)
    transit = does.add_parser("transit", help="turn feeds into layers")
    transit.add_argument("output")
    transit.add_argument("--feed", action="append", required=True, metavar="[NAME=]SOURCE")
    transit.add_argument("--mode", action="append", choices=["bus", "train"])
    transit.add_argument("--date")
    transit.add_argument("--schedule", action="store_true")
    paths = does.add_parser("paths", help="shortest paths between nodes of a network")
    paths.add_argument("network")
    paths.add_argument("--mode")
    paths.add_argument("--from", dest="origins", action="append", required=True)
    paths.add_argument("--to", dest="destinations", action="append", required=True)
    paths.add_argument("--threshold", type=float)
    paths.add_argument("--weight", default="tts")
    return parser.parse_args(arguments)


def feed_argument(text: str) -> tuple[str | None, str]:
    """``NAME=SOURCE`` or ``SOURCE``; an ``=`` within an address or a path isn't a name's."""
    name, eq, source = text.partition("=")
    return (name.strip(), source) if eq and "/" not in name and "\\" not in name and "?" not in name else (None, text)


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from railweave import api

    options = parsed(arguments)
    spark = SparkSession.builder.appName("railweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if options.command == "area":
        row, step = api.find_area(spark.read.parquet(options.boundaries), options.name, area_code=options.code, province=options.province)
        print(json.dumps({**row.asDict(), "step": step}, ensure_ascii=False, default=str))
    elif options.command == "transit":
        made = api.build_network(spark, options.output, modes=options.mode or ["bus", "train"], feeds=[feed_argument(f) for f in options.feed], date=options.date, schedule=options.schedule)
        print(json.dumps(made, ensure_ascii=False, default=str))
    else:
        ids = lambda values: [int(v) if v.lstrip("-").isdigit() else v for v in values]
        api.shortest_path(options.network, ids(options.origins), ids(options.destinations), options.threshold, mode=options.mode, weight=options.weight, geometry=False, spark=spark).show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
