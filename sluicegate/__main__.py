"""Command line: python -m sluicegate transform -s schema.json -i input [--stream]."""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluicegate")
    sub = parser.add_subparsers(dest="command", required=True)
    t = sub.add_parser("transform", help="transform an input to JSON")
    t.add_argument("-s", "--schema", required=True)
    t.add_argument("-i", "--input", help="default: standard input")
    t.add_argument("--stream", action="store_true", help="one compact record per line")
    t.add_argument("-p", "--property", action="append", default=[], metavar="NAME=VALUE")
    a = parser.parse_args(argv)
    for path in (a.schema, a.input):
        if path is not None and not os.path.exists(path):
            print(f"Error: input file '{path}' does not exist", file=sys.stderr)
            return 1
    from pyspark.sql import SparkSession

    from . import Engine, SchemaError
    from .plans.sinks import json_array

    spark = SparkSession.builder.appName("sluicegate").getOrCreate()
    with open(a.schema, encoding="utf-8") as f:
        schema = f.read()
    external = dict(p.split("=", 1) for p in a.property)
    try:
        plan = Engine(spark).compile(schema, external=external)
        if a.input is None:
            for v in (values := plan.transform_text(sys.stdin.read())) if a.stream else []:
                print(json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
            if not a.stream:
                values = plan.transform_text(sys.stdin.read())
                print(json.dumps(values, ensure_ascii=False, indent="\t", sort_keys=True))
            return 0
        rows = plan.transform_files(a.input)
        if not a.stream:
            for piece in json_array(rows):
                print(piece, end="")
            print()
            return 0
        for r in rows.orderBy("input_name", "rec_no").toLocalIterator():
            if r["error"] is not None:
                raise RuntimeError(r["error"])
            print(r["value"])
        return 0
    except (SchemaError, RuntimeError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
