"""Command line: build a store from text files, say what a store holds, search it.

python -m foldsearch build PLACES ADMIN1 ADMIN2 STORE
python -m foldsearch info STORE
python -m foldsearch search STORE TEXT [--limit N]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from foldsearch.operators.search import DEFAULT_LIMIT, search
from foldsearch.sources import places, store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foldsearch")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="read place and administrative-code files, write a store")
    for name in ("places", "admin1", "admin2", "store"):
        build.add_argument(name)
    build.add_argument("--source", default="", help="what the manifest calls the source")
    info = commands.add_parser("info", help="check a store and print its manifest")
    info.add_argument("store")
    look = commands.add_parser("search", help="print the first matches")
    look.add_argument("store")
    look.add_argument("text")
    look.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("foldsearch").getOrCreate()
    try:
        if args.command == "build":
            rows = places.read_places(spark, args.places, args.admin1, args.admin2)
            print(store.write_store(rows, args.store, source_name=args.source).to_json())
        elif args.command == "info":
            store.read_store(spark, args.store)
            print(store.read_manifest(spark, args.store).to_json())
        else:
            found = search(store.read_store(spark, args.store, verify=False), args.text, args.limit)
            for row in places.printed(found.orderBy("rank_no")).select("printed").collect() if args.limit >= 0 else places.printed(found.orderBy("rank_no")).select("printed").toLocalIterator():
                print(row["printed"], end="\n\n")
    except store.StoreError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
