"""Command line: import an edge list into a store, then serve it."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from logging.handlers import TimedRotatingFileHandler

from pyspark.sql import SparkSession

from vertexloom.service import serve
from vertexloom.sources.edge_lists import read_edge_list
from vertexloom.sources.store import GraphStore


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vertexloom", description=__doc__)
    p.add_argument("--database_dir", required=True, help="folder of the store")
    p.add_argument("--need_import", action="store_true", help="import data_path first")
    p.add_argument("--data_path", help="a .csv, .xlsx or .parquet edge list")
    p.add_argument("--batch_size", type=positive, help="taken for compatibility: an import is one job, whose tasks Spark sizes")
    p.add_argument("--port", type=positive, default=8200)
    p.add_argument("--log_level", default="info", choices=["debug", "info", "warning", "error"])
    p.add_argument("--log_file", help="also log here, a file a day")
    p.add_argument("--import_only", action="store_true", help="don't serve")
    args = p.parse_args(argv)
    if args.need_import and not args.data_path:
        p.error("data_path is needed with need_import")
    return args


def main(argv: Sequence[str] | None = None) -> int:
    args = arguments(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if args.log_file:
        handlers.append(TimedRotatingFileHandler(args.log_file, when="midnight"))
    logging.basicConfig(level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(message)s", handlers=handlers)
    spark = SparkSession.builder.appName("vertexloom").getOrCreate()
    store = GraphStore(spark, args.database_dir)
    if args.need_import:
        store.add(read_edge_list(spark, args.data_path))
        logging.info("imported %s as version %s", args.data_path, store.version())
    if not args.import_only:
        with serve(store.open(), args.port) as server:
            server.serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
