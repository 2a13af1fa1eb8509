"""Batch entry point: ``spark-submit -m logtab <path> [-o DIR] [-i] ...``.

Chunking and worker counts are Spark's business: ``--chunk-size`` becomes
``spark.sql.files.maxPartitionBytes`` (bytes per read task); parallelism
comes from the cluster (``--master``, executors, cores).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from logtab.operators.parsers import DEFAULT_PARSERS
from logtab.plans.tabulate import parse_logs


def arg_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="logtab", description=(
        "Turn firewall logs into one TSV table per grammar and a text file of rejected lines."))
    ap.add_argument("src", nargs="+", metavar="<path>", help="log file(s) or glob")
    ap.add_argument("-o", "--out-dir-path", default=None, metavar="<dir>",
                    help="where the tables go; a directory that is not there yet")
    ap.add_argument("-c", "--chunk-size", type=int, default=None, metavar="<bytes>",
                    help="bytes per read task (spark.sql.files.maxPartitionBytes)")
    ap.add_argument("-p", "--max-processes", type=int, default=None, metavar="<num>",
                    help="local runs only: worker slots (with -t: slots = p * t); on a cluster the "
                         "executors decide")
    ap.add_argument("-t", "--max-threads", type=int, default=1, metavar="<num>",
                    help="local runs only: multiplies -p")
    ap.add_argument("-i", "--preserve-intermediate-results", action="store_true",
                    help="keep the narrow records and key lists under <out>/.records and <out>/.keys")
    ap.add_argument("--year", type=int, default=2020, help="year for stamps that carry none")
    ap.add_argument("--on-bad-date", choices=["fail", "reject", "null"], default="fail")
    ap.add_argument("--no-order", action="store_true", help="parts in no particular order")
    ap.add_argument("--single-file", action="store_true", help="one file per output, joined from its parts")
    ap.add_argument("--max-columns", type=int, default=None, metavar="<num>",
                    help="stop if a table would get more columns (default: no limit)")
    ap.add_argument("--min-partitions", type=int, default=None, metavar="<num>",
                    help="deal the lines over so many tasks before parsing (gzip logs, small files)")
    ap.add_argument("--encoding", default="UTF-8", metavar="<name>", help="charset of the logs (UTF-8 or a one-byte charset)")
    ap.add_argument("--on-bad-bytes", choices=["replace", "fail", "reject"], default="replace")
    ap.add_argument("--natural-order", action="store_true",
                    help="order several sources by the number at the end of their names")
    return ap


def main(argv: list[str] | None = None) -> int:
    args = arg_parser().parse_args(sys.argv[1:] if argv is None else argv)
    builder = SparkSession.builder.appName("logtab")
    if args.max_processes and not SparkSession.getActiveSession():
        from pyspark import SparkConf

        if not SparkConf().contains("spark.master"):  # not launched by spark-submit with a master
            builder = builder.master(f"local[{max(1, args.max_processes * max(1, args.max_threads))}]")
    if args.chunk_size:
        builder = builder.config("spark.sql.files.maxPartitionBytes", str(args.chunk_size))
    spark = builder.getOrCreate()
    res = parse_logs(spark, args.src, out=args.out_dir_path, parsers=DEFAULT_PARSERS, year=args.year,
                     on_bad_date=args.on_bad_date, keep_records=args.preserve_intermediate_results,
                     preserve_order=not args.no_order, single_file=args.single_file,
                     natural_order=args.natural_order, max_columns=args.max_columns,
                     min_partitions=args.min_partitions, encoding=args.encoding, on_bad_bytes=args.on_bad_bytes)
    print(f"output: {res.out_dir}")
    for name, n in res.counts.items():
        print(f"  {name}: {n} lines")
    return 0
