"""Command line access to ingest and reports.

    python -m dealflow ingest --raw deals.csv --format csv --deals /data/deals
    python -m dealflow report weekly_digest priority_queue --deals /data/deals --out /data/out
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from dealflow.functions.dates import ISO_FORMAT
from dealflow.reports import REPORTS, run
from dealflow.session import tuned
from dealflow.sources import ingest, read_deals, read_raw, write_deals, write_report


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="dealflow")
    tasks = parser.add_subparsers(dest="task", required=True)

    make = tasks.add_parser("ingest", help="type a raw deal table and store it")
    make.add_argument("--raw", required=True, help="path or table name")
    make.add_argument("--format", default="parquet", help="a Spark format, or 'table'")
    make.add_argument(
        "--option", action="append", default=[], metavar="NAME=VALUE", help="option of the reader"
    )
    make.add_argument("--date-format", default=ISO_FORMAT)
    make.add_argument("--normalize", action="store_true", help="trim texts, mend label case")
    make.add_argument("--deals", required=True, help="folder of the typed table")

    give = tasks.add_parser("report", help="compute reports from a stored deal table")
    give.add_argument("names", nargs="+", choices=sorted(REPORTS), metavar="name")
    give.add_argument("--deals", required=True, help="folder of the typed table")
    give.add_argument("--as-of", type=dt.date.fromisoformat, help="report day, default today")
    give.add_argument("--out", help="folder to write to; without it all rows are printed")
    give.add_argument("--rows", type=int, help="print only the first so many rows")
    give.add_argument("--out-format", default="parquet")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = tuned(SparkSession.builder).appName("dealflow").getOrCreate()
    if args.task == "ingest":
        options = dict(option.split("=", 1) for option in args.option)
        raw = read_raw(spark, args.raw, args.format, **options)
        write_deals(ingest(raw, args.date_format, args.normalize), args.deals)
        return
    deals = read_deals(spark, args.deals)
    for name in args.names:
        report = run(name, deals, args.as_of)
        if args.out:
            write_report(report, f"{args.out}/{name}", args.out_format)
        else:
            shown = report if args.rows is None else report.limit(args.rows)
            print(name, *report.columns, sep="\t")
            for row in shown.toLocalIterator():
                print(name, *row, sep="\t")


if __name__ == "__main__":
    main()
