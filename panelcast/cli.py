"""Command line: ``python -m panelcast.cli forecast|validate|health``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelcast").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _forecast(args: argparse.Namespace) -> int:
    from panelcast.plans.pipeline import forecast
    from panelcast.sources import read_csv, write_csv

    levels = tuple(float(q) for q in args.quantiles.split(",")) if args.quantiles else ()
    result = forecast(read_csv(_session(), args.input), args.h, args.freq, quantiles=levels)
    write_csv(result.df.orderBy("unique_id", "ds"), args.output)  # range-sorted files; a small result is one
    print(f"Wrote {result.model_name} to {args.output}")
    return 0


def _validate(args: argparse.Namespace) -> int:
    from panelcast.errors import PanelcastError
    from panelcast.operators.panel import validate
    from panelcast.sources import read_csv

    try:
        df = validate(read_csv(_session(), args.input))
    except PanelcastError as e:
        print(f"Invalid: {e}")
        return 1
    n, first, last = df.agg(F.count_distinct("unique_id"), F.min("ds"), F.max("ds")).first()
    print(f"Valid: {n} series, {first} to {last}")
    return 0


def _health(_: argparse.Namespace) -> int:
    from panelcast.inspect import check_health

    report = check_health()
    print(report)
    return 0 if report.all_ok else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelcast")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("forecast", help="CSV panel to CSV forecast")
    p.add_argument("--input", required=True)
    p.add_argument("--h", type=int, required=True)
    p.add_argument("--freq", default="D")
    p.add_argument("--output", required=True)
    p.add_argument("--quantiles", default="0.1,0.5,0.9")
    p.set_defaults(run=_forecast)
    p = sub.add_parser("validate", help="check a CSV panel")
    p.add_argument("--input", required=True)
    p.set_defaults(run=_validate)
    sub.add_parser("health", help="list models and whether they can run").set_defaults(run=_health)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
