"""Run the reports over two tables and write every result.

    spark-submit job.py --orders PATH --contacts PATH --out PATH [--format csv]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from contactscope.plans import reports
from contactscope.plans.linked import prepare
from contactscope.sources import schemas
from contactscope.sources.tables import read_table, write_result

PARTS = ["descriptive", "statistics", "modelling", "segmentation", "executive"]


def run(
    spark: SparkSession,
    orders_path: str,
    contacts_path: str,
    out: str,
    fmt: str = "parquet",
    strict: bool = False,
    parts: list[str] | None = None,
) -> list[str]:
    """Read, link once, write each result table below ``out``; returns their paths."""
    orders = read_table(spark, orders_path, schemas.ORDERS, fmt, strict)
    contacts = read_table(spark, contacts_path, schemas.CONTACTS, fmt, strict)
    data = prepare(orders, contacts, strict, store=True)
    written = []
    for part in parts or PARTS:
        for name, result in getattr(reports, part)(data).items():
            written.append(write_result(result, name, f"{out.rstrip('/')}/{part}"))
    return written


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--orders", required=True)
    parser.add_argument("--contacts", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--strict", action="store_true", help="bad keys or times stop the job")
    parser.add_argument("--parts", nargs="*", choices=PARTS, default=None)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("contactscope").getOrCreate()
    for path in run(
        spark, args.orders, args.contacts, args.out, args.format, args.strict, args.parts
    ):
        print(path)


if __name__ == "__main__":
    main()
