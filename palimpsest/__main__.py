"""``python -m palimpsest FOLDER STATEMENT``: SQL over the views log, pages and segments of a log folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.session import PageLog


def main() -> None:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("folder")
    parser.add_argument("statement")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    log = PageLog.open(spark, args.folder)
    log.frame().createOrReplaceTempView("log")
    log.snapshot(log.durability()[1]).createOrReplaceTempView("pages")
    log.segments().createOrReplaceTempView("segments")
    spark.sql(args.statement).show(100, truncate=False)


if __name__ == "__main__":
    main()
