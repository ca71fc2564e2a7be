"""The whole job from the shell.

    spark-submit --py-files pagefacts.zip pagefacts/plans/job.py \\
        -i ids.csv --pages cache --pages-as files --tables out/db --reports out/reports
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagefacts.fixed_values import DEFAULT_IDENTIFIERS
from pagefacts.plans.build import build_tables, write_reports
from pagefacts.plans.staging import scratch
from pagefacts.sources.identifiers import checked_path, read_identifiers
from pagefacts.sources.pages import read_page_files, read_page_table


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Load product facts from captured pages into three tables.")
    parser.add_argument(
        "-i",
        "--identifiers",
        default=DEFAULT_IDENTIFIERS,
        help=f"CSV file or folder, identifier in the last field (default: {DEFAULT_IDENTIFIERS})",
    )
    parser.add_argument("--pages", required=True, help="page cache")
    parser.add_argument("--pages-as", choices=("files", "table"), default="table", help="one file per page, or parquet")
    parser.add_argument("--tables", required=True, help="folder for the tables; replaced")
    parser.add_argument("--reports", help="folder for text reports; replaced")
    parser.add_argument("--drop-blank-lines", action="store_true", help="pass over blank lines in the CSV")
    return parser.parse_args(argv)


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    checked_path(spark, options.identifiers)
    checked_path(spark, options.pages)
    on_blank = "drop" if options.drop_blank_lines else "fail"
    read_pages = read_page_files if options.pages_as == "files" else read_page_table
    # What the job stages is emptied when its tables and reports are written.
    with scratch(spark):
        ids = read_identifiers(spark, options.identifiers, on_blank=on_blank)
        build_tables(spark, ids, read_pages(spark, options.pages), options.tables)
        if options.reports:
            write_reports(spark, options.tables, options.reports)


if __name__ == "__main__":
    session = SparkSession.builder.appName("pagefacts").getOrCreate()
    run(session, arguments())
    session.stop()
