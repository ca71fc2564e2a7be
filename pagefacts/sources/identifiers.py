"""Identifier lists: CSV without a header, the identifier in the last field."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.sources.csv_records import is_whole, last_fields, last_of_whole


def checked_path(spark: SparkSession, path: str) -> str:
    """The path itself if there is something to read, else ValueError."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"{path} does not exist") from error
        raise
    return path


def last_field(line: Column) -> Column:
    """Last field of one CSV line. A quoted field that goes on in the next line is an error here."""
    open_quote = F.raise_error(F.concat(F.lit("record goes on after the end of the line: "), line))
    return F.when(is_whole(line), last_of_whole(line)).otherwise(open_quote.cast("string"))


def identifiers(lines: DataFrame, *, line: str = "value", on_blank: str = "fail") -> DataFrame:
    """Distinct identifiers of CSV records of one line each, in order. Nothing is trimmed or checked for form.

    ``on_blank`` says what a line without any character does: "fail" or "drop".
    """
    if on_blank not in ("fail", "drop"):
        raise ValueError(f"on_blank: {on_blank!r}")
    text = F.col(line)
    if on_blank == "drop":
        lines = lines.where(text != "")
        asin = last_field(text)
    else:
        blank = F.raise_error(F.lit("blank line in the identifier list")).cast("string")
        asin = F.when(text == "", blank).otherwise(last_field(text))
    return lines.select(asin.alias("asin")).distinct().orderBy("asin")


def read_identifiers(spark: SparkSession, path: str, *, on_blank: str = "fail") -> DataFrame:
    """Identifier list from a file or folder, in order: any number of fields, line breaks inside quotes, split anywhere.

    Building the list writes the lines to a staging table (see ``csv_records``).
    """
    checked_path(spark, path)
    fields = last_fields(spark, path, on_blank=on_blank)
    return fields.select(F.col("field").alias("asin")).distinct().orderBy("asin")
