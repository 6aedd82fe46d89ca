"""Places in files: which line (or element) of its file a row was.

A split of a file is read by one task from its first to its last record, and Spark tells
each row the file and the byte at which its split starts. So a row's place is the number
of rows in the splits before it, a prefix sum over one row per split, plus its number
inside the split. No row is sorted, and no id in the rows is needed.

Files are taken in the order of their names, as the parts of one table are written, so
places also run through a folder of part files; ``place_in_file`` counts from each file's
own start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import running_total
from ..session import materialize

SPLIT = {"file": "_metadata.file_path", "split_start": "_metadata.file_block_start"}


def split_columns() -> list[Column]:
    """Which split a row comes from (for rows straight from a file reader)."""
    return [F.col(v).alias(k) for k, v in SPLIT.items()]


def number_rows(tagged: DataFrame) -> DataFrame:
    """Add ``place`` and ``place_in_file`` (0-based) to rows that are written down with
    ``file``, ``split_start`` and ``seq``, which grows along each split without gaps. The
    rows before a split are known from one row per split, joined back by the split."""
    splits = tagged.groupBy("file", "split_start").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    splits = running_total(splits, ["file", "split_start"], "n", "before")
    known = splits.select("file", "split_start", "first", "before", F.min("before").over(Window.partitionBy("file")).alias("file_before"))
    inside = F.col("seq") - F.col("first")
    return (tagged.join(known, ["file", "split_start"])
            .withColumns({"place": (F.col("before") + inside).cast("bigint"),
                          "place_in_file": (F.col("before") - F.col("file_before") + inside).cast("bigint")})
            .drop("seq", "first", "before", "file_before"))


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """``value, file, split_start, place, place_in_file``: the lines of text files with
    their places. Large files are read by many tasks."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    lines = reader.text(path).select("value", *split_columns(), F.monotonically_increasing_id().alias("seq"))
    return number_rows(materialize(lines, "placed-lines"))
