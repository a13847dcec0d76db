"""Line counts per file, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import is_comment, lines, trimmed


def line_metrics(files: DataFrame) -> DataFrame:
    """files plus blank_lines, comment_lines and lines_of_code."""
    count = lambda test: F.size(F.filter("__lines", test)).cast("long")
    split = files.withColumn("__lines", lines(F.col("content")))
    blank = count(lambda x: trimmed(x) == "")
    comment = count(lambda x: is_comment(x))
    return split.withColumns({"blank_lines": blank, "comment_lines": comment, "lines_of_code": F.size("__lines") - blank - comment}).drop("__lines")
