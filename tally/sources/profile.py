"""A first look at text files: header rows, fixed width, delimiters."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)


def headers(df: DataFrame, key: str, text: str, delimiter: str = ",") -> DataFrame:
    """(key, header, width): the first line whose width, two at least, the next two lines share."""
    width = F.size(F.split("line", "\\" + delimiter if delimiter in "|.^$*+?()[]{}\\" else delimiter))
    w = Window.partitionBy(key).orderBy("i")
    x = _lines(df, key, text).select(key, "i", width.alias("w"))
    x = x.select(key, "i", "w", F.lead("w", 1).over(w).alias("w1"), F.lead("w", 2).over(w).alias("w2")).filter("w >= 2 and w = w1 and w = w2")
    return x.groupBy(key).agg(F.min("i").alias("header"), F.min_by("w", "i").alias("width"))


def fixed_width(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines, fixed_width): whether most lines have runs of spaces and no delimiter."""
    wide = F.col("line").rlike(" {2,}") & ~F.col("line").contains(",")
    return _lines(df, key, text).groupBy(key).agg(F.count("*").alias("lines"), (F.count_if(wide) * 2 > F.count("*")).alias("fixed_width"))


def delimiter(lines: list[str]) -> str | None:
    """The sign that the first lines share most evenly, of comma, tab, semicolon and bar."""
    best = None
    for d in ",\t;|":
        counts = Counter(x.count(d) for x in lines[:5] if x.strip())
        (n, times) = counts.most_common(1)[0] if counts else (0, 0)
        if n and (best is None or (times, n) > best[:2]):
            best = (times, n, d)
    return best[2] if best else None
