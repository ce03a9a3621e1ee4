"""Places of regular-expression matches, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_key(text: Column, doc_id: Column) -> list[Column]:
    """Columns that rows of the same id and text share, and no others."""
    return [doc_id.cast("string").alias("key_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("key_text")]


KEY = ["key_id", "key_text"]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["key_id"].eqNullSafe(b["key_id"]) & (a["key_text"] == b["key_text"])


def found(text: Column, regex: Column) -> Column:
    """Array of (before, match): characters between the last match and this one, and the match itself.

    Both built-ins search leftmost and without overlap, so the pieces of a
    split and the extracted matches alternate. Matches must not be empty.
    """
    between = F.transform(F.split(text, regex, -1), lambda p: F.char_length(p))
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    pairs = F.arrays_zip(between.alias("before"), hits.alias("match"))
    return F.filter(pairs, lambda p: p["match"].isNotNull())


def placed(exploded: DataFrame, by: list[str]) -> DataFrame:
    """``start`` and ``end`` (exclusive) of exploded (pos, before, match) rows of one search each, told apart by ``by``.

    A running sum over the matches of one search; its cost is linear in them.
    """
    over = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("match")
    end = F.sum(F.col("before") + size).over(over)
    return exploded.withColumn("end", end).withColumn("start", F.col("end") - size)
