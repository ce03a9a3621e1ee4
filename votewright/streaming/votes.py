"""Labeling functions on streams: voting is stateless, so the same plan runs on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import cast_votes
from ..operators.labeling import LabelingFunction, apply_lfs


def vote_stream(stream: DataFrame, lfs: list[LabelingFunction], id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, votes) of a streaming or a batch frame."""
    return apply_lfs(stream, lfs, id_col, keep).df


def windowed_coverage(stream: DataFrame, lfs: list[LabelingFunction], id_col: str, time_col: str, window: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Rows, covered rows and conflicts of each time window; rows later than ``lateness`` are left out of a stream."""
    votes = vote_stream(stream, lfs, id_col, (time_col,))
    cast = cast_votes("votes")
    if votes.isStreaming:
        votes = votes.withWatermark(time_col, lateness)
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    out = votes.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.size(cast) >= 1).cast("long")).alias("covered"),
        F.sum((F.size(F.array_distinct(cast)) >= 2).cast("long")).alias("conflicts"),
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "covered", "conflicts")
