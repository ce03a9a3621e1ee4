"""Statistics of labeling functions: row expressions and one aggregate, whatever the number of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import cast_votes
from .labeling import LabelingFunction, VoteFrame


class LFAnalysis:
    """Coverage, overlap, conflict, polarity and accuracy of the functions behind a :class:`VoteFrame`.

    Votes are first counted by pattern, so that the statistics work on a few
    rows rather than on all; counts are integers and divided once.
    """

    def __init__(self, votes: VoteFrame, lfs: list[LabelingFunction] | None = None, gold: str | None = None):
        if lfs is not None and len(lfs) != votes.m:
            raise ValueError(f"{len(lfs)} functions do not fit {votes.m} columns of votes")
        self.votes, self.gold = votes, gold
        self.names = [lf.name for lf in lfs] if lfs is not None else votes.names
        by = [gold] if gold else []
        cast = cast_votes("votes")
        self.patterns = votes.patterns(*by).withColumns({"n_cast": F.size(cast), "n_kinds": F.size(F.array_distinct(cast))})

    def _share(self, condition) -> float:
        row = self.patterns.agg(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.sum("n")).first()
        return row[0] / row[1] if row[1] else 0.0

    def label_coverage(self) -> float:
        """Share of rows with a vote."""
        return self._share(F.col("n_cast") >= 1)

    def label_overlap(self) -> float:
        """Share of rows with two votes or more."""
        return self._share(F.col("n_cast") >= 2)

    def label_conflict(self) -> float:
        """Share of rows whose votes differ."""
        return self._share(F.col("n_kinds") >= 2)

    def label_stats(self) -> DataFrame:
        """The three shares as one row: coverage, overlap, conflict."""
        part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
        return self.patterns.agg(part(F.col("n_cast") >= 1).alias("coverage"), part(F.col("n_cast") >= 2).alias("overlap"), part(F.col("n_kinds") >= 2).alias("conflict"))

    def counts(self) -> DataFrame:
        """One row a function: j, name and its integer counts; everything else derives from it."""
        each = self.patterns.select("*", F.posexplode("votes").alias("j", "vote"))
        cast = F.col("vote") >= 0
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
        columns = [
            F.sum("n").alias("total"),  # every row has an element for each function
            F.array_sort(F.collect_set(F.when(cast, F.col("vote")))).alias("polarity"),
            count(cast)("n_votes"),
            count(cast & (F.col("n_cast") >= 2))("n_overlaps"),
            count(cast & (F.col("n_kinds") >= 2))("n_conflicts"),
        ]
        if self.gold:
            y = F.col(self.gold)
            columns += [count(cast & (F.col("vote") == y))("correct"), count(cast & (y >= 0) & (F.col("vote") != y))("incorrect")]
        names = F.array(*map(F.lit, self.names))
        return each.groupBy("j").agg(*columns).withColumn("name", F.get(names, F.col("j")))

    def lf_polarities(self) -> list[list[int]]:
        return [r.polarity for r in self.counts().orderBy("j").collect()]

    def _each(self, column) -> list[float]:
        return [r[0] for r in self.counts().orderBy("j").select(column).collect()]

    def lf_coverages(self) -> list[float]:
        return self._each(F.col("n_votes") / F.col("total"))

    def lf_overlaps(self, normalize_by_coverage: bool = False) -> list[float]:
        return self._each(_ratio("n_overlaps", "n_votes" if normalize_by_coverage else "total"))

    def lf_conflicts(self, normalize_by_overlaps: bool = False) -> list[float]:
        return self._each(_ratio("n_conflicts", "n_overlaps" if normalize_by_overlaps else "total"))

    def lf_empirical_accuracies(self) -> list[float]:
        """Correct votes over all votes; votes on rows without gold count as wrong."""
        self._needs_gold()
        return self._each(_ratio("correct", "n_votes"))

    def lf_empirical_probs(self, cardinality: int) -> DataFrame:
        """P(vote | gold): j, vote (-1 .. cardinality - 1), y, prob; null where a class never occurs."""
        self._needs_gold()
        each = self.patterns.select("n", F.col(self.gold).alias("y"), F.posexplode("votes").alias("j", "vote")).where((F.col("y") >= 0) & (F.col("y") < cardinality))
        seen = each.groupBy("j", "vote", "y").agg(F.sum("n").alias("n"))
        totals = self.patterns.where(F.col(self.gold) >= 0).groupBy(F.col(self.gold).alias("y")).agg(F.sum("n").alias("total"))
        spark = self.votes.df.sparkSession
        grid = spark.range(self.votes.m).select(F.col("id").cast("int").alias("j"), F.explode(F.sequence(F.lit(-1), F.lit(cardinality - 1))).alias("vote"))
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(cardinality - 1))).alias("y"))
        joined = grid.join(seen, ["j", "vote", "y"], "left").join(F.broadcast(totals), "y", "left")  # a row for each class
        return joined.select("j", "vote", "y", F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total")).alias("prob"))

    def lf_summary(self, est_weights: list[float] | None = None) -> DataFrame:
        """One row a function, in order; gold adds correct, incorrect and accuracy, weights add learned_weight."""
        c = self.counts()
        columns = [F.col("name").alias("lf"), "j", F.col("polarity"), _ratio("n_votes", "total").alias("coverage"), _ratio("n_overlaps", "total").alias("overlaps"), _ratio("n_conflicts", "total").alias("conflicts")]
        if self.gold:
            columns += ["correct", "incorrect", _ratio("correct", "n_votes").alias("emp_acc")]
        if est_weights is not None:
            columns.append(F.get(F.array(*map(F.lit, est_weights)), F.col("j")).alias("learned_weight"))
        return c.select(*columns)

    def _needs_gold(self) -> None:
        if not self.gold:
            raise ValueError("this statistic needs a gold column")


def _ratio(a: str, b: str):
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
