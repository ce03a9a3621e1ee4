"""Column functions over votes, predictions and probabilities. -1 is abstain or unknown throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSTAIN = -1
TIE_POLICIES = ("abstain", "random", "true-random")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cast_votes(votes: Column | str) -> Column:
    return F.filter(_col(votes), lambda v: v >= 0)


def bound(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it.

    A filter on a derived column is pushed below the projections it was made in,
    where each name stands for its whole expression: without this, work grows as
    the product of the references of all steps.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def sha1_mod(value: Column | str, n: Column) -> Column:
    """SHA-1 of a number's decimal digits, as an integer modulo ``n``, folded eight hex digits at a time."""
    digest = F.sha1(_col(value).cast("string").cast("binary"))
    n = n.cast("long")
    chunks = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(5)]
    step = F.lit(1 << 32) % n
    return reduce(lambda acc, c: (acc * step + c) % n, chunks[1:], chunks[0] % n)


def probs_to_preds(probs: Column | str, tie_break_policy: str = "random", index: Column | str | None = None, tol: float = 1e-5) -> Column:
    """The most probable class; ties (within ``tol``) by policy.

    "random" picks by the SHA-1 of ``index``, a number that stands for the row;
    "true-random" draws anew each time; "abstain" gives -1.
    """
    if tie_break_policy not in TIE_POLICIES:
        raise ValueError(f"unknown tie_break_policy: {tie_break_policy}")
    if tie_break_policy == "random" and index is None:
        raise ValueError("the random tie break needs an index column")

    def chosen(ties: Column, draw: Column | None = None) -> Column:
        if tie_break_policy == "abstain":
            tied = F.lit(ABSTAIN)
        elif tie_break_policy == "true-random":
            tied = F.element_at(ties, (F.floor(draw * F.size(ties)) + 1).cast("int")).cast("int")
        else:
            tied = F.element_at(ties, (sha1_mod(index, F.size(ties)) + 1).cast("int")).cast("int")
        return F.when(F.size(ties) == 1, F.element_at(ties, 1).cast("int")).otherwise(tied)

    def best(p: Column, draw: Column | None = None) -> Column:
        ties = bound(F.array_max(p), lambda top: F.filter(F.transform(p, lambda x, i: F.when(top - x < tol, i)), lambda i: i.isNotNull()))
        few = F.raise_error(F.lit("probs must have more than one class")).cast("int")
        return F.when(F.size(p) <= 1, few).otherwise(bound(ties, lambda t: chosen(t, draw)))

    if tie_break_policy == "true-random":  # drawn outside of what is computed for the row's classes
        return bound(F.rand(), lambda draw: bound(probs, lambda p: best(p, draw)))
    return bound(probs, best)


def preds_to_probs(preds: Column | str, cardinality: int) -> Column:
    """One-hot doubles; a prediction outside 0 .. cardinality - 1 raises."""
    p = _col(preds)
    hot = F.transform(F.sequence(F.lit(0), F.lit(cardinality - 1)), lambda c: (c == p).cast("double"))
    return F.when((p < 0) | (p >= cardinality), F.raise_error(F.lit("an abstention or a vote beyond the classes has no one-hot probabilities")).cast("array<double>")).otherwise(hot)


def to_int_label(column: Column | str) -> Column:
    """An integer label; values with a fraction raise."""
    c = _col(column).cast("double")
    return F.when(c != F.floor(c), F.raise_error(F.lit("a label is not a whole number"))).otherwise(c).cast("int")


#: Rows of a range, about, and the most ranges.
RANGE_ROWS, RANGES = 1_000_000, 1024


def range_part(df: DataFrame, column: str, parts: int | None = None) -> Column:
    """The number of the range that a value lies in; ranges follow each other and hold about equally many rows.

    There is a range for each ``RANGE_ROWS`` rows, 64 at least and ``RANGES`` at
    most. The limits are values, so the same value gets the same number wherever
    and however often it is computed; a row finds its range by halving them.
    """
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    if numeric:  # one pass: fine quantiles, of which as many are taken as are needed
        shares = [k / RANGES for k in range(1, RANGES)]
        total, found = df.agg(F.count(column), F.percentile_approx(column, shares, 10 * RANGES)).first()
        found = found or []
    else:
        total = df.count()
        some = df.select(column).where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(max(1, total // RANGES))) == 0))
        found = [r[0] for r in some.distinct().limit(4 * RANGES).collect()]
    limits = sorted({x for x in found if x == x})
    parts = parts or min(RANGES, max(64, -(-total // RANGE_ROWS)))
    step = max(1, len(limits) // parts)
    limits = limits[step - 1 :: step]

    def below(low: int, high: int) -> Column:
        """How many of limits[low:high] the value reaches, plus ``low``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) >= F.lit(limits[middle]), below(middle + 1, high)).otherwise(below(low, middle))

    return below(0, len(limits))


def with_dense_index(df: DataFrame, id_col: str, name: str = "index") -> DataFrame:
    """Rows numbered from 0 in order of ``id_col``, without bringing them into one task.

    Rows are counted in ranges of the id first; a row's number is its place
    within its range plus the rows of the ranges before.
    """
    ranged = df.withColumn("_part", range_part(df, id_col))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(id_col)) - 1
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def filter_labels(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Rows in which no named column holds one of its listed values (all conditions together)."""
    unknown = set(filters) - set(df.columns)
    if unknown:
        raise ValueError(f"filter_dict has keys that are no columns: {sorted(unknown)}")
    return reduce(lambda d, item: d.where(~F.coalesce(F.col(item[0]).isin(list(item[1])), F.lit(False))), filters.items(), df)


def uniform(seed: int, *parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone, not on partitioning.

    It is the first 52 bits of the SHA-1 of "seed:part:part ...", which any engine can repeat.
    """
    cols = [F.lit(str(p)) if isinstance(p, int) else F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    digest = F.sha1(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def softmax(scores: Column | str) -> Column:
    """exp(x - max) / sum, computed on an array."""
    def shares(e: Column) -> Column:
        return bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total))

    powers = lambda s: bound(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    return bound(scores, lambda s: bound(powers(s), shares))


def cross_entropy_with_probs(logits: Column | str, target: Column | str, weight: list[float] | None = None) -> Column:
    """Soft cross-entropy of one row: sum over classes of target * weight * -log softmax."""
    z, t = _col(logits), _col(target)
    top = F.array_max(z)
    log_total = F.log(F.aggregate(F.transform(z, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)) + top
    terms = F.zip_with(z, t, lambda x, y: y * (log_total - x))
    if weight is not None:
        terms = F.zip_with(terms, F.array(*map(F.lit, weight)), lambda x, w: x * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def soft_loss(df: DataFrame, logits: str, target: str, weight: list[float] | None = None, reduction: str = "mean") -> DataFrame:
    """``loss`` for each row ("none"), or one row with the mean over rows or the sum."""
    if reduction not in ("none", "mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    each = cross_entropy_with_probs(logits, target, weight)
    if reduction == "none":
        return df.withColumn("loss", each)
    return df.agg((F.avg(each) if reduction == "mean" else F.sum(each)).alias("loss"))


def pad(values: Column | str, length: int, value: float | int = 0) -> Column:
    """An array cut or filled up to ``length``."""
    v = _col(values)
    return F.slice(F.concat(v, F.array_repeat(F.lit(value), length)), 1, length)


def pad_mask(values: Column | str, length: int, value: float | int = 0) -> Column:
    """1 where the padded array holds the padding value, else 0."""
    return F.transform(pad(values, length, value), lambda x: (x == value).cast("int"))
