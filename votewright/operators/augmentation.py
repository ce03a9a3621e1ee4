"""Transformation functions and the policies that decide which are applied in which order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import uniform
from .mapping import Mapper, missing_parentheses, unique_names


class TransformationFunction(Mapper):
    """A mapper that makes a new row from a row, or None (column kind: an all-null row) where it does not apply."""


def transformation_function(name: str | None = None, kind: str = "row", outputs: str | T.StructType | None = None, **kw: Any):
    missing_parentheses(name)
    return lambda f: TransformationFunction(name or f.__name__, f, kind, outputs=outputs, **kw)


def column_tf(name: str, column: str, f: Callable[[Column], Column]) -> TransformationFunction:
    """A transformation of one column by an expression; a null outcome means it does not apply."""
    return TransformationFunction(name, lambda x: {column: f(x)}, "column", [column])


class Policy:
    """Sequences of function numbers for each row. The empty sequence stands for the row as it is."""

    def __init__(self, n_tfs, n_per_original=1, keep_original=True):
        self._n, self.n_per_original, self.keep_original = n_tfs, n_per_original, keep_original

    def generate(self, rep: int, id_col: Column) -> Column:
        """The sequence of the ``rep``-th copy, as ARRAY<INT>."""
        raise NotImplementedError

    def sequences(self, id_col: Column) -> Column:
        """ARRAY<ARRAY<INT>> of a row."""
        none = [F.array().cast("array<int>")] if self.keep_original else []
        return F.array(*none, *[self.generate(k, id_col).cast("array<int>") for k in range(self.n_per_original)])


class ApplyAllPolicy(Policy):
    """All functions in order."""

    def generate(self, rep: int, id_col: Column) -> Column:
        return F.array(*map(F.lit, range(self._n)))


class ApplyOnePolicy(ApplyAllPolicy):
    """The first function alone."""

    def __init__(self, n_per_original=1, keep_original=True):
        super().__init__(1, n_per_original, keep_original)


class ApplyEachPolicy(Policy):
    """Each function alone, one copy for each."""

    def __init__(self, n_tfs, keep_original=True):
        super().__init__(n_tfs, n_tfs, keep_original)

    def generate(self, rep: int, id_col: Column) -> Column:
        return F.array(F.lit(rep))


class MeanFieldPolicy(Policy):
    """Independent draws of ``sequence_length`` functions with probabilities ``p``, fixed by seed, id, copy and place."""

    def __init__(self, n_tfs, sequence_length=1, p=None, n_per_original=1, keep_original=True, seed=0):
        super().__init__(n_tfs, n_per_original, keep_original)
        if p is None:
            raise ValueError("probabilities are needed")
        if len(p) != n_tfs or abs(sum(p) - 1) > 1e-6:
            raise ValueError("p must be a distribution over the functions")
        self.length, self.p, self.seed = sequence_length, list(p), seed

    def generate(self, rep: int, id_col: Column) -> Column:
        def pick(place: int) -> Column:
            u, total, out = uniform(self.seed, id_col.cast("string"), rep, place), 0.0, F
            for k, q in enumerate(self.p[:-1]):
                total += q
                out = out.when(u < total, F.lit(k))
            return out.otherwise(F.lit(self._n - 1)) if out is not F else F.lit(self._n - 1)

        return F.array(*[pick(k) for k in range(self.length)])


class RandomPolicy(MeanFieldPolicy):
    """All functions are equally likely."""

    def __init__(self, n_tfs, sequence_length=1, n_per_original=1, keep_original=True, seed=0):
        super().__init__(n_tfs, sequence_length, [1 / n_tfs] * n_tfs, n_per_original, keep_original, seed)


def apply_tfs(df: DataFrame, tfs: list[TransformationFunction], policy: Policy, id_col: str) -> DataFrame:
    """``df`` augmented: ``aug_idx`` numbers a row's copies (its sequence's place in the policy).

    A function that gives None is skipped and the sequence goes on; a copy on
    which no function of a non-empty sequence applied is dropped.
    """
    unique_names([t.name for t in tfs])
    if policy._n > len(tfs):
        raise ValueError("the policy has more functions than were given")
    kinds = {t.kind for t in tfs}
    spread = df.select("*", F.posexplode(policy.sequences(F.col(id_col))).alias("aug_idx", "_seq"))
    if kinds == {"column"}:
        return _by_columns(spread, tfs, policy, df.columns)
    if "column" in kinds:
        raise ValueError("column functions can't be mixed with Python functions")
    return _by_python(spread, tfs, df)


def _by_columns(spread: DataFrame, tfs: list[TransformationFunction], policy: Policy, columns: list[str]) -> DataFrame:
    length = len(tfs) if isinstance(policy, ApplyAllPolicy) else getattr(policy, "length", 1)
    work = spread.withColumn("_applied", F.size("_seq") == 0)
    for place in range(length):
        which = F.get("_seq", F.lit(place))
        outs = [t.named(t.f(*(F.col(c) for c in t.inputs))) for t in tfs]
        changed = list(dict.fromkeys(c for o in outs for c in o))
        done = F.lit(False)
        new = {c: F.col(c) for c in changed}
        for k, o in enumerate(outs):
            on = (which == k) & ~_all_null(o)
            done = done | F.coalesce(on, F.lit(False))
            new = {c: F.when(on, o[c]).otherwise(v) if c in o else v for c, v in new.items()}
        work = work.withColumns({**new, "_applied": F.col("_applied") | done})
    return work.where("_applied").select(*columns, "aug_idx")


def _all_null(out: dict[str, Column]) -> Column:
    test = F.lit(True)
    for c in out.values():
        test = test & c.isNull()
    return test


def _by_python(spread: DataFrame, tfs: list[TransformationFunction], df: DataFrame) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("aug_idx", T.IntegerType())])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                x, applied = {c: row[c] for c in names}, len(row["_seq"]) == 0
                for k in row["_seq"]:
                    out = tfs[k].call_row(x)
                    if out is not None:
                        x, applied = {c: getattr(out, c) for c in names}, True
                if applied:
                    rows.append({**x, "aug_idx": row["aug_idx"]})
            yield pd.DataFrame(rows, columns=[*names, "aug_idx"])

    return spread.mapInPandas(run, schema)


def apply_generator(df: DataFrame, tfs: list[TransformationFunction], policy: Policy, id_col: str, batch_size: int) -> Iterator[pd.DataFrame]:
    """The augmented rows in frames of at most ``batch_size``, a partition at a time."""
    rows, columns = [], [*df.columns, "aug_idx"]
    for row in apply_tfs(df, tfs, policy, id_col).toLocalIterator():
        rows.append(tuple(row))
        if len(rows) == batch_size:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)
