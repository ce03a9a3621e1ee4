"""Labeling functions and their application: rows in, one small integer a function out.

Three kinds: a column function is part of the query plan; a pandas function
sees a batch of its input columns; a row function sees a row. All pandas and
row functions of one call run in a single pass over Arrow batches, which
receives only the columns they name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import LambdaMapper, Mapper, apply_mappers, chain, map_batch, missing_parentheses, pieces, unique_names

ABSTAIN = -1


@dataclass
class LabelingFunction:
    """A named vote. ``kind``: "column" (no inputs needed), "pandas" or "row"."""

    name: str
    f: Callable[..., Any]
    kind: str = "column"
    inputs: list[str] = field(default_factory=list)
    resources: dict[str, Any] = field(default_factory=dict)
    pre: list[Mapper] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.kind not in ("column", "pandas", "row"):
            raise ValueError(f"unknown kind of labeling function: {self.kind}")
        if self.kind != "column" and not self.inputs:
            raise ValueError(f"{self.name}: name the input columns of a {self.kind} function")

    def __repr__(self) -> str:
        kind = type(self).__name__
        return f"{kind} {self.name}, Preprocessors: {self.pre}"

    def column(self) -> Column:
        """The vote as a column: negatives become -1, a null stays null."""
        vote = self.f(**self.resources)
        if isinstance(vote, bool | int):
            vote = F.lit(int(vote))
        return F.when(vote.cast("int") >= 0, vote.cast("int")).when(vote.isNotNull(), F.lit(ABSTAIN))

    def __call__(self, x: Any) -> Any:
        """The raw vote of one row (row functions) or one batch (pandas functions)."""
        for mapper in self.pre:
            x = mapper.call_row(x) if self.kind == "row" else map_batch(x, [mapper])
            if x is None:
                raise ValueError(f"preprocessor {mapper.name} gave None")
        return self.f(x, **self.resources)


def labeling_function(name: str | None = None, kind: str = "column", inputs: list[str] | None = None, resources: dict[str, Any] | None = None, pre: list[Mapper] | None = None):
    """Decorator that makes a :class:`LabelingFunction`; the name defaults to the function's."""
    missing_parentheses(name)

    def wrap(f: Callable[..., Any]) -> LabelingFunction:
        return LabelingFunction(name or f.__name__, f, kind, inputs or [], resources or {}, pre or [])

    return wrap


@dataclass(frozen=True)
class VoteFrame:
    """Votes of m functions on each row: (id, votes ARRAY<INT>), and what else was kept."""

    df: DataFrame
    id_col: str
    names: list[str]
    fault_cols: tuple[str, ...] = ()

    @property
    def m(self) -> int:
        return len(self.names)

    def wide(self) -> DataFrame:
        """One INT column for each function."""
        return self.df.select(self.id_col, *(F.get("votes", F.lit(j)).alias(n) for j, n in enumerate(self.names)))

    def long(self) -> DataFrame:
        """(id, j, vote) of the votes that are not abstentions."""
        return self.df.select(self.id_col, F.posexplode("votes").alias("j", "vote")).where("vote >= 0")

    def patterns(self, *by: str) -> DataFrame:
        """How often each combination of votes (and of the columns ``by``) occurs: all that statistics and models need."""
        return self.df.groupBy("votes", *by).agg(F.count(F.lit(1)).alias("n"))

    def faults(self) -> dict[str, int]:
        """How often each function failed, from a plain aggregate over the fault flags; {} if none did."""
        if not self.fault_cols:
            return {}
        row = self.df.agg(*(F.sum(F.col("faults")[j]).alias(f"f{j}") for j in range(self.m))).first()
        return {n: int(row[j]) for j, n in enumerate(self.names) if row[j]}


def apply_lfs(df: DataFrame, lfs: Iterable[LabelingFunction], id_col: str, keep: Iterable[str] = (), fault_tolerant: bool = False) -> VoteFrame:
    """The votes of ``lfs`` on every row, lazily; ``keep`` names columns to carry along.

    A null vote raises unless ``fault_tolerant``; then it, or an exception in a
    Python function, is an abstention and counts as a fault. (An error raised
    inside a column expression stops the query; write such rules with try_*
    functions, whose nulls are faults.)
    """
    lfs, keep = list(lfs), [c for c in keep if c != id_col]
    unique_names([lf.name for lf in lfs])
    plain = [lf for lf in lfs if lf.kind == "column"]
    python = [lf for lf in lfs if lf.kind != "column"]
    work = df
    slot: dict[str, Column] = {}
    if plain:
        mappers = list({id(m): m for lf in plain for m in lf.pre}.values())
        work = apply_mappers(work, mappers)
        for k, lf in enumerate(plain):
            slot[lf.name] = F.col(f"_vote{k}")
        work = work.withColumns({f"_vote{k}": lf.column() for k, lf in enumerate(plain)})
    if python:
        work = _python_votes(work, python, [id_col, *keep, *(f"_vote{k}" for k in range(len(plain)))], fault_tolerant)
        for k, lf in enumerate(python):
            slot[lf.name] = F.get("_python", F.lit(k))
    raw = [slot[lf.name] for lf in lfs]
    if fault_tolerant:
        votes = F.array(*[F.coalesce(v, F.lit(ABSTAIN)) for v in raw])
        faults = F.array(*[v.isNull().cast("int") for v in raw])
        return VoteFrame(work.select(id_col, *keep, votes.alias("votes"), faults.alias("faults")), id_col, [lf.name for lf in lfs], ("faults",))
    strict = [F.coalesce(v, F.raise_error(F.lit(f"labeling function {lf.name} returned no vote")).cast("int")) for v, lf in zip(raw, lfs, strict=True)]
    return VoteFrame(work.select(id_col, *keep, F.array(*strict).alias("votes")), id_col, [lf.name for lf in lfs])


def _python_votes(df: DataFrame, lfs: list[LabelingFunction], carry: list[str], tolerant: bool) -> DataFrame:
    if any(isinstance(m, LambdaMapper) and not m.inputs for lf in lfs for m in chain(lf.pre)):
        inputs = list(df.columns)  # a mapper of whole rows
    else:
        inputs = list(dict.fromkeys(c for lf in lfs for c in [*lf.inputs, *(i for m in chain(lf.pre) for i in m.inputs)] if c in df.columns))
    fields = list(dict.fromkeys([*carry, *inputs]))
    for m in chain(m for lf in lfs for m in lf.pre):
        m.schema()
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("_python", T.ArrayType(T.IntegerType()))])

    def votes_on(pdf):
        columns, mapped = [], {}
        for lf in lfs:
            key = tuple(id(m) for m in lf.pre)
            if key not in mapped:  # functions that share preprocessors share their result
                mapped[key] = map_batch(pdf, lf.pre, tolerant)
            columns.append(_votes_of(lf, mapped[key], tolerant))
        return [list(v) for v in zip(*columns, strict=True)]

    def run(batches):
        for pdf in batches:
            out = pdf[carry].copy()
            out["_python"] = [v for piece in pieces(pdf, inputs) for v in votes_on(piece[inputs])]
            yield out

    return df.select(*fields).mapInPandas(run, schema)


def _votes_of(lf: LabelingFunction, data: pd.DataFrame, tolerant: bool) -> list[int | None]:
    def clean(v):
        return None if v is None or v != v else (int(v) if v >= 0 else ABSTAIN)

    if lf.kind == "pandas":
        try:
            return [clean(v) for v in lf.f(data, **lf.resources)]
        except Exception:
            if not tolerant:
                raise
            if len(data) == 1:
                return [None]
            # row by row, so that what fails does not depend on how rows were batched
            return [v for k in range(len(data)) for v in _votes_of(lf, data.iloc[k : k + 1], tolerant)]
    out = []
    for row in data.itertuples(index=False):
        try:
            out.append(clean(lf.f(row, **lf.resources)))
        except Exception:
            if not tolerant:
                raise
            out.append(None)
    return out


def filter_unlabeled(df: DataFrame, votes: VoteFrame) -> DataFrame:
    """Rows of ``df`` on which at least one function votes.

    Votes that were applied with all columns of ``df`` kept are filtered as they
    stand; else the rows are found by their ids.
    """
    if set(df.columns) <= set(votes.df.columns):
        return votes.df.where(F.exists("votes", lambda v: v != ABSTAIN)).select(*df.columns)
    some = votes.df.where(F.exists("votes", lambda v: v != ABSTAIN)).select(votes.id_col)
    return df.join(some, votes.id_col, "left_semi")
