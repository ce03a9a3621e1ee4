"""Slicing functions: named subsets of rows, their labels, and the slice-aware combination of predictions."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labeling import LabelingFunction, apply_lfs
from .mapping import Mapper, missing_parentheses


class SlicingFunction(LabelingFunction):
    """A labeling function that says whether a row is in the slice: true or positive is in, anything else out."""

    def column(self) -> Column:
        value = self.f(**self.resources)
        value = F.lit(value) if isinstance(value, bool | int) else value
        return F.coalesce((value.cast("int") > 0).cast("int"), F.lit(0))


def slicing_function(name: str | None = None, kind: str = "column", inputs: list[str] | None = None, resources: dict[str, Any] | None = None, pre: list[Mapper] | None = None):
    missing_parentheses(name)
    return lambda f: SlicingFunction(name or f.__name__, f, kind, inputs or [], resources or {}, pre or [])


def apply_sfs(df: DataFrame, sfs: list[SlicingFunction], id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, one INT column named after each slice)."""
    votes = apply_lfs(df, sfs, id_col, keep, fault_tolerant=False)
    return votes.df.select(id_col, *keep, *((F.get("votes", F.lit(j)) > 0).cast("int").alias(n) for j, n in enumerate(votes.names)))


def slice_dataframe(df: DataFrame, sf: SlicingFunction, id_col: str | None = None) -> DataFrame:
    """The rows of ``df`` in the slice."""
    if sf.kind == "column":
        return df.where(sf.column() > 0)
    if id_col is None:
        raise ValueError("a Python slicing function needs the id column")
    if {"votes", "_python"} & set(df.columns):
        return df.join(apply_sfs(df, [sf], id_col).where(F.col(sf.name) > 0).select(id_col), id_col, "left_semi")
    votes = apply_lfs(df, [sf], id_col, df.columns)
    return votes.df.where(F.get("votes", F.lit(0)) > 0).select(*df.columns)


def add_slice_labels(df: DataFrame, task: str, label: str, slices: list[str]) -> DataFrame:
    """``{task}_slice:{s}_ind`` and ``_pred`` columns for "base" and each slice; the prediction label is -1 outside."""
    new = {f"{task}_slice:base_ind": F.lit(1), f"{task}_slice:base_pred": F.col(label)}
    for s in slices:
        inside = F.col(s).cast("int") > 0
        new |= {f"{task}_slice:{s}_ind": inside.cast("int"), f"{task}_slice:{s}_pred": F.when(inside, F.col(label)).otherwise(-1)}
    return df.withColumns(new)


def slice_weights(ind_probs: np.ndarray, pred_probs: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Attention over slices: softmax of P(in slice) * P(positive) / temperature; rows x slices each."""
    a = ind_probs * pred_probs / temperature
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def combine_slices(df: DataFrame, id_col: str, ind: str = "ind", pred: str = "pred", feat: str = "feat", temperature: float = 1.0) -> DataFrame:
    """(id, combined): slice features weighed by attention, one row for each id.

    ``ind`` and ``pred`` hold two logits each; attention is the softmax over an
    id's slices of the product of their positive-class probabilities.
    """
    positive = lambda z: 1 / (1 + F.exp(F.get(z, F.lit(0)) - F.get(z, F.lit(1))))
    binary = F.when((F.size(ind) != 2) | (F.size(pred) != 2), F.raise_error(F.lit("more than 2 classes are not implemented")).cast("double"))
    scored = df.withColumn("_a", F.exp(binary.otherwise(positive(ind) * positive(pred) / temperature)))
    flat = scored.select(id_col, "_a", F.posexplode(feat).alias("_k", "_x"))
    summed = flat.groupBy(id_col, "_k").agg((F.sum(F.col("_a") * F.col("_x")) / F.sum("_a")).alias("_v"))
    return summed.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("combined"))
