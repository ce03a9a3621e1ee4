"""Classification metrics, overall and by slice, and error buckets."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import filter_labels, range_part

logger = logging.getLogger(__name__)

METRICS: dict[str, list[str]] = {
    "accuracy": ["golds", "preds"],
    "coverage": ["preds"],
    "precision": ["golds", "preds"],
    "recall": ["golds", "preds"],
    "f1": ["golds", "preds"],
    "f1_micro": ["golds", "preds"],
    "f1_macro": ["golds", "preds"],
    "fbeta": ["golds", "preds"],
    "matthews_corrcoef": ["golds", "preds"],
    "roc_auc": ["golds", "probs"],
}


def confusion(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """(gold, pred, n): the one pass over the data that all label metrics need. A null label counts as -1."""
    label = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return df.groupBy(*by, label(gold).alias("gold"), label(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _safe(a, b):
    return a / b if b else 0.0


def from_confusion(cells: list[tuple[int, int, int]], metric: str, **kw: Any) -> float:
    """A metric from (gold, pred, count) cells; 0 where its denominator is 0."""
    total = sum(n for *_, n in cells)
    right = sum(n for g, p, n in cells if g == p)
    labels = sorted({g for g, _, _ in cells} | {p for _, p, _ in cells})
    tp = {c: sum(n for g, p, n in cells if g == p == c) for c in labels}
    fp = {c: sum(n for g, p, n in cells if p == c != g) for c in labels}
    fn = {c: sum(n for g, p, n in cells if g == c != p) for c in labels}
    if metric in ("accuracy", "f1_micro"):
        return _safe(right, total)
    if metric == "coverage":
        return _safe(sum(n for _, p, n in cells if p != -1), total)
    if metric == "f1_macro":
        return _safe(sum(_safe(2 * tp[c], 2 * tp[c] + fp[c] + fn[c]) for c in labels), len(labels))
    if metric == "matthews_corrcoef":
        p = {c: sum(n for _, q, n in cells if q == c) for c in labels}
        t = {c: sum(n for g, _, n in cells if g == c) for c in labels}
        top = right * total - sum(p[c] * t[c] for c in labels)
        below = (total**2 - sum(v * v for v in p.values())) * (total**2 - sum(v * v for v in t.values()))
        return _safe(top, math.sqrt(below))
    if metric in ("precision", "recall", "f1", "fbeta"):
        pos = kw.get("pos_label", 1)
        if max((g for g, _, _ in cells), default=0) > 1:
            raise ValueError(f"{metric} is for binary labels; use f1_macro or f1_micro for more classes")
        a, b, c = tp.get(pos, 0), fp.get(pos, 0), fn.get(pos, 0)
        if metric == "precision":
            return _safe(a, a + b)
        if metric == "recall":
            return _safe(a, a + c)
        if metric == "fbeta" and "beta" not in kw:
            raise ValueError("fbeta needs beta")
        beta2 = 1.0 if metric == "f1" else kw["beta"] ** 2
        return _safe((1 + beta2) * a, (1 + beta2) * a + beta2 * c + b)
    raise ValueError(f"The metric you provided ({metric}) is not supported.")


def roc_auc(df: DataFrame, gold: str, probs: str, *by: str) -> DataFrame:
    """``auc`` (and what ``by`` names): the chance that a positive row has the larger probs[1], ties counting half.

    Rows are counted by score first; ranks come from running sums over the
    distinct scores of a range, with the totals of the ranges before it added,
    so no task sees all scores. Null where a class is missing.
    """
    score = F.when(F.size(probs) == 2, F.get(probs, F.lit(1))).otherwise(F.raise_error(F.lit("roc_auc needs two classes")).cast("double"))
    counts = df.groupBy(*by, score.alias("score")).agg(F.count_if(F.col(gold) == 1).alias("pos"), F.count_if(F.col(gold) != 1).alias("neg"))
    parts = counts.withColumn("part", range_part(df.select(score.alias("score")), "score"))
    sums = parts.groupBy(*by, "part").agg(F.sum("neg").alias("part_neg"))
    over = Window.partitionBy(*by, F.lit(1)).orderBy("part")
    before = sums.select(*by, "part", (F.sum("part_neg").over(over) - F.col("part_neg")).alias("before"))  # a row for each range
    within = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = parts.withColumn("below", F.sum("neg").over(within) - F.col("neg")).join(before, [*by, "part"])
    won = F.sum(F.col("pos") * (F.col("before") + F.col("below") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def metric_score(df: DataFrame, metric: str, gold: str | None = None, pred: str | None = None, probs: str | None = None, filters: dict[str, list] | None = None, **kw: Any) -> float:
    """One metric over the rows left by ``filters`` ({column: values to leave out})."""
    if metric not in METRICS:
        raise ValueError(f"The metric you provided ({metric}) is not supported.")
    given = {"golds": gold, "preds": pred, "probs": probs}
    missing = [x for x in METRICS[metric] if given[x] is None]
    if missing:
        raise ValueError(f"The metric you provided ({metric}) requires inputs {missing}")
    filters = dict(filters or {})
    late = {} if metric == "roc_auc" else {c: filters.pop(c) for c in (gold, pred) if c in filters}  # left out of the cells, not of the rows
    df = filter_labels(df, filters)
    if metric == "roc_auc":
        row = roc_auc(df, gold, probs).first()
        return float("nan") if row is None or row.auc is None else row.auc
    cells = [(r.gold, r.pred, r.n) for r in confusion(df.withColumn("_gold", F.col(gold) if gold else F.lit(0)), "_gold", pred).collect()]
    cells = [c for c in cells if c[0] not in late.get(gold, ()) and c[1] not in late.get(pred, ())]
    return float(from_confusion(cells, metric, **kw))


class Scorer:
    """Several metrics at once. Rows whose gold or prediction abstains are left out, but for coverage and custom functions.

    ``custom_metric_funcs``: name -> function of the unfiltered frame and the
    names of its gold, pred and probs columns, returning a number or a dict.
    """

    def __init__(self, metrics: list[str] | None = None, custom_metric_funcs: dict[str, Callable] | None = None, abstain_label: int | None = -1, metric_kwargs: dict[str, dict] | None = None):
        self.metrics = list(metrics or [])
        for m in self.metrics:
            if m not in METRICS:
                raise ValueError(f"Unrecognized metric {m!r}; known are {sorted(METRICS)}")
        self.custom, self.abstain, self.kwargs = custom_metric_funcs or {}, abstain_label, metric_kwargs or {}

    def score(self, df: DataFrame, gold: str, pred: str | None = None, probs: str | None = None) -> dict[str, float]:
        if df.isEmpty():
            raise ValueError("there are no rows to score: the table is empty")
        out: dict[str, float] = {}
        filters = {} if self.abstain is None else {c: [self.abstain] for c in (gold, pred) if c}
        cells = None
        for m in self.metrics:
            if m == "roc_auc" or pred is None:
                out[m] = metric_score(df, m, gold, pred, probs, filters, **self.kwargs.get(m, {}))
                continue
            if cells is None:
                cells = self._from_cells([(r.gold, r.pred, r.n) for r in confusion(df, gold, pred).collect()])
            out[m] = cells[m]
        for name, f in self.custom.items():
            value = f(df, gold, pred, probs)
            out.update(value if isinstance(value, dict) else {name: value})
        return out

    def score_slices(self, df: DataFrame, slices: list[str], gold: str, pred: str | None = None, probs: str | None = None) -> dict[str, dict[str, float]]:
        """The metrics of all rows ("overall") and of each slice (a column that is 1 or true on its rows)."""
        unknown = [s for s in slices if s not in df.columns]
        if unknown:
            raise ValueError(f"slices are no columns: {unknown}")
        if pred is None or "roc_auc" in self.metrics or self.custom:
            return {"overall": self.score(df, gold, pred, probs), **{s: self.score(df.where(F.col(s).cast("int") > 0), gold, pred, probs) for s in slices}}
        member = F.array(F.lit(""), *[F.when(F.col(s).cast("int") > 0, F.lit(s)) for s in slices])
        each = df.select(F.explode(F.array_compact(member)).alias("_slice"), gold, pred)
        cells: dict[str, list] = {s: [] for s in ["", *slices]}
        for r in confusion(each, gold, pred, "_slice").collect():
            cells[r["_slice"]].append((r.gold, r.pred, r.n))
        return {s or "overall": self._from_cells(c) for s, c in cells.items()}

    def _from_cells(self, cells: list[tuple[int, int, int]]) -> dict[str, float]:
        if not cells:
            raise ValueError("there is nothing to score")
        known = cells if self.abstain is None else [c for c in cells if self.abstain not in c[:2]]
        return {m: float(from_confusion(cells if m == "coverage" else known, m, **self.kwargs.get(m, {}))) for m in self.metrics if m != "roc_auc"}

    def score_arrays(self, golds: np.ndarray, preds: np.ndarray, probs: np.ndarray | None = None) -> dict[str, float]:
        """The metrics of arrays on the driver; custom functions, which take frames, are left out."""
        golds, preds = np.asarray(golds, int), np.asarray(preds, int)
        pairs, counts = np.unique(np.stack([golds, preds], 1), axis=0, return_counts=True)
        cells = [(int(g), int(p), int(n)) for (g, p), n in zip(pairs, counts, strict=True)]
        out = self._from_cells(cells)
        if "roc_auc" in self.metrics:
            known = np.ones(len(golds), bool) if self.abstain is None else (golds != self.abstain) & (preds != self.abstain)
            out["roc_auc"] = array_auc(golds[known] == 1, np.asarray(probs)[known, 1])
        return {m: out[m] for m in self.metrics}


def array_auc(positive: np.ndarray, scores: np.ndarray) -> float:
    """The chance that a positive has the larger score, ties counting half; NaN where a class is missing."""
    _, place, counts = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[place]
    n = int(positive.sum())
    m = len(positive) - n
    return float((rank[positive].sum() - n * (n + 1) / 2) / (n * m)) if n and m else float("nan")


def slice_metrics(df: DataFrame, slices: list[str], gold: str, pred: str, abstain: int = -1) -> DataFrame:
    """slice, n, accuracy, precision, recall, f1, coverage of "overall" and each slice, in one aggregate without joins."""
    member = F.array(F.lit("overall"), *[F.when(F.col(s).cast("int") > 0, F.lit(s)) for s in slices])
    each = df.select(F.explode(F.filter(member, lambda s: s.isNotNull())).alias("slice"), F.col(gold).alias("g"), F.col(pred).alias("p"))
    used = (F.col("g") != abstain) & (F.col("p") != abstain)
    g, p = F.col("g"), F.col("p")
    c = each.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(used).alias("used"), F.count_if(p != abstain).alias("covered"), F.count_if(used & (g == p)).alias("right"),
        F.count_if(used & (g == 1) & (p == 1)).alias("tp"), F.count_if(used & (g != 1) & (p == 1)).alias("fp"), F.count_if(used & (g == 1) & (p != 1)).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("slice", "n", ratio(F.col("right"), F.col("used")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("covered"), F.col("n")).alias("coverage"))


def label_bucket_rows(df: DataFrame, id_col: str, *labels: str) -> DataFrame:
    """(labels, id) of each row: the buckets as a table, whatever their size; a projection."""
    if not labels:
        raise ValueError("at least one label column is needed")
    return df.select(*labels, id_col)


def bucket_sizes(df: DataFrame, *labels: str) -> DataFrame:
    """(labels, n) of each combination of labels that occurs."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def get_label_buckets(df: DataFrame, id_col: str, *labels: str) -> DataFrame:
    """A row for each combination of labels that occurs, with its ids in order.

    A bucket's ids are one value of one row, which is for buckets that fit in
    memory; ``label_bucket_rows`` has no such bound.
    """
    if not labels:
        raise ValueError("at least one label column is needed")
    return df.groupBy(*labels).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def get_label_instances(df: DataFrame, bucket: tuple[int, ...], *labels: str) -> DataFrame:
    """The rows whose labels are those of ``bucket``; none, and a warning, if it does not occur."""
    if len(bucket) != len(labels):
        raise ValueError("The bucket and the label columns must be equally many.")
    found = df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(labels, bucket, strict=True)]))
    if found.isEmpty():
        logger.warning("no row has the labels %s", bucket)
    return found
