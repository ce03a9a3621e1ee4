"""Multi-task classifiers in numpy: op graphs of linear and MLP modules, trained on the driver, applied in Arrow batches.

A network is small; the rows it is trained on are a bounded sample
(``max_rows``), and inference and scoring run over whole tables in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import probs_to_preds
from ..sources.params import read_params, write_params
from .metrics import Scorer

Outputs = dict[str, Any]


class Linear:
    """x @ w + b."""

    def __init__(self, n_in: int, n_out: int, seed: int = 0):
        rng = np.random.RandomState(seed)
        bound = 1 / np.sqrt(n_in)
        self.params = {"w": rng.uniform(-bound, bound, (n_in, n_out)), "b": rng.uniform(-bound, bound, n_out)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, Any]:
        return x @ self.params["w"] + self.params["b"], x

    def backward(self, kept: Any, grad: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return grad @ self.params["w"].T, {"w": kept.T @ grad, "b": grad.sum(axis=0)}


class MLP:
    """Linear layers with ReLU between them."""

    def __init__(self, sizes: Sequence[int], seed: int = 0, last_relu: bool = False):
        self.layers = [Linear(a, b, seed + k) for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))]
        self.last_relu = last_relu
        self.params = {f"{k}.{n}": p for k, layer in enumerate(self.layers) for n, p in layer.params.items()}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, Any]:
        kept = []
        for k, layer in enumerate(self.layers):
            x, inner = layer.forward(x)
            relu = k + 1 < len(self.layers) or self.last_relu
            kept.append((inner, x > 0 if relu else None))
            x = np.maximum(x, 0) if relu else x
        return x, kept

    def backward(self, kept: Any, grad: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        grads = {}
        for k in range(len(self.layers) - 1, -1, -1):
            inner, on = kept[k]
            grad = grad * on if on is not None else grad
            grad, g = self.layers[k].backward(inner, grad)
            grads.update({f"{k}.{n}": v for n, v in g.items()})
        return grad, grads


@dataclass
class Operation:
    """A module applied to the output of another operation (its name) or to an input field ("_input_", field)."""

    module_name: str
    inputs: str | tuple[str, str]
    name: str = ""

    def __post_init__(self) -> None:
        self.name = self.name or self.module_name


def cross_entropy(logits: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and its gradient; labels may be classes or probabilities."""
    z = logits - logits.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    target = labels if labels.ndim == 2 else np.eye(logits.shape[1])[labels]
    return float(-(target * logp).sum() / len(logits)), (np.exp(logp) * target.sum(axis=1, keepdims=True) - target) / len(logits)


def class_probs(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Task:
    """A name, its modules, its operations in order, its loss, output and scorer."""

    name: str
    module_pool: dict[str, Any]
    op_sequence: list[Operation]
    scorer: Scorer = field(default_factory=lambda: Scorer(["accuracy"]))
    loss_func: Callable = cross_entropy
    output_func: Callable = class_probs


class MultitaskClassifier:
    """Tasks that share modules by name; an operation that tasks share is run once for a batch."""

    def __init__(self, tasks: list[Task], name: str = "MultitaskClassifier"):
        self.name = name
        self.tasks: dict[str, Task] = {}
        self.module_pool: dict[str, Any] = {}
        for each in tasks:
            self.add_task(each)

    def add_task(self, task) -> None:
        """A further task; its modules are those of the same name that are there already."""
        if type(task).__name__ != "Task":
            raise ValueError(f"not a task: {task!r}")
        if task.name in self.tasks:
            raise ValueError(f"duplicate task name: {task.name}")
        for k, module in task.module_pool.items():
            self.module_pool.setdefault(k, module)
        task.module_pool = {k: self.module_pool[k] for k in task.module_pool}
        self.tasks[task.name] = task

    def params(self) -> dict[str, np.ndarray]:
        return {f"{m}/{n}": p for m, module in self.module_pool.items() for n, p in module.params.items()}

    def forward(self, x: dict[str, np.ndarray], tasks: Iterable[str]) -> tuple[Outputs, Outputs]:
        """Outputs of all operations of the tasks, and what their gradients need."""
        out: Outputs = {("_input_", k): v for k, v in x.items()}
        kept: Outputs = {}
        for t in tasks:
            for op in self.tasks[t].op_sequence:
                if op.name in out:
                    continue
                try:
                    out[op.name], kept[op.name] = self.module_pool[op.module_name].forward(out[op.inputs])
                except Exception as e:
                    raise ValueError(f"operation {op.name} failed: {e!r}") from e
        return out, kept

    def calculate_loss(self, x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> tuple[dict[str, float], dict[str, int], dict[str, np.ndarray]]:
        """Loss and count of each task over its active rows (label not -1), and gradients of the summed loss."""
        out, kept = self.forward(x, y)
        grads_out: Outputs = {}
        losses, counts = {}, {}
        for t, labels in y.items():
            active = (labels != -1) if labels.ndim == 1 else ~(labels == -1).any(axis=1)
            if not active.any():
                continue
            last = self.tasks[t].op_sequence[-1].name
            losses[t], g = self.tasks[t].loss_func(out[last][active], labels[active])
            counts[t] = int(active.sum())
            full = np.zeros_like(out[last])
            full[active] = g
            grads_out[last] = grads_out.get(last, 0) + full
        grads = {k: np.zeros_like(p) for k, p in self.params().items()}
        order = list(dict.fromkeys(op.name for t in y for op in self.tasks[t].op_sequence))
        ops = {op.name: op for t in y for op in self.tasks[t].op_sequence}
        for name in reversed(order):
            if name in grads_out:
                op = ops[name]
                back, g = self.module_pool[op.module_name].backward(kept[name], grads_out[name])
                for k, v in g.items():
                    grads[f"{op.module_name}/{k}"] += v
                if isinstance(op.inputs, str):
                    grads_out[op.inputs] = grads_out.get(op.inputs, 0) + back
        return losses, counts, grads

    def logits(self, x: dict[str, np.ndarray], tasks: Iterable[str] | None = None) -> dict[str, np.ndarray]:
        """What each task's last operation gives."""
        tasks = list(tasks or self.tasks)
        out, _ = self.forward(x, tasks)
        return {t: out[self.tasks[t].op_sequence[-1].name] for t in tasks}

    def probs(self, x: dict[str, np.ndarray], tasks: Iterable[str] | None = None) -> dict[str, np.ndarray]:
        return {t: self.tasks[t].output_func(z) for t, z in self.logits(x, tasks).items()}

    def predict(self, df: DataFrame, features: dict[str, str], id_col: str, keep: Sequence[str] = ()) -> DataFrame:
        """(id, kept columns, ``{task}_probs``, ``{task}_pred``); ``features``: input field -> array or number column."""
        tasks, keep = list(self.tasks), [c for c in keep if c != id_col]
        carry = list(dict.fromkeys([id_col, *keep]))
        cols = list(dict.fromkeys([*carry, *features.values()]))
        schema = T.StructType([*(df.schema[c] for c in carry), *(T.StructField(f"{t}_probs", T.ArrayType(T.DoubleType())) for t in tasks)])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pdf[carry].copy()
                p = self.probs({k: matrix(pdf[c]) for k, c in features.items()}) if len(pdf) else {t: [] for t in tasks}
                for t in tasks:
                    out[f"{t}_probs"] = list(map(list, p[t]))
                yield out

        scored = df.select(*cols).mapInPandas(run, schema)
        return scored.withColumns({f"{t}_pred": probs_to_preds(f"{t}_probs", "random", id_col) for t in tasks})

    def score(self, df: DataFrame, features: dict[str, str], id_col: str, labels: dict[str, str | None], dataset: str = "data", split: str = "test") -> dict[str, float]:
        """{label/dataset/split/metric: value}. ``labels``: label column -> task (None: not scored)."""
        used = {c: t for c, t in labels.items() if t is not None}
        p = self.predict(df, features, id_col, keep=list(used))
        out = {}
        for c, t in used.items():
            for metric, value in self.tasks[t].scorer.score(p, c, f"{t}_pred", f"{t}_probs").items():
                out[f"{c}/{dataset}/{split}/{metric}"] = value
        return out

    def save(self, path: str) -> None:
        write_params(path, {k: v.tolist() for k, v in self.params().items()})

    def load(self, path: str) -> None:
        have = self.params()
        for k, v in read_params(path).items():
            have[k][...] = np.asarray(v)


def labels_to_tasks(labels: Iterable[str], tasks: Iterable[str], remap: dict[str, str | None] | None = None) -> dict[str, str]:
    """Which task each label belongs to: its own name unless remapped; None removes it."""
    found = {}
    for label in labels:
        task = (remap or {}).get(label, label) if label in (remap or {}) else label
        if task is None:
            continue
        if task not in set(tasks):
            raise ValueError(f"label {label} has no task {task}")
        found[label] = task
    return found


def matrix(column: pd.Series) -> np.ndarray:
    first = column.iloc[0] if len(column) else 0.0
    return np.stack(column.to_list()).astype(float) if np.ndim(first) else column.to_numpy(float)[:, None]


@dataclass
class DictDataset:
    """Named fields and labels of equally many rows, with a name and a split."""

    name: str
    split: str
    x: dict[str, np.ndarray]
    y: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        for k, v in self.y.items():
            if not isinstance(v, np.ndarray):
                raise ValueError(f"Label {k} should be an array, not {type(v)}.")
        if len({len(v) for v in [*self.x.values(), *self.y.values()]}) > 1:
            raise ValueError("fields and labels differ in length")

    def __len__(self) -> int:
        return len(next(iter(self.x.values())))

    @classmethod
    def from_frame(cls, df: DataFrame, split: str, features: dict[str, str], labels: dict[str, str], id_col: str, max_rows: int = 100_000, name: str = "data") -> DictDataset:
        """At most ``max_rows`` rows, chosen by a hash of the id."""
        cols = list(dict.fromkeys([id_col, *features.values(), *labels.values()]))
        key = F.xxhash64(F.col(id_col).cast("string"))
        pdf = df.select(*cols).orderBy(key, id_col).limit(max_rows).toPandas()
        return cls(name, split, {k: matrix(pdf[c]) for k, c in features.items()}, {k: pdf[c].to_numpy(int) for k, c in labels.items()})


def batches(data: DictDataset, size: int, rng: np.random.RandomState | None = None) -> Iterator[tuple[dict, dict]]:
    order = rng.permutation(len(data)) if rng is not None else np.arange(len(data))
    for i in range(0, len(data), size):
        rows = order[i : i + size]
        yield {k: v[rows] for k, v in data.x.items()}, {k: v[rows] for k, v in data.y.items()}


def pad_batch(rows: list[Sequence[float]], max_len: int = 0, pad_value: float = 0, left: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows as a matrix, cut to ``max_len`` if that is given, and a mask of the padding."""
    width = max(map(len, rows), default=0)
    width = min(width, max_len) if max_len else width
    out = np.full((len(rows), width), pad_value, dtype=float)
    for k, row in enumerate(rows):
        row = list(row)[:width]
        if len(row):
            out[k, slice(width - len(row), width) if left else slice(0, len(row))] = row
    return out, (out == pad_value).astype(int)


def metrics_to_frame(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    """label, dataset, split, metric, score."""
    return spark.createDataFrame([(*k.split("/"), float(v)) for k, v in metrics.items()], "label string, dataset string, split string, metric string, score double")


def flow_outputs(outputs: dict[str, Any], suffix: str) -> list[Any]:
    """Outputs whose name ends with ``suffix``, in order of their names."""
    return [outputs[k] for k in sorted(k for k in outputs if isinstance(k, str) and k.endswith(suffix))]


class SliceCombiner:
    """Softmax attention over slices by P(in slice) * P(positive); a weighted sum of the slices' features."""

    def __init__(self, temperature: float = 1.0):
        self.params: dict[str, np.ndarray] = {}
        self.temperature = temperature

    def forward(self, x: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, Any]:
        if any(i.shape[1] != 2 or p.shape[1] != 2 for i, p, _ in x):
            raise NotImplementedError("more than 2 classes are not implemented")
        inside, positive = (np.stack([class_probs(z[j])[:, 1] for z in x], axis=1) for j in (0, 1))
        attention = class_probs(inside * positive / self.temperature)
        return sum(attention[:, k : k + 1] * f for k, (_, _, f) in enumerate(x)), (attention, inside, positive, [f for _, _, f in x])

    def backward(self, kept: Any, grad: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], dict[str, np.ndarray]]:
        """Gradients of each slice's membership logits, prediction logits and features."""
        attention, inside, positive, features = kept
        gain = np.stack([(grad * f).sum(axis=1) for f in features], axis=1)
        score = attention * (gain - (attention * gain).sum(axis=1, keepdims=True)) / self.temperature
        two = lambda g: np.stack([-g, g], axis=1)
        back = []
        for k in range(attention.shape[1]):
            i, p = inside[:, k], positive[:, k]
            back.append((two(score[:, k] * p * i * (1 - i)), two(score[:, k] * i * p * (1 - p)), attention[:, k : k + 1] * grad))
        return back, {}


def with_base(slices: Iterable[str]) -> list[str]:
    return ["base", *(s for s in slices if s != "base")]


def convert_to_slice_tasks(task: Task, slices: list[str], size: int = 8, seed: int = 0) -> list[Task]:
    """The tasks of a slice-aware version of a binary ``task`` whose last operation is a linear head.

    For "base" and each slice there is a membership task ``{task}_slice:{slice}_ind``
    and a prediction task ``..._pred`` over a transform of ``size`` features, with
    one prediction head for all; the last task, of the task's own name, combines
    the slices' features by attention. All share what precedes the head.
    """
    *entry, head = task.op_sequence
    weights = task.module_pool[head.module_name].params["w"]
    if weights.shape[1] != 2:
        raise NotImplementedError("more than 2 classes are not implemented")
    if len(set(slices)) != len(slices):
        raise ValueError(f"slice names are not unique: {slices}")
    body = {op.module_name: task.module_pool[op.module_name] for op in entry}
    at, width = entry[-1].name, weights.shape[0]
    shared, tasks = Linear(size, 2, seed + 77), []
    for k, s in enumerate(with_base(slices)):
        ind, pred = f"{task.name}_slice:{s}_ind", f"{task.name}_slice:{s}_pred"
        tasks.append(Task(ind, {**body, f"{ind}_head": Linear(width, 2, seed + k)}, [*entry, Operation(f"{ind}_head", at)], Scorer(["f1"])))
        ops = [*entry, Operation(f"{pred}_transform", at), Operation("pred_head", f"{pred}_transform", f"{pred}_head")]
        tasks.append(Task(pred, {**body, f"{pred}_transform": MLP([width, size], seed + 100 + k, last_relu=True), "pred_head": shared}, ops, task.scorer))
    ops = [op for t in tasks for op in t.op_sequence]
    own = [*{o.name: o for o in ops}.values(), Operation("combiner", "_slices_"), Operation("master_head", "combiner", f"{task.name}_master")]
    return [*tasks, Task(task.name, {"combiner": SliceCombiner(), "master_head": Linear(size, 2, seed + 78)}, own, task.scorer)]


class SliceAwareClassifier(MultitaskClassifier):
    """A base task with a membership and a prediction head for "base" and each slice, and a combiner of their features.

    Task names are ``{task}_slice:{slice}_ind`` and ``_pred``, and the base
    task's own for the combined prediction. Prediction heads share one layer.
    """

    def __init__(self, base: str, body: Any, width: int, slices: list[str], size: int = 8, field_name: str = "x", scorer: Scorer | None = None, seed: int = 0):
        self.base, self.slices = base, with_base(slices)
        plain = Task(base, {"body": body, "head": Linear(width, 2, seed)}, [Operation("body", ("_input_", field_name)), Operation("head", "body")], scorer or Scorer(["accuracy"]))
        super().__init__(convert_to_slice_tasks(plain, slices, size, seed), "SliceAwareClassifier")

    def _parts(self) -> list[tuple[str, str, str]]:
        b = f"{self.base}_slice:"
        return [(f"{b}{s}_ind_head", f"{b}{s}_pred_head", f"{b}{s}_pred_transform") for s in self.slices]

    def forward(self, x: dict[str, np.ndarray], tasks: Iterable[str]) -> tuple[Outputs, Outputs]:
        tasks = list(tasks)
        heads = [t for t in self.tasks if t != self.base] if self.base in tasks else [t for t in tasks if t != self.base]
        out, kept = super().forward(x, heads)
        if self.base in tasks:
            out["combiner"], kept["combiner"] = self.module_pool["combiner"].forward([(out[i], out[p], out[f]) for i, p, f in self._parts()])
            out[f"{self.base}_master"], kept[f"{self.base}_master"] = self.module_pool["master_head"].forward(out["combiner"])
        return out, kept

    def calculate_loss(self, x, y):
        rest = {t: v for t, v in y.items() if t != self.base}
        losses, counts, grads = super().calculate_loss(x, rest) if rest else ({}, {}, {k: np.zeros_like(p) for k, p in self.params().items()})
        labels = y.get(self.base)
        if labels is None or not (labels != -1).any():
            return losses, counts, grads
        out, kept = self.forward(x, [self.base])
        active = labels != -1
        master = f"{self.base}_master"
        losses[self.base], g = cross_entropy(out[master][active], labels[active])
        counts[self.base] = int(active.sum())
        full = np.zeros_like(out[master])
        full[active] = g
        back, own = self.module_pool["master_head"].backward(kept[master], full)
        for k, v in own.items():
            grads[f"master_head/{k}"] += v

        def through(module: str, op: str, grad: np.ndarray) -> np.ndarray:
            down, own = self.module_pool[module].backward(kept[op], grad)
            for k, v in own.items():
                grads[f"{module}/{k}"] += v
            return down

        slices, _ = self.module_pool["combiner"].backward(kept["combiner"], back)
        for (i, p, f), (of_ind, of_pred, of_feature) in zip(self._parts(), slices, strict=True):
            down = through(f, f, of_feature + through("pred_head", p, of_pred))
            through("body", "body", down + through(i, i, of_ind))
        return losses, counts, grads

    def score_slices(self, df: DataFrame, features: dict[str, str], id_col: str, label_cols: Iterable[str]) -> dict[str, float]:
        """The combined prediction scored against every ``*_pred`` label column; membership labels are left out."""
        labels = {c: self.base if c.endswith("_pred") or c == self.base else None for c in label_cols}
        return self.score(df, features, id_col, labels)


def demo_scores(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """Two tasks over the embedding table, trained on a bounded sample of ids not divisible by 4; the whole table is scored, by split."""
    from ..config import TrainerConfig
    from .training import Trainer

    frame = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("parity"), (F.col("embedding")[0] > 0).cast("int").alias("sign"))
    train = DictDataset.from_frame(frame.where("vec_id % 4 <> 0"), "train", {"x": "x"}, {"parity": "parity", "sign": "sign"}, "vec_id", 20_000)
    body = MLP([train.x["x"].shape[1], 16], seed=1, last_relu=True)
    tasks = [Task(n, {"body": body, f"{n}_head": Linear(16, 2, seed=k)}, [Operation("body", ("_input_", "x")), Operation(f"{n}_head", "body")]) for k, n in enumerate(("parity", "sign"))]
    model = MultitaskClassifier(tasks)
    Trainer(TrainerConfig(n_epochs=10, lr=0.01)).fit(model, [train])
    scored = model.predict(frame, {"x": "x"}, "vec_id", keep=["parity", "sign"])
    split = scored.withColumns({"train": (F.col("vec_id") % 4 != 0).cast("int"), "valid": (F.col("vec_id") % 4 == 0).cast("int")})
    found = {t: Scorer(["accuracy"]).score_slices(split, ["train", "valid"], t, f"{t}_pred") for t in ("parity", "sign")}
    scores = {f"{t}/embeddings/{s}/{m}": v for t, by in found.items() for s, each in by.items() if s != "overall" for m, v in each.items()}
    return metrics_to_frame(spark, scores)
