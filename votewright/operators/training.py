"""The training loop on the driver: batch order, learning rates, logs and checkpoints."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np

from ..config import CheckpointerConfig, LogManagerConfig, LogWriterConfig, TrainerConfig, merge_config
from ..functions.optim import Optimizer, lr_schedule
from ..sources.params import read_params, write_params
from .classification import DictDataset, MultitaskClassifier, batches

logger = logging.getLogger(__name__)


class SequentialScheduler:
    """All batches of one data set after another."""

    def get_batches(self, data: list[DictDataset], size: int, rng: np.random.RandomState) -> Iterator[tuple[Any, DictDataset]]:
        for d in data:
            for b in batches(d, size, rng):
                yield b, d


class ShuffledScheduler:
    """Batches of all data sets in a random order."""

    def get_batches(self, data: list[DictDataset], size: int, rng: np.random.RandomState) -> Iterator[tuple[Any, DictDataset]]:
        sources = [batches(d, size, rng) for d in data]
        turns = np.concatenate([np.full(-(-len(d) // size), k) for k, d in enumerate(data)])
        rng.shuffle(turns)
        for k in turns:
            yield next(sources[k]), data[k]


SCHEDULERS = {"sequential": SequentialScheduler, "shuffled": ShuffledScheduler}


class LogManager:
    """Counts points, batches and epochs, and tells when to evaluate and to checkpoint."""

    def __init__(self, n_batches_per_epoch: int, config: LogManagerConfig | None = None, checkpointer: Checkpointer | None = None, writer: LogWriter | None = None):
        self.config = config or LogManagerConfig()
        if self.config.counter_unit not in ("points", "batches", "epochs"):
            raise ValueError(f"Unrecognized unit: {self.config.counter_unit}")
        self.per_epoch, self.checkpointer, self.writer = n_batches_per_epoch, checkpointer, writer
        self.points = self.batches = 0
        self.since = self.evaluations = 0.0

    @property
    def epochs(self) -> float:
        return self.batches / self.per_epoch

    @property
    def count(self) -> float:
        return {"points": self.points, "batches": self.batches, "epochs": self.epochs}[self.config.counter_unit]

    def update(self, size: int) -> None:
        self.points += size
        self.batches += 1
        self.since += {"points": size, "batches": 1, "epochs": 1 / self.per_epoch}[self.config.counter_unit]

    def trigger_evaluation(self) -> bool:
        if self.since + 1e-9 < self.config.evaluation_freq:
            return False
        self.since = 0.0
        self.evaluations += 1
        return True

    def trigger_checkpointing(self) -> bool:
        return self.checkpointer is not None and self.evaluations % self.checkpointer.config.checkpoint_factor == 0

    def cleanup(self, model: MultitaskClassifier) -> MultitaskClassifier:
        if self.writer is not None:
            self.writer.cleanup()
        if self.checkpointer is None:
            return model
        self.checkpointer.clear()
        return self.checkpointer.load_best_model(model)


class Checkpointer:
    """Keeps the parameters that were best by each metric ("label/dataset/split/metric:min" or ":max")."""

    def __init__(self, config: CheckpointerConfig, evaluation_freq: float = 1.0):
        if evaluation_freq <= 0:
            raise ValueError("checkpoint freq must be greater than 0")
        if config.checkpoint_runway < 0:
            raise ValueError("checkpoint_runway must not be negative")
        self.config = config
        self.metrics = {}
        for text in (config.checkpoint_metric, *config.checkpoint_task_metrics):
            metric, _, mode = text.partition(":")
            if mode not in ("min", "max") or len(metric.split("/")) != 4:
                raise ValueError(f"Unrecognized checkpoint metric: {text}")
            self.metrics[metric] = mode
        self.best: dict[str, float] = {}
        self.folder = Path(config.checkpoint_dir or "checkpoints")
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, metric: str) -> Path:
        return self.folder / f"best_{metric.replace('/', '_')}.json"

    def is_new_best(self, metrics: dict[str, float]) -> set[str]:
        found = set()
        for m, mode in self.metrics.items():
            if m in metrics and (m not in self.best or (metrics[m] < self.best[m] if mode == "min" else metrics[m] > self.best[m])):
                self.best[m] = metrics[m]
                found.add(m)
        return found

    def checkpoint(self, count: float, model: MultitaskClassifier, metrics: dict[str, float]) -> None:
        if count < self.config.checkpoint_runway:
            return
        for m in self.is_new_best(metrics):
            model.save(str(self.path(m)))

    def load_best_model(self, model: MultitaskClassifier) -> MultitaskClassifier:
        metric = next(iter(self.metrics))
        if metric in self.best:
            model.load(str(self.path(metric)))
        else:
            logger.warning("the checkpoint metric %s was never computed; the last parameters stay", metric)
        return model

    def clear(self) -> None:
        """Only the best of the first metric is kept."""
        if self.config.checkpoint_clear:
            for m in list(self.metrics)[1:]:
                self.path(m).unlink(missing_ok=True)


class LogWriter:
    """Scalars by name as [[step, value], ...], written as JSON."""

    def __init__(self, config: LogWriterConfig | None = None):
        c = config or LogWriterConfig()
        self.folder = Path(c.log_dir) / (c.run_name or time.strftime("%Y_%m_%d/%H_%M_%S"))
        self.folder.mkdir(parents=True, exist_ok=True)
        self.scalars: dict[str, list] = {}

    def add_scalar(self, name: str, value, step) -> None:
        self.scalars.setdefault(name, []).append([step, float(value)])

    def write_config(self, config: Any) -> None:
        self.write_text(repr(config), "config.txt")

    def write_text(self, text, filename) -> None:
        (self.folder / filename).write_text(text)

    def write_json(self, value: Any, filename: str) -> None:
        (self.folder / filename).write_text(json.dumps(value))

    def write_log(self, filename: str = "log.json") -> None:
        self.write_json(self.scalars, filename)

    def cleanup(self) -> None:
        self.write_log()


class Trainer:
    """Mini-batch training of a :class:`MultitaskClassifier`."""

    def __init__(self, config: TrainerConfig | None = None, name: str = "trainer", **settings: Any):
        self.config, self.name = merge_config(config or TrainerConfig(), settings), name

    def fit(self, model: MultitaskClassifier, data: list[DictDataset]) -> dict[str, float]:
        """Train on the data sets of the train split; returns the last metrics."""
        c = self.config
        train = [d for d in data if d.split == c.train_split]
        valid = [d for d in data if d.split == c.valid_split]
        if not train:
            raise ValueError(f"no data set has the train_split {c.train_split}: {sorted({d.split for d in data})}")
        if c.batch_scheduler not in SCHEDULERS:
            raise ValueError(f"Unrecognized batch scheduler option '{c.batch_scheduler}'")
        if c.logging and c.log_writer != "json":
            raise ValueError(f"Unrecognized writer option '{c.log_writer}'")
        rng = np.random.RandomState(c.seed)
        per_epoch = sum(-(-len(d) // c.batch_size) for d in train)
        self.optimizer = Optimizer(c.optimizer, c.lr, c.l2, c.optimizer_config)
        rate = lr_schedule(c.lr_scheduler, c.lr, c.n_epochs * per_epoch, per_epoch, c.lr_scheduler_config)
        writer = LogWriter(c.log_writer_config) if c.logging else None
        checkpointer = Checkpointer(c.checkpointer_config, c.log_manager_config.evaluation_freq) if c.checkpointing else None
        log = LogManager(per_epoch, c.log_manager_config, checkpointer, writer)
        if writer:
            writer.write_config(c)
        metrics: dict[str, float] = {}
        totals: dict[str, list[float]] = {}
        params = model.params()
        for _ in range(c.n_epochs):
            for (x, y), d in SCHEDULERS[c.batch_scheduler]().get_batches(train, c.batch_size, rng):
                y = {k: v for k, v in y.items() if k in model.tasks}
                losses, counts, grads = model.calculate_loss(x, y)
                self.optimizer.lr = rate(log.batches)
                if losses:
                    if c.grad_clip:
                        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                        grads = {k: g * min(1.0, c.grad_clip / (norm + 1e-6)) for k, g in grads.items()}
                    self.optimizer.step(params, grads)
                for t, loss in losses.items():
                    total = totals.setdefault(f"{t}/{d.name}/{d.split}", [0.0, 0])
                    total[0] += loss * counts[t]
                    total[1] += counts[t]
                log.update(len(next(iter(x.values()))))
                if log.trigger_evaluation():
                    metrics = self._metrics(totals) | self._evaluate(model, valid)
                    totals = {}
                    for k, v in metrics.items():
                        logger.info("%s=%.4f", k, v)
                        if writer:
                            writer.add_scalar(k, v, log.count)
                    if log.trigger_checkpointing():
                        checkpointer.checkpoint(log.count, model, metrics)
        log.cleanup(model)
        return metrics

    def _metrics(self, totals: dict[str, list[float]]) -> dict[str, float]:
        out = {f"{k}/loss": s / n for k, (s, n) in totals.items() if n}
        n = sum(t[1] for t in totals.values())
        out[f"model/all/{self.config.train_split}/loss"] = sum(t[0] for t in totals.values()) / n if n else 0.0
        out[f"model/all/{self.config.train_split}/lr"] = self.optimizer.lr
        return out

    def _evaluate(self, model: MultitaskClassifier, valid: list[DictDataset]) -> dict[str, float]:
        """The metrics of each task's scorer, and its loss."""
        out = {}
        for d in valid:
            y = {k: v for k, v in d.y.items() if k in model.tasks}
            logits = model.logits(d.x, y)
            for t, labels in y.items():
                task, at = model.tasks[t], f"{t}/{d.name}/{d.split}"
                active = (labels != -1) if labels.ndim == 1 else ~(labels == -1).any(axis=1)
                if active.any():
                    out[f"{at}/loss"] = task.loss_func(logits[t][active], labels[active])[0]
                probs = task.output_func(logits[t])
                golds = labels if labels.ndim == 1 else labels.argmax(axis=1)
                out |= {f"{at}/{m}": v for m, v in task.scorer.score_arrays(golds, probs.argmax(axis=1), probs).items()}
        return out

    def save(self, path: str) -> None:
        """Settings as text and the optimiser's state."""
        state = {k: {n: np.asarray(v).tolist() for n, v in s.items()} for k, s in self.optimizer.state.items()}
        write_params(path, {"config": repr(self.config), "steps": self.optimizer.steps, "state": state})

    def load(self, path: str) -> None:
        found = read_params(path)
        self.optimizer = Optimizer(self.config.optimizer, self.config.lr, self.config.l2, self.config.optimizer_config)
        self.optimizer.steps = found["steps"]
        self.optimizer.state = {k: {n: np.asarray(v) for n, v in s.items()} for k, s in found["state"].items()}
