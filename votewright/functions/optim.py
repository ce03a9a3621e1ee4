"""Optimisers and learning-rate schedules in numpy, shared by the label model and the trainer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..config import LRSchedulerConfig, OptimizerConfig


class Optimizer:
    """Updates a dict of arrays in place; ``l2`` is added to the gradients as weight decay."""

    def __init__(self, name: str, lr: float, l2: float = 0.0, config: OptimizerConfig | None = None):
        if name not in ("sgd", "adam", "adamax"):
            raise ValueError(f"Unrecognized optimizer option '{name}'")
        self.name, self.lr, self.l2, self.config = name, lr, l2, config or OptimizerConfig()
        self.state: dict[str, dict[str, np.ndarray]] = {}
        self.steps = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in grads.items():
            p = params[k]
            g = g + self.l2 * p if self.l2 else g
            s = self.state.setdefault(k, {})
            p -= getattr(self, f"_{self.name}")(s, g).astype(p.dtype)

    def _sgd(self, s, g):
        s["v"] = self.config.sgd_config.momentum * s["v"] + g if "v" in s else g
        return self.lr * s["v"]

    def _adam(self, s, g):
        a, b = self.config.adam_config.betas
        s["m"] = a * s.get("m", 0) + (1 - a) * g
        s["v"] = b * s.get("v", 0) + (1 - b) * g * g
        v = s["v"]
        if self.config.adam_config.amsgrad:
            v = s["top"] = np.maximum(s.get("top", 0), v)
        return self.lr / (1 - a**self.steps) * s["m"] / (np.sqrt(v / (1 - b**self.steps)) + 1e-8)

    def _adamax(self, s, g):
        c = self.config.adamax_config
        a, b = c.betas
        s["m"] = a * s.get("m", 0) + (1 - a) * g
        s["u"] = np.maximum(b * s.get("u", 0), np.abs(g) + c.eps)
        return self.lr / (1 - a**self.steps) * s["m"] / s["u"]


def lr_schedule(name: str, lr: float, total: int, per_epoch: int, config: LRSchedulerConfig) -> Callable[[int], float]:
    """The learning rate at each step (from 0): warm-up first, then the named schedule, never below min_lr."""
    if name not in ("constant", "linear", "exponential", "step"):
        raise ValueError(f"Unrecognized lr scheduler option '{name}'")
    if config.warmup_unit not in ("batches", "epochs"):
        raise ValueError(f"{config.warmup_unit} is no warmup_unit (batches or epochs)")
    if config.warmup_steps < 0 or config.warmup_percentage < 0 or config.warmup_percentage > 1:
        raise ValueError("warmup_steps and warmup_percentage must not be negative")
    if config.warmup_steps:
        warm = int(config.warmup_steps * (per_epoch if config.warmup_unit == "epochs" else 1))
    else:
        warm = int(config.warmup_percentage * total)

    def at(step: int) -> float:
        if step < warm:
            return lr * (step + 1) / warm
        k = step - warm
        if name == "linear":
            value = lr * max(0.0, 1 - k / max(1, total - warm))
        elif name == "exponential":
            value = lr * config.exponential_config.gamma ** (k // per_epoch)
        elif name == "step":
            value = lr * config.step_config.gamma ** (k // per_epoch // config.step_config.step_size)
        else:
            value = lr
        return max(value, config.min_lr)

    return at
