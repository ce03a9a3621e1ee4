"""Settings of trainers and models, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class SGDOptimizerConfig:
    momentum: float = 0.9


@dataclass(frozen=True)
class AdamOptimizerConfig:
    amsgrad: bool = False
    betas: tuple[float, float] = (0.9, 0.999)


@dataclass(frozen=True)
class AdamaxOptimizerConfig:
    eps: float = 1e-8
    betas: tuple[float, float] = (0.9, 0.999)


@dataclass(frozen=True)
class OptimizerConfig:
    sgd_config: SGDOptimizerConfig = field(default_factory=SGDOptimizerConfig)
    adam_config: AdamOptimizerConfig = field(default_factory=AdamOptimizerConfig)
    adamax_config: AdamaxOptimizerConfig = field(default_factory=AdamaxOptimizerConfig)


@dataclass(frozen=True)
class ExponentialLRSchedulerConfig:
    gamma: float = 0.9


@dataclass(frozen=True)
class StepLRSchedulerConfig:
    gamma: float = 0.9
    step_size: int = 5


@dataclass(frozen=True)
class LRSchedulerConfig:
    warmup_steps: float = 0
    warmup_unit: str = "batches"
    warmup_percentage: float = 0.0
    min_lr: float = 0.0
    exponential_config: ExponentialLRSchedulerConfig = field(default_factory=ExponentialLRSchedulerConfig)
    step_config: StepLRSchedulerConfig = field(default_factory=StepLRSchedulerConfig)


@dataclass(frozen=True)
class LabelModelTrainConfig:
    n_epochs: int = 100
    lr: float = 0.01
    l2: Any = 0.0
    optimizer: str = "sgd"
    optimizer_config: OptimizerConfig = field(default_factory=OptimizerConfig)
    lr_scheduler: str = "constant"
    lr_scheduler_config: LRSchedulerConfig = field(default_factory=lambda: LRSchedulerConfig(warmup_unit="epochs"))
    prec_init: Any = 0.7
    seed: int = 0
    log_freq: int = 10
    mu_eps: float | None = None


@dataclass(frozen=True)
class LogManagerConfig:
    counter_unit: str = "epochs"
    evaluation_freq: float = 1.0


@dataclass(frozen=True)
class CheckpointerConfig:
    checkpoint_dir: str | None = None
    checkpoint_metric: str = "model/all/train/loss:min"
    checkpoint_factor: int = 1
    checkpoint_task_metrics: tuple[str, ...] = ()
    checkpoint_runway: int = 0
    checkpoint_clear: bool = True


@dataclass(frozen=True)
class LogWriterConfig:
    log_dir: str = "logs"
    run_name: str | None = None


@dataclass(frozen=True)
class TrainerConfig:
    seed: int = 0
    batch_size: int = 64
    n_epochs: int = 1
    grad_clip: float = 1.0
    lr: float = 0.01
    l2: float = 0.0
    valid_split: str = "valid"
    train_split: str = "train"
    test_split: str = "test"
    optimizer: str = "adam"
    optimizer_config: OptimizerConfig = field(default_factory=OptimizerConfig)
    lr_scheduler: str = "constant"
    lr_scheduler_config: LRSchedulerConfig = field(default_factory=LRSchedulerConfig)
    batch_scheduler: str = "shuffled"
    checkpointing: bool = False
    checkpointer_config: CheckpointerConfig = field(default_factory=CheckpointerConfig)
    logging: bool = False
    log_writer: str = "json"
    log_writer_config: LogWriterConfig = field(default_factory=LogWriterConfig)
    log_manager_config: LogManagerConfig = field(default_factory=LogManagerConfig)


def merge_config(config: Any, updates: dict[str, Any]) -> Any:
    """``config`` with values replaced, nested dicts into nested settings; unknown keys raise. Nothing given is changed."""
    known = {f.name for f in fields(config)}
    unknown = set(updates) - known
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    new = {k: merge_config(getattr(config, k), v) if isinstance(v, dict) and is_dataclass(getattr(config, k)) else v for k, v in updates.items()}
    return replace(config, **new)
