"""Models that turn votes into probabilities: voters, and the generative label model.

Fitting needs counts of vote patterns (or of pairs of votes) alone; the solver
runs on the driver over arrays of (functions * classes) squared. Scoring is a
projection.
"""

from __future__ import annotations

import logging
from itertools import permutations
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LabelModelTrainConfig, merge_config
from ..functions.labels import bound, probs_to_preds, softmax, uniform
from ..functions.optim import Optimizer, lr_schedule
from ..sources.params import read_params, write_params
from .labeling import VoteFrame
from .metrics import Scorer

logger = logging.getLogger(__name__)

#: With more distinct vote patterns than this, pairs of votes are counted in Spark instead.
MAX_PATTERNS = 200_000


class BaseLabeler:
    """``proba`` gives the column of class probabilities; the rest follows from it."""

    def __init__(self, cardinality: int = 2):
        self.cardinality = cardinality

    def proba(self, votes: VoteFrame) -> Column:
        raise NotImplementedError

    def predict_proba(self, votes: VoteFrame) -> DataFrame:
        """The votes' frame with ``probs``."""
        return votes.df.withColumn("probs", self.proba(votes))

    def predict(self, votes: VoteFrame, tie_break_policy: str = "abstain", index: str | None = None, return_probs: bool = False) -> DataFrame:
        """The votes' frame with ``pred`` (and ``probs``); ``index`` stands for the row in random tie breaks, by default the id."""
        out = self.predict_proba(votes).withColumn("pred", probs_to_preds("probs", tie_break_policy, index or votes.id_col))
        return out if return_probs else out.drop("probs")

    def score(self, votes: VoteFrame, gold: str, metrics: list[str] | None = None, tie_break_policy: str = "abstain") -> dict[str, float]:
        """Metrics of the predictions against the column ``gold`` kept in the votes' frame."""
        scored = self.predict(votes, tie_break_policy, return_probs=True)
        return Scorer(metrics or ["accuracy"]).score(scored, gold, "pred", "probs")

    def state(self) -> dict[str, Any]:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}

    def save(self, path: str) -> None:
        """Parameters as JSON."""
        write_params(path, {"class": type(self).__name__, **self.state()})

    def load(self, path: str) -> BaseLabeler:
        found = read_params(path)
        if found.pop("class") != type(self).__name__:
            raise ValueError(f"{path} holds another kind of model")
        for k, v in found.items():
            setattr(self, k, np.array(v) if isinstance(v, list) else v)
        return self


class RandomVoter(BaseLabeler):
    """Random probabilities, fixed by the seed and the row's id."""

    def __init__(self, cardinality: int = 2, seed: int = 0):
        super().__init__(cardinality)
        self.seed = seed

    def proba(self, votes: VoteFrame) -> Column:
        draws = F.array(*[uniform(self.seed, F.col(votes.id_col).cast("string"), c) for c in range(self.cardinality)])
        total = lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
        return bound(draws, lambda d: bound(total(d), lambda t: F.transform(d, lambda x: x / t)))


class MajorityClassVoter(BaseLabeler):
    """The most frequent class of a given balance, whatever the votes; equals share."""

    balance: Any = None

    def fit(self, balance: list[float]) -> MajorityClassVoter:
        self.balance = np.asarray(balance, dtype=float)
        self.cardinality = len(self.balance)
        return self

    def proba(self, votes: VoteFrame) -> Column:
        top = np.asarray(self.balance) == np.max(self.balance)
        return F.array(*[F.lit(float(x)) for x in top / top.sum()])


class MajorityLabelVoter(BaseLabeler):
    """The class with most votes on the row; equals share, and without votes all classes do."""

    def proba(self, votes: VoteFrame) -> Column:
        k = self.cardinality
        beyond = F.raise_error(F.lit(f"a vote is not below the cardinality {k}")).cast("array<double>")

        def shared(counts: Column, top: Column) -> Column:
            share = F.size(F.filter(counts, lambda x: x == top))
            return bound(F.lit(1.0) / share, lambda each: F.transform(counts, lambda x: F.when(x == top, each).otherwise(0.0)))

        def of(votes: Column) -> Column:
            counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.size(F.filter(votes, lambda v: v == c)))
            probs = bound(counts, lambda n: bound(F.array_max(n), lambda top: shared(n, top)))
            return F.when(F.exists(votes, lambda v: v >= k), beyond).otherwise(probs)

        return bound("votes", of)


def vote_counts(votes: VoteFrame, cardinality: int) -> tuple[np.ndarray, int]:
    """How often each pair of votes stands on one row (functions * classes squared), and the number of rows."""
    d = votes.m * cardinality
    top, n, kinds = votes.df.agg(F.max(F.array_max("votes")), F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("votes"))).first()
    if top is not None and top >= cardinality:
        raise ValueError(f"a vote for class {top} does not fit the cardinality {cardinality}")
    counts = np.zeros((d, d))
    if kinds <= MAX_PATTERNS * 0.9:
        rows = votes.patterns().toLocalIterator()
        for r in rows:
            on = [j * cardinality + v for j, v in enumerate(r.votes) if v >= 0]
            counts[np.ix_(on, on)] += r.n
    else:
        for r in pair_counts(votes, cardinality).collect():  # at most d * d rows
            counts[r.a, r.b] = r.n
    return counts, n


def pair_counts(votes: VoteFrame, cardinality: int) -> DataFrame:
    """(a, b, n): on how many rows the votes a and b (function * cardinality + class) stand together.

    Patterns are counted first, so that each distinct one is expanded once.
    """
    on = F.filter(F.transform("votes", lambda v, j: F.when(v >= 0, j * cardinality + v)), lambda x: x.isNotNull())
    each = votes.patterns().select("n", on.alias("on"))
    pairs = each.select("n", "on", F.explode("on").alias("a")).select("n", "a", F.explode("on").alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


class TrainLogger:
    """Counts epochs and logs metrics at every ``log_freq``-th, from the first on; never if that is 0."""

    def __init__(self, log_freq: int):
        self.log_freq, self.epochs = log_freq, 0

    def check(self) -> bool:
        self.epochs += 1
        return bool(self.log_freq) and (self.epochs - 1) % self.log_freq == 0

    def log(self, metrics: dict[str, float]) -> str:
        line = f"epoch {self.epochs - 1}: " + ", ".join(f"{k}={v:.3f}" for k, v in metrics.items())
        logger.info(line)
        return line


class LabelModel(BaseLabeler):
    """Accuracies of the functions and class probabilities, learned from agreements alone."""

    def fit(self, votes: VoteFrame, class_balance: list[float] | None = None, dev_gold: DataFrame | None = None, **settings: Any) -> LabelModel:
        """Learn from the pair counts. Class balance: given, or that of ``dev_gold`` (its only column), or uniform."""
        self.config = merge_config(LabelModelTrainConfig(), settings)
        self._check(votes.m)
        counts, n = vote_counts(votes, self.cardinality)
        return self.fit_counts(counts, n, self.balance(class_balance, dev_gold))

    def fit_counts(self, counts: np.ndarray, n: int, balance: np.ndarray, **settings: Any) -> LabelModel:
        """Learn from counts of pairs of votes among ``n`` rows."""
        c = self.config = merge_config(getattr(self, "config", LabelModelTrainConfig()), settings)
        k = self.cardinality
        self.n, self.p, self.m = n, np.asarray(balance, dtype=np.float32), counts.shape[0] // k
        self._check(self.m)
        self.O = (counts / max(n, 1)).astype(np.float32)
        self.coverage = np.add.reduceat(np.diag(self.O), np.arange(0, self.m * k, k))
        self.mask = (1 - np.kron(np.eye(self.m), np.ones((k, k)))).astype(np.float32)
        self._init(c)
        params = {"mu": self.mu}
        l2 = np.asarray(c.l2, dtype=np.float32)
        optimizer = Optimizer(c.optimizer, c.lr, float(l2) if l2.ndim == 0 else 0.0, c.optimizer_config)
        if c.lr_scheduler_config.warmup_steps and c.lr_scheduler_config.warmup_unit != "epochs":
            raise ValueError("the label model warms up in epochs; set warmup_unit to that")
        rate = lr_schedule(c.lr_scheduler, c.lr, c.n_epochs, 1, c.lr_scheduler_config)
        log = TrainLogger(c.log_freq)
        with np.errstate(over="ignore", invalid="ignore"):
            for epoch in range(c.n_epochs):
                loss, grad = self._loss(l2)
                if np.isnan(loss):
                    raise ArithmeticError("the loss is NaN; try a smaller learning rate")
                optimizer.lr = rate(epoch)
                optimizer.step(params, {"mu": grad})
                if log.check():
                    log.log({"train/loss": loss})
        if not np.isfinite(self.mu).all():
            raise ArithmeticError("the loss is NaN; try a smaller learning rate")
        self._clamp(c.mu_eps)
        self._break_symmetry()
        return self

    def _check(self, m: int) -> None:
        if m < 3:
            raise ValueError(f"the label model needs at least 3 labeling functions, not {m}")

    def balance(self, class_balance: list[float] | None, dev_gold: DataFrame | None) -> np.ndarray:
        k = self.cardinality
        if class_balance is not None:
            p = np.asarray(class_balance, dtype=float)
            if len(p) != k:
                raise ValueError(f"class_balance has length {len(p)}, the cardinality is {k}")
        elif dev_gold is not None:
            name = dev_gold.columns[0]
            seen = {r[0]: r[1] for r in dev_gold.where(F.col(name) >= 0).groupBy(name).count().collect()}
            if any(y >= k for y in seen):
                raise ValueError(f"Y_dev has labels that are not below the cardinality {k}.")
            p = np.array([seen.get(y, 0) for y in range(k)], dtype=float) / max(1, sum(seen.values()))
        else:
            p = np.full(k, 1 / k)
        if (p == 0).any():
            raise ValueError(f"the prior is 0 for classes {np.flatnonzero(p == 0).tolist()}")
        return p

    def _init(self, c: LabelModelTrainConfig) -> None:
        m, k = self.m, self.cardinality
        prec = c.prec_init
        if isinstance(prec, bool) or not isinstance(prec, int | float | list | tuple | np.ndarray):
            raise TypeError(f"prec_init is of type {type(prec)} which is not supported.")
        prec = np.full(m, prec, dtype=float) if isinstance(prec, int | float) else np.asarray(prec, dtype=float)
        if prec.shape != (m,):
            raise ValueError(f"prec_init must have shape {m}.")
        self.mu_init = np.zeros((m * k, k), dtype=np.float32)
        right = np.diag(self.O).reshape(m, k) * prec[:, None] / self.p
        for y in range(k):
            self.mu_init[y::k, y] = right[:, y].clip(0, 1)
        self.mu = (self.mu_init * np.float32(np.random.RandomState(c.seed).random_sample())).astype(np.float32)

    def _loss(self, l2: Any) -> tuple[float, np.ndarray]:
        mu, p = self.mu, self.p
        fit = (self.O - (mu * p) @ mu.T) * self.mask
        sums = (mu * p).sum(axis=1) - np.diag(self.O)
        d2 = np.asarray(l2, dtype=np.float32) ** 2
        d2 = d2[:, None] if d2.ndim else d2
        away = mu - self.mu_init
        loss = float((fit**2).sum() + (sums**2).sum() + (d2 * away**2).sum())
        return loss, -4 * fit @ (mu * p) + 2 * sums[:, None] * p[None, :] + 2 * d2 * away

    def _clamp(self, eps: float | None) -> None:
        digits = int(np.ceil(np.log10(max(self.n, 1))))
        e = min(10.0**-digits, 0.01) if eps is None else eps
        self.mu = np.clip(self.mu, e, 1 - e)

    def _break_symmetry(self) -> None:
        """Among classes of equal prior, order columns so that functions are better than chance."""
        k = self.cardinality
        gain = np.array([[self.mu[a::k, b].sum() for b in range(k)] for a in range(k)])
        order = list(range(k))
        rounded = np.round(self.p, 3)
        for value in dict.fromkeys(rounded.tolist()):
            group = [y for y in range(k) if rounded[y] == value]
            chosen = assignment(gain[np.ix_(group, group)])
            for y, c in zip(group, chosen, strict=True):
                order[y] = group[c]
        self.mu = self.mu[:, order]

    def get_conditional_probs(self) -> np.ndarray:
        """P(vote | class): functions x (abstain and classes) x classes."""
        k = self.cardinality
        out = np.zeros((self.m, k + 1, k))
        out[:, 1:, :] = self.mu.reshape(self.m, k, k)
        out[:, 0, :] = 1 - out[:, 1:, :].sum(axis=1)
        return out

    def get_weights(self) -> np.ndarray:
        """Accuracies given a vote, within [1e-6, 1]."""
        right = np.einsum("iyy,y->i", self.get_conditional_probs()[:, 1:, :], self.p)
        share = np.divide(right, self.coverage, out=np.ones_like(right), where=self.coverage > 0)
        return share.clip(1e-6, 1.0)

    def proba(self, votes: VoteFrame) -> Column:
        """softmax over classes of log prior + the log probabilities of the votes cast; abstentions say nothing."""
        self._check(votes.m)
        return posterior(self.mu, self.p, votes.m, self.cardinality)

    def state(self) -> dict[str, Any]:
        keep = ("cardinality", "n", "m", "p", "O", "coverage", "mu", "mu_init")
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items() if k in keep}


def posterior(mu: np.ndarray, p: np.ndarray, m: int, k: int) -> Column:
    """Class probabilities of a row's votes, from P(vote | class) and the class balance."""
    with np.errstate(divide="ignore"):
        logs, prior = np.log(np.asarray(mu, dtype=np.float64)), np.log(np.asarray(p, dtype=np.float64))
    tables = [F.split(F.lit(",".join(map(repr, logs[:, y].tolist())).replace("inf", "Infinity")), ",").cast("array<double>") for y in range(k)]
    return softmax(bound("votes", lambda votes: F.array(*[_voted_sum(votes, table, k, float(prior[y])) for y, table in enumerate(tables)])))


def _voted_sum(votes: Column, table: Column, k: int, start: float) -> Column:
    terms = F.transform(votes, lambda v, j: F.when(v >= 0, F.get(table, j * k + v)).otherwise(0.0))
    return F.aggregate(terms, F.lit(start), lambda a, x: a + x)


def assignment(gain: np.ndarray) -> list[int]:
    """Columns for the rows with the largest sum: all orders for up to 7, else the Hungarian method."""
    n = len(gain)
    if n <= 7:
        return list(max(permutations(range(n)), key=lambda o: sum(gain[i, c] for i, c in enumerate(o))))
    cost = -gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0, free = match[j0], np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out
