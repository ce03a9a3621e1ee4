"""Random vote matrices with known conditional probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import uniform


def random_cpts(m: int, cardinality: int, abstain_multiplier: float, rng: np.random.RandomState) -> np.ndarray:
    """P(vote | class): m x (cardinality + 1) x cardinality, leaning to the right class."""
    k = cardinality
    p = rng.random_sample((m, k + 1, k))
    p[:, 1:, :] += (k - 1) * np.eye(k)
    p[:, 0, :] *= abstain_multiplier
    return p / p.sum(axis=1, keepdims=True)


def simple_label_matrix(n: int, m: int, cardinality: int, abstain_multiplier=1.0, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(cpts, gold, votes) as arrays."""
    rng = np.random.RandomState(seed)
    cpts = random_cpts(m, cardinality, abstain_multiplier, rng)
    gold = rng.choice(cardinality, n)
    draws = rng.random_sample((n, m))
    votes = (draws[:, :, None] > cpts.cumsum(axis=1)[:, :, gold].transpose(2, 0, 1)).sum(axis=2) - 1
    return cpts, gold, np.minimum(votes, cardinality - 1)


def synthetic_votes(spark: SparkSession, n: int, m: int, cardinality: int, abstain_multiplier=1.0, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """(cpts, frame of id, gold, votes); rows are drawn by hashing, so the frame is the same however it is split."""
    cpts = random_cpts(m, cardinality, abstain_multiplier, np.random.RandomState(seed))
    gold = F.floor(uniform(seed, "id", -1) * cardinality).cast("int")
    sums = cpts.cumsum(axis=1)

    def vote(j: int):
        u, out = uniform(seed, "id", j), F
        for y in range(cardinality):
            inner = F
            for v in range(cardinality):
                inner = inner.when(u < float(sums[j, v, y]), F.lit(v - 1))
            out = out.when(F.col("gold") == y, inner.otherwise(F.lit(cardinality - 1)))
        return out

    frame = spark.range(n).withColumn("gold", gold)
    return cpts, frame.select("id", "gold", F.array(*[vote(j) for j in range(m)]).alias("votes"))
