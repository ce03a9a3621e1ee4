"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; every pair of a
query block and a candidate block is a cell, worked off by one task call. In a
cell, tiles of int8 products bound every inner product from both sides (the
norms of the quantisation errors give the width); only pairs whose upper bound
reaches the running threshold are computed again on the original vectors in
double precision, and kept in one heap for each query. A cell returns at most k
rows a query, which a last ranking joins.

Products of int8 values are summed in float32, exact for up to 1,040
dimensions; beyond that, float64 is used. Among candidates of a cell with the
very same vector only the k + 1 smallest ids can be returned, so only those are
searched.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, as queries or candidates, nor do null ids; vectors of
another length than the query's are not its candidates; rows that repeat a
vec_id count once, with the smallest vector; ties go to the smaller vec_id.
Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least and most rows in a block, about, and rows in a tile within a cell. Blocks grow with the table, so that rows are copied less often.
QUERY_BLOCK, CANDIDATE_BLOCK = (2048, 16_384), (8192, 32_768)
SIDE = 16
QUERY_TILE, CANDIDATE_TILE = 256, 2048
PAIRS = 100_000
SCHEMA = "query_id long, vec_id long, score double"


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, norms of the rounding errors and of the rounded rows."""
    scale = np.abs(v).max(axis=1) / 127
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    norm = lambda x: np.linalg.norm(x / scale[:, None], axis=1) * scale  # noqa: E731  squares of the components themselves may overflow
    return codes, scale, norm(v - near), norm(near)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    flat = table.column("embedding").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.ascontiguousarray(values.reshape(len(ids), -1)[order])


def best_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows to search: of equal vectors, the k + 1 with the smallest ids (rows are in order of id)."""
    _, same = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(same[order])) + 1])
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return np.sort(order[place <= k])


def cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k nearest candidates of each query within a cell."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not candidates.num_rows:
        return none
    qid, q = matrix(queries)
    cid, c = matrix(candidates)
    rows = best_copies(cid, c, k)
    cid, c = cid[rows], c[rows]
    qc, qs, qe, qn = quantised(q)
    cc, cs, ce, cn = quantised(c)
    exact = np.float32 if q.shape[1] <= 1040 else np.float64
    full = np.linalg.norm(c / cs[:, None], axis=1) * cs
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    for b in range(0, len(cid), CANDIDATE_TILE):
        cols = slice(b, min(b + CANDIDATE_TILE, len(cid)))
        right = cc[cols].astype(exact).T
        for a in range(0, len(qid), QUERY_TILE):
            sel = slice(a, min(a + QUERY_TILE, len(qid)))
            near = (qc[sel].astype(exact) @ right).astype(np.float64) * qs[sel, None] * cs[None, cols]
            width = qn[sel, None] * ce[None, cols] + qe[sel, None] * full[None, cols]
            width += 1e-12 * (1 + np.abs(near))  # rounding of the bounds themselves
            beyond = ~np.isfinite(near) | ~np.isfinite(width)  # no bound: to be scored
            near[beyond], width[beyond] = 0, np.inf
            near[qid[sel, None] == cid[None, cols]] = -np.inf
            held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[sel]])
            low = np.where(near > -np.inf, near - width, -np.inf)
            if low.shape[1] > k:
                held = np.maximum(held, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            r, s = np.nonzero((near + width >= held[:, None]) & (near > -np.inf))
            for i in range(0, len(r), PAIRS):
                rr, ss = r[i : i + PAIRS] + a, s[i : i + PAIRS] + b
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.cumsum(q[rr] * c[ss], axis=1)[:, -1]  # summed in order
                score[np.isnan(score)] = -np.inf
                for x, y, z in zip(rr.tolist(), score.tolist(), cid[ss].tolist(), strict=True):
                    heap = heaps[x]
                    if len(heap) < k:
                        heapq.heappush(heap, (y, -z))
                    elif heap[0] < (y, -z):
                        heapq.heapreplace(heap, (y, -z))
    out = [(i, -z, y) for i, heap in zip(qid.tolist(), heaps, strict=True) for y, z in heap]
    if not out:
        return none
    a, b, s = zip(*out, strict=True)
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})


def usable(embeddings: DataFrame) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = usable(embeddings)
    asked = rows.where(F.col("vec_id") % every == 0)
    counts = rows.select(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    size_of = lambda n, bounds: min(bounds[1], max(bounds[0], n // SIDE))
    blocks = max(1, -(-counts[0] // (candidate_block or size_of(counts[0], CANDIDATE_BLOCK))))
    query_blocks = max(1, -(-counts[1] // (query_block or size_of(counts[1], QUERY_BLOCK))))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("embedding").alias("dims")
    left = asked.select("vec_id", "embedding", size, dealt(query_blocks).alias("qb")).select("*", every_of(blocks).alias("cb"))
    right = rows.select("vec_id", "embedding", size, dealt(blocks).alias("cb")).select("*", every_of(query_blocks).alias("qb"))
    keys = ["dims", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda x, y: cell(x, y, k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
