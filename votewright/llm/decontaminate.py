"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of documents of about ``SHARD_BYTES``. All its words, with a
break after each document, are one sequence; over it an FM-index
(Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions) is
built, all test phrases are found by backward search, located, and their spans
merged. Documents are never shuffled. The test phrases travel in blocks of
bounded size, one pass over the documents for each block.

Defined results: a null or wordless text has no words, no hits and the hash of
the empty string; texts are taken whole, a text longer than a shard is a shard
of its own; null, empty or wordless items have no phrase; repeated items count
once for each item_id; null item_ids take no part. Rows with a null doc_id and
repeated rows are answered like any other, one by one. An empty table gives no
rows, an empty benchmark no hits. Further columns of either table are ignored
by ``decontaminate`` and kept by ``cut``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: UTF-8 bytes of test items in one block; what is sent to the executors at a time.
BLOCK_BYTES = 8 << 20
SAMPLE = 8
#: UTF-8 bytes of the texts of one index.
SHARD_BYTES = 1 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
EMPTY = hashlib.sha256(b"").hexdigest()


class Phrases:
    """The distinct windows of a block of items, by length, and whose they are."""

    def __init__(self, rows: list[tuple[object, str]], window: int = WINDOW):
        codes, row, _, _ = words_of(*common.utf8(pa.array([t for _, t in rows], pa.large_string())))
        self.vocabulary, words = np.unique(codes, return_inverse=True)
        first = np.searchsorted(row, np.arange(len(rows) + 1))
        by_length: dict[int, dict[tuple, set]] = {}
        for k, (item, _) in enumerate(rows):
            w = words[first[k] : first[k + 1]]
            if not len(w):
                continue
            n = min(window, len(w))
            for x in np.lib.stride_tricks.sliding_window_view(w, n):
                by_length.setdefault(n, {}).setdefault(tuple(x.tolist()), set()).add(item)
        self.windows = {n: np.array(list(d), dtype=np.int64) for n, d in by_length.items()}
        self.items = {n: [sorted(x, key=str) for x in d.values()] for n, d in by_length.items()}


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code, row and number within its row of each word, and the words of each row."""
    data = common.LOWER[data]
    starts, ends, row = common.word_spans(data, off)
    count = np.bincount(row, minlength=len(off) - 1)
    codes = common.span_hash(common.prefix_codes(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return codes, row, np.arange(len(row)) - (np.cumsum(count) - count)[row], count


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order; the last symbol must be the only smallest.

    By doubling, where each round sorts only the suffixes that are still tied.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    start = np.ones(n + 1, dtype=bool)  # where a group of equal prefixes begins
    start[1:n] = s[order[1:]] != s[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(start[:n], np.arange(n), 0))
    k = 1
    while True:
        tied = np.flatnonzero(~(start[:n] & start[1:]))
        if not len(tied):
            return order
        suffix = order[tied]
        group = rank[suffix]
        then = rank[np.minimum(suffix + k, n - 1)]  # the last suffix is never tied, so no tied one ends within k
        key = group * n + then
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        new = np.ones(len(tied), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        start[tied] = new
        rank[suffix] = np.maximum.accumulate(np.where(new, tied, 0))
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of queries at once."""

    def __init__(self, s: np.ndarray):
        self.levels = max(1, int(s.max(initial=0)).bit_length())
        self.ranks, self.zeros, self.bits = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.bits.append(bit.astype(np.int8))
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(upto), upto
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self.ranks[k][low], self.ranks[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.levels):
            bit = self.bits[k][at].astype(np.int64)
            r = self.ranks[k][at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + r, at - r)
        return out


class FMIndex:
    """Backward search over a sequence of positive symbols ending in one 0."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.n, self.top = len(s), int(s.max(initial=0))
        self.matrix = WaveletMatrix(bwt)
        counts = np.bincount(s, minlength=int(s.max(initial=0)) + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        kept = (sa % sample == 0) | (sa == 0)
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept_at = sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with each row of ``patterns``."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            known = c <= self.top
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live] = self.before[c] + self.matrix.rank(c, low[live])
            high[live] = self.before[c] + self.matrix.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order, by steps to a sampled one."""
        out = np.full(len(at), -1, dtype=np.int64)
        left, steps = np.arange(len(at)), 0
        while len(left):
            here = at[left]
            done = self.kept[here]
            out[left[done]] = self.kept_at[self.kept_rank[here[done]]] + steps
            left = left[~done]
            here = at[left]
            c = self.matrix.access(here)
            at = at.copy()
            at[left] = self.before[c] + self.matrix.rank(c, here)
            steps += 1
        return out


def find(data: np.ndarray, off: np.ndarray, phrases: Phrases):
    """The words of each row, and (row, first word, length, windows) of every occurrence in a shard, by its FM-index."""
    codes, row, number, count = words_of(data, off)
    found: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
    if not len(codes) or not phrases.windows:
        return count, found
    kinds, word = np.unique(codes, return_inverse=True)
    slot = np.arange(len(codes)) + row - row[0]  # a break after each row
    text = np.ones(int(slot[-1]) + 2, dtype=np.int64)
    text[slot] = word + 2
    text[-1] = 0
    index = FMIndex(text)
    back = np.full(len(text), -1, dtype=np.int64)
    back[slot] = np.arange(len(codes))
    at = np.minimum(np.searchsorted(kinds, phrases.vocabulary), len(kinds) - 1)
    symbol = np.where(kinds[at] == phrases.vocabulary, at + 2, index.top + 1)  # no word of the shard: a symbol that it has not
    for n, windows in phrases.windows.items():
        low, high = index.search(symbol[windows])
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        places = back[index.locate(common.ranges(low[hit], times))]
        found.append((row[places], number[places], n, np.repeat(hit, times)))
    return count, found


def scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, finish) -> Iterator[pa.RecordBatch]:
    """finish(batch, words of each row, merged spans by row, items by row) of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = common.utf8(batch.column("text"))
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if "spans" in batch.schema.names:
            for r, (s, x) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                if x:
                    spans[r], items[r] = [(p["start"], p["end"]) for p in s], set(x)
        n_words = []
        for i, j in common.chunks(off, SHARD_BYTES):
            count, found = find(data[off[i] : off[j]], off[i : j + 1] - off[i], phrases)
            n_words.append(count)
            for rows, number, n, which in found:
                names = phrases.items[n]
                for r, w, k in zip((rows + i).tolist(), number.tolist(), which.tolist(), strict=True):
                    spans.setdefault(r, []).append((w, w + n))
                    items.setdefault(r, set()).update(str(x) for x in names[k])
        yield finish(batch, np.concatenate(n_words), {r: merged(s) for r, s in spans.items()}, items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def span_column(n: int, spans: dict) -> pa.Array:
    return pa.array([[{"start": s, "end": e} for s, e in spans.get(r, ())] for r in range(n)], SPANS)


def carried(batch, n_words, spans, items) -> pa.RecordBatch:
    """What was found so far, for the next block of phrases."""
    n = batch.num_rows
    keep = [c for c in batch.schema.names if c not in ("spans", "items")]
    found = pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), span_column(n, spans), found], names=[*keep, "spans", "items"])


def answer(batch, n_words, spans, items) -> pa.RecordBatch:
    n = batch.num_rows
    n_hit, n_items = np.zeros(n, np.int64), np.zeros(n, np.int64)
    digests = [EMPTY] * n
    for r, s in spans.items():
        n_hit[r] = sum(e - b for b, e in s)
        n_items[r] = len(items[r])
        digests[r] = hashlib.sha256(",".join(sorted(items[r])).encode()).hexdigest()
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(digests), pa.array(n_items >= 2), span_column(n, spans)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``block_bytes`` (a longer item is a block)."""
    rows, size = [], 0
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id")
    for item, text in items.toLocalIterator():
        grown = size + len(text) * 2
        if rows and grown > block_bytes:
            yield rows
            rows, grown = [], len(text) * 2
        rows.append((item, text))
        size = grown
    if rows:
        yield rows


FOUND = "spans array<struct<start:long,end:long>>, items array<string>"


def passes(frame: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, finish, schema: str) -> DataFrame:
    """``frame`` (with a text) scanned once for each block of phrases; the last pass ends with ``finish``.

    The driver holds the phrases of one block at a time.
    """
    common.small_batches(frame.sparkSession)
    context = frame.sparkSession.sparkContext
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    waiting = None
    for rows in blocks(benchmark, block_bytes):
        if waiting is not None:
            frame = frame.mapInArrow(lambda batches, sent=waiting: scan(batches, sent.value, carried), f"{fields}, {FOUND}")
        waiting = context.broadcast(Phrases(rows, window))
    waiting = waiting or context.broadcast(Phrases([], window))
    return frame.mapInArrow(lambda batches: scan(batches, waiting.value, finish), schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit spans (in words, merged) of each document."""
    frame = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return passes(frame, benchmark, window, block_bytes, answer, RESULT.replace("doc_id long", f"doc_id {kind}"))


def cut(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without the contaminated ones, and without the words hit in the rest.

    A removed span goes from the first byte of its first word to the last byte
    of its last word. Columns stay as they were but for text and, where there
    is one, n_chars. One pass over the documents, no join.
    """
    names = documents.columns
    frame = documents.select(*(F.col(c).alias(f"in_{c}") for c in names if c != "text"), F.col("text").cast("string").alias("text"))

    def strip(batch, n_words, spans, items) -> pa.RecordBatch:
        stay = [r for r in range(batch.num_rows) if len(items.get(r, ())) < 2]
        batch = batch.take(pa.array(stay, pa.int64()))
        spans = [spans.get(r, ()) for r in stay]
        texts = [without(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
        arrays = []
        for c in names:
            a = batch.column(c if c == "text" else f"in_{c}")
            if c == "text":
                a = pa.array(texts, a.type)
            elif c == "n_chars":
                a = pa.array([len(t) if s else v for t, s, v in zip(texts, spans, a.to_pylist(), strict=True)], a.type)
            arrays.append(a)
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return passes(frame, benchmark, window, block_bytes, strip, documents.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = common.word_spans(common.LOWER[raw], np.array([0, len(raw)]))
    keep = np.ones(len(raw), dtype=bool)
    for s, e in spans:
        keep[starts[s] : ends[e - 1]] = False
    return raw[keep].tobytes().decode()
