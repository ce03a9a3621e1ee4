"""Toxicity with subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of itself and of its byte n-grams (3 to 6,
with ends marked), hashed into ``BUCKETS`` rows, so an unseen spelling shares
most vectors with known ones. A segment of ``SEGMENT`` words is the average of
its words (a repeated word counts once, and the places of repeats and of a
short segment's missing words as zero vectors) and goes through a linear softmax; a text's score is that of its most
toxic segment. Every word of a text lies in a segment. Training first averages
whole texts, then takes the most toxic segment of each, as scoring does.

The model is fitted on at most ``TRAIN_ROWS`` texts of each label, of at most
``TRAIN_CHARS`` characters, whose crc32(doc_id) mod 5 is not 0; scores use the
text alone. Because everything between embedding and softmax is linear, a word
is scored once per batch however often it stands there.

Defined results: texts without words (null, empty, punctuation) get the score
of an empty segment, the softmax of the bias; with no labelled rows every score
is 0.0. Texts are scored whole, however long; repeated rows, and rows without an
id, are scored one by one. Repeated label rows of a document count once, as the
largest label; rows with null doc_id or null labels are not learned from. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language import bounded

BUCKETS = 1 << 17
SIZE = 8
GRAMS = (3, 4, 5, 6)
SEGMENT = 48
#: At most so many labelled texts of each label, none longer than TRAIN_CHARS, are learned from.
TRAIN_ROWS = 2500
DECAY = 1e-6
TRAIN_CHARS = 1_000_000


def bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, one after another, and how many each has."""
    n = ends - starts
    off = np.concatenate([[0], np.cumsum(n + 2)])
    buf = np.full(int(off[-1]), ord("<"), np.uint8)
    buf[common.ranges(off[:-1] + 1, n)] = data[common.ranges(starts, n)]
    buf[off[1:] - 1] = ord(">")
    prefix = common.prefix_codes(buf)
    owners, codes = [np.arange(len(n))], [common.span_hash(prefix, off[:-1], off[1:])]
    for g in GRAMS:
        many = np.maximum(n + 2 - g, 0)  # the word itself is there already
        many[n + 2 == g] = 0
        s = common.ranges(off[:-1], many)
        owners.append(np.repeat(np.arange(len(n)), many))
        codes.append(common.span_hash(prefix, s, s + g))
    owner, code = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(owner, kind="stable")
    return (code[order] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), np.bincount(owner, minlength=len(n))


def first_uses(word: np.ndarray, number: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word stands in its segment for the first time."""
    segment = number // SEGMENT
    base = np.int64(word.max(initial=0)) + 1
    key = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])])) * base + word
    out = np.zeros(len(word), dtype=bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


class SubwordBag:
    def __init__(self, seed: int = 21):
        rng = np.random.default_rng(seed)
        self.table = ((rng.random((BUCKETS, SIZE)) - 0.5) / SIZE).astype(np.float32)
        self.out = ((rng.random((SIZE, 2)) - 0.5) / SIZE).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: tuple[int, int] = (8, 8), rate: float = 0.02, batch: int = 64, seed: int = 22) -> None:
        """Adam on the cross-entropy; both classes weigh alike. epochs: over whole texts, then over their most toxic segments."""
        data, off = common.utf8(pa.array(texts, pa.large_string()))
        data = common.LOWER[data]
        parts = []
        for i, j in common.chunks(off):  # bounds the memory of the hashes
            s, e, r = common.word_spans(data[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append((s + off[i], e + off[i], r + i, common.span_hash(common.prefix_codes(data[off[i] : off[j]]), s, e)))
        starts, ends, row, codes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        if not len(starts) or len(set(labels.tolist())) < 2:
            self.bias[1] = 8.0 if len(labels) and labels.min() > 0 else -8.0
            return
        _, one, word = np.unique(codes, return_index=True, return_inverse=True)
        del codes, parts
        grams, size = bags(data, starts[one], ends[one])
        at = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
        rng = np.random.default_rng(seed)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.table, self.out, self.bias)]
        able = np.flatnonzero(np.diff(first))
        fresh = first_uses(word, np.arange(len(word)) - first[row], row)
        for epoch in range(sum(epochs)):
            order = rng.permutation(able)
            scored = self.word_scores(grams, size) if epoch >= epochs[0] else None
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                spans = [(first[r], first[r + 1]) for r in rows]
                if scored is not None:
                    spans = [self._worst(scored, word, fresh, s, e) for s, e in spans]
                count = np.array([e - s for s, e in spans])
                words, where = np.unique(word[common.ranges(np.array([s for s, _ in spans]), count)], return_inverse=True)
                text = np.repeat(np.arange(len(rows)), count)
                share = (1.0 / np.maximum(count, SEGMENT)).astype(np.float32)
                mass = np.zeros((len(rows), len(words)), np.float32)
                mass[text, where] = share[text]  # a repeated word counts once
                n = size[words]
                begin = np.cumsum(n) - n
                feature = grams[common.ranges(at[words], n)]
                vectors = np.add.reduceat(self.table[feature], begin) / n[:, None].astype(np.float32)
                hidden = mass @ vectors
                z = hidden @ self.out + self.bias
                d = np.exp(z - z.max(axis=1, keepdims=True))
                d /= d.sum(axis=1, keepdims=True)
                d[np.arange(len(rows)), labels[rows]] -= 1
                d *= (weight[rows] / len(rows))[:, None]
                kinds, slot = np.unique(feature, return_inverse=True)
                each = np.repeat((mass.T @ (d @ self.out.T)) / n[:, None], n, axis=0)
                table_grad = np.stack([np.bincount(slot, each[:, k], minlength=len(kinds)) for k in range(SIZE)], axis=1).astype(np.float32)
                grads = [table_grad + DECAY * self.table[kinds], hidden.T @ d, d.sum(0)]
                for p, (m, v), g, pick in zip((self.table, self.out, self.bias), moments, grads, (kinds, slice(None), slice(None)), strict=True):
                    m[pick] += 0.1 * (g - m[pick])
                    v[pick] += 0.01 * (g * g - v[pick])
                    p[pick] -= rate * m[pick] / (np.sqrt(v[pick]) + 1e-6)

    def word_scores(self, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's part of the logit of label 1 over label 0."""
        each = (self.table @ (self.out[:, 1] - self.out[:, 0]))[grams]
        owner = np.repeat(np.arange(len(size)), size)
        return np.bincount(owner, each, minlength=len(size)) / size

    @staticmethod
    def _worst(scored: np.ndarray, word: np.ndarray, fresh: np.ndarray, s: int, e: int) -> tuple[int, int]:
        cuts = np.arange(s, e, SEGMENT)
        k = int(np.add.reduceat(scored[word[s:e]] * fresh[s:e], cuts - s).argmax())
        return int(cuts[k]), int(min(cuts[k] + SEGMENT, e))

    def freeze(self) -> tuple[np.ndarray, float]:
        return (self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def logits(data: np.ndarray, off: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    """The largest segment logit of each text."""
    each, bias = model
    out = np.full(len(off) - 1, bias)
    data = common.LOWER[data]
    starts, ends, row = common.word_spans(data, off)
    if not len(starts):
        return out
    codes = common.span_hash(common.prefix_codes(data), starts, ends)
    _, one, word = np.unique(codes, return_index=True, return_inverse=True)
    grams, size = bags(data, starts[one], ends[one])
    score = np.bincount(np.repeat(np.arange(len(size)), size), each[grams], minlength=len(size)) / size
    first = np.searchsorted(row, np.arange(len(off)))
    count = np.diff(first)
    pieces = (count + SEGMENT - 1) // SEGMENT
    owner = np.repeat(np.arange(len(count)), pieces)
    begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    fresh = first_uses(word, np.arange(len(word)) - first[row], row)
    mean = np.add.reduceat(score[word] * fresh, begin) / SEGMENT
    have = np.flatnonzero(pieces)
    out[have] = bias + np.maximum.reduceat(mean, (np.cumsum(pieces) - pieces)[have])
    return out


def score(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, float] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = common.utf8(batch.column("text"))
        if model is None:
            p = np.zeros(batch.num_rows)
        else:
            z = [logits(data[off[i] : off[j]], off[i : j + 1] - off[i], model) for i, j in common.chunks(off)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -500, 500)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` texts of each label, chosen by a hash of doc_id, and their labels."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.crc_mod(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = bounded(known.where("toxic = 1"), rows).unionByName(bounded(known.where("toxic = 0"), rows))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.char_length("text") <= TRAIN_CHARS)
    found = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.toxic) for r in found.toLocalIterator())
    return [t for _, t, _ in got], np.array([y for *_, y in got], dtype=np.int64)


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float] | None:
    if not len(texts):
        return None
    model = SubwordBag()
    model.fit(texts, labels)
    return model.freeze()


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(train(*sample(documents, labels, rows)))
    asked = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(common.crc_mod(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    common.small_batches(documents.sparkSession)
    return asked.mapInArrow(lambda batches: score(batches, sent.value), f"doc_id {kind}, held_out boolean, score double, predicted int")
