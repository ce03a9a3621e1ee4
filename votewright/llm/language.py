"""Language identification with a byte convolutional network trained in numpy.

Bytes are one-hot; filters of several widths slide over fixed windows of bytes,
each filter's largest response in a window is kept (max pooling), and a softmax
over the languages follows. A filter over one-hot bytes is a sum of one table
row for each byte, so inference looks rows up instead of multiplying: rows for
pairs of bytes are added as int16 and pooled by halving. All windows of a text
count, weighted by their bytes.

The network is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` rows,
``TRAIN_WINDOWS`` windows each) whose crc32(doc_id) mod 5 is not 0. Predictions
use the text alone.

Defined results: lang_pred is ``und`` with score 0.0 where the text is null,
empty or has no letter (str.isalpha), and everywhere if there is no labelled
row. Ties go to the alphabetically first language. Texts are read whole, however
long. Rows with a null doc_id are predicted, never learned from; repeated rows
are answered one by one. An empty table gives no rows. Further columns are
ignored by ``identify`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: At most so many labelled rows, and windows of each, are learned from.
TRAIN_ROWS = 1500
TRAIN_WINDOWS = 3
EPOCHS = 6
UNDETERMINED = "und"
#: How far from chance to certainty a text's best language must come to be accepted.
ACCEPT = 0.1


class ByteConvNet:
    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        total = len(WIDTHS) * FILTERS
        self.params = {f"t{w}": (rng.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS}
        self.params["bias"] = np.zeros(total, np.float32)
        self.params["out"] = (rng.standard_normal((total, len(classes))) * 0.1).astype(np.float32)
        self.params["prior"] = np.zeros(len(classes), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each row of windows, and where it is."""
        best, where = [], []
        for w in WIDTHS:
            t = self.params[f"t{w}"]
            z = t[0][x[:, :WINDOW]]
            for j in range(1, w):
                z += t[j][x[:, j : j + WINDOW]]
            at = z.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(best, axis=1), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, seed: int = 12) -> None:
        """Adam on the cross-entropy; the gradient of a pooled filter goes to the bytes where it was largest."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                bx, by = x[rows], y[rows]
                m, where = self.pooled(bx)
                h = np.maximum(m + self.params["bias"], 0)
                d = softmax(h @ self.params["out"] + self.params["prior"])
                d[np.arange(len(by)), by] -= 1
                d /= len(by)
                dh = (d @ self.params["out"].T) * (h > 0)
                grads = {"out": h.T @ d, "prior": d.sum(0), "bias": dh.sum(0)}
                filters = np.arange(FILTERS)[None, :]
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.params[f"t{w}"])
                    part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(bx, where[k] + j, axis=1), np.broadcast_to(filters, part.shape)), part)
                    grads[f"t{w}"] = g
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def freeze(self) -> Frozen:
        return Frozen(self)


class Frozen:
    """The network with int16 tables for pairs of bytes."""

    def __init__(self, net: ByteConvNet):
        self.classes = net.classes
        p = net.params
        reach = max(float(np.abs(p[f"t{w}"]).max(axis=(1, 2)).sum()) for w in WIDTHS)
        self.scale = np.float32(reach / 30000 or 1)
        self.tables = []
        for w in WIDTHS:
            t, parts = p[f"t{w}"], []
            for j in range(0, w - 1, 2):
                parts.append((j, True, np.rint((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) / self.scale).astype(np.int16)))
            if w % 2:
                parts.append((w - 1, False, np.rint(t[w - 1] / self.scale).astype(np.int16)))
            self.tables.append(parts)
        self.bias, self.out, self.prior = p["bias"], p["out"], p["prior"]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Class probabilities of each window; ``data``: whole windows and at least 4 bytes more."""
        n = (len(data) - 4) // WINDOW
        pairs = data[:-1].astype(np.intp) * 256 + data[1:]
        m = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        step = 256
        for a in range(0, n, step):
            b = min(n, a + step)
            s, e = a * WINDOW, b * WINDOW
            for k, parts in enumerate(self.tables):
                z = None
                for j, double, table in parts:
                    rows = np.take(table, pairs[s + j : e + j] if double else data[s + j : e + j], axis=0)
                    z = rows if z is None else np.add(z, rows, out=z)
                z = z.reshape(b - a, WINDOW, FILTERS)
                width = WINDOW
                while width > 1:
                    width //= 2
                    z = np.maximum(z[:, :width], z[:, width : 2 * width])
                m[a:b, k * FILTERS : (k + 1) * FILTERS] = z[:, 0]
        return softmax(np.maximum(m * self.scale + self.bias, 0) @ self.out + self.prior)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def laid_out(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole windows; first window of each text, window weights and owners."""
    sizes = np.diff(off)
    count = (sizes + WINDOW - 1) // WINDOW
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]) * WINDOW + 4, np.uint8)
    out[common.ranges(first[:-1] * WINDOW, sizes)] = data
    owner = np.repeat(np.arange(len(sizes)), count)
    weight = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return out, first, weight, owner


LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def predict(batches: Iterator[pa.RecordBatch], model: Frozen | None, keep_text: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = common.utf8(batch.column("text"))
        n = batch.num_rows
        names = np.full(n, UNDETERMINED, dtype=object)
        scores = np.zeros(n)
        lettered = np.zeros(n, dtype=bool)
        for i, j in common.chunks(off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            letters = np.concatenate([[0], np.cumsum(LETTER[part])])
            has = letters[o[1:]] > letters[o[:-1]]
            for r in np.flatnonzero(~has & (o[1:] > o[:-1])):
                has[r] = any(map(str.isalpha, part[o[r] : o[r + 1]].tobytes().decode()))
            lettered[i:j] = has
            if model is None or not has.any():
                continue
            padded, _, weight, owner = laid_out(part, o)
            p = model.windows(padded)
            total = np.stack([np.bincount(owner, p[:, k] * weight, minlength=j - i) for k in range(p.shape[1])], axis=1)
            total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
            best = total.argmax(axis=1)
            names[i:j] = np.where(has, np.array(model.classes, dtype=object)[best], UNDETERMINED)
            scores[i:j] = np.where(has, np.clip(total[np.arange(j - i), best], 0, 1), 0.0)
        arrays = [pa.array(names.tolist(), pa.string()), pa.array(scores)]
        added = ["lang_pred", "score"]
        if keep_text:
            arrays, added = [*arrays, pa.array(lettered)], [*added, "lettered"]
        kept = [c for c in batch.schema.names if c != "text" or keep_text]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *added])


def sample(documents: DataFrame, rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> list[tuple[str, list[str]]]:
    """(lang, windows of text) of at most ``rows`` learnable rows, chosen by a hash of doc_id."""
    able = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (common.crc_mod(F.col("doc_id")) != 0))
    return [(r.lang, r.parts) for r in bounded(able, rows).select("lang", _windows(windows).alias("parts")).toLocalIterator()]


def bounded(frame: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, never more, by a hash of doc_id; the few rows above a hash bound are ordered, not all."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(77))
    total = frame.select(F.count(F.lit(1))).first()[0]
    share = min(1.0, 1.1 * rows / max(total, 1) + 50 / max(total, 1))
    near = frame.where(F.pmod(key, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)) if share < 1 else frame
    return near.orderBy(F.pmod(key, F.lit(1 << 30)), F.col("doc_id")).limit(rows)


def _windows(count: int):
    size = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    at = [F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(k)), size.cast("long")).cast("int") + 1 if k else F.lit(1) for k in range(count)]
    return F.array_distinct(F.array(*[F.substring(F.col("text"), a, WINDOW) for a in at]))


def train(rows: list[tuple[str, list[str]]], epochs: int = EPOCHS) -> Frozen | None:
    classes = sorted({lang for lang, _ in rows})
    x, y = [], []
    for lang, parts in sorted(rows, key=lambda r: (r[0], r[1])):
        for part in parts:
            raw = np.frombuffer(part.encode()[:WINDOW], np.uint8)
            if len(raw):
                x.append(np.pad(raw, (0, WINDOW + 4 - len(raw))))
                y.append(classes.index(lang))
    if not x:
        return None
    net = ByteConvNet(classes)
    net.fit(np.stack(x), np.array(y), epochs)
    return net.freeze()


def identify(documents: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    frame = documents.withColumn("text", F.col("text").cast("string"))
    sent = documents.sparkSession.sparkContext.broadcast(train(sample(frame, rows)))
    asked = frame.select("doc_id", "text", F.coalesce(common.crc_mod(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    common.small_batches(documents.sparkSession)
    return asked.mapInArrow(lambda batches: predict(batches, sent.value), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def least_score(languages: int) -> float:
    """The least score with which a text is accepted where so many languages are told apart."""
    return 1 / languages + ACCEPT * (1 - 1 / languages) - 1e-6


def accepted(documents: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``documents`` but for those whose language cannot be told; a null lang becomes the predicted one.

    Rejected are texts that are null or have no letter, and those of which the
    network prefers no language: the best one's score is below ``least_score``.
    Where no label was there to learn from, every lettered text stays.
    """
    frame = documents.withColumn("text", F.col("text").cast("string"))
    model = train(sample(frame, rows))
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    inner = frame.select(*(F.col(c).alias(c if c == "text" else f"in_{c}") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    common.small_batches(documents.sparkSession)
    told = inner.mapInArrow(lambda batches: predict(batches, sent.value, True), f"{fields}, lang_pred string, score double, lettered boolean")
    told = told.where("lettered" if model is None else F.col("lettered") & (F.col("score") >= least_score(len(model.classes))))
    kept = {c: F.col(c if c == "text" else f"in_{c}") for c in names}
    if model is not None and documents.schema["lang"].dataType.typeName() == "string":
        kept["lang"] = F.coalesce(kept["lang"], "lang_pred")
    return told.select(*(kept[c].alias(c) for c in names))
