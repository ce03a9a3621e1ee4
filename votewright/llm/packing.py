"""Packing of tokenized documents into sequences by non-negative least squares.

1. One pass tokenizes each text once (id ``END`` after it) and cuts it into
   pieces: whole windows, and what remains. Only the pieces' sizes and crc32
   leave the pass; they are written to the checkpoint folder.
2. The histogram of piece lengths (at most ``BINS`` classes) comes to the driver.
   Combinations of at most ``DEPTH`` length classes longer than ``EXACT`` that
   fill a window exactly are enumerated (shorter pieces are packed greedily),
   their repeat counts solved by non-negative least squares and rounded down; what the rounded counts leave over is packed greedily, longest
   first, again as patterns with repeat counts, so driver work depends on the
   number of classes and never on the number of documents.
3. A piece's rank within its class picks its sequence. Ranks are counted within
   salted parts of a class, so a length that a third of all pieces have is
   spread over many tasks. A last window function over each sequence (at most
   4096 tokens) gives the offsets.

Defined results: a null or empty text is one piece with id 2 alone; a text is
packed whole, however long, in pieces of at most a window. Repeated rows and
rows with a null doc_id are packed one by one; of equal pieces any may take
either place. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
END = 2
#: Lengths up to EXACT are classes of their own, longer ones go by units of UNIT.
EXACT, UNIT = 256, 16
BINS = EXACT + WINDOW // UNIT - EXACT // UNIT
DEPTH = 3
#: Pieces in one salted part of a length class.
PART = 100_000
#: Words that a worker keeps encoded; beyond that it starts anew.
CACHE = 200_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII symbols and digits before which a letter run ends; not '|', which the special tokens hold.
BREAK = np.zeros(256, dtype=bool)
BREAK[33:65] = BREAK[91:97] = True
BREAK[[123, 125, 126]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of parts of lower-cased bytes that the tokenizer treats apart from each other."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    letter = (data >= 97) & (data <= 122)
    accented = np.zeros_like(letter)  # two-byte letters U+00C0 to U+00FF
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros_like(solid)
    cut[1:] = (letter | accented)[:-1] & BREAK[data[1:]]
    begin = solid & (edge[:-1] | cut)
    begin[1:] |= solid[1:] & ~solid[:-1]
    starts = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | begin[1:]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Token ids of words, each encoded once while it is kept."""

    LETTERS = re.compile("[a-zà-öø-ÿß]+")

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.letters = byte_letters()
        self.reset()

    def reset(self) -> None:
        self.table = pd.Index(np.zeros(0, np.uint64))
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        model, letters = self.tokenizer.model, self.letters
        for k, w in enumerate(words):
            text = w.decode()
            if self.LETTERS.fullmatch(text) and unicodedata.is_normalized("NFC", text):
                out[k] = [t.id for t in model.tokenize(text if text.isascii() else "".join([letters[b] for b in w]))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def lookup(self, codes: np.ndarray, word_at) -> np.ndarray:
        """Places in ``sizes`` of words by hash; ``word_at`` gives the bytes of the k-th."""
        at = self.table.get_indexer(codes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.table) + len(new) > CACHE and len(self.table):
                self.reset()
                return self.lookup(codes, word_at)
            ids = self.encode([word_at(k) for k in new])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            at[new] = len(self.sizes) + np.arange(len(new))
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
            self.table = pd.Index(np.concatenate([self.table.to_numpy(), codes[new]]))
        return at


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """A worker's encoder, kept from batch to batch and task to task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def token_ids(data: np.ndarray, off: np.ndarray, words: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, END after each, and each text's number of ids."""
    n = len(off) - 1
    raw = data
    data = common.LOWER[data]
    starts, ends, row = units(data, off)
    special = set()
    mark = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) else []
    if len(mark):  # may spell a special token, which lower-casing would change
        special = set((np.searchsorted(off, mark, side="right") - 1).tolist())
    codes = common.span_hash(common.prefix_codes(data), starts, ends)
    unit, kinds = pd.factorize(codes)
    first = np.empty(len(kinds), np.int64)
    first[unit[::-1]] = np.arange(len(unit))[::-1]
    at = words.lookup(kinds, lambda k: data[starts[first[k]] : ends[first[k]]].tobytes())
    begin = np.cumsum(words.sizes) - words.sizes
    count = words.sizes[at][unit] if len(unit) else np.zeros(0, np.int64)
    flat = words.flat[common.ranges(begin[at][unit], count)] if len(unit) else np.zeros(0, np.uint32)
    per = np.bincount(row, count, minlength=n).astype(np.int64)
    if special:
        parts = np.split(flat, np.cumsum(per)[:-1])
        for r in special:
            parts[r] = np.array(words.tokenizer.encode(raw[off[r] : off[r + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            per[r] = len(parts[r])
        flat = np.concatenate(parts)
    total = np.cumsum(per + 1)
    out = np.empty(int(total[-1]) if n else 0, np.uint32)
    closing = total - 1
    keep = np.ones(len(out), dtype=bool)
    keep[closing] = False
    out[closing] = END
    out[keep] = flat
    return out, per + 1


def pieces(batches: Iterator[pa.RecordBatch], tokenizer_json: str) -> Iterator[pa.RecordBatch]:
    words = encoder(tokenizer_json)
    for batch in batches:
        data, off = common.utf8(batch.column("text"))
        rows, start, length, crc, tokens = [], [], [], [], []
        for i, j in common.chunks(off):
            ids, count = token_ids(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
            view, at = memoryview(ids.astype("<u4")).cast("B"), 0
            for r, n in enumerate(count.tolist(), i):
                for s in range(0, n, WINDOW):
                    m = min(WINDOW, n - s)
                    rows.append(r)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(view[4 * (at + s) : 4 * (at + s + m)]))
                    tokens.append(n)
                at += n
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, long)), batch.column("copy").take(pa.array(rows, long)), *(pa.array(x, long) for x in (start, length, crc, tokens))],
            names=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"],
        )


def capacity(bins: np.ndarray) -> np.ndarray:
    """The longest piece of each length class."""
    return np.where(bins <= EXACT, bins, (bins - EXACT + EXACT // UNIT) * UNIT)


def combinations(present: np.ndarray, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` of the long classes present whose capacities fill a window exactly."""
    have = set(present.tolist())
    sizes = {int(c): int(b) for b, c in zip(present, capacity(present), strict=True) if b > EXACT}
    order = sorted(sizes)
    out: list[tuple[int, ...]] = []

    def grow(rest: int, least: int, chosen: tuple[int, ...]) -> None:
        if rest in sizes and rest >= least:
            out.append((*chosen, sizes[rest]))
        if len(chosen) + 1 < depth:
            for c in order:
                if c >= least and 2 * c <= rest:
                    grow(rest - c, c, (*chosen, sizes[c]))

    grow(WINDOW, 1, ())
    assert all(set(c) <= have for c in out)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 0) -> np.ndarray:
    """min |ax - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x = np.zeros(n)
    active = np.zeros(n, dtype=bool)
    gram, target = a.T @ a, a.T @ b
    slope = target.copy()
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(steps or 3 * a.shape[0]):
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= tolerance:
            break
        active[k] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if z.min(initial=1) > 0:
                x[:] = 0
                x[on] = z
                break
            bad = z <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - z[bad], 1e-300))
            x[on] += step * (z - x[on])
            gone = on[(x[on] <= 1e-12) | (bad & (x[on] <= 1e-9))]
            if not len(gone):
                gone = on[bad][:1]
            active[gone] = False
            x[gone] = 0
            if not active.any():
                break
        slope = target - gram @ x
    return x


def patterns(histogram: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """(length classes of a sequence, repeats) that place every piece of the histogram exactly once."""
    left = {b: c for b, c in histogram.items() if c > 0}
    out = []
    present = np.array(sorted(left), dtype=np.int64)
    ways = combinations(present) if len(present) else []
    if ways:
        rows = {int(b): k for k, b in enumerate(b for b in present if b > EXACT)}
        a = np.zeros((len(rows), len(ways)))
        for k, way in enumerate(ways):
            for b in way:
                a[rows[b], k] += 1
        x = nnls(a, np.array([left[b] for b in rows], dtype=float))
        for k in np.argsort(-x, kind="stable"):
            way = ways[k]
            times = min(int(np.floor(x[k] + 1e-6)), *(left[b] // way.count(b) for b in way))
            if times > 0:
                out.append((way, times))
                for b in way:
                    left[b] -= times
    left = {b: c for b, c in left.items() if c}
    size = {b: int(capacity(np.array([b]))[0]) for b in left}
    while left:  # longest first; each pattern uses up a class
        room, way = WINDOW, {}
        for b in sorted(left, reverse=True):
            fit = min(room // size[b], left[b])
            if fit:
                way[b] = fit
                room -= fit * size[b]
        times = min(left[b] // c for b, c in way.items())
        out.append((tuple(b for b, c in way.items() for _ in range(c)), times))
        for b, c in way.items():
            left[b] -= c * times
            if not left[b]:
                del left[b]
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each class the runs of ranks in order: (first rank, first sequence, repeats, place in the sequence)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for way, times in plan:
        for place, b in enumerate(way):
            rank = used.get(b, 0)
            out.setdefault(b, []).append((rank, base, times, place))
            used[b] = rank + times
        base += times
    return out


def pack(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    frame = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("copy"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    common.small_batches(spark)
    cut = frame.mapInArrow(lambda batches: pieces(batches, sent.value), f"doc_id {kind}, copy long, start long, length long, ids_crc32 long, doc_tokens long")
    length = F.col("length")
    cut = cut.withColumn("bin", F.when(length <= EXACT, length).otherwise(EXACT - EXACT // UNIT + F.ceil(length / UNIT)).cast("int"))
    cut = common.Store(spark, "pack").save(cut, "pieces")
    histogram = {r.bin: r.n for r in cut.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most BINS rows
    runs = slots(patterns(histogram))
    parts = max(8, sum(histogram.values()) // PART)
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.lit(parts)).cast("int"))
    before = salted.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("bin", "part", (F.sum("n").over(Window.partitionBy("bin").orderBy("part")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("bin", "part").orderBy("doc_id", "copy", "start")) - 1)
    ranked = ranked.join(before, ["bin", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    where = spark.createDataFrame([(b, *map(list, zip(*r, strict=True))) for b, r in runs.items()], "bin int, ranks array<long>, firsts array<long>, repeats array<long>, places array<long>")
    placed = ranked.join(F.broadcast(where), "bin").withColumn("run", F.size(F.filter("ranks", lambda x: x <= F.col("rank"))))
    pick = lambda c: F.element_at(c, F.col("run"))
    placed = placed.withColumns({"sequence_id": pick("firsts") + F.col("rank") - pick("ranks"), "place": pick("places")})
    over = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(over) - F.col("length")).alias("offset"))
