"""Helpers shared by the operators: UTF-8 buffers of Arrow columns, word spans and hashes, checkpoints."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
CHUNK_BYTES = 512 << 10
#: Bits of the bitmaps that thin a table before it is joined; they let through more where they fill up, and lose nothing.
FILTER_BITS = 1 << 22

_RNG = np.random.default_rng(20240607)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept between calls."""
    have = _POWERS.get(name)
    if have is None or len(have) <= n:
        have = np.empty(max(n + 1, CHUNK_BYTES + 1), dtype=np.uint64)
        have[0] = 1
        have[1:] = base
        have = np.cumprod(have, dtype=np.uint64)
        if n <= CHUNK_BYTES:  # those of a longer text are not kept
            _POWERS[name] = have
    return have[: n + 1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of rows with about ``limit`` bytes; each row lies in exactly one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and each word's row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = WORD_BYTE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True  # words do not cross texts
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``span_hash`` gives the hash of any span."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODES[data] * powers(len(data), PRIME, "up")[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, mixed; independent of where a span stands."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix), INVERSE, "down")[starts]
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def crc_mod(column: Column, n: int = 5) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


#: The most rows of a narrow table that is broadcast.
SMALL_ROWS = 300_000
#: Bytes of an Arrow batch that a Python worker is sent.
BATCH_BYTES = 4 << 20
LAST_ID = (1 << 63) - 1


#: Arrays of 1 MB and more are given back to the system as soon as they are freed.
ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, and its Python workers do not hold on to freed memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    for name, value in ALLOCATOR.items():
        spark.sparkContext.environment.setdefault(name, value)


def order_id(documents: DataFrame) -> Column:
    """doc_id as a value that orders rows, null last: whole numbers as long, all other kinds as text."""
    if documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long", "void"):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(chr(0x10FFFF)))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context; one beneath the warehouse where neither is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_for = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_for.get() if set_for.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def checkpoint_folder(spark: SparkSession, name: str = "pipeline") -> str:
    """A new folder's name within the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Tables written as Parquet to the shared folder, so that a lost executor costs no more than the work since the last one.

    The shuffle files of a plan go as soon as its table stands. ``drop`` deletes
    tables that are no longer needed; those of the returned, still lazy result stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, checkpoint_folder(spark, name), {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            path = hadoop(self.paths[table])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def thinned(table: DataFrame, column: Column, wanted: DataFrame, key: Column) -> DataFrame:
    """The rows of ``table`` whose ``column`` may be among the values of ``key`` in ``wanted``: all that are, and few others.

    They are told by a broadcast bitmap of ``FILTER_BITS`` bits, whatever the
    input's size; where it is full, all rows pass.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at"))
    words = wanted.select(at(key).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    mine = at(column)
    return table.join(F.broadcast(words), F.shiftright(mine, 6) == F.col("_word")).where(F.getbit("_bits", mine.bitwiseAND(F.lit(63))) == 1).drop("_word", "_bits")


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written, narrow ``table``, to be broadcast in a join if it has at most so many ``rows``; else the join shuffles."""
    return F.broadcast(table) if table.count() <= rows else table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def constant(values, kind: str) -> Column:
    """A constant array of numbers, sent to the planner as one string rather than one expression each."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
