"""Removal of repeated 100-byte strings by sharded, sparse enhanced suffix arrays.

A string that stands twice brings the same *anchor* twice: the smallest hash
among its 32-byte grams, leftmost if there are several. A text has about one
anchor for 35 bytes; each stands for the run of string starts it was chosen by.

1. Anchors are dealt by their hash. Runs whose whole bytes repeat an earlier
   run are covered at once (within a batch even before the shuffle, so a passage
   that a third of all texts hold costs a row for each batch). Anchors whose
   runs differ are the edges of repeats; their bytes are fetched.
2. In each shard the suffixes that begin at those anchors are sorted, common
   prefix lengths taken, and the tree of common-prefix intervals is walked by a
   stack scan. Each occurrence is covered as far as it extends, both ways,
   together with some earlier one: the best left agreement stands in for the
   test that left sides differ (``maximal_repeats``, which is not on this path).
   All occurrences of an interval are compared, not neighbours.
3. Anchors with more than ``HOT`` differing runs go another, equally exact way:
   the hashes of their strings are dealt instead, earliest first.
4. Covered spans are merged by document and the other bytes kept.

Defined results: a null text is empty: no bytes, no spans, the digest of the
empty string. Texts shorter than the string length lose nothing; texts are taken
whole, however long. Rows with a null doc_id come after all others; ids that are
not whole numbers are ordered as text. Further columns are ignored. Rows that repeat a doc_id and text are one
document and get the same answer each; other texts of a repeated doc_id are
taken as further texts of that document, in the order of their digests. An
empty table gives no rows. Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # the farthest start of a string before its anchor
#: Bytes of text for each shard and document bucket, about.
SHARD_BYTES = 4 << 20
#: Differing runs of one anchor that are still compared in a suffix array.
HOT = 20_000

ANCHOR = np.dtype([("h", "<u8"), ("r", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("size", "<i4")])
EDGE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("before", "u1"), ("after", "u1"), ("hot", "u1"), ("left", f"V{REACH}"), ("right", f"V{LENGTH}")])
EDGE_KEY = np.dtype([(c, EDGE[c]) for c in ("h", "doc", "at", "before", "after", "hot")])
STRING = np.dtype([("code", "<u8"), ("doc", "<i8"), ("at", "<i8")])
SCHEMA = "bucket int, kind int, payload binary"
ANCHORS, SPANS, EDGES, STRINGS = range(4)


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window of ``width`` values."""
    value, place, have = h, np.zeros(len(h), np.uint8), 1
    while 2 * have <= width:
        take = value[:-have] <= value[have:]
        place = np.where(take, place[:-have], place[have:] + np.uint8(have))
        value = np.where(take, value[:-have], value[have:])
        have *= 2
    if have < width:
        shift = width - have
        take = value[:-shift] <= value[shift:]
        place = np.where(take, place[:-shift], place[shift:] + np.uint8(shift))
    return np.arange(len(place)) + place


def anchors(data: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of texts, and the places of all their strings' hashes (for ``strings``)."""
    prefix = common.prefix_codes(data)
    starts = np.arange(max(len(data) - GRAM + 1, 0))
    grams = common.span_hash(prefix, starts, starts + GRAM)
    sizes = np.diff(off)
    first = common.ranges(off[:-1], np.maximum(sizes - LENGTH + 1, 0))  # string starts
    if not len(first):
        return np.zeros(0, ANCHOR), prefix
    chosen = leftmost_minima(grams, REACH + 1)[first]
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    new = np.ones(len(first), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(first)) - 1
    out = np.zeros(len(begin), ANCHOR)
    at, low, high, r = chosen[begin], first[begin], first[end], row[begin]
    out["h"], out["doc"], out["at"] = grams[at], ids[r], at - off[r]
    out["before"], out["after"] = at - low, high + REACH - at  # the run's starts: at - before .. at - REACH + after
    out["r"] = common.mix(common.span_hash(prefix, low, high + LENGTH) + out["before"].astype(np.uint64) * common.PRIME + out["after"])
    return out, prefix


def run_span(a: np.ndarray) -> np.ndarray:
    """The bytes that an anchor's run of strings covers."""
    out = np.zeros(len(a), SPAN)
    out["doc"], out["start"] = a["doc"], a["at"] - a["before"]
    out["size"] = a["before"].astype(np.int64) + a["after"] + LENGTH - REACH
    return out


def firsts(a: np.ndarray, key: str) -> np.ndarray:
    """Order by key, document and place, and where each key's earliest row stands in it."""
    order = np.lexsort((a["at"], a["doc"], a[key]))
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[key][order][1:] != a[key][order][:-1]
    return order, new


def dealt(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(bucket[part[0]]), kind, rows[part].tobytes()


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "kind", "payload"])


def rows_of(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    parts = [p for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(parts), dtype)


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return doc % buckets


def find_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = common.utf8(batch.column("text"))
        ids = batch.column("id").to_numpy()
        parts = [anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], ids[i:j])[0] for i, j in common.chunks(off)]
        found = np.concatenate([*parts, np.zeros(0, ANCHOR)])
        order, new = firsts(found, "r")
        keep, later = found[np.sort(order[new])], run_span(found[np.sort(order[~new])])
        yield batch_of([*dealt(keep, (keep["h"] % np.uint64(buckets)).astype(np.int64), ANCHORS), *dealt(later, doc_bucket(later["doc"], buckets), SPANS)])


def meet(table: pa.Table, buckets: int) -> pa.Table:
    """A shard's anchors: repeated runs become spans, runs that differ under one anchor become edges; spans pass."""
    a = rows_of(table, ANCHORS, ANCHOR)
    out = [(b, k, p) for b, k, p in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True) if k == SPANS]
    order, new = firsts(a, "r")
    later, kept = run_span(a[order[~new]]), a[order[new]]
    _, which, runs = np.unique(kept["h"], return_inverse=True, return_counts=True)
    edge = kept[runs[which] > 1]
    hot = (runs[which] > HOT)[runs[which] > 1]
    e = np.zeros(len(edge), EDGE_KEY)
    for c in ("h", "doc", "at", "before", "after"):
        e[c] = edge[c]
    e["hot"] = hot
    out += dealt(later, doc_bucket(later["doc"], buckets), SPANS)
    out += dealt(e, doc_bucket(e["doc"], buckets), EDGES)
    return pa.Table.from_batches([batch_of(out)])


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of a bucket's texts in order of id, and the ids."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    data, off = common.utf8(table.column("text").take(pa.array(order)))
    return data, off, ids[order]


def fetch(docs: pa.Table, edges: pa.Table, buckets: int) -> pa.Table:
    """The bytes around a bucket's edge anchors, dealt by anchor; hot ones as hashes of their strings."""
    e = rows_of(edges, EDGES, EDGE_KEY)
    if not len(e) or not docs.num_rows:
        return pa.Table.from_batches([batch_of([])])
    data, off, ids = texts_of(docs)
    e = e[np.lexsort((e["at"], e["doc"]))]
    row = np.searchsorted(ids, e["doc"])
    place = off[row] + e["at"]
    out: list = []
    cold = e["hot"] == 0
    c, p = e[cold], place[cold]
    if len(c):
        full = np.zeros(len(c), EDGE)
        for name in ("h", "doc", "at", "before", "after"):
            full[name] = c[name]
        wide = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        left = wide[(p + REACH)[:, None] - 1 - np.arange(REACH)[None, :]]  # backwards from the anchor
        right = wide[(p + REACH)[:, None] + np.arange(LENGTH)[None, :]]
        left, right = left + np.uint8(1), right + np.uint8(1)  # UTF-8 has no byte 255, so 0 is free for "beyond the run"
        left[np.arange(REACH)[None, :] >= c["before"][:, None]] = 0
        right[np.arange(LENGTH)[None, :] >= (c["after"].astype(np.int64) + LENGTH - REACH)[:, None]] = 0
        full["left"], full["right"] = np.ascontiguousarray(left).view(f"V{REACH}")[:, 0], np.ascontiguousarray(right).view(f"V{LENGTH}")[:, 0]
        out += dealt(full, (c["h"] % np.uint64(buckets)).astype(np.int64), EDGES)
    w, p = e[~cold], place[~cold]
    if len(w):
        many = w["before"].astype(np.int64) + w["after"] - REACH + 1
        start = common.ranges(p - w["before"], many)
        rows = np.zeros(len(start), STRING)
        rows["code"] = common.span_hash(common.prefix_codes(data), start, start + LENGTH)
        r = np.repeat(row[~cold], many)
        rows["doc"], rows["at"] = ids[r], start - off[r]
        order, new = firsts(rows, "code")
        later = np.zeros(int((~new).sum()), SPAN)
        gone = rows[order[~new]]
        later["doc"], later["start"], later["size"] = gone["doc"], gone["at"], LENGTH
        kept = rows[order[new]]
        out += dealt(kept, (kept["code"] % np.uint64(buckets)).astype(np.int64), STRINGS)
        out += dealt(later, doc_bucket(later["doc"], buckets), SPANS)
    return pa.Table.from_batches([batch_of(out)])


def agreement(m: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows a and b of ``m`` share, at most the smaller of their sizes."""
    differ = m[a] != m[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Common-prefix intervals (length, parent's length, first, last) of at least ``least``, by a stack scan; lcp[i]: of suffixes i - 1 and i."""
    stack: list[list[int]] = []
    values = lcp.tolist()
    for i in range(1, len(values) + 1):
        v = values[i] if i < len(values) else 0
        left = i - 1
        while stack and stack[-1][0] > v:
            length, left = stack.pop()
            yield length, max(v, stack[-1][0] if stack else 0), left, i - 1
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append([v, left])


class SuffixShard:
    """The enhanced suffix array over the suffixes that begin at anchors."""

    def __init__(self, e: np.ndarray):
        self.right = np.ascontiguousarray(e["right"]).view(np.uint8).reshape(len(e), LENGTH)
        self.left = np.ascontiguousarray(e["left"]).view(np.uint8).reshape(len(e), REACH)
        self.right_size = e["after"].astype(np.int64) + LENGTH - REACH
        self.left_size = e["before"].astype(np.int64)
        words = np.zeros((len(e), 104), np.uint8)
        words[:, :LENGTH] = self.right
        keys = words.view(">u8").astype(np.uint64)
        self.order = np.lexsort((*keys.T[::-1], e["h"]))
        o = self.order
        self.lcp = np.zeros(len(e), np.int64)
        if len(e) > 1:
            same = e["h"][o[1:]] == e["h"][o[:-1]]
            self.lcp[1:] = np.where(same, agreement(self.right, self.right_size, o[:-1], o[1:]), 0)
        words = np.zeros((len(e), 72), np.uint8)
        words[:, :REACH] = self.left
        by_left = np.lexsort(words.view(">u8").astype(np.uint64).T[::-1])
        self.left_rank = np.empty(len(e), np.int64)
        self.left_rank[by_left] = np.arange(len(e))
        when = np.lexsort((e["at"], e["doc"]))
        self.time = np.empty(len(e), np.int64)
        self.time[when] = np.arange(len(e))

    def best_left(self, members: np.ndarray) -> np.ndarray:
        """For each member the longest left agreement with an earlier one (-1: there is none).

        Members stand in order of their left sides in a linked list, from which
        the latest is taken out time and again: its neighbours then hold the
        best agreement with all that are earlier.
        """
        m = members[np.argsort(self.left_rank[members], kind="stable")]
        n = len(m)
        near = [-1, *agreement(self.left, self.left_size, m[:-1], m[1:]).tolist(), -1]  # with the one before
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        best = [-1] * n
        for x in np.argsort(-self.time[m]).tolist():
            a, b = before[x], after[x]
            up, down = near[x] if a >= 0 else -1, near[b] if b < n else -1
            best[x] = max(up, down)
            if b < n:
                before[b] = a
                near[b] = min(up, down) if a >= 0 else -1
            if a >= 0:
                after[a] = b
        out = np.full(len(members), -1, np.int64)
        place = {int(v): k for k, v in enumerate(members)}
        for x, v in enumerate(m.tolist()):
            out[place[v]] = best[x]
        return out

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bytes to the left, bytes to the right) that an earlier row repeats, at least LENGTH together."""
        two, rows, lefts, rights = [], [], [], []
        for length, parent, i, j in intervals(self.lcp, GRAM):
            if j == i + 1:
                two.append((length, i, j))
            else:
                members = self.order[i : j + 1]
                best = self.best_left(members)
                on = best + length >= LENGTH
                rows.append(members[on])
                lefts.append(best[on])
                rights.append(np.full(int(on.sum()), length))
        if two:
            length, i, j = np.array(two).T
            a, b = self.order[i], self.order[j]
            best = agreement(self.left, self.left_size, a, b)
            later = np.where(self.time[a] > self.time[b], a, b)
            on = best + length >= LENGTH
            rows.append(later[on])
            lefts.append(best[on])
            rights.append(length[on])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(rows + none), np.concatenate(lefts + none), np.concatenate(rights + none)

    def maximal_repeats(self, least: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
        """(length, rows of all occurrences) of the intervals whose left sides differ; the length counts from the anchor on."""
        for length, _, i, j in intervals(self.lcp, least):
            m = self.order[i : j + 1]
            ends = self.left_size[m] == 0
            if ends.any() or len(np.unique(self.left[m, 0])) > 1:
                yield length, m


def extend(table: pa.Table, buckets: int) -> pa.Table:
    """A shard's edges and strings become covered spans."""
    out: list = [(b, k, p) for b, k, p in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True) if k == SPANS]
    e = rows_of(table, EDGES, EDGE)
    if len(e):
        row, left, right = SuffixShard(e).covered()
        s = np.zeros(len(row), SPAN)
        s["doc"], s["start"], s["size"] = e["doc"][row], e["at"][row] - left, left + right
        out += dealt(s, doc_bucket(s["doc"], buckets), SPANS)
    w = rows_of(table, STRINGS, STRING)
    if len(w):
        order, new = firsts(w, "code")
        gone = w[order[~new]]
        s = np.zeros(len(gone), SPAN)
        s["doc"], s["start"], s["size"] = gone["doc"], gone["at"], LENGTH
        out += dealt(s, doc_bucket(s["doc"], buckets), SPANS)
    return pa.Table.from_batches([batch_of(out)])


def finish(docs: pa.Table, spans: pa.Table) -> pa.Table:
    data, off, ids = texts_of(docs)
    s = rows_of(spans, SPANS, SPAN)
    row = np.searchsorted(ids, s["doc"])
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, off[row] + s["start"], 1)
    np.add.at(depth, off[row] + s["start"] + s["size"], -1)
    gone = np.cumsum(depth[:-1]) > 0
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    inner = off[:-1][np.diff(off) > 0]
    begin[inner] = gone[inner]
    removed, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begin))
    del depth, begin
    digests, kept = [], ~gone
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        digests.append(hashlib.sha256(data[a:b][kept[a:b]].tobytes()).hexdigest())
    return pa.table({
        "id": pa.array(ids), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array((removed[off[1:]] - removed[off[:-1]]).astype(np.int64)),
        "n_spans": pa.array((runs[off[1:]] - runs[off[:-1]]).astype(np.int64)), "kept_sha256": pa.array(digests, pa.string()),
    })


def remove_repeats(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    kind = documents.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    common.small_batches(documents.sparkSession)
    rows = documents.select(common.order_id(documents).alias("id"), text.alias("text"))
    back = lambda df: df.select(F.when(F.col("id") != F.lit(last), F.col("id")).cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    whole = rows.schema["id"].dataType.typeName() == "long"
    last = common.LAST_ID if whole else chr(0x10FFFF)
    if whole and rows.groupBy("id").count().where("count > 1").isEmpty():
        return back(_removed(rows, shard_bytes))
    marked = rows.withColumn("mark", F.sha2("text", 256))
    single = marked.dropDuplicates(["id", "mark"]).orderBy("id", "mark").withColumn("number", F.monotonically_increasing_id())
    single = common.Store(documents.sparkSession, "repeats").save(single, "single")  # growing numbers in order of id and mark
    done = _removed(single.select(F.col("number").alias("id"), "text"), shard_bytes).withColumnRenamed("id", "number")
    named = single.select("id", "mark", "number").join(done, "number").drop("number")
    return back(marked.select("id", "mark").join(named, ["id", "mark"]))


def _removed(rows: DataFrame, shard_bytes: int) -> DataFrame:
    total = rows.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(total // shard_bytes) | 1
    found = rows.mapInArrow(lambda batches: find_anchors(batches, buckets), SCHEMA)
    met = common.Store(rows.sparkSession, "repeats").save(found.groupBy("bucket").applyInArrow(lambda t: meet(t, buckets), SCHEMA), "met")
    docs = rows.select("id", "text", F.pmod("id", F.lit(buckets)).cast("int").alias("bucket"))
    edges = met.where(F.col("kind") == EDGES)
    around = docs.groupBy("bucket").cogroup(edges.groupBy("bucket")).applyInArrow(lambda d, e: fetch(d, e, buckets), SCHEMA)
    spans = around.groupBy("bucket").applyInArrow(lambda t: extend(t, buckets), SCHEMA).unionByName(met.where(F.col("kind") == SPANS))
    return docs.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
