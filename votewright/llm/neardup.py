"""Near-duplicate documents by BagMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles (lower-cased words; a text
of one to four words is one shingle). Its signature estimates the weighted
Jaccard similarity without bias: the unit levels of every shingle's weight lie
in dyadic blocks [0,1), [1,2), [2,4), [4,8), ..., each with its own Poisson
process of points; a point falls on a register and on a level of its block and
counts if the level lies under the weight; a register keeps its earliest point.
Points later than a document's bound on its slowest register are never drawn.

``BANDS`` bands of ``ROWS`` registers: two documents with similarity 0.8 meet
in a band but for 2 in 100,000 cases. Equal word sequences are one node from
the start. In each bucket every node is first compared with the bucket's hub,
the node that meets most others in all buckets, exactly on multisets; the
components of the links found are formed. Then the pairs of a bucket that are
still apart are compared, but for those that cannot reach the threshold: the
distances to the hub differ by more than the threshold allows (1 - similarity is
a metric), the sizes do, or sketches of one bit a register differ more than
they do in 1 of 100,000 cases at the threshold. So a large group of copies costs
one comparison a member.

Comparisons are dealt in blocks of bounded size: a text goes once to each block
that needs it, and a hub that a third of all documents resemble has as many
blocks as it takes.

Defined results: documents without words (null and empty texts too) are classes
of their own; texts are taken whole, however long; rows with a null doc_id are
compared with none and get a null class (but are compared where copies are
removed, see ``without_near_copies``); rows that repeat a doc_id and text fall
into one class; the class id is its smallest doc_id, so ties do not matter. An
empty table gives no rows. Further columns are ignored by ``classes`` and kept
by ``without_near_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: A register of a document is empty after the first bound with a chance of e ** -MARGIN / REGISTERS.
MARGIN = 6.0
#: Registers of which a sketch keeps a bit, and the most bits that may differ at the threshold: 4.5 deviations above the mean.
SKETCH = 128
#: Words of the texts compared in one block, about.
BLOCK_WORDS = 500_000
STEP = np.uint64(0xA0761D6478BD642F)


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hash and row of every shingle, and a digest of each row's words (empty: none)."""
    data = common.LOWER[data]
    starts, ends, row = common.word_spans(data, off)
    n = len(off) - 1
    words = common.span_hash(common.prefix_codes(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    raw = memoryview(words.astype("<u8")).cast("B")
    digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    at = common.ranges(first[:-1], np.maximum(count - size + 1, 0))
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = h * common.PRIME + words[at + j]
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.array([np.uint64(int.from_bytes(digests[r][:8], "little")) for r in short], dtype=np.uint64)
    return np.concatenate([common.mix(h), extra]), np.concatenate([row[at], short]).astype(np.int64), digests


def weights(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle), sorted, and their multiplicities."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, row: np.ndarray, w: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The earliest point (its time's bits) of each register of each of ``n`` rows; all ones where a row is empty."""
    out = np.full((n, registers), np.inf)
    total = np.bincount(row, w, minlength=n)
    with np.errstate(divide="ignore"):
        bound = (np.log(registers) + MARGIN) / total
    todo = total > 0
    while todo.any():
        pick = np.flatnonzero(todo[row])
        _points(h[pick], row[pick], w[pick], bound, out)
        todo &= np.isinf(out).any(axis=1)
        out[todo] = np.inf
        bound = np.where(todo, bound * 2, bound)
    return out.view(np.uint64)


def times(a: np.uint64, k: int) -> np.uint64:
    return np.uint64(int(a) * k & (1 << 64) - 1)


def _points(h: np.ndarray, row: np.ndarray, w: np.ndarray, bound: np.ndarray, out: np.ndarray) -> None:
    registers = out.shape[1]
    flat = out.reshape(-1)
    low, block = 0, 0
    while len(h):
        size = max(1, low)
        seed = common.mix(h + times(STEP, block + 1))
        owner, weight, limit = row, w, bound[row]
        time = np.zeros(len(h))
        k = 0
        while len(seed):
            k += 1
            draw = common.mix(seed + times(common.PRIME, k))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (registers * size)
            live = time <= limit
            seed, owner, weight, limit, time, draw = (x[live] for x in (seed, owner, weight, limit, time, draw))
            spot = common.mix(draw + STEP)
            register = ((spot >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
            if size == 1:
                on = slice(None)
            else:
                level = low + (((spot & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
                on = level < weight
            np.minimum.at(flat, owner[on] * registers + register[on].astype(np.int64), time[on])
        low, block = max(1, 2 * low), block + 1
        more = w > low
        h, row, w = h[more], row[more], w[more]


def band_codes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit code for each band, with the band's number mixed in."""
    parts = sig.reshape(len(sig), bands, -1)
    code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)) * STEP
    for k in range(parts.shape[2]):
        code = common.mix(code * common.PRIME + parts[:, :, k])
    return code.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of mixed registers, 64 to a number."""
    bits = (common.mix(sig[:, :SKETCH]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def sketch_limit(threshold: float, registers: int = SKETCH) -> int:
    p = (1 - threshold) / 2
    return int(registers * p + 4.5 * (registers * p * (1 - p)) ** 0.5)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = common.utf8(batch.column("text"))
        nodes, codes, bits, sizes = [], [], [np.zeros((0, SKETCH // 64), np.int64)], [np.zeros(0, np.int64)]
        for i, j in common.chunks(off):
            h, row, digests = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sig = signatures(*weights(h, row), j - i)
            codes.append(band_codes(sig))
            bits.append(sketches(sig))
            sizes.append(np.bincount(row, minlength=j - i))
            nodes += digests
        flat = np.concatenate(codes).reshape(-1) if codes else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), pa.array(flat))
        sketch = np.concatenate(bits)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.binary()), bands, pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(np.concatenate(sizes))],
            names=["doc_id", "mark", "node", "bands", "bits0", "bits1", "size"],
        )


class Bags:
    """The shingle multisets of texts: numbers that stand for (shingle, how often it came before)."""

    def __init__(self, texts: pa.Array):
        data, off = common.utf8(texts)
        keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in common.chunks(off):
            h, row, _ = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
            keys.append(common.mix(h + place.astype(np.uint64) * STEP))
            sizes.append(np.bincount(row, minlength=j - i))
        kinds, self.numbers = np.unique(np.concatenate(keys), return_inverse=True)
        self.sizes = np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(kinds), dtype=bool)

    def similarities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of each pair of rows, exactly."""
        out = np.zeros(len(a))
        order = np.argsort(b, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else []:
            one = int(b[part[0]])
            mine = self.numbers[self.starts[one] : self.starts[one] + self.sizes[one]]
            self.mark[mine] = True
            n = self.sizes[a[part]]
            hit = np.concatenate([[0], np.cumsum(self.mark[self.numbers[common.ranges(self.starts[a[part]], n)]])])
            ends = np.cumsum(n)
            both = hit[ends] - hit[ends - n]
            out[part] = both / np.maximum(n + len(mine) - both, 1)
            self.mark[mine] = False
        return out


def named_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and text of the texts with words; of equal nodes in a task the first."""
    seen: set[bytes] = set()
    for batch in batches:
        data, off = common.utf8(batch.column("text"))
        nodes, keep = [], []
        for i, j in common.chunks(off):
            for r, x in enumerate(shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])[2], i):
                if x and x not in seen:
                    seen.add(x)
                    nodes.append(x)
                    keep.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text").take(pa.array(keep, pa.int64()))], names=["node", "text"])


def compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """a, b and sim of a block's pairs."""
    place = {x: k for k, x in enumerate(texts.column("node").to_pylist())}
    a, b = (np.array([place[x] for x in pairs.column(c).to_pylist()], np.int64) for c in ("a", "b"))
    sim = Bags(texts.column("text")).similarities(a, b)
    return pa.table([pairs.column("a"), pairs.column("b"), pa.array(sim)], names=["a", "b", "sim"])


def compared(pairs: DataFrame, texts: DataFrame, store: common.Store, star: bool) -> DataFrame:
    """``pairs`` (a, b, hub, words) with sim instead of hub and words; ``star``: b is the hub of each pair.

    The pairs of a hub form a matrix that is cut into blocks of about BLOCK_WORDS words; small hubs share blocks.
    """
    sums = pairs.groupBy("hub").agg(F.sum("words").alias("all"))
    total = pairs.agg(F.sum("words")).first()[0] or 0
    blocks = int(total // BLOCK_WORDS) + 1
    share = F.col("all") / F.lit(BLOCK_WORDS)
    cuts = F.ceil(share if star else F.sqrt(share)).cast("long")
    cell = lambda c: F.pmod(F.xxhash64(c), cuts)
    block = F.pmod(F.xxhash64("hub", cell("a"), F.lit(0) if star else cell("b")), F.lit(blocks)).cast("int")
    dealt = store.save(pairs.join(sums, "hub").select("a", "b", block.alias("block")), "dealt")
    needed = store.save(dealt.select(F.col("block").alias("slot"), F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    needed = texts.join(common.small(needed), "node")
    return dealt.groupBy("block").cogroup(needed.groupBy("slot")).applyInArrow(compare, "a binary, b binary, sim double")


def marked(documents: DataFrame) -> DataFrame:
    """doc_id, text and mark (the text's hash) of each row."""
    text = F.col("text").cast("string")
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))


def signed_rows(documents: DataFrame, store: common.Store) -> DataFrame:
    """doc_id, mark, node (a digest of the text's words), bands, sketch and size (shingles) of each row."""
    common.small_batches(documents.sparkSession)
    rows = marked(documents)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return store.save(rows.mapInArrow(sign, f"doc_id {kind}, mark long, node binary, bands array<long>, bits0 long, bits1 long, size long"), "signed")


def labelled(documents: DataFrame, signed: DataFrame, store: common.Store, threshold: float) -> DataFrame:
    """node, its row (rep and mark: the smallest doc_id, null last) and label (its class) of each node with words."""
    worded = signed.where(F.octet_length("node") > 0)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("r")
    kept = worded.groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("bands", "bits0", "bits1", "size")))
    nodes = store.save(kept.select("node", F.col("r.doc_id").alias("rep"), "r.mark", "bands", "bits0", "bits1", "size"), "nodes")
    rungs = nodes.select("node", "bits0", "bits1", "size", F.explode("bands").alias("code"))
    sizes = store.save(rungs.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = store.save(common.thinned(rungs, F.col("code"), sizes, F.col("code")).join(sizes, "code"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "node").groupBy("code").agg(F.max(F.struct("degree", "node", "size")).alias("h")).select("code", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"))
    cells = store.save(members.join(hubs, "code"), "cells")
    stars = cells.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "hub", (F.col("size") + F.col("hub_size")).alias("words")).distinct()
    stars = store.save(stars, "stars")

    reps = nodes.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select(F.struct("rep", "mark").alias("at"))
    kept = common.thinned(marked(documents), F.struct(F.col("doc_id").alias("rep"), "mark"), store.save(reps, "reps"), F.col("at"))
    texts = store.save(kept.select("text").mapInArrow(named_texts, "node binary, text string"), "texts")

    scored = store.save(compared(stars, texts, store, True), "scored")
    links = scored.where(F.col("sim") >= threshold).select("a", "b")
    label = components(links, store)

    toward = scored.select(F.col("a").alias("node"), F.col("b").alias("hub"), "sim")
    held = cells.join(label, "node", "left").join(toward, ["node", "hub"], "left")
    held = held.select("code", "node", "hub", "bits0", "bits1", "size", F.coalesce("label", "node").alias("label"), F.coalesce("sim", F.lit(1.0)).alias("sim"))
    held = store.save(held, "held")
    mixed = held.groupBy("code").agg((F.min("label") != F.max("label")).alias("apart")).where("apart")
    apart = store.save(held.join(mixed, "code", "left_semi"), "apart")
    store.drop(members, sizes, cells, held)
    named = lambda x: apart.select("code", *(F.col(c).alias(f"{x}_{c}") for c in apart.columns if c != "code"))
    far = lambda k: F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}")))
    n, m = F.col("a_size"), F.col("b_size")
    able = (F.abs(F.col("a_sim") - F.col("b_sim")) <= 1 - threshold + 1e-9) & (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (far("bits0") + far("bits1") <= sketch_limit(threshold))
    rest = named("a").join(named("b"), "code").where((F.col("a_node") > F.col("b_node")) & (F.col("a_label") != F.col("b_label")) & able)
    rest = rest.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.min("a_hub").alias("hub"), F.first(n + m).alias("words"))
    done = scored.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = store.save(rest.join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = store.save(compared(rest, texts, store, False).where(F.col("sim") >= threshold).select("a", "b"), "more")
        if not more.isEmpty():
            label = components(links.unionByName(more), store)
    store.drop(apart, rest, texts, stars, scored)
    return nodes.select("node", "rep", "mark").join(label, "node", "left").select("node", "rep", "mark", F.coalesce("label", "node").alias("label"))


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and class_size (documents of the class) of each document."""
    store = common.Store(documents.sparkSession, "neardup")
    known = documents.where("doc_id is not null")
    signed = signed_rows(known, store)
    nodes = labelled(known, signed, store, threshold)
    least = nodes.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = nodes.join(least, "label").select("node", "class_id")
    sized = signed.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    sized = store.save(sized, "sized")
    sizes = sized.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    done = sized.join(sizes, "class_id").select("doc_id", "class_id", "class_size")
    kind = documents.schema["doc_id"].dataType.simpleString()
    lone = documents.where("doc_id is null").select("doc_id", F.lit(None).cast(kind).alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return done.unionByName(lone)


def without_near_copies(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with one row of each class: the one with the smallest doc_id, rows without an id last.

    Rows are known by doc_id and the text's hash, and rows with a null doc_id
    are compared like all others. Of rows equal in both, one stays. Rows whose
    texts are equal but have no words (as line dedup leaves copies) are one
    class here; null texts are equal to none of another doc_id.
    """
    store = common.Store(documents.sparkSession, "neardup")
    signed = signed_rows(documents, store)
    nodes = labelled(documents, signed, store, threshold)
    least = nodes.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "mark")).alias("r"))
    keepers = least.select(F.col("r.rep").alias("gone_id"), F.col("r.mark").alias("gone_mark"))
    rows = signed.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("node") > 0).alias("worded"))
    told = rows.where(F.col("mark") != F.xxhash64(F.lit(None).cast("string")))
    wordless = told.where("not worded").groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("r"))
    keepers = keepers.unionByName(wordless.select(F.col("r.doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")))
    kept = F.expr("doc_id <=> gone_id and mark = gone_mark")
    gone = store.save(told.join(keepers, kept, "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")), "gone")
    repeated = store.save(rows.where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")), "repeated")
    whole = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), F.struct(*documents.columns).alias("whole"))
    stay = whole.join(gone, kept, "left_anti")
    if not repeated.isEmpty():
        once = stay.join(repeated, kept, "left_semi").groupBy("doc_id", "mark").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
        stay = stay.join(repeated, kept, "left_anti").select("whole").unionByName(once.select("whole"))
    return stay.select("whole.*")
