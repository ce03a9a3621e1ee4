import hashlib
import random

import numpy as np
import pytest

from votewright.llm import repeats


def brute(docs):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            x = b[s : s + 100]
            if x in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcd éß\x00🙂") for _ in range(n))
    passages = [say(rng.choice([90, 99, 100, 101, 130, 400])) for _ in range(8)]
    docs = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "Z" + p[k + 1 :]
            parts += [say(rng.randint(0, 60)), p[: rng.choice([len(p), len(p), 110])]]
        docs.append((i * 3, "".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "a" * 5000), (1003, "ab" * 300), (1004, "a" * 99), (1005, passages[0] * 3), (1006, docs[5][1]), (1007, "xyz " * 2000 + "end")]
    return docs


@pytest.mark.parametrize("seed, hot, shard", [(1, 20_000, 1 << 24), (2, 20_000, 2000), (3, 2, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, hot, shard):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as bucket")
    if hot == 2:  # workers import the module anew, so the small bound is tried without Spark
        import pyarrow as pa

        n = 5
        batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in docs], "text": [t or "" for _, t in docs]})
        by = lambda tables: {b: t.filter(pa.compute.equal(t.column("bucket"), b)) for t in [pa.concat_tables(tables)] for b in set(t.column("bucket").to_pylist())}
        found = by([pa.Table.from_batches(list(repeats.find_anchors(iter([batch]), n)))])
        met = by([repeats.meet(t, n) for t in found.values()])
        parts = {b: pa.Table.from_batches([batch]).filter(pa.array([i % n == b for i, _ in docs])) for b in range(n)}
        around = by([repeats.fetch(parts[b], t.filter(pa.compute.equal(t.column("kind"), repeats.EDGES)), n) for b, t in met.items()])
        assert any(repeats.STRINGS in t.column("kind").to_pylist() for t in around.values())
        spans = by([*(repeats.extend(t, n) for t in around.values()), *(t.filter(pa.compute.equal(t.column("kind"), repeats.SPANS)) for t in met.values())])
        empty = found[next(iter(found))].slice(0, 0)
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for b, t in parts.items() if t.num_rows for r in repeats.finish(t, spans.get(b, empty)).to_pylist()}
    else:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame, shard).collect()}
    want = brute(docs)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert got.keys() == want.keys()


def test_odd_rows(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefg") for _ in range(300))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame).collect())
    assert got == [(1, 300, 0, 0), (1, 300, 0, 0), (2, 300, 300, 1), (99, 0, 0, 0), (99, 300, 300, 1)]
    assert repeats.remove_repeats(frame.limit(0)).count() == 0


def test_intervals_hold_all_occurrences():
    rng = np.random.default_rng(0)
    e = np.zeros(40, repeats.EDGE)
    right = rng.integers(1, 3, (40, 100)).astype(np.uint8)
    right[:25, :40] = right[0, :40]
    e["right"] = np.ascontiguousarray(right).view("V100")[:, 0]
    e["left"] = np.ascontiguousarray(rng.integers(1, 3, (40, 68)).astype(np.uint8)).view("V68")[:, 0]
    e["before"], e["after"], e["at"] = 68, 68, np.arange(40)
    found = {n: set(m.tolist()) for n, m in repeats.SuffixShard(e).maximal_repeats(40)}
    assert set(range(25)) in found.values()
