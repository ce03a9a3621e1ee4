import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from votewright.llm import neighbours, packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((500, 12)).astype(np.float32)
    v[100:220] = v[7]  # many equal vectors
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(500)]
    odd = [(1000, None), (1001, [0.0] * 12), (1020, [float("nan")] + [1.0] * 11), (1040, [float("inf")] + [1.0] * 11), (1060, [None] + [1.0] * 11), (1080, []), (1100, [1.0, 2.0]), (1101, [2.0, 0.5]), (None, [1.0] * 12), rows[3]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'x' as score")
    d = v.astype(np.float64)
    want = {}
    for i in range(0, 500, 20):
        s = (d[i] * d).sum(axis=1)
        order = sorted((j for j in range(500) if j != i), key=lambda j: (-s[j], j))[:20]
        want[i] = order
    for blocks in ((2048, 8192), (7, 90)):
        got = {}
        for r in neighbours.nearest(frame, query_block=blocks[0], candidate_block=blocks[1]).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got.pop(1100) == [1101]
        assert got == want
    assert neighbours.nearest(frame.limit(0)).count() == 0


def check(texts, rows):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(by_seq)


def test_packing(spark):
    rng = np.random.default_rng(6)
    words = ["the", "Of", "thndor", "l'anelle", "é", "été,", "x1y2", "'s", "I'll", "Ça!?", "ß", "日本", "🙂", "a|b"]
    texts = {i: " ".join(rng.choice(words, int(rng.gamma(1, 500)))) for i in range(150)}
    texts |= {500: None, 501: "", 502: "the " * 12_000, 503: "<|endoftext|> and <|ENDOFTEXT|>", 504: "\x1c \x85z é K"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as length", "2 as bin")
    rows = packing.pack(frame, PATH).collect()
    used = check(texts, rows)
    assert sum(r.length for r in rows) > 0.9 * 4096 * (used - 2)
    assert packing.pack(frame.limit(0), PATH).count() == 0
    twice = packing.pack(frame.union(frame).where("doc_id < 20"), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) >= 40


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, packing.BINS), st.integers(1, 5000), max_size=30))
def test_patterns_place_each_piece_once(histogram):
    plan = packing.patterns(histogram)
    used = {}
    for way, times in plan:
        assert packing.capacity(np.array(way)).sum() <= 4096
        for b in way:
            used[b] = used.get(b, 0) + times
    assert used == histogram


def test_nnls():
    a = np.array([[1.0, 0], [1, 1], [0, 2]])
    assert np.allclose(packing.nnls(a, np.array([2.0, 5, 6])), [2, 3])
    assert np.allclose(packing.nnls(np.eye(2), np.array([-1.0, 3])), [0, 3])


def test_products_that_overflow_bounds(spark):
    rows = [(0, [1e155, 1.0]), (1, [1e150, 2.0]), (2, [2e155, 0.0]), (3, [-1e155, 5.0]), (4, [1.0, 1.0]), (5, [1e200, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r["rank"], r.score) for r in neighbours.nearest(frame).collect()}
    want = {i: sum(a * b for a, b in zip(rows[0][1], v, strict=True)) for i, v in rows[1:]}
    assert {i: s for i, (_, s) in got.items()} == want
    assert sorted(got, key=lambda i: got[i][0]) == sorted(want, key=lambda i: (-want[i], i))
