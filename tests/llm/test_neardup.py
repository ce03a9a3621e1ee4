import random
from collections import Counter

import numpy as np
import pyarrow as pa

from votewright.llm import neardup
from votewright.llm.components import components


def bag(text, n=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    wa, wb = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
    sa = neardup.signatures(h, np.zeros(40, np.int64), wa, 1, registers=20000)[0]
    sb = neardup.signatures(h, np.zeros(40, np.int64), wb, 1, registers=20000)[0]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sa == sb).mean() - want) < 0.015


def test_classes_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + rng.choice(["", "x", "y"])
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    docs += [(900, None), (901, ""), (902, "!!"), (903, "la " * 4000), (904, "la " * 4500), (905, "la " * 9000), (906, "One two"), (907, "one, TWO")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, docs[0][1], "y"), (*docs[0], "x")], "doc_id long, text string, node string").selectExpr("*", "1 as class_id")
    bags = {i: bag((t or "").replace(",", "").replace("!", "")) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, _ in docs]
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert got.pop(None) is None
    assert got == {i: root(i) for i in ids}
    kept = neardup.without_near_copies(frame).where("doc_id is not null").select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} == {root(i) for i in ids}
    assert neardup.classes(frame.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(bytes([k]), bytes([k + 1])) for k in range(60)] + [(b"\xf0", b"\xf1"), (b"\xf2", b"\xf1")]
    got = {bytes(r.node): bytes(r.label) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert set(got.values()) == {b"\x00", b"\xf0"} and len(got) == 64


def test_small_blocks_and_many_stars_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    monkeypatch.setattr(neardup, "BLOCK_WORDS", 300)
    assert {r.doc_id: r.class_id for r in neardup.classes(frame).collect()} == plain
    # links that no hub has: near copies in a chain, each 0.8 or more from the next
    chain = [(i, " ".join([*(f"c{k}" for k in range(4 * i, 4 * i + 60)), "z"])) for i in range(30)]
    classes = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    want, bags = list(range(30)), [bag(t) for _, t in chain]
    for i in range(1, 30):
        if similarity(bags[i], bags[i - 1]) >= 0.8:
            want[i] = want[i - 1]
    assert classes == dict(enumerate(want))


def test_similarities_are_exact():
    texts = ["a b c d e f g", "a b c d e f g h", "a b c d e a b c d e a b c d e", "", "a b", None]
    rows = np.arange(len(texts))
    bags = neardup.Bags(pa.array(texts))
    a, b = np.repeat(rows, len(rows)), np.tile(rows, len(rows))
    want = [similarity(bag(texts[i] or ""), bag(texts[j] or "")) for i, j in zip(a, b, strict=True)]
    assert np.allclose(bags.similarities(a, b), want)


def test_copies_are_removed_by_row(spark):
    say = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [(1, say("a"), "x"), (5, say("a") + " end", "x"), (5, say("b"), "x"), (7, say("c"), "x"), (7, say("c"), "x"), (7, say("c"), "y")]
    rows += [(None, say("a"), "x"), (None, say("d"), "x"), (None, say("d"), "x"), (None, say("d") + " end", "x"), (None, say("e"), "x"), (8, "--", "x"), (8, "--", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in neardup.without_near_copies(frame).collect()]
    near_d = {(None, say("d")), (None, say("d") + " end")}  # of rows without an id the hash decides
    assert len(near_d & set(got)) == 1
    want = [(1, say("a")), (5, say("b")), (7, say("c")), (None, say("e")), (8, "--")]
    assert sorted((g for g in got if g not in near_d), key=str) == sorted(want, key=str)
    assert len(got) == len(want) + 1
