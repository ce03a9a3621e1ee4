import hashlib
import random
import re

import numpy as np

from votewright.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = WORD.findall(lower(text or ""))
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w = WORD.findall(lower(text or ""))
        hit, items = set(), set()
        for n in range(1, 9):
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[x]
        names = ",".join(sorted(str(i) for i in items))
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), len(items) >= 2)
    return out


def got(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "Cd", "é", "über", "x1", "zz", "q"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    bench = [(i, say(rng.randint(0, 14))) for i in range(12)] + [(50, None), (51, "solo"), (52, "!!"), (53, "ab Cd é über x1 zz q ab"), (54, "ab Cd é über x1 zz q ab")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "only Solo here"), (103, "AB, cd é über x1 zz q ab cd"), (104, "x " * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    expected = brute(docs, bench)
    assert got(d.decontaminate(frame, items)) == expected
    assert got(d.decontaminate(frame, items, block_bytes=150)) == expected
    assert got(d.decontaminate(frame, items.limit(0))) == {k: (v[0], 0, 0, d.EMPTY, False) for k, v in expected.items()}
    assert d.decontaminate(frame.limit(0), items).count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    s = np.append(rng.integers(1, 5, 400), 0)
    index = d.FMIndex(s)
    for n in (1, 2, 4):
        p = rng.integers(1, 7, (30, n))
        low, high = index.search(p)
        for k in range(30):
            want = [i for i in range(400 - n + 1) if (s[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_cut(spark):
    docs = spark.createDataFrame([(1, "A one two three. B", "x", 18), (2, None, None, None), (3, "fine", "y", 4)], "doc_id long, text string, spans string, n_chars long").drop("spans")
    bench = spark.createDataFrame([(7, "one two three"), (8, "beta"), (9, "gamma")], "item_id long, text string")
    docs = docs.union(spark.createDataFrame([(4, "beta or gamma", 13)], docs.schema))
    assert docs.exceptAll(d.cut(docs, bench.limit(0))).isEmpty()
    assert {r.doc_id: (r.text, r.n_chars) for r in d.cut(docs, bench).collect()} == {1: ("A . B", 5), 2: (None, None), 3: ("fine", 4)}


def test_index_finds_what_is_found(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    frame = d.decontaminate(docs, bench)
    assert [r.n_hit for r in frame.collect()] == [2]
    phrases = d.Phrases([(7, "two three")])
    off = np.array([0, 18])
    data = np.frombuffer(b"one two three four", np.uint8)
    assert sum(len(f[0]) for f in d.find(data, off, phrases)[1]) == 1
    monkeypatch.setattr(d.FMIndex, "search", lambda self, p: (np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)))
    assert sum(len(f[0]) for f in d.find(data, off, phrases)[1]) == 0


def test_suffix_array():
    rng = np.random.default_rng(4)
    for size in (1, 2, 30, 500):
        for top in (1, 2, 50):
            s = np.append(np.tile(rng.integers(1, top + 1, size), 2), 0)
            want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
            assert d.suffix_array(s).tolist() == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a one two three b", "x", "y"), (None, None, "z", None)], "doc_id long, text string, items string, in_text string")
    bench = spark.createDataFrame([(7, "one two three", "q")], "item_id string, text string, spans string")
    assert {r.text for r in d.cut(docs, bench).collect()} == {"a  b", None}
    assert d.cut(docs, bench).columns == docs.columns
    assert d.cut(docs.limit(0), bench).count() == 0
