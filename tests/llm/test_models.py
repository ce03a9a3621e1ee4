import random
import zlib

import numpy as np

from votewright.llm import language, toxicity

WORDS = {"aa": ["the", "and", "house", "water", "thing"], "bb": ["der", "und", "haus", "wasser", "größe"]}


def docs(n=160, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[g]) for _ in range(rng.randint(5, 150))), g, "s") for i in range(n) for g in [rng.choice(["aa", "bb"])]]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language(spark):
    rows = docs()
    odd = [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 !! 7", "aa", "s"), (903, "der " * 40000, None, "s"), (904, "ж", None, None), (None, "the and the house", "aa", "s")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as lang_pred")
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    assert np.mean([got[i].lang_pred == g for i, _, g, _ in rows]) >= 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0.0
    assert got[903].lang_pred == "bb" and got[904].lang_pred in ("aa", "bb") and got[None].held_out is False
    assert all(r.held_out == held(r.doc_id) for r in got.values() if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.identify(frame.where("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(frame.limit(0)).count() == 0


def test_language_tables_agree_with_the_network():
    rng = np.random.default_rng(2)
    net = language.ByteConvNet(["a", "b", "c"])
    x = rng.integers(0, 256, (5, language.WINDOW + 4)).astype(np.uint8)
    x[:, language.WINDOW :] = 0
    frozen = net.freeze()
    for row in x:
        m, _ = net.pooled(row[None])
        want = language.softmax(np.maximum(m + net.params["bias"], 0) @ net.params["out"] + net.params["prior"])
        assert np.abs(frozen.windows(row) - want).max() < 1e-2


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["rotten", "vileness", "grubby"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS["aa"]) + rng.choice("abcde") for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for k in range(0, len(words), 15):
                words[k] = rng.choice(bad)
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, 1, toxic))
    rows += [(900, None, None), (901, "", "x"), (902, "vilenes", "x"), (903, "thinga " * 30000 + "rotten grubby vileness rotten", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as toxic", "0.5 as score")
    gold = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), labels[5]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, gold).collect()}
    test = [(i, y) for i, _, y in labels if held(i)]
    assert np.mean([got[i].predicted == y for i, y in test]) >= 0.95
    assert got[900].score == got[901].score and got[901].predicted == 0 and got[903].predicted == 1
    assert got[902].score > got[901].score  # an unseen spelling
    assert {r.score for r in toxicity.toxicity(frame, gold.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(frame.limit(0), gold).count() == 0
