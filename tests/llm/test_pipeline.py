import os
import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [a + b + c for a in "bdfg" for b in "aeo" for c in "lmnr"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(14), say(14)]
    docs = [(i, "\n".join(say(rng.randint(6, 30)) for _ in range(4)), "en", "s", 0) for i in range(60)]
    copied = say(80)
    docs += [(100, copied, "en", "s", 0), (101, copied + " extra", "en", "s", 0), (102, None, "en", "s", 0), (103, "12 34", None, "s", 0)]
    docs += [(104, f"{say(9)} {passages[0]} {say(9)}", "en", "s", 0), (105, f"{passages[0]} {say(5)} {passages[1]}", "en", "s", 0), (106, docs[3][1].split("\n")[0] + "\n" + say(20), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in frame.collect()}
        assert k == 4 or frame.columns == columns
    ids = lambda name: set(seen[name])
    assert ids("language_id") == {i for i, *_ in docs} - {102, 103}
    assert ids("line_dedup") == ids("language_id")
    assert docs[3][1].split("\n")[0] not in seen["line_dedup"][106].text
    assert seen["line_dedup"][101].text == ""  # its only line repeats that of 100
    assert ids("near_dedup") >= ids("line_dedup") - {101}
    assert ids("decontamination") == ids("near_dedup") - {105}
    assert passages[0] not in seen["decontamination"][104].text and seen["decontamination"][104].n_chars == len(seen["decontamination"][104].text)
    assert ids("packing") == ids("decontamination")
    got = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert got.exceptAll(frame.drop("sequence_id", "offset")).isEmpty() and got.count() == frame.count()
    assert os.listdir(tmp_path)


def test_language_stage_without_labels(spark, tmp_path):
    docs = [(1, "a clean text", None), (2, "12 34", None), (3, None, None), (4, "слово", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, frame, str(tmp_path)).collect()} == {1, 4}


def test_emptied_copies_go(spark, tmp_path):
    copied = " ".join(f"w{k}" for k in range(40))
    docs = [(i, copied, "en") for i in range(6)] + [(10, "--", "en"), (11, "--", "en"), (12, "own words here", "en"), (13, None, "en"), (14, None, "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    edited = corpus_pipeline.line_dedup(spark, frame, str(tmp_path))
    assert {r.doc_id for r in edited.where("text = ''").collect()} == {1, 2, 3, 4, 5}
    # of the emptied copies one stays, as of the other equal texts without words
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, edited, str(tmp_path)).collect()) == [0, 1, 10, 12, 13, 14]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text and columns with names the operators use themselves."""
    own = "doc_id long, text string, lang string, source string, n_chars int, kept string, gone_id long, items string, whole int, mark string, label int, node string, `in_text` string"
    say = lambda k, n=40: " ".join(f"{c}{k}" for c in "abcdefghijklmnopqrstuvwxyz"[: n % 27] * (n // 20 + 1))
    row = lambda i, t, lang="en": (i, t, lang, "s", None, "k", 5, "i", 1, "m", 0, "n", "x")
    rows = [row(k, say(k)) for k in range(12)] + [row(3, say(3)), row(20, say(4) + " more"), row(None, say(30)), row(None, say(30)), (None,) * 13, row(21, None), row(22, ""), row(23, "-- --"), row(24, say(77) * 400)]
    docs = spark.createDataFrame(rows, own)
    spark.createDataFrame([(1, say(7)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
            if name != "packing":
                assert out.columns == docs.columns
                frame = out
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r.doc_id for r in frame.collect()}
        if not docs.where("true").isEmpty() and ids:
            assert ids == set(range(12)) | {20, 24, None}  # of 20 nothing is left, and it is the only one
