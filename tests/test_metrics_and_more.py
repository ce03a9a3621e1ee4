import math

import pytest
from pyspark.sql import functions as F

from votewright.operators import augmentation as aug
from votewright.operators import metrics as M
from votewright.operators import slicing as S
from votewright.operators.labeling import apply_lfs, labeling_function
from votewright.operators.nlp import nlp_labeling_function
from votewright.operators.synthetic import synthetic_votes
from votewright.streaming.votes import windowed_coverage


def pairs(spark, golds, preds, probs=None):
    rows = [(k, g, p, None if probs is None else probs[k]) for k, (g, p) in enumerate(zip(golds, preds, strict=True))]
    return spark.createDataFrame(rows, "id long, gold int, pred int, probs array<double>")


def test_metrics(spark):
    df = pairs(spark, map(int, "00011"), map(int, "11001"))
    score = lambda m, d=df, **kw: M.metric_score(d, m, "gold", "pred", "probs", **kw)
    assert score("precision") == pytest.approx(1 / 3) and score("recall") == 0.5 and score("f1") == pytest.approx(0.4) and score("fbeta", beta=1) == pytest.approx(0.4)
    multi = pairs(spark, [0, 0, 1, 1, 2], [1, 1, 0, 1, 2])
    assert score("f1_micro", multi) == pytest.approx(0.4) and score("f1_macro", multi) == pytest.approx(0.47, abs=0.01)
    with pytest.raises(ValueError, match="binary"):
        score("f1", multi)
    assert score("matthews_corrcoef", pairs(spark, [0, 1, 0, 1], [0, 1, 0, 1])) == 1.0
    ranked = pairs(spark, [0, 0, 1, 1], [0, 0, 1, 1], [[0.9, 0.1], [0.6, 0.4], [0.65, 0.35], [0.2, 0.8]])
    assert score("roc_auc", ranked) == pytest.approx(0.75)
    assert math.isnan(score("roc_auc", ranked.where("gold = 1")))
    assert score("accuracy", pairs(spark, [-1, 0, 1], [0, 0, 0]), filters={"gold": [-1]}) == 0.5
    for kw in ({"metric": "other"}, {"metric": "roc_auc", "gold": "gold"}):
        with pytest.raises(ValueError, match="metric you provided"):
            M.metric_score(df, **kw)


def test_scorer_and_slices(spark):
    df = pairs(spark, [1, 0, 1, 0, -1], [1, -1, 0, 0, 1]).withColumn("s", (F.col("id") < 3).cast("int"))
    scorer = M.Scorer(["accuracy", "coverage"], {"rows": lambda d, *_: d.count()})
    assert scorer.score(df, "gold", "pred") == {"accuracy": pytest.approx(2 / 3), "coverage": 0.8, "rows": 5}
    by = scorer.score_slices(df, ["s"], "gold", "pred")
    assert by["overall"]["coverage"] == 0.8 and by["s"]["accuracy"] == 0.5
    rows = {r.slice: r for r in M.slice_metrics(df, ["s"], "gold", "pred").collect()}
    assert rows["s"].accuracy == 0.5 and rows["overall"].n == 5 and rows["overall"].coverage == 0.8
    with pytest.raises(ValueError, match="empty"):
        scorer.score(df.limit(0), "gold", "pred")
    with pytest.raises(ValueError, match="Unrecognized"):
        M.Scorer(["nope"])


def test_buckets(spark):
    df = pairs(spark, [2, 1, 3, 1, 1, 3], [1, 2, 3, 1, 2, 3])
    got = {(r.gold, r.pred): r.ids for r in M.get_label_buckets(df, "id", "gold", "pred").collect()}
    assert got == dict([((3, 3), [2, 5]), ((1, 1), [3]), ((1, 2), [1, 4]), ((2, 1), [0])])
    assert [r.id for r in M.get_label_instances(df, (1, 2), "gold", "pred").orderBy("id").collect()] == [1, 4]
    assert M.get_label_instances(df, (9, 9), "gold", "pred").count() == 0


def test_augmentation(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([1, 2, 3])], "id long, num long")

    @aug.transformation_function(outputs="num long")
    def square(num):
        return {"num": num**2}

    @aug.transformation_function(outputs="num long")
    def none_on_two(num):
        return None if num == 2 else {"num": num**2}

    def run(tfs, policy):
        return [(r.id, r.num) for r in aug.apply_tfs(df, tfs, policy, "id").orderBy("id", "aug_idx").collect()]

    again = aug.TransformationFunction("again", square.f, "row", outputs="num long")
    assert [n for _, n in run([square, again], aug.ApplyAllPolicy(2, keep_original=False))] == [1, 16, 81]
    assert [n for _, n in run([square, again], aug.ApplyAllPolicy(2, 2))] == [n for x in (1, 2, 3) for n in (x, x**4, x**4)]
    other = aug.TransformationFunction("other", none_on_two.f, "row", outputs="num long")
    assert run([none_on_two, other], aug.ApplyAllPolicy(2, 2)) == [(0, 1), (0, 1), (0, 1), (1, 2), (2, 3), (2, 81), (2, 81)]
    seqs = lambda p: [list(map(list, r[0])) for r in df.limit(1).select(p.sequences(F.col("id"))).collect()][0]
    assert seqs(aug.ApplyEachPolicy(3)) == [[], *([k] for k in range(3))]
    assert seqs(aug.ApplyOnePolicy(2)) == [[], [0], [0]]
    assert all(len(s) == 4 and set(s) <= {0, 1} for s in seqs(aug.RandomPolicy(2, 4, 3, keep_original=False)))
    plus = aug.column_tf("plus", "num", lambda c: F.when(c != 2, c * c))
    assert run([plus, aug.column_tf("p2", "num", lambda c: F.when(c != 2, c * c))], aug.ApplyAllPolicy(2)) == [(0, 1), (0, 1), (1, 2), (2, 3), (2, 81)]
    assert [len(b) for b in aug.apply_generator(df, [square], aug.ApplyOnePolicy(), "id", 4)] == [4, 2]
    with pytest.raises(ValueError, match="distribution"):
        aug.MeanFieldPolicy(2, 1, [0.5, 0.6])


def test_slicing(spark):
    df = spark.createDataFrame([(k, v, y) for k, (v, y) in enumerate(zip((k / 10 for k in range(1, 6)), map(int, "01101"), strict=True))], "id long, val double, y int")

    @S.slicing_function()
    def small():
        return F.col("val") < 0.25

    assert S.slice_dataframe(df, small).count() == 2
    inds = S.apply_sfs(df, [small], "id", ("val", "y"))
    rows = S.add_slice_labels(inds, "t", "y", ["small"]).orderBy("id").collect()
    assert [r["t_slice:small_pred"] for r in rows] == [0, 1, -1, -1, -1] and [r["t_slice:base_pred"] for r in rows] == [0, 1, 1, 0, 1]
    heads = spark.createDataFrame([(1, [0.0, 1.0], [0.0, 1.0], [4.0, 4.0]), (1, [0.0, 1.0], [0.0, 1.0], [2.0, 2.0])], "id long, ind array<double>, pred array<double>, feat array<double>")
    assert S.combine_slices(heads, "id").first().combined == pytest.approx([3, 3])


def test_nlp_shares_one_parse(spark):
    @nlp_labeling_function(text_field="text")
    def person(x):
        return 0 if any(t["lower"] == "jane" for t in x.doc["tokens"]) else -1

    df = spark.createDataFrame([(0, "Jane Doe."), (1, "nobody")], "id long, text string")
    assert [r.person for r in apply_lfs(df, [person], "id").wide().orderBy("id").collect()] == [0, -1]
    with pytest.raises(ValueError, match="different parameters"):
        nlp_labeling_function(doc_field="other")(lambda x: 0)


def test_synthetic_votes_do_not_depend_on_partitions(spark):
    cpts, df = synthetic_votes(spark, 500, 4, 3, seed=1)
    again = synthetic_votes(spark, 500, 4, 3, seed=1)[1].repartition(7)
    assert df.exceptAll(again).isEmpty()
    rows = df.collect()
    for y in range(3):
        mine = [r.votes[0] for r in rows if r.gold == y]
        assert abs(mine.count(-1) / len(mine) - cpts[0, 0, y]) < 0.12


@labeling_function()
def positive():
    return F.when(F.col("value") > 0, 1).otherwise(-1)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), ((F.col("id") % 3).cast("int") - 1).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windowed_coverage(stream, [positive], "id", "ts")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got == sorted(map(tuple, windowed_coverage(rows, [positive], "id", "ts").collect())) and len(got) == 34
