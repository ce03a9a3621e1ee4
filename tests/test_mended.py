import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

import votewright
from votewright.config import CheckpointerConfig, LogManagerConfig, TrainerConfig
from votewright.functions.labels import range_part, uniform, with_dense_index
from votewright.operators import classification as C
from votewright.operators import metrics as M
from votewright.operators.label_models import TrainLogger
from votewright.operators.labeling import apply_lfs, filter_unlabeled, labeling_function
from votewright.operators.mapping import apply_mappers, lambda_mapper
from votewright.operators.nlp import nlp_preprocessor, simple_parser
from votewright.operators.training import Trainer


def test_a_failing_batch_is_retried_by_row(spark):
    @labeling_function(kind="pandas", inputs=["x"])
    def breaks(d):
        if (d.x == 3).any():
            raise ArithmeticError
        return d.x % 2

    df = spark.range(8).select(F.col("id"), F.col("id").alias("x"))
    for size in ("2", "8"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        v = apply_lfs(df.coalesce(1), [breaks], "id", fault_tolerant=True)
        assert {r.id: r.votes[0] for r in v.df.collect()} == {k: -1 if k == 3 else k % 2 for k in range(8)}
        assert v.faults() == {"breaks": 1}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lambda_mapper_sees_all_columns(spark):
    whole = lambda_mapper(outputs="z long")(lambda x: {"z": x.a * 10 + x.b})
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert [r.z for r in apply_mappers(df, [whole]).orderBy("a").collect()] == [12, 34]

    @labeling_function(kind="row", inputs=["a"], pre=[whole])
    def uses(x):
        return x.z % 3

    assert {r.a: r.votes[0] for r in apply_lfs(df, [uses], "a").df.collect()} == {1: 0, 3: 1}


def test_filter_without_a_join(spark):
    @labeling_function()
    def some():
        return F.when(F.col("x") > 2, 1).otherwise(-1)

    df = spark.range(6).select(F.col("id"), F.col("id").alias("x"))
    out = filter_unlabeled(df, apply_lfs(df, [some], "id", df.columns))
    assert sorted(r.id for r in out.collect()) == [3, 4, 5] and out.columns == df.columns
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_null_labels_are_unknown(spark):
    df = spark.createDataFrame([(1, 1), (0, None), (None, 1), (0, 1)], "gold int, pred int")
    assert M.metric_score(df, "accuracy", "gold", "pred", filters={"gold": [-1], "pred": [-1]}) == 0.5
    assert M.metric_score(df, "coverage", pred="pred") == 0.75
    assert M.Scorer(["accuracy"]).score(df, "gold", "pred")["accuracy"] == 0.5


def test_scores_of_arrays(spark):
    rng = np.random.default_rng(1)
    gold, score = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    pred, probs = (score > 0.4).astype(int), np.stack([1 - score, score], 1)
    frame = spark.createDataFrame([(int(g), int(p), [float(x) for x in q]) for g, p, q in zip(gold, pred, probs, strict=True)], "gold int, pred int, probs array<double>")
    scorer = M.Scorer(["accuracy", "f1", "roc_auc", "coverage"])
    assert scorer.score_arrays(gold, pred, probs) == pytest.approx(scorer.score(frame, "gold", "pred", "probs"))


def test_missing_bucket_warns(spark, caplog):
    df = spark.createDataFrame([(0, 1)], "gold int, pred int")
    with caplog.at_level(logging.WARNING):
        assert M.get_label_instances(df, (1, 1), "gold", "pred").count() == 0
    assert "(1, 1)" in caplog.text
    assert M.bucket_sizes(df, "gold", "pred").collect()[0].n == 1
    assert M.label_bucket_rows(df.withColumn("id", F.lit(5)), "id", "gold", "pred").collect()[0].id == 5


def test_checkpoints_by_the_tasks_scorer(tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] > 0).astype(int)
    task = C.Task("t", {"body": C.Linear(2, 2)}, [C.Operation("body", ("_input_", "x"))], M.Scorer(["f1"]))
    data = [C.DictDataset("d", s, {"x": x}, {"t": y}) for s in ("train", "valid")]
    config = TrainerConfig(n_epochs=3, lr=0.1, checkpointing=True, checkpointer_config=CheckpointerConfig(checkpoint_dir=str(tmp_path), checkpoint_metric="t/d/valid/f1:max"), log_manager_config=LogManagerConfig(evaluation_freq=1))
    metrics = Trainer(config).fit(C.MultitaskClassifier([task]), data)
    assert metrics["t/d/valid/f1"] > 0.8 and "t/d/valid/loss" in metrics
    assert list(tmp_path.iterdir())


def test_gradient_through_attention():
    rng = np.random.default_rng(2)
    x = [tuple(rng.normal(size=(4, n)) for n in (2, 2, 3)) for _ in range(3)]
    combiner, g = C.SliceCombiner(0.7), rng.normal(size=(4, 3))
    _, kept = combiner.forward(x)
    back, _ = combiner.backward(kept, g)
    for s in range(3):
        for part in range(3):
            want = np.zeros_like(x[s][part])
            for at in np.ndindex(want.shape):
                old = x[s][part][at]
                sides = []
                for step in (1e-6, -1e-6):
                    x[s][part][at] = old + step
                    sides.append((combiner.forward(x)[0] * g).sum())
                x[s][part][at] = old
                want[at] = (sides[0] - sides[1]) / 2e-6
            assert np.allclose(back[s][part], want, atol=1e-6)


def test_slice_tasks():
    task = C.Task("t", {"body": C.MLP([3, 5], last_relu=True), "head": C.Linear(5, 2)}, [C.Operation("body", ("_input_", "x")), C.Operation("head", "body")])
    tasks = C.convert_to_slice_tasks(task, ["a", "b"])
    assert [t.name for t in tasks] == [f"t_slice:{s}_{k}" for s in ("base", "a", "b") for k in ("ind", "pred")] + ["t"]
    assert all(t.module_pool["body"] is task.module_pool["body"] for t in tasks[:-1])
    assert len({id(t.module_pool["pred_head"]) for t in tasks if t.name.endswith("_pred")}) == 1
    with pytest.raises(ValueError, match="unique"):
        C.convert_to_slice_tasks(task, ["a", "a"])


def test_train_logger():
    log = TrainLogger(2)
    assert [log.check() for _ in range(4)] == [True, False, True, False]
    assert log.log({"loss": 0.5}) == "epoch 3: loss=0.500"
    assert not TrainLogger(0).check()


def test_parser_fields():
    doc = simple_parser("Boxes of Anna Smith cost 12.")
    assert [t["lemma"] for t in doc["tokens"]][:1] == ["boxe"] and [t["pos"] for t in doc["tokens"]] == ["X", "X", "PROPN", "PROPN", "X", "NUM", "PUNCT"]
    with pytest.raises(ValueError, match="parts"):
        nlp_preprocessor(disable=("parser",))


def test_uniform_numbers_and_ranges(spark):
    df = spark.range(4000).select("id", uniform(7, "id", 1).alias("u"), F.concat(F.lit("k"), F.col("id") % 50).alias("s"))
    u = [r.u for r in df.collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and len(set(u)) == 4000
    parts = df.select("u", range_part(df, "u").alias("p")).groupBy("p").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.count("u").alias("n")).orderBy("p").collect()
    assert len(parts) > 30 and all(x.b < y.a for x, y in zip(parts[:-1], parts[1:], strict=True)) and max(r.n for r in parts) < 400
    assert [r["index"] for r in with_dense_index(df.select("s").distinct(), "s").orderBy("s").collect()] == list(range(50))


def test_package_is_sent(spark):
    votewright.ship(spark)
    assert "PYTHONPATH" in spark.sparkContext.environment
