import math

import numpy as np
import pytest

from votewright.config import LabelModelTrainConfig, TrainerConfig, merge_config
from votewright.functions.labels import soft_loss
from votewright.operators.classification import MLP, DictDataset, Linear, MultitaskClassifier, Operation, SliceAwareClassifier, Task, labels_to_tasks, pad_batch
from votewright.operators.label_models import LabelModel, MajorityClassVoter, MajorityLabelVoter, RandomVoter, assignment, pair_counts, vote_counts
from votewright.operators.labeling import VoteFrame
from votewright.operators.synthetic import simple_label_matrix
from votewright.operators.training import Checkpointer, LogManager, Trainer

from .test_labeling import frame, rows_of


def probs(model, votes):
    return [list(r.probs) for r in model.predict_proba(votes).orderBy("id").collect()]


def test_voters(spark):
    votes = frame(spark, rows_of("010", "010", "100", "..1", "..."))
    assert probs(MajorityLabelVoter(2), votes) == [[1, 0], [1, 0], [1, 0], [0, 1], [0.5, 0.5]]
    assert probs(MajorityClassVoter().fit([0.8, 0.2]), votes) == [[1, 0]] * 5
    p = np.array(probs(RandomVoter(2), votes))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    with pytest.raises(Exception, match="cardinality"):
        probs(MajorityLabelVoter(2), frame(spark, [[2, 0, 0]]))


def test_pair_counts(spark):
    votes = frame(spark, rows_of("010", "010", "100", "011"))
    counts, n = vote_counts(votes, 2)
    one_hot = np.array([[1, 0, 0, 1, 1, 0], [1, 0, 0, 1, 1, 0], [0, 1, 1, 0, 1, 0], [1, 0, 0, 1, 0, 1]])
    assert n == 4 and (counts == one_hot.T @ one_hot).all()
    again = np.zeros((6, 6))
    for r in pair_counts(votes, 2).collect():
        again[r.a, r.b] = r.n
    assert (again == counts).all()


def fitted(gold, votes, k=2, **kw):
    m = votes.shape[1]
    hot = np.concatenate([np.eye(k + 1)[votes[:, j] + 1][:, 1:] for j in range(m)], axis=1)
    model = LabelModel(k)
    model.fit_counts(hot.T @ hot, len(votes), np.full(k, 1 / k), **kw)
    return model


def test_label_model_loss(spark):
    model = fitted(None, np.array(rows_of("0.0", "01.")), n_epochs=0)
    model.mu = model.mu_init + np.float32(0.05)
    loss, grad = model._loss(0.0)
    assert loss == pytest.approx(0.675, abs=0.01)
    for k in range(3):
        keep = model.mu.copy()
        model.mu = keep.astype(np.float64)
        model.mu[k, 0] += 1e-4
        up, _ = model._loss(0.0)
        model.mu[k, 0] -= 2e-4
        down, _ = model._loss(0.0)
        model.mu = keep
        assert (up - down) / 2e-4 == pytest.approx(grad[k, 0], abs=1e-2)


@pytest.mark.parametrize("abstain, epochs, accuracy", [(1.0, 200, 0.9), (1000.0, 1000, 0.65)])
def test_label_model_recovers_parameters(abstain, epochs, accuracy):
    cpts, gold, votes = simple_label_matrix(10_000, 10, 2, abstain, seed=123)
    model = fitted(gold, votes, n_epochs=epochs, lr=0.01, seed=123)
    assert np.abs(model.get_conditional_probs() - cpts).mean() < 0.015
    p = np.tile(np.log(model.p.astype(float)), (len(votes), 1))
    for j in range(10):
        on = votes[:, j] >= 0
        p[on] += np.log(model.mu.astype(float))[2 * j + votes[on, j]]
    voted = (votes >= 0).any(axis=1)
    assert (p.argmax(axis=1) == gold)[voted].mean() >= accuracy


def test_label_model_predicts(spark, tmp_path):
    rng = np.random.default_rng(0)
    gold = rng.integers(0, 2, 400)
    rows = [[g if rng.random() < 0.8 else (1 - g if rng.random() < 0.8 else -1) for _ in range(5)] for g in gold] + [[-1] * 5]
    votes = frame(spark, rows, [*gold, 0])
    model = LabelModel(2).fit(votes, n_epochs=100, seed=3)
    assert model.score(votes, "gold", ["accuracy", "coverage", "f1"])["accuracy"] > 0.85
    assert probs(model, votes)[-1] == pytest.approx([0.5, 0.5])
    assert (model.get_weights() > 0.6).all()
    model.save(str(tmp_path / "m.json"))
    assert np.allclose(LabelModel().load(str(tmp_path / "m.json")).mu, model.mu)
    with pytest.raises(ArithmeticError, match="NaN"):
        LabelModel(2).fit(votes, lr=1e8)
    with pytest.raises(ValueError, match="at least 3"):
        LabelModel(2).fit(VoteFrame(votes.df.selectExpr("id", "slice(votes, 1, 2) as votes"), "id", ["a", "b"]))
    with pytest.raises(ValueError, match="cardinality"):
        LabelModel(2).fit(frame(spark, [[2, 0, 0]]))


def test_balance_and_symmetry(spark):
    model = LabelModel(2)
    dev = spark.createDataFrame([(0,)] * 6 + [(1,)] * 4 + [(-1,)], "y int")
    assert model.balance(None, dev).tolist() == [0.6, 0.4]
    for bad in ([0.3, 0.3, 0.4], [1.0, 0.0]):
        with pytest.raises(ValueError, match="length|prior is 0"):
            model.balance(bad, None)
    rng = np.random.default_rng(4)
    gain = rng.random((9, 9))
    assert sorted(assignment(gain)) == list(range(9))
    small = rng.random((6, 6))
    import votewright.operators.label_models as lm

    padded = np.zeros((9, 9))
    padded[:6, :6] = small + 10
    assert lm.assignment(padded)[:6] == assignment(small)


def test_config():
    c = merge_config(LabelModelTrainConfig(), {"lr": 0.5, "lr_scheduler_config": {"min_lr": 0.1}})
    assert c.lr == 0.5 and c.lr_scheduler_config.min_lr == 0.1 and c.n_epochs == 100
    with pytest.raises(ValueError):
        merge_config(c, {"nope": 1})


def data(n, split, seed):
    rng = np.random.RandomState(seed)
    x = rng.uniform(-1, 1, (n, 2))
    return DictDataset("d", split, {"x": x}, {"t1": (x[:, 0] < x[:, 1]).astype(int), "t2": (x[:, 0] < x[:, 1] + 0.25).astype(int)})


def test_training_converges(spark, tmp_path):
    body = MLP([2, 16], seed=1, last_relu=True)
    tasks = [Task(t, {"body": body, f"{t}_head": Linear(16, 2, k)}, [Operation("body", ("_input_", "x")), Operation(f"{t}_head", "body")]) for k, t in enumerate(("t1", "t2"))]
    model = MultitaskClassifier(tasks)
    with pytest.raises(ValueError, match="duplicate"):
        model.add_task(tasks[0])
    config = TrainerConfig(n_epochs=20, lr=0.02, checkpointing=True, logging=True)
    config = merge_config(config, {"checkpointer_config": {"checkpoint_dir": str(tmp_path / "c")}, "log_writer_config": {"log_dir": str(tmp_path / "l"), "run_name": "r"}})
    metrics = Trainer(config).fit(model, [data(1000, "train", 1), data(300, "valid", 2)])
    assert metrics["t1/d/valid/accuracy"] > 0.95 and metrics["t2/d/valid/accuracy"] > 0.95
    assert metrics["model/all/train/loss"] < 0.15 and (tmp_path / "l/r/log.json").exists()
    test = data(200, "test", 3)
    df = spark.createDataFrame([(k, x.tolist(), int(a), int(b)) for k, (x, a, b) in enumerate(zip(test.x["x"], test.y["t1"], test.y["t2"], strict=True))], "id long, x array<double>, t1 int, t2 int")
    scores = model.score(df, {"x": "x"}, "id", {"t1": "t1", "t2": None})
    assert list(scores) == ["t1/data/test/accuracy"] and scores["t1/data/test/accuracy"] > 0.9
    model.save(str(tmp_path / "m.json"))
    model.load(str(tmp_path / "m.json"))
    with pytest.raises(ValueError, match="train_split"):
        Trainer().fit(model, [data(5, "valid", 1)])


def test_inactive_labels_and_gradient():
    model = MultitaskClassifier([Task("t", {"h": MLP([2, 3, 2], 5)}, [Operation("h", ("_input_", "x"))])])
    x, y = {"x": np.random.RandomState(0).randn(10, 2)}, {"t": np.array([-1] + [0, 1, 1] * 3)}
    loss, count, grads = model.calculate_loss(x, y)
    assert count == {"t": 9}
    for k, p in model.params().items():
        p.flat[0] += 1e-6
        up = model.calculate_loss(x, y)[0]["t"]
        p.flat[0] -= 1e-6
        assert (up - loss["t"]) / 1e-6 == pytest.approx(grads[k].flat[0], abs=1e-4)
    assert model.calculate_loss(x, {"t": np.full(10, -1)})[0] == {}


def test_slice_aware(spark):
    d = data(600, "train", 5)
    inside = d.x["x"][:, 0] > 0.2
    y = d.y["t1"]
    labels = {"t": y}
    for s, on in (("base", np.ones(600, bool)), ("right", inside)):
        labels[f"t_slice:{s}_ind"] = on.astype(int)
        labels[f"t_slice:{s}_pred"] = np.where(on, y, -1)
    model = SliceAwareClassifier("t", MLP([2, 8], 2, last_relu=True), 8, ["right"])
    assert len(model.tasks) == 2 * 2 + 1
    Trainer(TrainerConfig(n_epochs=25, lr=0.02)).fit(model, [DictDataset("d", "train", d.x, labels)])
    df = spark.createDataFrame([(k, x.tolist(), int(a)) for k, (x, a) in enumerate(zip(d.x["x"], y, strict=True))], "id long, x array<double>, t int")
    assert model.score_slices(df, {"x": "x"}, "id", ["t"])["t/data/test/accuracy"] > 0.9


def test_small_parts(spark):
    padded, mask = pad_batch([[1, 2], [3]], 3)
    assert padded.tolist() == [[1, 2], [3, 0]] and mask.tolist() == [[0, 0], [0, 1]]
    assert pad_batch([[1], [3, 4]], left=True)[0].tolist() == [[0, 1], [3, 4]]
    assert labels_to_tasks(["a", "b", "c"], ["a", "b"], {"c": "a", "b": None}) == {"a": "a", "c": "a"}
    df = spark.createDataFrame([([0.0, 1.0], [1.0, 0.0])], "z array<double>, t array<double>")
    assert soft_loss(df, "z", "t").first().loss == pytest.approx(math.log(1 + math.e))
    with pytest.raises(ValueError, match="reduction"):
        soft_loss(df, "z", "t", reduction="other")
    for metric in ("loss:min", "a/b/c/d:other"):
        with pytest.raises(ValueError, match="checkpoint metric"):
            Checkpointer(TrainerConfig().checkpointer_config.__class__(checkpoint_metric=metric))
    log = LogManager(2)
    log.update(5)
    assert not log.trigger_evaluation()
    log.update(5)
    assert log.trigger_evaluation() and log.points == 10 and log.epochs == 1
