import pytest
from pyspark.sql import functions as F

from votewright.functions.labels import probs_to_preds, with_dense_index
from votewright.operators.analysis import LFAnalysis
from votewright.operators.labeling import VoteFrame, apply_lfs, filter_unlabeled, labeling_function
from votewright.operators.mapping import Mapper, apply_mappers, get_hashable, get_parameters, lambda_mapper, mapper, preprocessor

NUMS = [3, 43, 12, 9, 3]


@labeling_function()
def f():
    return F.when(F.col("num") > 42, 0).otherwise(-1)


@labeling_function(kind="pandas", inputs=["num"], resources={"db": [3, 6, 9]})
def g(x, db):
    return x.num.isin(db).astype(int) - 1


@preprocessor(outputs="num_squared long")
def square(num):
    return {"num_squared": num * num}


@labeling_function(kind="row", inputs=["num"], pre=[square])
def fp(x):
    return 0 if x.num_squared > 42 else -1


@labeling_function(kind="row", inputs=["num"])
def f_bad(x):
    return 0 if x.mum > 42 else -1


@labeling_function(kind="row", inputs=["num"])
def f_null(x):
    return None


@pytest.fixture(scope="module")
def nums(spark):
    return spark.createDataFrame(list(enumerate(NUMS)), "id long, num int")


def matrix(votes):
    return [list(r.votes) for r in votes.df.orderBy(votes.id_col).collect()]


def rows_of(*texts):
    """Votes written as digits, a dot for an abstention."""
    return [[-1 if c == "." else int(c) for c in t] for t in texts]


def frame(spark, rows, gold=None):
    data = [(k, list(map(int, r)), None if gold is None else int(gold[k])) for k, r in enumerate(rows)]
    return VoteFrame(spark.createDataFrame(data, "id long, votes array<int>, gold int"), "id", [f"l{j}" for j in range(len(rows[0]))])


def test_apply(nums):
    assert matrix(apply_lfs(nums, [f, g], "id")) == rows_of(".0", "0.", "..", ".0", ".0")
    assert matrix(apply_lfs(nums, [f, fp], "id")) == rows_of("..", "00", ".0", ".0", "..")


def test_faults(nums):
    votes = apply_lfs(nums, [g, f_bad, f_null], "id", fault_tolerant=True)
    assert matrix(votes) == rows_of("0..", "...", "...", "0..", "0..")
    assert votes.faults() == {"f_bad": 5, "f_null": 5}
    assert apply_lfs(nums, [f], "id", fault_tolerant=True).faults() == {}
    for bad in (f_bad, f_null):
        with pytest.raises(Exception, match="mum|no vote"):
            apply_lfs(nums, [bad], "id").df.collect()


def test_declarations(nums):
    assert repr(f) == "LabelingFunction f, Preprocessors: []"
    with pytest.raises(ValueError, match="missing parentheses"):
        labeling_function(lambda: 1)
    with pytest.raises(ValueError, match="not unique"):
        apply_lfs(nums, [f, f], "id")
    with pytest.raises(ValueError, match="at least one"):
        apply_lfs(nums, [], "id")


L = rows_of("..0..0", "...2..", "2....0", "1.2.00", "......", "1.0210")
Y = list(range(3)) * 2


def test_analysis(spark):
    a = LFAnalysis(frame(spark, L, Y), gold="gold")
    near = lambda x: pytest.approx(x)
    sixths = lambda t: near([int(c) / 6 for c in t])
    assert (a.label_coverage(), a.label_overlap(), a.label_conflict()) == (near(5 / 6), near(4 / 6), near(3 / 6))
    assert ["".join(map(str, p)) for p in a.lf_polarities()] == "12 _ 02 2 01 0".replace("_", "").split(" ")
    assert a.lf_coverages() == sixths("303224")
    assert a.lf_overlaps() == sixths("303124")
    assert a.lf_overlaps(True) == near([1, 0, 1, 1 / 2, 1, 1])
    assert a.lf_conflicts() == sixths("302123")
    assert a.lf_conflicts(True) == near([1, 0, 0.5 / 0.75, 1, 1, 0.75])
    assert a.lf_empirical_accuracies() == sixths("202333")
    rows = a.lf_summary([0.1] * 6).orderBy("j").collect()
    assert [r.correct for r in rows] == [1, 0, 1, 1, 1, 2] and [r.incorrect for r in rows] == [2, 0, 2, 1, 1, 2]
    probs = {(r.j, r.vote, r.y): r.prob for r in a.lf_empirical_probs(3).collect()}
    assert len(probs) == 6 * 4 * 3
    for j in range(6):
        for v in range(-1, 3):
            for y in range(3):
                assert probs[j, v, y] == near(sum(r[j] == v and g == y for r, g in zip(L, Y, strict=True)) / Y.count(y))
    with pytest.raises(ValueError, match="do not fit"):
        LFAnalysis(frame(spark, L), [f])


def test_filter_unlabeled(spark):
    votes = frame(spark, rows_of("01.", "...", "110"))
    assert sorted(r.id for r in filter_unlabeled(votes.df, votes).collect()) == [0, 2]


def test_tie_breaks(spark):
    rows = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(10)] + [(10, [0.2, 0.8])], "id long, p array<double>")
    preds = lambda policy: [r[0] for r in rows.orderBy("id").select(probs_to_preds("p", policy, "id")).collect()]
    assert preds("random") == [0, 1, 0, 1, 0, 0, 0, 0, 1, 1, 1]
    assert preds("abstain") == [-1] * 10 + [1]
    assert set(preds("true-random")) <= {0, 1}
    with pytest.raises(ValueError, match="unknown"):
        probs_to_preds("p", "other", "id")


def test_dense_index(spark):
    df = spark.range(0, 1000, 7).repartition(5)
    got = with_dense_index(df, "id").collect()
    assert {r.id: r["index"] for r in got} == {7 * k: k for k in range(143)}


def test_mappers(spark):
    df = spark.createDataFrame([(8, "Henry has fun"), (9, "x"), (8, "y")], "num int, text string")
    split = Mapper("split", lambda text: {"lower": text.lower(), "words": text.split(), "other": 1}, "row", outputs="text_lower string, text_words array<string>", rename={"lower": "text_lower", "words": "text_words"})
    row = apply_mappers(df, [split]).first()
    assert row.text_lower == "henry has fun" and row.text_words == ["Henry", "has", "fun"] and "other" not in row
    some = mapper("odd", outputs="half int")(lambda num: {"half": num // 2} if num % 2 else None)
    assert [r.half for r in apply_mappers(df, [some]).collect()] == [4]
    memo = Mapper("memo", lambda num: {"n2": num * 2}, "row", outputs="n2 int", memoize=True)
    assert sorted(r.n2 for r in apply_mappers(df, [memo]).collect()) == [16, 16, 18]
    whole = lambda_mapper(outputs="z int", inputs=["num"])(lambda x: {"z": x.num + 1})
    assert [r.z for r in apply_mappers(df, [whole]).collect()] == [9, 10, 9]
    with pytest.raises(ValueError):
        get_parameters(lambda *a: 1)
    assert get_hashable({"a": [1, {"b": 2}]}) == get_hashable({"a": [1, {"b": 2}]})
