"""Regression tests: what Python functions make of long batches is bounded; predictions can be filtered cheaply."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from votewright.functions.labels import filter_labels
from votewright.operators.label_models import LabelModel, MajorityLabelVoter
from votewright.operators.labeling import apply_lfs, labeling_function
from votewright.operators.mapping import apply_mappers, preprocessor
from votewright.operators.nlp import nlp_labeling_function, nlp_preprocessor, simple_parser
from votewright.plans import catalogue


@preprocessor(kind="pandas", outputs="seen long", inputs=["text"])
def seen(pdf):
    return pdf[["text"]].assign(seen=int(pdf["text"].str.len().sum()))[["seen"]]


@labeling_function(kind="row", inputs=["text"], pre=[seen])
def lf_seen(x):
    return int(x.seen > 200_000)


def test_a_batch_of_long_texts_goes_through_in_pieces(spark):
    df = spark.range(600, numPartitions=1).select("id", F.repeat(F.lit("word "), 400).alias("text"))
    df = df.unionByName(spark.createDataFrame([(600, None), (601, ""), (602, "x" * 150_000)], "id long, text string")).coalesce(1)
    votes = {r.id: r.lf_seen for r in apply_lfs(df.where("text is not null"), [lf_seen], "id").wide().collect()}
    assert votes == {k: 0 for k in range(603) if k != 600}
    rows = apply_mappers(df, [nlp_preprocessor()]).select("id", F.size("doc.tokens").alias("n")).orderBy("id").collect()
    assert [(r.id, r.n) for r in rows if r.id < 600] == [(k, 400) for k in range(600)]
    assert [r.id for r in rows] == list(range(603)) and [r.n for r in rows[601:]] == [0, 1]
    assert max(r.seen for r in apply_mappers(df.where("text is not null"), [seen]).collect()) <= 200_000


def test_kept_tokens_are_copied():
    first, second = simple_parser("Cats ate 12 cats."), simple_parser("12 Cats")
    first["tokens"][0]["lemma"] = "changed"
    assert [(t["text"], t["start"], t["pos"], t["lemma"]) for t in second["tokens"]] == [("12", 0, "NUM", "12"), ("Cats", 3, "PROPN", "cat")]
    assert [(t["start"], t["pos"]) for t in simple_parser("Cats ate")["tokens"]] == [(0, "X"), (5, "X")]


@nlp_labeling_function()
def lf_first_start(x):
    return x.doc["tokens"][0]["start"]


def test_rows_keep_their_votes_across_pieces(spark):
    df = spark.range(3000, numPartitions=1).select("id", F.concat(F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")), F.repeat(F.lit("ab "), 100)).alias("text"))
    assert all(r.lf_first_start == r.id % 7 for r in apply_lfs(df, [lf_first_start], "id").wide().collect())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_predictions_computes_votes_once(spark, tmp_path):
    lf_text = labeling_function("lf_text")(lambda: F.when(F.col("text").contains("License"), 0).otherwise(-1))
    lf_even = labeling_function("lf_even")(lambda: F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    lf_five = labeling_function("lf_five")(lambda: F.when(F.col("id") % 5 == 0, 0).otherwise(-1))
    lf_null = labeling_function("lf_null")(lambda: F.when(F.col("id") >= 0, 1))
    spark.range(-4, 40).select("id", F.when(F.col("id") % 3 == 0, "a License").otherwise("b").alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    votes = apply_lfs(df, [lf_text, lf_even, lf_five], "id")
    label_model = LabelModel(2)
    label_model.m, label_model.p, label_model.mu = 3, np.array([0.4, 0.6]), np.array([[0.6, 0.2], [0.01, 0.01], [0.01, 0.01], [0.1, 0.5], [0.2, 0.1], [0.01, 0.01]])
    for model in (MajorityLabelVoter(2), label_model):
        for policy in ("abstain", "random"):
            out = model.predict(votes, policy, return_probs=True)
            every = {r.id: (r.pred, *r.probs) for r in out.collect()}
            assert len(every) == 44 and {p for p, *_ in every.values()} <= {-1, 0, 1}
            for keep in (filter_labels(out, {"pred": [0]}), out.where("pred = 1")):
                assert plan_of(keep).count("License") <= 6
                assert all(every[r.id] == (r.pred, *r.probs) for r in keep.collect())
            assert {r.id for r in filter_labels(out, {"pred": [0]}).collect()} == {k for k, v in every.items() if v[0] != 0}
    ties = MajorityLabelVoter(2).predict(votes, "true-random").collect()
    assert {r.pred for r in ties} <= {0, 1} and all(r.pred == 0 for r in ties if r.id % 6 == 3)
    with pytest.raises(Exception, match="lf_null returned no vote"):
        MajorityLabelVoter(2).predict(apply_lfs(df, [lf_null, lf_even], "id"), "random").where("pred = 1").collect()


def test_texts_are_not_joined_to_gold_labels(spark):
    for name in ("label_instances", "filter_labels", "lf_summary_gold"):
        lines = plan_of(catalogue.queries()[name](spark, "/root/testdata/sf0.001")).split("\n")
        assert sum(x.count("License") for x in lines) <= 6
        join = next(k for k, x in enumerate(lines) if "Join" in x)
        assert not any("License" in x for x in lines[:join])
