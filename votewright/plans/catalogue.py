"""The query catalogue: one entry for each operator, with its oracle SQL.

The sample functions vote on documents; gold labels are ``labels.quality``, -1
where a document has none. Every oracle starts from the same CASE expressions.
"""

from __future__ import annotations

import tempfile
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import augmentation as aug
from ..operators import metrics as M
from ..operators import slicing as S
from ..operators import synthetic
from ..operators.analysis import LFAnalysis
from ..operators.label_models import LabelModel, MajorityClassVoter, MajorityLabelVoter, RandomVoter, pair_counts, posterior
from ..operators.labeling import VoteFrame, apply_lfs, filter_unlabeled, labeling_function
from ..operators.classification import MLP, Linear, Operation, Task, convert_to_slice_tasks
from ..operators.mapping import Mapper, apply_mappers, column_mapper, lambda_mapper, preprocessor
from ..operators.nlp import nlp_labeling_function, token_column
from ..sources.tables import read_table, with_gold
from ..streaming.votes import windowed_coverage


@labeling_function()
def lf_short():
    return F.when(F.col("n_chars") < 600, 0).otherwise(-1)


@labeling_function()
def lf_long():
    return F.when(F.col("n_chars") > 2000, 1).otherwise(-1)


@labeling_function(resources={"language": "en"})
def lf_en(language):
    return F.when(F.col("lang") == language, 1).otherwise(-1)


@labeling_function()
def lf_mod5():
    return F.when(F.col("doc_id") % 5 == 0, 0).otherwise(-1)


@labeling_function()
def lf_mod7():
    return F.when(F.col("doc_id") % 7 == 0, 1).otherwise(-1)


@labeling_function()
def lf_license():
    return F.when(F.col("text").contains("License"), 0).otherwise(-1)


@labeling_function()
def lf_never():
    return F.when(F.col("text").contains("{"), 0).otherwise(-1)


LFS = [lf_short, lf_long, lf_en, lf_mod5, lf_mod7, lf_license, lf_never]
CASES = [
    "CASE WHEN n_chars < 600 THEN 0 ELSE -1 END", "CASE WHEN n_chars > 2000 THEN 1 ELSE -1 END", "CASE WHEN lang = 'en' THEN 1 ELSE -1 END", "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE -1 END",
    "CASE WHEN doc_id % 7 = 0 THEN 1 ELSE -1 END", "CASE WHEN contains(text, 'License') THEN 0 ELSE -1 END", "CASE WHEN contains(text, '{') THEN 0 ELSE -1 END",
]
NAMES = [lf.name for lf in LFS]
M_LFS = len(LFS)
SLICES = ["s_short", "s_en", "s_mod3"]


def gold_documents(spark: SparkSession, d: str) -> DataFrame:
    return with_gold(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id", "quality")


def votes(spark: SparkSession, d: str, gold: bool = False) -> VoteFrame:
    v = apply_lfs(read_table(spark, d, "documents"), LFS, "doc_id")
    return judged(v, read_table(spark, d, "labels")) if gold else v


def judged(v: VoteFrame, labels: DataFrame) -> VoteFrame:
    """Votes with ``gold``: joined to the votes, so that the texts voted on are not shuffled."""
    return replace(v, df=with_gold(v.df, labels, v.id_col, "quality"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, gold, votes, probs, pred of the majority vote, and the slice columns."""
    sliced = read_table(spark, d, "documents").withColumns({"s_short": (F.col("n_chars") < 900).cast("int"), "s_en": (F.col("lang") == "en").cast("int"), "s_mod3": (F.col("doc_id") % 3 == 0).cast("int")})
    v = judged(apply_lfs(sliced, LFS, "doc_id", SLICES), read_table(spark, d, "labels"))
    return MajorityLabelVoter(2).predict(v, "random", return_probs=True)


# SQL building blocks
VOTES = "v AS (SELECT doc_id, " + ", ".join(f"{c} AS v{j}" for j, c in enumerate(CASES)) + " FROM documents)"
LONG = "lv AS (" + " UNION ALL ".join(f"SELECT doc_id, {j} AS j, v{j} AS vote FROM v" for j in range(M_LFS)) + ")"
STATS = "st AS (SELECT doc_id, count(*) FILTER (vote >= 0) AS n_cast, count(DISTINCT CASE WHEN vote >= 0 THEN vote END) AS n_kinds FROM lv GROUP BY doc_id)"
GOLD = "g AS (SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS gold FROM documents d LEFT JOIN labels l USING (doc_id))"
NAME = "CASE j " + " ".join(f"WHEN {j} THEN '{n}'" for j, n in enumerate(NAMES)) + " END"
COUNTS = "c AS (SELECT doc_id, count(*) FILTER (vote = 0) AS c0, count(*) FILTER (vote = 1) AS c1 FROM lv GROUP BY doc_id)"
PROBS = "p AS (SELECT doc_id, CASE WHEN c0 > c1 THEN 1.0 WHEN c0 = c1 THEN 0.5 ELSE 0.0 END::DOUBLE AS p0, CASE WHEN c1 > c0 THEN 1.0 WHEN c0 = c1 THEN 0.5 ELSE 0.0 END::DOUBLE AS p1 FROM c)"
TIE = "((" + " + ".join(f"('0x' || substr(sha1(doc_id::VARCHAR), {1 + 8 * k}, 8))::BIGINT" for k in (4,)) + ") % 2)"  # 2 ** 32 is even: the last chunk decides
PRED = f"r AS (SELECT doc_id, p0, p1, CASE WHEN p0 > p1 THEN 0 WHEN p1 > p0 THEN 1 ELSE {TIE} END::INTEGER AS pred FROM p)"
BASE = f"{VOTES}, {LONG}, {COUNTS}, {PROBS}, {PRED}, {GOLD}, e AS (SELECT r.*, g.gold FROM r JOIN g USING (doc_id))"
CELLS = "k AS (SELECT gold, pred, count(*) AS n FROM e WHERE gold <> -1 AND pred <> -1 GROUP BY gold, pred), b AS (SELECT sum(n) FILTER (gold = 1 AND pred = 1) AS tp, sum(n) FILTER (gold = 0 AND pred = 1) AS fp, sum(n) FILTER (gold = 1 AND pred = 0) AS fn, sum(n) FILTER (gold = 0 AND pred = 0) AS tn FROM k)"
USED = "u AS (SELECT * FROM e WHERE gold <> -1 AND pred <> -1)"


def lf_apply(spark, d):
    return votes(spark, d).wide()


def lf_stats(spark, d):
    return LFAnalysis(votes(spark, d)).label_stats()


def lf_polarity(spark, d):
    return LFAnalysis(votes(spark, d)).lf_summary().select("lf", F.array_join("polarity", ",").alias("polarity"))


def lf_summary(spark, d):
    return LFAnalysis(votes(spark, d)).lf_summary().withColumn("polarity", F.array_join("polarity", ","))


def lf_summary_gold(spark, d):
    return LFAnalysis(votes(spark, d, True), LFS, "gold").lf_summary([0.5 + j / 100 for j in range(M_LFS)]).withColumn("polarity", F.array_join("polarity", ","))


def lf_normalized(spark, d):
    c = LFAnalysis(votes(spark, d)).counts()
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return c.select("j", ratio("n_overlaps", "n_votes").alias("overlaps"), ratio("n_conflicts", "n_overlaps").alias("conflicts"))


def lf_empirical_probs(spark, d):
    return LFAnalysis(votes(spark, d, True), gold="gold").lf_empirical_probs(2)


def vote_patterns(spark, d):
    return votes(spark, d).patterns().select(F.array_join(F.col("votes").cast("array<string>"), ",").alias("pattern"), "n")


def votes_long(spark, d):
    return votes(spark, d).long()


def pair_matrix(spark, d):
    return pair_counts(votes(spark, d), 2).select("a", "b", "n")


def majority_probs(spark, d):
    v = votes(spark, d)
    return MajorityLabelVoter(2).predict_proba(v).select("doc_id", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1"))


def majority_abstain(spark, d):
    return MajorityLabelVoter(2).predict(votes(spark, d)).select("doc_id", "pred")


def majority_random(spark, d):
    return MajorityLabelVoter(2).predict(votes(spark, d), "random").select("doc_id", "pred")


def majority_class(spark, d):
    return MajorityClassVoter().fit([0.2, 0.8]).predict_proba(votes(spark, d)).select("doc_id", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1"))


def random_voter(spark, d):
    return RandomVoter(3, seed=4).predict_proba(votes(spark, d)).select("doc_id", *[F.col("probs")[c].alias(f"p{c}") for c in range(3)])


def unlabeled_filtered(spark, d):
    docs = read_table(spark, d, "documents")
    return filter_unlabeled(docs, apply_lfs(docs, LFS, "doc_id", docs.columns)).select("doc_id", "n_chars")


#: P(vote | class) of the sample functions, functions x votes by class, for scoring with fixed parameters.
FIXED_CPT = [[[0.3, 0.1], [0.05, 0.02]], [[0.1, 0.05], [0.2, 0.45]], [[0.02, 0.03], [0.5, 0.7]], [[0.25, 0.2], [0.01, 0.02]], [[0.02, 0.01], [0.1, 0.2]], [[0.06, 0.03], [0.01, 0.01]], [[0.02, 0.01], [0.01, 0.02]]]
PRIOR = [0.4, 0.6]


def bayes_posterior(spark, d):
    mu = np.array(FIXED_CPT).reshape(-1, 2)
    v = votes(spark, d)
    probs = posterior(mu, np.array(PRIOR), M_LFS, 2)
    return v.df.select("doc_id", F.round(probs[0], 6).alias("p0"), F.round(probs[1], 6).alias("p1"))


def label_model(spark, d):
    v = votes(spark, d)
    model = LabelModel(2).fit(v, class_balance=[0.3, 0.7], n_epochs=200, seed=1)
    return model.predict(v, return_probs=True).select("doc_id", "probs", "pred")


def label_model_weights(spark, d):
    model = LabelModel(2).fit(votes(spark, d), class_balance=[0.3, 0.7], n_epochs=200, seed=1)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(NAMES, model.get_weights(), strict=True)], "lf string, weight double")


def class_balance(spark, d):
    shares = LabelModel(2).balance(None, gold_documents(spark, d).select("gold"))
    return spark.createDataFrame([(y, float(p)) for y, p in enumerate(shares)], "gold int, share double")


def labeler_score(spark, d):
    scores = MajorityLabelVoter(2).score(votes(spark, d, True), "gold", ["accuracy", "coverage", "f1"], "random")
    return spark.createDataFrame([(scores["accuracy"], scores["coverage"], scores["f1"])], "accuracy double, coverage double, f1 double")


def saved_voter(spark, d):
    with tempfile.TemporaryDirectory() as folder:  # parameters are the driver's
        MajorityClassVoter().fit([0.2, 0.8]).save(f"{folder}/voter.json")
        voter = MajorityClassVoter().load(f"{folder}/voter.json")
    return voter.predict_proba(votes(spark, d)).select("doc_id", F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1"))


def conditional_probs(spark, d):
    model = LabelModel(2)
    model.m, model.mu = M_LFS, np.array(FIXED_CPT).reshape(-1, 2)
    p = model.get_conditional_probs()
    rows = [(j, v - 1, y, float(p[j, v, y])) for j in range(M_LFS) for v in range(3) for y in range(2)]
    return spark.createDataFrame(rows, "j int, vote int, y int, prob double").withColumn("prob", F.round("prob", 6))


def scorer_slices(spark, d):
    by = M.Scorer(["accuracy", "coverage", "f1"]).score_slices(predicted(spark, d), SLICES, "gold", "pred")
    return spark.createDataFrame([(s, m["accuracy"], m["coverage"], m["f1"]) for s, m in by.items()], "slice string, accuracy double, coverage double, f1 double")


def _metric(name, **kw):
    def run(spark, d):
        value = M.metric_score(predicted(spark, d), name, "gold", "pred", "probs", {} if name == "coverage" else {"gold": [-1], "pred": [-1]}, **kw)
        return spark.createDataFrame([(value,)], f"{name} double")

    return run


def metric_roc_auc(spark, d):
    return M.roc_auc(L.filter_labels(predicted(spark, d), {"gold": [-1]}), "gold", "probs")


def confusion_matrix(spark, d):
    return M.confusion(predicted(spark, d), "gold", "pred")


def score_slices(spark, d):
    return M.slice_metrics(predicted(spark, d), SLICES, "gold", "pred")


@S.slicing_function()
def sf_short():
    return F.col("n_chars") < 900


@S.slicing_function()
def sf_en():
    return F.col("lang") == "en"


def slice_matrix(spark, d):
    return S.apply_sfs(read_table(spark, d, "documents"), [sf_short, sf_en], "doc_id")


def slice_dataframe(spark, d):
    return S.slice_dataframe(read_table(spark, d, "documents"), sf_short).select("doc_id", "n_chars")


def slice_labels(spark, d):
    frame = gold_documents(spark, d).withColumn("short", (F.col("n_chars") < 900).cast("int"))
    return S.add_slice_labels(frame, "quality", "gold", ["short"]).select("doc_id", *[F.col(f"quality_slice:{s}_{x}").alias(f"{s}_{x}") for s in ("base", "short") for x in ("ind", "pred")])


def slice_combiner(spark, d):
    ev = read_table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 8).cast("array<double>").alias("e"))
    heads = F.explode(F.array(*[F.struct(F.array(F.col("e")[2 * k], F.col("e")[2 * k + 1]).alias("ind"), F.array(F.col("e")[k], F.col("e")[k + 4]).alias("pred"), F.array(F.col("e")[k], F.lit(float(k))).alias("feat")) for k in range(3)])).alias("h")
    out = S.combine_slices(ev.select("vec_id", heads).select("vec_id", "h.*"), "vec_id")
    return out.select("vec_id", F.round(F.col("combined")[0], 6).alias("c0"), F.round(F.col("combined")[1], 6).alias("c1"))


def label_buckets(spark, d):
    return M.get_label_buckets(predicted(spark, d), "doc_id", "gold", "pred").select("gold", "pred", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def label_instances(spark, d):
    return M.get_label_instances(predicted(spark, d), (0, 1), "gold", "pred").select("doc_id")


def preds_to_probs(spark, d):
    p = predicted(spark, d).select("doc_id", L.preds_to_probs("pred", 2).alias("h"))
    return p.select("doc_id", F.col("h")[0].alias("p0"), F.col("h")[1].alias("p1"))


def dense_index(spark, d):
    return L.with_dense_index(read_table(spark, d, "documents").where("n_chars > 500"), "doc_id").select("doc_id", F.col("index").cast("long").alias("index"))


def filtered_labels(spark, d):
    return L.filter_labels(predicted(spark, d), {"gold": [-1], "pred": [0]}).select("doc_id", "gold", "pred")


def soft_cross_entropy(spark, d):
    ev = read_table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("z"), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)).alias("t"))
    each = L.cross_entropy_with_probs("z", "t", [1.0, 2.0, 0.5])
    return ev.select("vec_id", F.round(each, 6).alias("loss"))


def soft_loss(spark, d):
    ev = read_table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("z"), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)).alias("t"))
    parts = [L.soft_loss(ev, "z", "t", [1.0, 2.0, 0.5], r).select(F.lit(r).alias("reduction"), F.round("loss", 6).alias("loss")) for r in ("mean", "sum")]
    return parts[0].unionByName(parts[1])


def int_labels(spark, d):
    return read_table(spark, d, "labels").select("doc_id", L.to_int_label(F.col("toxic") * 1.0).alias("toxic"))


def lambda_mapped(spark, d):
    @lambda_mapper(outputs="twice long, tag string")
    def twice(x):
        return {"twice": 2 * x.n_chars, "tag": f"{x.lang}/{x.source}"}

    return apply_mappers(read_table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), [twice]).select("doc_id", "twice", "tag")


@preprocessor(outputs="parity int")
def parity(n_chars):
    return {"parity": n_chars % 2}


@labeling_function(kind="row", inputs=["n_chars"], pre=[parity])
def lf_parity(x):
    return x.parity if x.n_chars > 300 else -1


def preprocessed_votes(spark, d):
    return apply_lfs(read_table(spark, d, "documents"), [lf_parity], "doc_id").wide()


@labeling_function(kind="pandas", inputs=["doc_id"])
def lf_breaks(x):
    if (x.doc_id % 13 == 0).any():
        raise ArithmeticError("thirteen")
    return x.doc_id % 2


def batch_faults(spark, d):
    """A function that fails on some rows loses those alone, however rows are batched."""
    v = apply_lfs(read_table(spark, d, "documents"), [lf_en, lf_breaks], "doc_id", fault_tolerant=True)
    return v.df.select("doc_id", F.col("votes")[1].alias("vote"), F.col("faults")[1].alias("fault"))


def softmax_probs(spark, d):
    ev = read_table(spark, d, "embeddings").select("vec_id", L.softmax(F.slice("embedding", 1, 2).cast("array<double>")).alias("p"))
    return ev.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


def padded(spark, d):
    ev = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ev.select("conv_id", F.array_join(L.pad("turns", 4, -9).cast("array<string>"), ",").alias("padded"), F.array_join(L.pad_mask("turns", 4, -9).cast("array<string>"), ",").alias("mask"))


def mapped_columns(spark, d):
    m = column_mapper("squares", num_squared=lambda n_chars: n_chars * n_chars, lang_upper=lambda lang: F.upper(lang))
    return apply_mappers(read_table(spark, d, "documents"), [m]).select("doc_id", "num_squared", "lang_upper")


def memoized_map(spark, d):
    m = Mapper("lengths", lambda lang, source: {"key_len": len(lang) + len(source)}, "row", ["lang", "source"], "key_len int", memoize=True)
    return apply_mappers(read_table(spark, d, "documents").select("doc_id", "lang", "source"), [m]).select("doc_id", "key_len")


def rows_mapped_to_none(spark, d):
    m = Mapper("odd", lambda doc_id: {"half": doc_id // 2} if doc_id % 3 else None, "row", ["doc_id"], "half long")
    return apply_mappers(read_table(spark, d, "documents").select("doc_id"), [m])


@labeling_function(kind="pandas", inputs=["n_chars"])
def lf_pandas(x):
    return (x.n_chars > 1000).astype(int) * 2 - 1


@labeling_function(kind="row", inputs=["doc_id"])
def lf_row(x):
    return x.doc_id % 4 if x.doc_id % 11 else None


def python_votes(spark, d):
    return apply_lfs(read_table(spark, d, "documents"), [lf_en, lf_pandas, lf_row], "doc_id", fault_tolerant=True).wide()


def fault_counts(spark, d):
    v = apply_lfs(read_table(spark, d, "documents"), [lf_en, lf_pandas, lf_row], "doc_id", fault_tolerant=True)
    return v.df.agg(*[F.sum(F.col("faults")[j]).alias(n) for j, n in enumerate(v.names)])


@nlp_labeling_function()
def lf_words(x):
    return sum(t["is_alpha"] for t in x.doc["tokens"]) % 3


def nlp_votes(spark, d):
    return apply_lfs(read_table(spark, d, "documents"), [lf_words], "doc_id").wide()


def token_counts(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", F.size(token_column()).cast("long").alias("n"))


PLUS = aug.column_tf("plus", "n_chars", lambda c: c + 1)
SQUARE = aug.column_tf("square", "n_chars", lambda c: F.when(c % 2 == 0, F.try_multiply(c, c)))


def _augmented(policy):
    def run(spark, d):
        return aug.apply_tfs(read_table(spark, d, "documents").select("doc_id", "n_chars"), [PLUS, SQUARE], policy, "doc_id")

    return run


def augment_python(spark, d):
    @aug.transformation_function(inputs=["n_chars"], outputs="n_chars long")
    def half(n_chars):
        return {"n_chars": n_chars // 2} if n_chars % 2 == 0 else None

    return aug.apply_tfs(read_table(spark, d, "documents").select("doc_id", "n_chars"), [half], aug.ApplyOnePolicy(), "doc_id")


def augment_sampled(spark, d):
    policy = aug.MeanFieldPolicy(2, 3, [0.25, 0.75], n_per_original=2, seed=9)
    return aug.apply_tfs(read_table(spark, d, "documents").select("doc_id", "n_chars"), [PLUS, SQUARE], policy, "doc_id")


def augment_generator(spark, d):
    """How many frames, rows and characters the generator gives; the driver holds one frame at a time."""
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars")
    frames = rows = chars = 0
    for frame in aug.apply_generator(docs, [PLUS, SQUARE], aug.ApplyEachPolicy(2), "doc_id", 500):
        frames, rows, chars = frames + 1, rows + len(frame), chars + int(frame["n_chars"].sum())
    return spark.createDataFrame([(frames, rows, chars)], "frames long, n_rows long, chars long")


def augment_random(spark, d):
    return aug.apply_tfs(read_table(spark, d, "documents").select("doc_id", "n_chars"), [PLUS, SQUARE], aug.RandomPolicy(2, 2, 2, seed=3), "doc_id")


def synthetic_matrix(spark, d):
    return synthetic.synthetic_votes(spark, 1000, 5, 3, 1.0, seed=2)[1].select("id", "gold", *[F.col("votes")[j].alias(f"v{j}") for j in range(5)])


def slice_tasks(spark, d):
    """The tasks that a binary task and two slices are turned into, and their operations in order."""
    head = Task("quality", {"body": MLP([2, 4], last_relu=True), "head": Linear(4, 2)}, [Operation("body", ("_input_", "x")), Operation("head", "body")])
    tasks = convert_to_slice_tasks(head, ["s_short", "s_en"])
    return spark.createDataFrame([(t.name, len(t.op_sequence), t.op_sequence[-1].name) for t in tasks], "task string, n_ops int, last string")


@labeling_function()
def lf_discount():
    return F.when(F.col("l_discount") > 0.05, 1).otherwise(-1)


@labeling_function()
def lf_quantity():
    return F.when(F.col("l_quantity") < 10, 0).when(F.col("l_quantity") > 40, 1).otherwise(-1)


@labeling_function()
def lf_flag():
    return F.when(F.col("l_returnflag") == "R", 0).otherwise(-1)


def lineitem_votes(spark, d):
    lf = read_table(spark, d, "lineitem")
    v = apply_lfs(lf.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), [lf_discount, lf_quantity, lf_flag], "id")
    return LFAnalysis(v).counts().select("name", "n_votes", "n_overlaps", "n_conflicts")


@labeling_function()
def lf_purchase():
    return F.when(F.col("event_type") == "purchase", 1).otherwise(-1)


@labeling_function()
def lf_value():
    return F.when(F.col("value") > 50, 0).otherwise(-1)


def event_windows(spark, d):
    return windowed_coverage(read_table(spark, d, "events"), [lf_purchase, lf_value], "event_id", "ts", "1 day")


def multitask_training(spark, d):
    from ..operators.classification import demo_scores

    return demo_scores(spark, read_table(spark, d, "embeddings"))


METRIC_SQL = {
    "accuracy": f"WITH {BASE}, {USED} SELECT avg((gold = pred)::INTEGER)::DOUBLE AS accuracy FROM u",
    "coverage": f"WITH {BASE} SELECT avg((pred <> -1)::INTEGER)::DOUBLE AS coverage FROM e",
    "precision": f"WITH {BASE}, {CELLS} SELECT tp::DOUBLE / (tp + fp) AS precision FROM b",
    "recall": f"WITH {BASE}, {CELLS} SELECT tp::DOUBLE / (tp + fn) AS recall FROM b",
    "f1": f"WITH {BASE}, {CELLS} SELECT 2 * tp::DOUBLE / (2 * tp + fp + fn) AS f1 FROM b",
    "f1_micro": f"WITH {BASE}, {USED} SELECT avg((gold = pred)::INTEGER)::DOUBLE AS f1_micro FROM u",
    "f1_macro": f"WITH {BASE}, {CELLS} SELECT (2 * tn::DOUBLE / (2 * tn + fn + fp) + 2 * tp::DOUBLE / (2 * tp + fp + fn)) / 2 AS f1_macro FROM b",
    "fbeta": f"WITH {BASE}, {CELLS} SELECT 5.0::DOUBLE * tp::DOUBLE / (5.0::DOUBLE * tp::DOUBLE + 4.0::DOUBLE * fn::DOUBLE + fp::DOUBLE) AS fbeta FROM b",
    "matthews_corrcoef": f"WITH {BASE}, {CELLS}, s AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, (tp + fp + fn + tn)::DOUBLE AS s FROM b) SELECT ((tp + tn) * s - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp))) / sqrt((s * s - (tp + fp) * (tp + fp) - (tn + fn) * (tn + fn)) * (s * s - (tp + fn) * (tp + fn) - (tn + fp) * (tn + fp))) AS matthews_corrcoef FROM s",
}


def _summary(extra_from: str, extra: str) -> str:
    return (
        f"WITH {VOTES}, {LONG}, {STATS}, {GOLD}, t AS (SELECT count(*)::DOUBLE AS total FROM documents) SELECT {NAME} AS lf, j::INTEGER AS j, "
        "coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT vote::VARCHAR AS x FROM lv l2 WHERE l2.j = lv.j AND vote >= 0)), '') AS polarity, "
        "count(*) FILTER (vote >= 0) / any_value(total) AS coverage, count(*) FILTER (vote >= 0 AND n_cast >= 2) / any_value(total) AS overlaps, "
        f"count(*) FILTER (vote >= 0 AND n_kinds >= 2) / any_value(total) AS conflicts{extra} FROM lv JOIN st USING (doc_id){extra_from} CROSS JOIN t GROUP BY j"
    )


def _uniform(seed: int, *parts) -> str:
    """The library's seeded uniform number: the first 52 bits of a SHA-1."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"(('0x' || substr(sha1({text}), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE)"


def _sampled_sql(seed: int, first: float, length: int, copies: int) -> str:
    """Original rows, and copies on which plus (drawn with probability ``first``) and square (where even, and no overflow) were applied."""
    square = "TRY_CAST(x::HUGEINT * x::HUGEINT AS BIGINT)"
    parts = ["SELECT doc_id, n_chars, 0::INTEGER AS aug_idx FROM documents"]
    for rep in range(copies):
        inner = f"SELECT doc_id, {rep} AS rep, n_chars::BIGINT AS x, false AS done FROM documents"
        for place in range(length):
            plus = f"{_uniform(seed, 'doc_id', rep, place)} < {first!r}::DOUBLE"
            inner = f"SELECT doc_id, rep, CASE WHEN {plus} THEN x + 1 WHEN x % 2 = 0 THEN coalesce({square}, x) ELSE x END AS x, done OR {plus} OR (x % 2 = 0 AND {square} IS NOT NULL) AS done FROM ({inner})"
        parts.append(f"SELECT doc_id, x, {rep + 1}::INTEGER FROM ({inner}) WHERE done")
    return " UNION ALL ".join(parts)


def _synthetic_sql(n: int, m: int, k: int, abstain: float, seed: int) -> str:
    sums = synthetic.random_cpts(m, k, abstain, np.random.RandomState(seed)).cumsum(axis=1)
    cases = []
    for j in range(m):
        u = _uniform(seed, "id", j)
        inner = [f"WHEN gold = {y} THEN CASE " + " ".join(f"WHEN {u} < {float(sums[j, v, y])!r}::DOUBLE THEN {v - 1}" for v in range(k)) + f" ELSE {k - 1} END" for y in range(k)]
        cases.append(f"(CASE {' '.join(inner)} END)::INTEGER AS v{j}")
    return f"WITH r AS (SELECT id, floor({_uniform(seed, 'id', -1)} * {k})::INTEGER AS gold FROM range({n}) t(id)) SELECT id, gold, {', '.join(cases)} FROM r"


def _augment_sql(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_D = "SELECT doc_id, n_chars, {} AS aug_idx FROM documents"
PLUS_SQL = "n_chars + 1"
#: plus, then square where even, else skipped
ALL_SQL = "CASE WHEN (n_chars + 1) % 2 = 0 THEN (n_chars + 1) * (n_chars + 1) ELSE n_chars + 1 END"


def queries():
    found = {
        "lf_apply": lf_apply, "lf_coverage_overlap_conflict": lf_stats, "lf_polarity": lf_polarity, "lf_summary": lf_summary, "lf_summary_gold": lf_summary_gold, "lf_normalized": lf_normalized,
        "lf_empirical_probs": lf_empirical_probs, "vote_patterns": vote_patterns, "votes_long": votes_long, "pair_matrix": pair_matrix, "majority_probs": majority_probs,
        "majority_preds_abstain": majority_abstain, "majority_preds_random": majority_random, "majority_class": majority_class, "random_voter": random_voter, "filter_unlabeled": unlabeled_filtered,
        "bayes_posterior_fixed_cpt": bayes_posterior, "label_model_probs": label_model, "label_model_weights": label_model_weights, "class_balance": class_balance, "metric_roc_auc": metric_roc_auc,
        "confusion_matrix": confusion_matrix, "score_slices": score_slices, "slice_matrix": slice_matrix, "slice_dataframe": slice_dataframe, "slice_labels": slice_labels, "slice_combiner": slice_combiner,
        "label_buckets": label_buckets, "label_instances": label_instances, "preds_to_probs": preds_to_probs, "dense_index": dense_index, "filter_labels": filtered_labels,
        "soft_cross_entropy": soft_cross_entropy, "softmax_probs": softmax_probs, "padded": padded, "mapped_columns": mapped_columns, "memoized_map": memoized_map,
        "rows_mapped_to_none": rows_mapped_to_none, "python_votes": python_votes, "fault_counts": fault_counts, "nlp_votes": nlp_votes, "token_counts": token_counts,
        "augment_apply_all": _augmented(aug.ApplyAllPolicy(2, keep_original=False)), "augment_apply_each": _augmented(aug.ApplyEachPolicy(2)), "augment_apply_one": _augmented(aug.ApplyOnePolicy(2)),
        "augment_none_skip": augment_python, "augment_sampled": augment_sampled, "augment_random": augment_random, "synthetic_matrix": synthetic_matrix, "lineitem_votes": lineitem_votes,
        "event_windows": event_windows, "multitask_training": multitask_training, "labeler_score": labeler_score, "saved_voter": saved_voter, "conditional_probs": conditional_probs,
        "scorer_slices": scorer_slices, "soft_loss": soft_loss, "int_labels": int_labels, "lambda_mapped": lambda_mapped, "preprocessed_votes": preprocessed_votes, "batch_faults": batch_faults,
        "augment_generator": augment_generator, "slice_tasks": slice_tasks,
    }
    for name in METRIC_SQL:
        found[f"metric_{name}"] = _metric(name, **({"beta": 2.0} if name == "fbeta" else {}))
    return found


def oracle_sql():
    log_terms = {y: " + ".join([f"ln({PRIOR[y]}::DOUBLE)", *[f"CASE v{j} WHEN 0 THEN ln({FIXED_CPT[j][0][y]}::DOUBLE) WHEN 1 THEN ln({FIXED_CPT[j][1][y]}::DOUBLE) ELSE 0 END" for j in range(M_LFS)]]) for y in (0, 1)}
    slice_rows = " UNION ALL ".join([f"SELECT 'overall' AS slice, gold, pred FROM e"] + [f"SELECT '{s}', gold, pred FROM e JOIN documents d USING (doc_id) WHERE {c}" for s, c in zip(SLICES, ("d.n_chars < 900", "d.lang = 'en'", "doc_id % 3 = 0"), strict=True)])
    head = lambda k: f"SELECT vec_id, {k} AS k, 1 / (1 + exp(embedding[{2 * k + 1}]::DOUBLE - embedding[{2 * k + 2}]::DOUBLE)) * (1 / (1 + exp(embedding[{k + 1}]::DOUBLE - embedding[{k + 5}]::DOUBLE))) AS a, embedding[{k + 1}]::DOUBLE AS f0, {k}::DOUBLE AS f1 FROM embeddings"
    z = [f"embedding[{k}]::DOUBLE" for k in (1, 2, 3)]
    lse = f"ln({' + '.join(f'exp({x})' for x in z)})"
    draws = ", ".join(f"{_uniform(4, 'doc_id', c)} AS u{c}" for c in range(3)) + " FROM documents"
    sql = {
        "lf_apply": f"SELECT doc_id, {', '.join(f'({c})::INTEGER AS {n}' for c, n in zip(CASES, NAMES, strict=True))} FROM documents",
        "lf_coverage_overlap_conflict": f"WITH {VOTES}, {LONG}, {STATS} SELECT count(*) FILTER (n_cast >= 1) / count(*)::DOUBLE AS coverage, count(*) FILTER (n_cast >= 2) / count(*)::DOUBLE AS overlap, count(*) FILTER (n_kinds >= 2) / count(*)::DOUBLE AS conflict FROM st",
        "lf_polarity": f"WITH {VOTES}, {LONG} SELECT {NAME} AS lf, coalesce(string_agg(DISTINCT CASE WHEN vote >= 0 THEN vote::VARCHAR END, ','), '') AS polarity FROM lv GROUP BY j",
        "lf_summary": _summary("", ""),
        "lf_summary_gold": _summary(" JOIN g USING (doc_id)", ", count(*) FILTER (vote >= 0 AND vote = gold) AS correct, count(*) FILTER (vote >= 0 AND gold >= 0 AND vote <> gold) AS incorrect, coalesce(count(*) FILTER (vote >= 0 AND vote = gold)::DOUBLE / nullif(count(*) FILTER (vote >= 0), 0), 0) AS emp_acc, (CASE j " + " ".join(f"WHEN {j} THEN {0.5 + j / 100!r}" for j in range(M_LFS)) + " END)::DOUBLE AS learned_weight"),
        "lf_normalized": f"WITH {VOTES}, {LONG}, {STATS}, q AS (SELECT j, count(*) FILTER (vote >= 0) AS a, count(*) FILTER (vote >= 0 AND n_cast >= 2) AS b, count(*) FILTER (vote >= 0 AND n_kinds >= 2) AS c FROM lv JOIN st USING (doc_id) GROUP BY j) SELECT j::INTEGER AS j, coalesce(b::DOUBLE / nullif(a, 0), 0) AS overlaps, coalesce(c::DOUBLE / nullif(b, 0), 0) AS conflicts FROM q",
        "lf_empirical_probs": f"WITH {VOTES}, {LONG}, {GOLD}, n AS (SELECT gold AS y, count(*) AS total FROM g WHERE gold >= 0 GROUP BY gold), grid AS (SELECT j, vote, y FROM range({M_LFS}) a(j), range(-1, 2) b(vote), range(2) c(y)), s AS (SELECT j, vote, gold AS y, count(*) AS n FROM lv JOIN g USING (doc_id) GROUP BY ALL) SELECT j::INTEGER AS j, vote::INTEGER AS vote, y::INTEGER AS y, coalesce(s.n, 0)::DOUBLE / total AS prob FROM grid LEFT JOIN s USING (j, vote, y) LEFT JOIN n USING (y)",
        "vote_patterns": f"WITH {VOTES} SELECT concat_ws(',', {', '.join(f'v{j}' for j in range(M_LFS))}) AS pattern, count(*) AS n FROM v GROUP BY ALL",
        "votes_long": f"WITH {VOTES}, {LONG} SELECT doc_id, j::INTEGER AS j, vote::INTEGER AS vote FROM lv WHERE vote >= 0",
        "pair_matrix": f"WITH {VOTES}, {LONG}, o AS (SELECT doc_id, 2 * j + vote AS a FROM lv WHERE vote >= 0) SELECT x.a::INTEGER AS a, y.a::INTEGER AS b, count(*) AS n FROM o x JOIN o y USING (doc_id) GROUP BY ALL",
        "majority_probs": f"WITH {VOTES}, {LONG}, {COUNTS}, {PROBS} SELECT doc_id, p0, p1 FROM p",
        "majority_preds_abstain": f"WITH {VOTES}, {LONG}, {COUNTS} SELECT doc_id, CASE WHEN c0 > c1 THEN 0 WHEN c1 > c0 THEN 1 ELSE -1 END::INTEGER AS pred FROM c",
        "majority_preds_random": f"WITH {VOTES}, {LONG}, {COUNTS}, {PROBS}, {PRED} SELECT doc_id, pred FROM r",
        "majority_class": "SELECT doc_id, 0.0::DOUBLE AS p0, 1.0::DOUBLE AS p1 FROM documents",
        "filter_unlabeled": f"WITH {VOTES} SELECT doc_id, n_chars FROM documents JOIN v USING (doc_id) WHERE {' OR '.join(f'v{j} <> -1' for j in range(M_LFS))}",
        "bayes_posterior_fixed_cpt": f"WITH {VOTES}, s AS (SELECT doc_id, {log_terms[0]} AS a, {log_terms[1]} AS b FROM v) SELECT doc_id, round(1 / (1 + exp(b - a)), 6) AS p0, round(1 / (1 + exp(a - b)), 6) AS p1 FROM s",
        "class_balance": f"WITH {GOLD} SELECT gold, count(*)::DOUBLE / (SELECT count(*) FROM g WHERE gold >= 0) AS share FROM g WHERE gold >= 0 GROUP BY gold",
        "metric_roc_auc": f"WITH {BASE}, u AS (SELECT p1, gold FROM e WHERE gold <> -1) SELECT avg(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS auc FROM u a, u b WHERE a.gold = 1 AND b.gold = 0",
        "confusion_matrix": f"WITH {BASE} SELECT gold, pred, count(*) AS n FROM e GROUP BY ALL",
        "score_slices": f"WITH {BASE}, s AS ({slice_rows}), q AS (SELECT slice, count(*) AS n, count(*) FILTER (gold <> -1 AND pred <> -1) AS used, count(*) FILTER (pred <> -1) AS covered, count(*) FILTER (gold <> -1 AND gold = pred) AS rt, count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn FROM s GROUP BY slice) SELECT slice, n, coalesce(rt::DOUBLE / nullif(used, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, covered::DOUBLE / n AS coverage FROM q",
        "slice_matrix": "SELECT doc_id, (n_chars < 900)::INTEGER AS sf_short, (lang = 'en')::INTEGER AS sf_en FROM documents",
        "slice_dataframe": "SELECT doc_id, n_chars FROM documents WHERE n_chars < 900",
        "slice_labels": f"WITH {GOLD} SELECT doc_id, 1::INTEGER AS base_ind, gold AS base_pred, (n_chars < 900)::INTEGER AS short_ind, CASE WHEN n_chars < 900 THEN gold ELSE -1 END::INTEGER AS short_pred FROM documents JOIN g USING (doc_id)",
        "slice_combiner": f"WITH h AS ({' UNION ALL '.join(head(k) for k in range(3))}) SELECT vec_id, round(sum(exp(a) * f0) / sum(exp(a)), 6) AS c0, round(sum(exp(a) * f1) / sum(exp(a)), 6) AS c1 FROM h GROUP BY vec_id",
        "label_buckets": f"WITH {BASE} SELECT gold, pred, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM e GROUP BY gold, pred",
        "label_instances": f"WITH {BASE} SELECT doc_id FROM e WHERE gold = 0 AND pred = 1",
        "preds_to_probs": f"WITH {BASE} SELECT doc_id, (pred = 0)::INTEGER::DOUBLE AS p0, (pred = 1)::INTEGER::DOUBLE AS p1 FROM e",
        "dense_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE n_chars > 500",
        "filter_labels": f"WITH {BASE} SELECT doc_id, gold, pred FROM e WHERE gold <> -1 AND pred <> 0",
        "soft_cross_entropy": f"SELECT vec_id, round(0.2 * ({lse} - {z[0]}) + 2.0 * 0.5 * ({lse} - {z[1]}) + 0.5 * 0.3 * ({lse} - {z[2]}), 6)::DOUBLE AS loss FROM embeddings",
        "softmax_probs": f"SELECT vec_id, round(1 / (1 + exp({z[1]} - {z[0]})), 6) AS p0, round(1 / (1 + exp({z[0]} - {z[1]})), 6) AS p1 FROM embeddings",
        "padded": "WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id) SELECT conv_id, " + ", ".join(f"{x} AS {n}" for n, x in (("padded", "concat_ws(',', " + ", ".join(f"coalesce(l[{k}], -9)" for k in (1, 2, 3, 4)) + ")"), ("mask", "concat_ws(',', " + ", ".join(f"(l[{k}] IS NULL)::INTEGER" for k in (1, 2, 3, 4)) + ")"))) + " FROM t",
        "mapped_columns": "SELECT doc_id, n_chars * n_chars AS num_squared, upper(lang) AS lang_upper FROM documents",
        "memoized_map": "SELECT doc_id, (length(lang) + length(source))::INTEGER AS key_len FROM documents",
        "rows_mapped_to_none": "SELECT doc_id, doc_id // 2 AS half FROM documents WHERE doc_id % 3 <> 0",
        "python_votes": "SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE -1 END::INTEGER AS lf_en, CASE WHEN n_chars > 1000 THEN 1 ELSE -1 END::INTEGER AS lf_pandas, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 4 ELSE -1 END::INTEGER AS lf_row FROM documents",
        "fault_counts": "SELECT 0::BIGINT AS lf_en, 0::BIGINT AS lf_pandas, count(*) FILTER (doc_id % 11 = 0) AS lf_row FROM documents",
        "augment_apply_all": f"SELECT doc_id, {ALL_SQL} AS n_chars, 0::INTEGER AS aug_idx FROM documents",
        "augment_apply_each": _augment_sql(_D.format("0::INTEGER"), f"SELECT doc_id, {PLUS_SQL}, 1::INTEGER FROM documents", "SELECT doc_id, n_chars * n_chars, 2::INTEGER FROM documents WHERE n_chars % 2 = 0"),
        "augment_apply_one": _augment_sql(_D.format("0::INTEGER"), f"SELECT doc_id, {PLUS_SQL}, 1::INTEGER FROM documents", f"SELECT doc_id, {PLUS_SQL}, 2::INTEGER FROM documents"),
        "augment_none_skip": _augment_sql(_D.format("0::INTEGER"), "SELECT doc_id, n_chars // 2, 1::INTEGER FROM documents WHERE n_chars % 2 = 0"),
        "lineitem_votes": "WITH v AS (SELECT CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END AS a, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity > 40 THEN 1 ELSE -1 END AS b, CASE WHEN l_returnflag = 'R' THEN 0 ELSE -1 END AS c FROM lineitem), s AS (SELECT *, (a >= 0)::INTEGER + (b >= 0)::INTEGER + (c >= 0)::INTEGER AS n, (a = 1 OR b = 1) AND (b = 0 OR c = 0) AS x FROM v) " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({k} >= 0) AS n_votes, count(*) FILTER ({k} >= 0 AND n >= 2) AS n_overlaps, count(*) FILTER ({k} >= 0 AND x) AS n_conflicts FROM s" for n, k in (("lf_discount", "a"), ("lf_quantity", "b"), ("lf_flag", "c"))),
        "random_voter": f"WITH u AS (SELECT doc_id, {draws}) SELECT doc_id, u0 / (u0 + u1 + u2) AS p0, u1 / (u0 + u1 + u2) AS p1, u2 / (u0 + u1 + u2) AS p2 FROM u",
        "nlp_votes": r"SELECT doc_id, (len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+'))) % 3)::INTEGER AS lf_words FROM documents",
        "token_counts": r"SELECT item_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS n FROM benchmark",
        "augment_sampled": _sampled_sql(9, 0.25, 3, 2),
        "augment_random": _sampled_sql(3, 0.5, 2, 2),
        "augment_generator": "WITH r AS (SELECT n_chars AS c FROM documents UNION ALL SELECT n_chars + 1 FROM documents UNION ALL SELECT n_chars * n_chars FROM documents WHERE n_chars % 2 = 0) SELECT ceil(count(*) / 500.0)::BIGINT AS frames, count(*) AS n_rows, sum(c)::BIGINT AS chars FROM r",
        "synthetic_matrix": _synthetic_sql(1000, 5, 3, 1.0, 2),
        "labeler_score": f"SELECT a.accuracy, c.coverage, f.f1 FROM ({METRIC_SQL['accuracy']}) a, ({METRIC_SQL['coverage']}) c, ({METRIC_SQL['f1']}) f",
        "saved_voter": "SELECT doc_id, 0.0::DOUBLE AS p0, 1.0::DOUBLE AS p1 FROM documents",
        "conditional_probs": "SELECT * FROM (VALUES " + ", ".join(f"({j}::INTEGER, {v}::INTEGER, {y}::INTEGER, round({(1 - FIXED_CPT[j][0][y] - FIXED_CPT[j][1][y]) if v < 0 else FIXED_CPT[j][v][y]!r}::DOUBLE, 6))" for j in range(M_LFS) for v in (-1, 0, 1) for y in (0, 1)) + ") t(j, vote, y, prob)",
        "soft_loss": f"WITH e AS (SELECT 0.2 * ({lse} - {z[0]}) + 2.0 * 0.5 * ({lse} - {z[1]}) + 0.5 * 0.3 * ({lse} - {z[2]}) AS x FROM embeddings) SELECT 'mean' AS reduction, round(avg(x), 6)::DOUBLE AS loss FROM e UNION ALL SELECT 'sum', round(sum(x), 6)::DOUBLE FROM e",
        "int_labels": "SELECT doc_id, toxic::INTEGER AS toxic FROM labels",
        "lambda_mapped": "SELECT doc_id, 2 * n_chars AS twice, lang || '/' || source AS tag FROM documents",
        "preprocessed_votes": "SELECT doc_id, CASE WHEN n_chars > 300 THEN n_chars % 2 ELSE -1 END::INTEGER AS lf_parity FROM documents",
        "batch_faults": "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id % 2 END::INTEGER AS vote, (doc_id % 13 = 0)::INTEGER AS fault FROM documents",
        "slice_tasks": "SELECT * FROM (VALUES " + ", ".join(f"('quality_slice:{s}_ind', 2::INTEGER, 'quality_slice:{s}_ind_head'), ('quality_slice:{s}_pred', 3::INTEGER, 'quality_slice:{s}_pred_head')" for s in ("base", "s_short", "s_en")) + ", ('quality', 12::INTEGER, 'quality_master')) t(task, n_ops, last)",
        "event_windows": "WITH v AS (SELECT date_trunc('day', ts)::TIMESTAMP AS w, event_type = 'purchase' AS a, value > 50 AS b FROM events) SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, count(*) AS n, count(*) FILTER (a OR b) AS covered, count(*) FILTER (a AND b) AS conflicts FROM v GROUP BY w",
    }
    sql["scorer_slices"] = f"SELECT slice, accuracy, coverage, f1 FROM ({sql['score_slices']})"
    return sql | {f"metric_{k}": v for k, v in METRIC_SQL.items()}
