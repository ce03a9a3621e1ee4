"""Held-out and recall figures of the operators: ``python -m votewright.llm.measure DIR``."""

from __future__ import annotations

import json
import random
import string
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import registry, secrets
from .common import read


def language(spark: SparkSession, d: str) -> dict:
    """Held-out documents whose language was told right."""
    told = registry.op3_language_id(spark, d).where("held_out").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null")
    n, right = told.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    return {"documents": n, "right": right}


def toxic(spark: SparkSession, d: str) -> dict:
    """Held-out labelled documents: toxic ones found and clean ones flagged."""
    labels = read(spark, d, "labels").where("toxic in (0, 1)").select("doc_id", "toxic")
    got = registry.op7_toxicity(spark, d).where("held_out").join(labels, "doc_id")
    cells = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    return {"toxic": cells.get((1, 1), 0) + cells.get((1, 0), 0), "found": cells.get((1, 1), 0), "clean": cells.get((0, 1), 0) + cells.get((0, 0), 0), "flagged": cells.get((0, 1), 0)}


def near_copies(spark: SparkSession, d: str) -> dict:
    """Documents of classes of two or more by exhaustive comparison, and how many of them have the same class here."""
    import duckdb

    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        want = {i: c for i, c, n in db.sql(f"SELECT doc_id, class_id, class_size FROM ({registry.oracle_sql()['op1_neardup']})").fetchall() if n > 1}
    got = {r.doc_id: r.class_id for r in registry.op1_neardup(spark, d).select("doc_id", "class_id").collect()}
    return {"copies": len(want), "same_class": sum(got[i] == c for i, c in want.items())}


def secret_runs(spark: SparkSession, d: str) -> dict:
    """Random strings by length that the Markov models tell, and the share of documents with a span of theirs beyond the patterns'."""
    rng, table, n = random.Random(1), secrets.log_ratios(read(spark, d, "documents")), len(secrets.ALPHABET)
    score = lambda x: sum(table[secrets.ALPHABET.index(a) * n + secrets.ALPHABET.index(b)] for a, b in zip(x[:-1], x[1:], strict=True))
    drawn = lambda k: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(k))
    found = {k: sum(score(drawn(k)) > secrets.MARGIN for _ in range(1000)) for k in (12, 16, 20, 24, 40, 270)}
    got = registry.op6_secrets(spark, d).agg(F.count(F.lit(1)), F.count_if(F.expr("n_markov > 0")), F.count_if(F.expr("n_markov > 0 and n_assign + n_access + n_hex = 0"))).first()
    return {"found_of_1000_by_length": found, "documents": got[0], "with_markov_spans": got[1], "with_markov_spans_alone": got[2]}


def padding(spark: SparkSession, d: str) -> dict:
    """Sequences, and the share of padding in them (a power of two needs none)."""
    full = registry.op8_packing(spark, d).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.pow(F.lit(2), F.ceil(F.log2(F.col("n").cast("double"))))
    size = F.when(power == F.col("n"), F.col("n")).otherwise(F.lit(4096))
    n, used, room = full.agg(F.count(F.lit(1)), F.sum("n"), F.sum(size)).first()
    return {"sequences": n, "padding": round(1 - used / room, 5)}


def main(d: str) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for measure in (language, toxic, near_copies, secret_runs, padding):
        print(json.dumps({measure.__name__: measure(spark, d)}), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
