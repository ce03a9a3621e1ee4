"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; every result is written as Parquet and read again as the next stage's
documents. The stages are filters and edits with documents' own columns, but
for the last, which returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from votewright.llm.common import checkpoint_folder, read
from votewright.llm.decontaminate import cut
from votewright.llm.language import accepted
from votewright.llm.lines import without_repeats
from votewright.llm.neardup import without_near_copies
from votewright.llm.packing import pack
from votewright.llm.registry import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null lang becomes the one the network predicts.

    Texts that are null, empty or without a letter go, and those of which the
    network prefers no language; without labels to learn from every lettered
    text stays. Repeated rows and rows without an id are judged one by one, long
    texts whole; columns stay, whatever their names; an empty table stays empty.
    """
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, are taken out of their documents.

    Every row stays: null texts stay null, a copy of which nothing is left has
    an empty text (the next stage keeps one such). Rows equal in doc_id and text
    lose the same lines; rows without an id come last; lines without a letter or
    digit stay. An empty table stays empty.
    """
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest doc_id, rows without an id last.

    Of rows equal in doc_id and text one stays, of equal texts without words
    one; null texts are copies of nothing. An empty table stays empty.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with phrases of two benchmark items go; single items' phrases are cut out of the rest.

    Null, empty and wordless texts stay as they are, as all do if there are no
    items; repeated rows and rows without an id are judged one by one.
    """
    return cut(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    A null or empty text is one piece with id 2; repeated rows and rows without
    an id are packed one by one; an empty table has no pieces.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained and iterative stages have no SQL; tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written to the checkpoint folder and read again."""
    folder = checkpoint_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
