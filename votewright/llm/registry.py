"""Queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from .common import read
from .decontaminate import decontaminate
from .language import identify
from .licenses import scan as scan_licenses
from .lines import dedup
from .neardup import classes
from .neighbours import nearest
from .oracles import SQL
from .packing import pack
from .repeats import remove_repeats
from .secrets import scan as scan_secrets
from .toxicity import toxicity


def tokenizer_path():
    """Where the public vocabulary lies on the driver; its content is sent to the executors."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_neardup(spark, sf_dir):
    return classes(read(spark, sf_dir, "documents"))


def op2_repeats(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))


def op4_lines(spark, sf_dir):
    return dedup(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op6_secrets(spark, sf_dir):
    return scan_secrets(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_nearest(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"))


def op10_licenses(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_neardup": op1_neardup,
        "op2_repeats": op2_repeats,
        "op3_language_id": op3_language_id,
        "op4_lines": op4_lines,
        "op5_decontaminate": op5_decontaminate,
        "op6_secrets": op6_secrets,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_nearest": op9_nearest,
        "op10_licenses": op10_licenses,
    }


def oracle_sql():
    """The rest is trained, or has spans and labels that SQL cannot give; tests/llm holds each against brute force or held-out rows."""
    return dict(SQL)
