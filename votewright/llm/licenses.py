"""Licence scans by ordered signature rules with a keyword prefilter.

A text that holds none of a few stems is done with; for the rest, words are
lower-cased and joined by single spaces, the rules whose keyword occurs are
searched, and of the places found those that lie within the place of a rule of
higher priority (or within a longer one of the same priority) are suppressed.
What is left gives the labels, beside those of the three base phrases. All of
it is DataFrame functions; containment is a running maximum over the places in
order, so its cost does not grow with the square of their number.

Defined results: a null text is empty; without places n_base is 0, first_word
and last_word are null, the label lists are empty strings and the score is 0.
The score is 1 with a base label, else 0.95, 0.8 or 0.5 by the best surviving
priority. Texts are scanned whole, however long. Rows that repeat an id and a
text, and rows without an id, get the same answer each; of two rules that find
the very same place the first in the list counts. Further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import rules
from .matches import KEY, found, placed, row_key, same_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Every place of a rule or a base phrase holds one of these stems, or matches SHORT.
STEMS = [
    "licen", "lizenz", "domain", "reserved", "confidential", "creative", "gpl", "cddl", "cc0", "bsd", "apache", "mozilla", "gfdl", "eupl", "cecill", "odbl", "pddl", "sspl", "busl",
    "expat", "hereby", "neither", "advertising", "redistribution", "openssl", "ssleay", "ncsa", "illinois", "x11", "consortium", "permission", "affero", "altered",
    "unencumbered", "fuck", "bitstream", "agreement", "watcom", "mulan", "openrail", "clause", "classpath", "w3c", "ms-pl", "cdla",
]
#: Short keywords, told by a word limit before them.
SHORT = r"(?<![0-9a-z\x80-\x{10FFFF}])(?:cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by|perl|beer|wtfpl|mpl|epl|odc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by|ofl|jpl|ms[\x00-\x2F\x3A-\x60\x7B-\x7F]+pl|evil)"
WEIGHT = {3: 0.95, 2: 0.8, 1: 0.5}


def spaces(c):
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def lowered(text):
    """A-Z in lower case; other letters may change too, but neither word limits nor the phrases depend on them."""
    return F.lower(text)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = lowered(F.col("text"))
    table = rules()
    near = reduce(lambda a, b: a | b, [low.contains(x) for x in STEMS]) | low.rlike(SHORT)
    some = rows.select(*row_key(F.col("text"), F.col("doc_id")), low.alias("low"), near.alias("near")).where("near")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", GAP, " ")), F.lit(" "))
    some = some.dropDuplicates(KEY).select(*KEY, norm.alias("norm"))
    listed = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(f" (?:{x})(?= )").alias("regex")) for n, label, p, k, x in table])
    base = F.array(*[F.struct(F.lit(-1 - k).alias("rule"), F.lit(label).alias("label"), F.lit(9).alias("priority"), F.lit(x).alias("keyword"), F.lit(f" {x}(?= )").alias("regex")) for k, (label, x) in enumerate(BASE)])
    tried = some.select(*KEY, "norm", F.explode(F.filter(F.concat(base, listed), lambda r: F.col("norm").contains(r["keyword"]))).alias("r"))
    hits = tried.select(*KEY, "r.rule", "r.label", "r.priority", F.posexplode(found(F.col("norm"), F.col("r.regex"))).alias("pos", "hit"), "norm")
    # a base phrase's word number: the spaces before it, kept only where it is needed
    hits = placed(hits.select(*KEY, "rule", "label", "priority", "pos", "hit.before", "hit.match", F.when(F.col("rule") < 0, F.col("norm")).alias("norm")), [*KEY, "rule"])
    hits = hits.withColumn("word", F.when(F.col("rule") < 0, spaces(F.substring(F.col("norm"), F.lit(1), F.col("start").cast("int")))))
    order = Window.partitionBy(*KEY).orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule")
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    level = lambda p: F.when((F.col("priority") >= p) & (F.col("rule") >= 0), F.col("end"))
    covered = F.lit(False)
    for p in sorted(WEIGHT):
        covered = covered | ((F.col("priority") == p) & (F.coalesce(F.max(level(p)).over(until), F.lit(-1)) >= F.col("end")))
    later = Window.partitionBy(*KEY).orderBy("start").rangeBetween(Window.currentRow, Window.currentRow)
    for p in sorted(WEIGHT):  # a place of higher priority that begins at the same character but ends earlier stands after it
        covered = covered | ((F.col("priority") == p) & (F.coalesce(F.max(level(p + 1)).over(later), F.lit(-1)) >= F.col("end")))
    kept = hits.withColumn("covered", covered)
    rule = F.col("rule")
    labels = kept.groupBy(*KEY).agg(
        F.count_if(rule < 0).alias("n_base"),
        F.min("word").cast("long").alias("first_word"),
        F.max("word").cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(rule < 0, F.col("label")))).alias("base"),
        F.array_sort(F.collect_set(F.when((rule < 0) | ~F.col("covered"), F.col("label")))).alias("all"),
        F.max(F.when(rule < 0, 9).when(~F.col("covered"), F.col("priority"))).alias("best"),
    )
    weight = F.when(F.col("best") == 9, 1.0)
    for p, w in WEIGHT.items():
        weight = weight.when(F.col("best") == p, w)
    labels = labels.select(*KEY, "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"), weight.otherwise(0.0).alias("score"))
    asked = rows.select("doc_id", *row_key(F.col("text"), F.col("doc_id")), F.regexp_count("text", F.lit(WORD.replace(r"\x60", r"\x40\x5B-\x60"))).cast("long").alias("n_words"))
    return asked.join(labels, same_key(asked, labels), "left").select(
        asked["doc_id"], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
