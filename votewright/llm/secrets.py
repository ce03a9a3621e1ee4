"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two bigram models over the characters of a run, one of random strings and one
of ordinary identifiers and words, are compared by their log-likelihood ratio;
a run of at least 12 characters, taken whole, whose ratio exceeds ``MARGIN``
nats is a span of kind ``markov``. Random strings are drawn by hashing counters,
ordinary ones are a labelled list and the words of a bounded sample of documents.

Everything runs in DataFrame functions: the patterns' places come from running
sums over split pieces, the models are a table of at most 65 * 65 log ratios.

Defined results: a null text is empty and has no spans; the digest of no spans
is that of the empty string. Texts are scanned whole, however long. Rows that
repeat an id and a text, and rows without an id, get the same answer each. Spans
that start together stand in the order of their kinds. Further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constant
from .matches import KEY, found, placed, row_key, same_key

#: Patterns in order of kind, with the least length of the part that decides.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NEAR = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # all runs of 18 or more; shorter ones hold no longer one
HEX = "[0-9a-f]{16,}"
RUN, RUN_NEAR = "[A-Za-z0-9+/_=-]{12,}", "[A-Za-z0-9+/_=-]{12}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least log-likelihood ratio of a secret, in nats.
MARGIN = 12.0
#: Random strings drawn, and documents whose words are learned from.
RANDOM_STRINGS = 3000
SAMPLE_DOCUMENTS = 2000
#: How often each listed identifier counts.
LISTED_WEIGHT = 200

IDENTIFIERS = """
get_user_name setDefaultValue application_configuration HttpRequestHandler maximum-connection-count
database_connection_string createNewInstance abstract_base_class_factory onButtonClickListener is_enabled
public_static_final_string org/apache/commons/logging com/example/project/service content-type-negotiation
user_authentication_provider JavaScriptObjectNotation serialize_to_json_string parse_command_line_arguments
test_should_return_empty_list initializeComponentState background-color-transition margin-bottom-large
index_of_first_element number_of_worker_threads temporaryFileDirectory environment_variable_name
calculateTotalPriceWithTax validate_email_address_format handleIncomingMessage retry_with_exponential_backoff
spring-boot-starter-web usr/local/share/applications home/user/documents/reports src/main/resources/templates
__init_subclass__ numpy_array_from_buffer convolutional_neural_network stochastic_gradient_descent
AbstractSingletonProxyFactoryBean internationalization_and_localization characterEncodingFilter
pneumonoultramicroscopic responsibilities-and-requirements Donaudampfschifffahrtsgesellschaft
contraintes_environnementales desenvolvimiento_extraordinario Rechtsschutzversicherungsgesellschaften
""".split()


#: Runs of one character are ordinary too.
IDENTIFIERS += [c * 24 for c in ALPHABET]


def log_ratios(documents: DataFrame, strings: int = RANDOM_STRINGS, rows: int = SAMPLE_DOCUMENTS) -> list[float]:
    """log P(b after a | random) - log P(b after a | ordinary) for each pair of characters, row by row."""
    spark = documents.sparkSession
    n = len(ALPHABET)
    digest = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id").cast("string")), 256)
    shapes = [
        F.translate(F.base64(F.unhex(digest("base64"))), "\r\n", ""),
        F.substring(F.translate(F.base64(F.unhex(digest("id"))), "+/=", "xyz"), 1, 32),
        F.translate(F.base64(F.unhex(digest("url"))), "+/=", "-_"),
        F.upper(F.substring(F.translate(F.base64(F.unhex(digest("upper"))), "+/=", "7KQ"), 1, 24)),
        F.substring(digest("hex"), 1, 40),
        F.substring(digest("uuid"), 3, 20),
    ]
    # each shape is equally frequent
    random = spark.range(0, strings, 1, 2).select(F.explode(F.array(*shapes)).alias("run"))
    share = documents.select(F.count(F.lit(1))).first()[0]
    keep = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30)) <= int(min(1.0, rows / max(share, 1)) * (1 << 30))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = documents.where(keep).limit(2 * rows).select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("run"))
    listed = spark.range(0, 1, 1, 1).select(F.explode(F.split(F.lit(" ".join(IDENTIFIERS)), " ")).alias("run"))
    weighed = lambda df, is_random, weight: df.select("run", F.lit(is_random).alias("is_random"), F.lit(weight).alias("weight"))
    both = weighed(random, True, 1).unionByName(weighed(words, False, 1)).unionByName(weighed(listed, False, LISTED_WEIGHT))
    code = F.transform(F.split("run", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = both.select("is_random", "weight", code.alias("codes")).select("is_random", "weight", F.explode(_pairs(F.col("codes"))).alias("pair")).where("pair >= 0")
    counts = {(r.is_random, r.pair): r.n for r in pairs.groupBy("is_random", "pair").agg(F.sum("weight").alias("n")).collect()}  # at most 2 n n rows
    out = []
    for a in range(n):
        totals = {k: sum(counts.get((k, a * n + b), 0) for b in range(n)) + 0.5 * n for k in (True, False)}
        for b in range(n):
            p = {k: (counts.get((k, a * n + b), 0) + 0.5) / totals[k] for k in (True, False)}
            out.append(math.log(p[True] / p[False]))
    return out


def _pairs(codes):
    """Numbers a * n + b of neighbouring characters (from 0); -1 where one is not in the alphabet."""
    n = len(ALPHABET)
    size = F.size(codes)
    left, right = F.slice(codes, 1, F.greatest(size - 1, F.lit(0))), F.slice(codes, 2, F.greatest(size - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * n + b - 1).otherwise(-1))


def scan(documents: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end) and n_markov of each document."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = constant(log_ratios(documents), "double")
    text = F.col("text")
    none = F.array().cast("array<struct<before:int,match:string>>")
    searches = [(ASSIGN, ASSIGN_NEAR), (ACCESS, "AKIA"), (HEX, "[0-9a-f]{16}"), (RUN, RUN_NEAR)]
    columns = [
        F.struct(F.lit(k).alias("kind"), F.when(text.rlike(near), found(text, F.lit(regex))).otherwise(none).alias("hits"))
        for k, (regex, near) in enumerate(searches)
    ]
    near = text.contains("AKIA") | text.rlike(RUN_NEAR) | text.rlike(ASSIGN_NEAR)
    some = rows.where(near).select(*row_key(text, F.col("doc_id")), "text").dropDuplicates(KEY)
    hits = some.select(*KEY, F.explode(F.array(*columns)).alias("s")).select(*KEY, "s.kind", F.posexplode("s.hits").alias("pos", "hit"))
    hits = placed(hits.select(*KEY, "kind", "pos", "hit.before", "hit.match"), [*KEY, "kind"])
    codes = F.transform(F.split("match", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    ratio = F.aggregate(F.transform(_pairs(codes), lambda p: F.when(p < 0, 0.0).otherwise(F.get(table, p))), F.lit(0.0), lambda a, x: a + x)
    value = F.regexp_extract("match", ASSIGN, 2)
    kept = hits.where(F.when(F.col("kind") == 0, F.char_length(value) >= 12).when(F.col("kind") == 3, ratio > margin).otherwise(True))
    spans = kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    named = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    spans = spans.select(
        *KEY, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_markov"),
        F.sha2(named(F.filter("all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), named(F.col("all")).alias("spans"),
    )
    asked = rows.select("doc_id", *row_key(text, F.col("doc_id")))
    zero = lambda c: F.coalesce(spans[c], F.lit(0).cast("long")).alias(c)
    return asked.join(spans, same_key(asked, spans), "left").select(
        asked["doc_id"], zero("n_assign"), zero("n_access"), zero("n_hex"), zero("n_markov"),
        F.coalesce(spans["base_sha256"], F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce(spans["spans"], F.lit("")).alias("spans"),
    )
