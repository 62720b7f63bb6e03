"""Secret scans in SQL functions alone: fixed patterns plus a pair of Markov models.

Base spans are the leftmost non-overlapping matches of three patterns, kept when long
enough. The method adds spans of tokens that no base span touches: two first-order
character models, one of random strings and one of ordinary identifiers, score each
token by its log-likelihood ratio, and tokens above a threshold are secrets.

Both models are fitted on labelled samples. The query labels values of base matches as
random and words of the documents as ordinary, at most ``SAMPLE_ROWS`` of each, those of
the smallest hash. Only pair counts (at most 2 * 68 * 68 rows) reach the driver. Without any
random sample the smoothed model is the uniform one.

Places are code points, ends exclusive. Null text is an empty text. Repeated rows each
get a row; null ids stay null.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge, and the words that stand for ordinary identifiers.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{8,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # 0: any other character

#: Natural-log ratio from which a token counts as random.
LEAST_RATIO = 20.0
SAMPLE_ROWS = 20_000

SPAN = "struct<start:int,kind_no:int,end:int,value:string>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans; ``value`` is the given group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"))

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.length(part["found"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), part["value"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), _none().alias("spans"))
    spans = F.aggregate(parts, first, step, lambda done: done["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and then kind."""
    assign = F.filter(matches(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    access = F.filter(matches(text, ACCESS, "access"), lambda s: F.length(s["value"]) >= ACCESS_LEAST)
    return F.array_sort(F.concat(assign, access, matches(text, HEX, "hex")))


def _with_base(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumn("__text", text).withColumn("__base", base_spans(F.col("__text")))


def samples(documents: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled samples (value, random): values of base matches and words of the texts."""
    base = _with_base(documents.select("text"))
    secrets = base.select(F.explode("__base.value").alias("value")).distinct()
    words = base.select(F.explode(F.regexp_extract_all(F.col("__text"), F.lit(WORD), F.lit(0))).alias("value"))
    # A value with three digits or more may be a secret: it is no sample of an ordinary word.
    words = words.where(~F.col("value").rlike("[0-9].*[0-9].*[0-9]")).distinct()

    def first(frame: DataFrame, random: bool) -> DataFrame:
        return frame.orderBy(F.xxhash64("value"), "value").limit(rows).withColumn("random", F.lit(random))

    return first(secrets, True).unionAll(first(words, False))


def _classes(value: Column) -> Column:
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    return F.transform(characters, lambda c: F.position(c, F.lit(ALPHABET)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of character classes, from (value, random) rows."""
    classes = _classes(F.col("value"))
    pairs = labelled.select("random", classes.alias("c")).where("size(c) > 1")
    pairs = pairs.select("random", F.explode(pair_codes(F.col("c"))).alias("pair"))
    counts = pairs.groupBy("random", "pair").count().collect()
    table = {True: [1.0] * SIZE * SIZE, False: [1.0] * SIZE * SIZE}
    for random, pair, n in counts:
        table[random][pair] += n
    sums = {k: [sum(v[a * SIZE : (a + 1) * SIZE]) for a in range(SIZE)] for k, v in table.items()}
    return [
        math.log(table[True][i] / sums[True][i // SIZE]) - math.log(table[False][i] / sums[False][i // SIZE])
        for i in range(SIZE * SIZE)
    ]


def pair_codes(classes: Column) -> Column:
    n = F.size(classes) - 1
    return F.zip_with(F.slice(classes, 1, n), F.slice(classes, 2, n), lambda a, b: a * SIZE + b)


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string under the two models."""
    weights = F.from_json(F.lit(json.dumps(table)), "array<double>")
    classes = _classes(value)
    codes = F.when(F.size(classes) > 1, pair_codes(classes)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(codes, F.lit(0.0), lambda total, code: total + F.element_at(weights, code + 1))


def all_spans(documents: DataFrame, table: list[float], least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``documents`` with ``__text``, ``__base`` and ``__spans`` (base and added spans)."""
    based = _with_base(documents)
    tokens = F.filter(
        matches(F.col("__text"), TOKEN, "markov"),
        lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    added = F.filter("__tokens", lambda t: ratio(t["value"], table) >= least_ratio)
    return (
        based.withColumn("__tokens", tokens)
        .withColumn("__spans", F.when(F.size("__tokens") == 0, F.col("__base")).otherwise(F.array_sort(F.concat("__base", added))))
        .drop("__tokens")
    )


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_no"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def report(documents: DataFrame, table: list[float]) -> DataFrame:
    """Counts, digest and list of the spans of every document row."""

    def count(kind: str) -> Column:
        own = F.filter("__base", lambda s: s["kind_no"] == KINDS.index(kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS[:3])
    found = all_spans(documents.select("doc_id", "text"), table)
    return found.select("doc_id", *counts, F.sha2(listed("__base"), 256).alias("base_sha256"), listed("__spans").alias("spans"))


def redact(documents: DataFrame, table: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with all their columns; every span in ``text`` is replaced by ``mark``.

    Overlapping spans become one mark. A null text stays null; ``n_chars`` follows if there.
    """
    found = all_spans(documents, table)
    text = F.col("__text")

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        gap = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        out = F.when(fresh, F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    clean = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.aggregate("__spans", first, step, rest))
    out = found.withColumn("text", clean)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed = F.when(F.size("__spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind))
        out = out.withColumn("n_chars", changed)
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return report(documents, train(samples(documents)))
