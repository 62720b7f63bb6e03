from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import structure as S


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_numbers(spark):
    got = column(spark, ["1,000 samples at 84.2%.", "no digits", "v1.2.3. and 7", "10._"], X.statement_numbers)
    assert got == [["1000", "84.2"], [], ["1.2.3", "7"], ["10"]]


def test_tokens(spark):
    got = column(spark, ["That 3abcde Method-A uses the Data_set", "of an it"], X.significant_tokens)
    assert got == [["abcde", "data_set", "method-a", "uses"], []]


def test_subject(spark):
    got = column(
        spark,
        ["The Vision model reaches 3", "Our net improves it", "plain words", "A b is c", "It reaches"],
        X.claim_subject,
    )
    # A one-letter subject needs its article, as the pattern asks for two characters.
    assert got == ["Vision model", "net", None, "A b", "It"]


def test_metric_phrase(spark):
    got = column(
        spark, ["reaches 84.2% top-1 accuracy on the full set", "none", "ends with 5"], X.metric_phrase
    )
    assert got == ["top-1 accuracy on the", "none", "ends with 5"]


def test_one_character_apart(spark):
    df = spark.createDataFrame(
        [("82.5", "82.6"), ("82.5", "82.5"), ("82.5", "8.25"), ("1", "12")], "a string, b string"
    )
    got = [r[0] for r in df.select(X.one_character_apart(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, False, False]


def test_normalization(spark):
    assert column(spark, ["Straße:  ﬁne—Art!"], X.normalize_title) == ["strasse fine art"]
    assert column(spark, ["  Few_Shot / Learning!! "], X.normalize_tag) == ["few-shot-learning"]
    assert column(spark, ["ResNet-50 (v2)"], X.normalize_entity) == ["resnet 50 v2"]


def test_redaction(spark):
    got = column(
        spark,
        ["key sk-abcdefgh12 end", "Bearer abcdefghij.k", 'token = "abcd1234"', "clean"],
        X.redact,
    )
    assert got == ["key [REDACTED_API_KEY] end", "Bearer [REDACTED]", 'token: [REDACTED]"', "clean"]
    df = spark.sql("select map('Api-Key', 'x', 'cookieJar', 'y', 'note', 'password: hunter22') as m")
    m = df.select(X.redact_map(F.col("m")).alias("m")).first()["m"]
    assert m == {"Api-Key": "[REDACTED]", "cookieJar": "[REDACTED]", "note": "password: [REDACTED]"}


@pytest.mark.parametrize(
    "heading,expected,level",
    [
        ("Abstract", "ABSTRACT", 0),
        ("1. Introduction", "INTRODUCTION", 0),
        ("2.1 Related   Work", "RELATED_WORK", 1),
        ("3.2 Evaluation Setup", "EXPERIMENT", 1),
        ("IV. Results", "RESULT", 0),
        ("A.2.1 Proofs", "THEORY", 2),
        ("Our Approach", "METHOD", 0),
        ("Threats to Validity", "LIMITATION", 0),
        ("References", "REFERENCES", 0),
        ("Something else", "OTHER", 0),
    ],
)
def test_headings(spark, heading, expected, level):
    df = spark.createDataFrame([(heading,)], "h string")
    row = df.select(S.normalize_heading(F.col("h")), S.heading_level(F.col("h"))).first()
    assert (row[0], row[1]) == (expected, level)
