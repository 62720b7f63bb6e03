"""Two-step window helpers against plain Python, with one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import keyed


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = ["hot"] * 300 + [f"k{i}" for i in range(20) for _ in range(rng.randint(1, 9))]
    return [(k, rng.randint(0, 60), i, rng.randint(0, 9)) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, id int, v int")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_number_previous_and_running_max(df, rows):
    bucket = F.floor(F.col("t") / 7)
    out = keyed.number_in_key(df, ["k"], ["t", "id"], bucket, "n")
    out = keyed.previous_in_key(out, ["k"], ["t", "id"], bucket, "v", "p")
    out = keyed.running_max_before(out, ["k"], ["t", "id"], bucket, "v", "m")
    got = {r["id"]: (r["n"], r["p"], r["m"]) for r in out.collect()}
    want = {}
    for items in by_key(rows).values():
        for i, r in enumerate(items):
            before = [x[3] for x in items[:i]]
            want[r[2]] = (i + 1, before[-1] if before else None, max(before) if before else None)
    assert got == want


def test_top_k_and_latest(df, rows):
    top = keyed.top_k_items(df.select("k", F.struct("t", "id").alias("item")), ["k"], "item", 5)
    got = {r["k"]: [tuple(i) for i in r["items"]] for r in top.collect()}
    assert got == {k: [(r[1], r[2]) for r in items[:5]] for k, items in by_key(rows).items()}
    last = {r["k"]: r["id"] for r in keyed.latest_by(df, ["k"], ["t", "id"]).collect()}
    assert last == {k: items[-1][2] for k, items in by_key(rows).items()}


def test_order_statistics(df, rows):
    n = F.col("n")
    out = keyed.order_statistics(
        df, ["k"], "t", {"lo": F.floor((n - 1) / 2) + 1, "hi": F.least(n - 1, F.floor(n * 0.9)) + 1},
        F.floor(F.col("t") / 5),
    )
    got = {r["k"]: (r["lo"], r["hi"]) for r in out.collect()}
    want = {}
    for k, items in by_key(rows).items():
        values = sorted(r[1] for r in items)
        size = len(values)
        want[k] = (values[(size - 1) // 2], values[min(size - 1, int(size * 0.9))])
    assert got == want


def test_ranges_split_a_hot_key_of_one_day(spark):
    """Nine tenths of the rows have one key and one time: only the last order column tells them apart."""
    rows = [("hot", 0, i, i % 7) for i in range(3600)] + [(f"k{i % 40}", i % 3, i, i % 5) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(4)
    placed = keyed.ranges(frame, ["k"], ["t", "id"], 16)
    sizes = [r[0] for r in placed.groupBy("_b").count().select("count").collect()]
    assert len(sizes) >= 12 and max(sizes) < 800
    low = placed.groupBy("_b").agg(F.min(F.struct("k", "t", "id")).alias("low"), F.max(F.struct("k", "t", "id")).alias("high"))
    bounds = [(tuple(r.low), tuple(r.high)) for r in low.orderBy("_b").collect()]
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    got = keyed.number_in_key(frame, ["k"], ["t", "id"], None, "n")
    got = keyed.previous_in_key(got, ["k"], ["t", "id"], None, "v", "p")
    got = keyed.running_max_before(got, ["k"], ["t", "id"], None, "v", "m")
    found = {(r["k"], r["id"]): (r["n"], r["p"], r["m"]) for r in got.collect()}
    for k, items in by_key(rows).items():
        values = [x[3] for x in items]
        for i, r in enumerate(items):
            assert found[k, r[2]] == (i + 1, values[i - 1] if i else None, max(values[:i]) if i else None)
