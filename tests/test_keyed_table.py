"""The keyed table against a plain set, with repeated and failed batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import shared_folder
from evidentia.sources.keyed_table import KeyedTable
from evidentia.streaming import jobs

ROWS = "doc string, key string, value long"


def table(spark, path=None, **how):
    schema = T.StructType.fromDDL(ROWS)
    return KeyedTable(spark, path or shared_folder(spark), schema, ("key", "doc"), ("doc",), **{"slots": 8, "buckets": 2, **how})


def put(target, rows, commit):
    return target.append(target.spark.createDataFrame(rows, ROWS), commit)


def keys(target):
    return sorted([(r.doc, r.key) for r in target.rows().collect()], key=str)


def test_every_key_once_over_random_batches(spark):
    target, rng, want = table(spark), random.Random(2), set()
    assert target.rows().count() == 0 and target.ledger().count() == 0
    for n in range(5):
        rows = [(f"d{rng.randrange(12)}", rng.choice([None, *"abcdefgh"]), n) for _ in range(40)]
        assert put(target, rows, f"c{n}")
        assert {(r.doc, r.key) for r in target.committed(f"c{n}").collect()} == {(d, k) for d, k, _ in rows} - want
        want |= {(d, k) for d, k, _ in rows}
        assert keys(target) == sorted(want, key=str)
    assert not put(target, [("new", "new", 1)], "c0")  # a name counts once
    assert put(target, [], "nothing") and keys(target) == sorted(want, key=str)
    assert target.ledger().agg(F.sum("rows")).first()[0] == len(want)


def test_a_batch_without_repeats_reads_no_rows(spark, monkeypatch):
    target = table(spark, buckets=8)
    put(target, [(f"d{i}", f"k{i}", i) for i in range(600)], "first")
    fresh = spark.createDataFrame([(f"d{i}", f"k{i}", i) for i in range(600, 700)], ROWS)
    assert target.candidates(fresh).count() <= 2
    again = spark.createDataFrame([("d5", "k5", 0), ("d5", "other", 0), ("d601", "k601", 0)], ROWS)
    found = target.candidates(again).collect()
    assert ("d5", "k5") in {(r.doc, r.key) for r in found} and len({r.slot for r in found}) <= 2
    reads = []
    plain = KeyedTable._read
    monkeypatch.setattr(KeyedTable, "_read", lambda self, part, schema: reads.append(part) or plain(self, part, schema))
    put(target, [("d1000", "k1000", 1)], "second")
    assert "data" not in reads


@pytest.mark.parametrize("stop", ["filters", "ledger"])
def test_a_batch_that_failed_is_invisible_and_written_anew(spark, monkeypatch, stop):
    target = table(spark)
    put(target, [("a", "1", 0)], "one")
    writer = spark.range(1).write.__class__
    plain = writer.parquet

    def failing(self, path, *args, **kwargs):
        if f"/{stop}/" in path:
            raise OSError("lost")
        return plain(self, path, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(writer, "parquet", failing)
        with pytest.raises(OSError):
            put(target, [("a", "1", 5), ("a", "2", 5)], "two")
    assert keys(target) == [("a", "1")]
    assert put(target, [("a", "1", 6), ("a", "2", 6), ("b", "3", 6)], "two")
    assert keys(target) == [("a", "1"), ("a", "2"), ("b", "3")]


def test_a_failure_between_two_sinks_is_made_up_for(spark, monkeypatch):
    store = jobs.Store.at(spark, shared_folder(spark), 4)
    docs = spark.createDataFrame([("1", "one\ntwo"), ("2", "one\ntwo"), ("3", "three"), ("4", None), ("5", "")], "doc_id string, text string")
    with monkeypatch.context() as patch:
        plain = KeyedTable.append
        patch.setattr(KeyedTable, "append", lambda self, b, c: 1 / 0 if self.path.endswith("projection") else plain(self, b, c))
        with pytest.raises(ZeroDivisionError):
            store.ingest(docs, "b0")
    assert store.evidence.rows().count() == 3 and store.projection.rows().count() == 0
    for commit in ("b0", "b0", "b1"):  # sent again, twice, and as a new batch
        store.ingest(docs, commit)
    assert {r.doc_id for r in store.documents.rows().collect()} == {"1", "3", "5"}
    assert sorted(r.text for r in store.evidence.rows().collect()) == ["one", "three", "two"]
    got = [(r.document_id, r.content) for r in store.projection.rows().collect()]
    assert sorted(c for _, c in got) == ["one", "three", "two"] and len({d for d, _ in got}) == 3
