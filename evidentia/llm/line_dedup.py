"""Line dedup: lines that many documents hold stay in one document only.

Every text is exploded into lines. A line's key is the line without white space at both
ends and with A-Z lower-cased; keys of enough characters travel as 128-bit hashes. The
different documents of a key are counted, per host where one is given, and a key held by
``min_documents`` or more loses its lines everywhere but in the largest ``doc_id`` that
holds it. A document then gets the hashes it has to give up and is put together again in
line order.

A line that a third of all documents hold is one row per document before it is counted and
is counted in two steps, (key, document) and then key; the frequent keys are stored, so that
their look-up is a join which adaptive execution can split. Only hashes take part: texts move once, to meet
the hashes they lose.

Null or empty text: one empty line. Lines below ``min_chars`` code points always stay. Rows
with a null ``doc_id`` count as one document, below all others. Repeated rows each get a
row, and count once; rows of one ``doc_id`` with different texts are one document. Null
host: a host of its own. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

MIN_CHARS = 20
MIN_DOCUMENTS = 3

_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None if the key is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.translate(None, _CONTINUATION)) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _input(documents: DataFrame, host: str | None) -> DataFrame:
    place = F.lit("") if host is None else F.coalesce(F.col(host).cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), place.alias("host"), text.cast("binary").alias("text"),
        F.xxhash64(text).alias("text_hash"),
    )


def line_keys(documents: DataFrame, host: str | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """host, doc_id, text_hash, key: one row per different key of a text."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, text in enumerate(batch.column("text")):
                found = {line_key(x, min_chars) for x in text.as_py().split(b"\n")} - {None}
                rows += [row] * len(found)
                keys += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("host", "doc_id", "text_hash")] + [pa.array(keys, pa.binary())],
                ["host", "doc_id", "text_hash", "key"],
            )

    return _input(documents, host).mapInArrow(explode, "host string, doc_id long, text_hash long, key binary")


def frequent_keys(keys: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """host, key, keeper (the largest document that holds it), documents."""
    held = keys.groupBy("host", "key", "doc_id").agg(F.lit(1).alias("one"))
    counted = held.groupBy("host", "key").agg(F.count("one").alias("documents"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("documents") >= min_documents)


def _rebuild(min_chars: int):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_of, dropped, kept = [], [], []
            for text, keys in zip(batch.column("text"), batch.column("lost"), strict=True):
                lines = text.as_py().split(b"\n")
                lost = set(keys.as_py() or ())
                left = [x for x in lines if line_key(x, min_chars) not in lost] if lost else lines
                lines_of.append(len(lines))
                dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(kept, pa.binary())],
                ["doc_id", "host", "n_lines", "n_dropped", "kept"],
            )

    return rebuild


def without_repeated_lines(
    documents: DataFrame, host: str | None = None, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """doc_id, host, n_lines (before), n_dropped and the kept text as UTF-8 bytes, one row per document row."""
    keys = line_keys(documents, host, min_chars)
    frequent = common.stored(frequent_keys(keys, min_documents).select("host", "key", "keeper"))
    # A text that several rows of one doc_id repeat loses its keys once.
    lost = (
        keys.join(frequent, ["host", "key"])
        .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
        .groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t"))
        .agg(F.collect_set("key").alias("lost"))
    )
    texts = _input(documents, host)
    same = texts["doc_id"].eqNullSafe(lost["d"]) & (texts["host"] == lost["h"]) & (texts["text_hash"] == lost["t"])
    return (
        texts.join(lost, same, "left")
        .select("doc_id", "host", "text", "lost")
        .mapInArrow(_rebuild(min_chars), "doc_id long, host string, n_lines long, n_dropped long, kept binary")
    )


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = without_repeated_lines(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
