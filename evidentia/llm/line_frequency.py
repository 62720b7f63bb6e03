"""Quality rules with cross-document line frequency.

Lines of every document are normalised and hashed; a line's frequency is the number
of different document texts of its host that hold it. Lines above the limit are
removed, and a document that loses too many of its words that way is rejected.

Base figures of a document are computed beside it. Exact copies of a text count as
one document of a host, so copying a clean document does not make its lines boilerplate.

Null text: no words, all figures 0, rejected as too short. Null host: a host of its own.
Null ``doc_id`` is returned as it is. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

#: Characters counted as symbols. Fixed values of the contract.
SYMBOLS = "#*$%&|<>"

WINDOW = 8
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

FIGURES = (
    "doc_id long, host string, text_hash binary, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long"
)
LINES = "host string, line_hash binary, text_hash binary, words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in ``words``.

    Windows are compared exactly: ranks of pairs of shorter windows stand for longer ones.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        top = int(ids.max()) + 1
        pairs = ids[: len(ids) - step] * top + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        if int(ids.max()) + 1 == len(ids):
            return 0
        width += step
    counts = np.bincount(ids)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(counts[ids] >= 2)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def normalised(line: bytes) -> bytes:
    """Lower-case letters A-Z, one space between words, every digit as 0."""
    return b" ".join(line.lower().translate(_DIGITS).split())


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols = SYMBOLS.encode()
    kept = bytes(b for b in range(256) if b not in symbols)
    # Continuation bytes and white space do not start a word character.
    no_char = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or b""
            words = text.split()
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            rows.append(
                (
                    xxhash.xxh3_128_digest(text),
                    len(words),
                    len(text.translate(None, no_char)),
                    len(text.translate(None, kept)),
                    len(lines) - len(set(lines)),
                    repeated_words(words),
                )
            )
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        names = ("text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host")]
            + [pa.array(c, pa.binary() if i == 0 else pa.int64()) for i, c in enumerate(columns)],
            ["doc_id", "host", *names],
        )


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, keys, texts, sizes = [], [], [], []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            text_hash = xxhash.xxh3_128_digest(text)
            found: dict[bytes, int] = {}
            for line in text.split(b"\n"):
                if plain := normalised(line):
                    key = xxhash.xxh3_128_digest(plain)
                    found[key] = found.get(key, 0) + plain.count(b" ") + 1
            hosts += [host] * len(found)
            texts += [text_hash] * len(found)
            keys += found.keys()
            sizes += found.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())],
            ["host", "line_hash", "text_hash", "words"],
        )


def _input(documents: DataFrame, host: str) -> DataFrame:
    return documents.select(
        "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("binary").alias("text")
    )


def figures(documents: DataFrame, host: str = "source") -> DataFrame:
    """Base figures, one row per document row."""
    return _input(documents, host).mapInArrow(_figures, FIGURES)


def removed_words(documents: DataFrame, host: str = "source", max_documents: int = 20) -> DataFrame:
    """Words in lines above the limit: host, text_hash, removed_words (texts that lose none are absent).

    The count of different texts is keyed by line and text first, so a line that a third
    of all documents share is counted in many tasks; only its partial counts meet.
    """
    lines = _input(documents, host).select("host", "text").mapInArrow(_lines, LINES).distinct()
    frequent = lines.groupBy("host", "line_hash").agg(F.count_distinct("text_hash").alias("documents"))
    frequent = frequent.where(F.col("documents") > max_documents).select("host", "line_hash")
    return (
        lines.join(frequent, ["host", "line_hash"])
        .groupBy("host", "text_hash")
        .agg(F.sum("words").alias("removed_words"))
    )


def without_frequent_lines(documents: DataFrame, frequent: DataFrame, host: str = "source") -> DataFrame:
    """doc_id and text without the lines in ``frequent`` (host, line_hash); texts that lose all lines are absent.

    Lines are exploded, looked up and put together again by their number. Repeated rows give one.
    """
    keyed = _input(documents, host).withColumn("row", F.xxhash64("doc_id", "host", "text"))
    lines = keyed.mapInArrow(_numbered, "doc_id long, host string, row long, number long, line binary, line_hash binary")
    marked = frequent.select("host", "line_hash").distinct()
    left = lines.join(marked, ["host", "line_hash"], "left_anti")
    kept = left.distinct().groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("number", F.col("line").cast("string").alias("line")))).alias("lines")
    )
    return kept.select("doc_id", F.array_join(F.col("lines.line"), "\n").alias("text"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "host", "row", "number", "line", "line_hash"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        out = []
        for row in batch.select(["doc_id", "host", "row", "text"]).to_pylist():
            for number, line in enumerate((row["text"] or b"").split(b"\n")):
                key = xxhash.xxh3_128_digest(normalised(line))
                out.append((row["doc_id"], row["host"], row["row"], number, line, key))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def verdicts(
    documents: DataFrame, host: str = "source", max_documents: int = 20, max_removed: float = 0.5
) -> DataFrame:
    """Figures, base verdict and final verdict of every document row.

    A document passes when it does not fail a base rule and at most ``max_removed`` of
    its words are in lines that more than ``max_documents`` texts of its host hold.
    """
    base = figures(documents, host)
    lost = removed_words(documents, host, max_documents)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0))
    return (
        base.join(lost, ["host", "text_hash"], "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (removed <= max_removed * F.col("n_words")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", removed.alias("removed_words"),
        )
    )


def op10_line_frequency(spark, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "documents"))
