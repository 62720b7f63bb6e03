"""Benchmark decontamination against a broadcast set of benchmark word windows.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters
beyond ASCII. A window is 13 consecutive words of a benchmark item; an item with
fewer words is one window. Window hashes are broadcast; document windows are scanned
in vectorised blocks, and every hash hit is verified word by word.

The broadcast holds at most ``max_windows`` windows. A larger benchmark is cut into
blocks of items, each scanned against all documents; hits of the blocks are merged,
so results do not depend on the bound.

Null text has no words; null item text is no item. Repeated items count each by
their own id, repeated document rows each get a row. An empty benchmark leaves all
documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

WINDOW = 13

#: Word bytes as they are after lower-casing; 0 for all others.
_LOWER = np.array(
    [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8
)
_VALUES = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUES = np.where(_LOWER > 0, _VALUES[_LOWER], np.uint64(0))


class Words:
    """Words of neighbouring texts: places in one buffer, hashes and first word of each text."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        inside = np.zeros(len(raw) + 1, dtype=np.int8)
        inside[1:] = _LOWER[raw] > 0
        edges = np.diff(inside)
        self.starts = np.flatnonzero(edges == 1)
        self.ends = np.flatnonzero(edges == -1)
        self.hashes = common.span_hashes(common.prefix_sums(_VALUES[raw]), self.starts, self.ends)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.firsts = np.searchsorted(self.starts, at)

    def words(self, first: int, last: int) -> tuple[bytes, ...]:
        """Normalised words ``first`` to ``last`` - 1."""
        return tuple(
            self.buffer[a:b].lower() for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)
        )


def _window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    sums = common.prefix_sums(hashes)
    starts = np.arange(len(hashes) - width + 1)
    return common.span_hashes(sums, starts, starts + width)


class WindowSet:
    """Windows of a block of benchmark items by width."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        self.by_words: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            own = Words([text.encode()])
            n = len(own.starts)
            if not n:
                continue
            width = min(window, n)
            for at, h in enumerate(_window_hashes(own.hashes, width).tolist()):
                ids = self.by_words.setdefault(width, {}).setdefault(own.words(at, at + width), [])
                if str(item) not in ids:
                    ids.append(str(item))
                hashes.setdefault(width, set()).add(h)
        self.sorted = {w: np.array(sorted(hs), dtype=np.uint64) for w, hs in hashes.items()}
        self.bits = {}
        self.shift = {}
        for width, hs in self.sorted.items():
            power = max(16, int(np.ceil(np.log2(len(hs) * 64))))
            self.shift[width] = np.uint64(64 - power)
            self.bits[width] = np.zeros(1 << power, dtype=bool)
            self.bits[width][hs >> self.shift[width]] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end word, item ids) of all verified windows that lie in one text."""
        for width, known in self.sorted.items():
            if len(words.hashes) < width:
                continue
            hashes = _window_hashes(words.hashes, width)
            at = np.flatnonzero(self.bits[width][hashes >> self.shift[width]])
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            at = at[known[place] == hashes[at]]
            row = np.searchsorted(words.firsts, at, "right")
            at = at[words.firsts[row] >= at + width]
            table = self.by_words[width]
            for first in at.tolist():
                if ids := table.get(words.words(first, first + width)):
                    yield first, first + width, ids


def scan(texts: list[bytes], windows: WindowSet) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: number of words, merged ranges of hit words, items hit."""
    words = Words(texts)
    ranges: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for first, end, ids in sorted(windows.hits(words), key=lambda x: x[:2]):
        row = int(np.searchsorted(words.firsts, first, "right")) - 1
        own = ranges.setdefault(row, [])
        if own and first <= own[-1][1]:
            own[-1] = (own[-1][0], max(end, own[-1][1]))
        else:
            own.append((first, end))
        items.setdefault(row, set()).update(ids)
    counts = np.diff(words.firsts).tolist()
    for row, n in enumerate(counts):
        base = int(words.firsts[row])
        yield n, [(a - base, b - base) for a, b in ranges.get(row, ())], items.get(row, set())


def _scanner(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = windows.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            n_words, spans, items = [], [], []
            for start, end in common.chunks([len(t) for t in texts], common.CHUNK):
                for n, ranges, ids in scan(texts[start:end], known):
                    n_words.append(n)
                    spans.append([{"first": a, "end": b} for a, b in ranges])
                    items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return run


SCANNED = "doc_id long, text_hash binary, n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def window_blocks(benchmark: DataFrame, max_windows: int) -> Iterator[WindowSet]:
    """Window sets of at most about ``max_windows`` windows (one item at least), together all items."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * max_windows)))  # a word takes two characters at least
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield WindowSet([tuple(r) for r in part.collect()])


def hits(documents: DataFrame, benchmark: DataFrame, max_windows: int = 5_000_000) -> DataFrame:
    """doc_id, n_words, hit word ranges and item ids of every document row."""
    spark = documents.sparkSession
    source = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    parts = [
        source.mapInArrow(_scanner(spark.sparkContext.broadcast(windows)), SCANNED)
        for windows in window_blocks(benchmark, max_windows)
    ]
    if len(parts) == 1:
        return parts[0].drop("text_hash")
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionAll(part)
    # A block gives a row per document row: equal rows are told apart by their count alone.
    return (
        joined.groupBy("doc_id", "text_hash", "n_words")
        .agg(
            (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
            merged_ranges(F.array_sort(F.flatten(F.collect_set("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        .select("doc_id", "n_words", "spans", "items")
    )


def merged_ranges(spans):
    """Union of sorted [first, end) ranges."""
    kind = "array<struct<first:long,end:long>>"

    def add(done, span):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["first"])
        wider = F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end")))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), wider)).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast(kind), add)


def verdicts(found: DataFrame) -> DataFrame:
    """Digest of ``hits``: contaminated when a twentieth of the words or more is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            "contaminated",
        )
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, max_windows: int = 5_000_000) -> DataFrame:
    """``documents`` with all their columns, without the contaminated rows.

    The text travels once from the scan to a Python worker and a flag comes back.
    """
    out, spark = documents, documents.sparkSession
    for windows in window_blocks(benchmark, max_windows):
        shared = spark.sparkContext.broadcast(windows)
        flagged = F.pandas_udf(_ranges_of(shared), "array<struct<first:long,end:long>>")
        ranges = flagged(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
        out = out.withColumn("__spans", F.concat("__spans", ranges) if "__spans" in out.columns else ranges)
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    n_hit = F.aggregate(
        merged_ranges(F.array_sort("__spans")), F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"]
    )
    dirty = (F.size("__spans") > 0) & (20 * n_hit >= words)
    return out.where(~F.coalesce(dirty, F.lit(False))).drop("__spans")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _ranges_of(shared):
    def ranges(texts: pd.Series) -> pd.Series:
        out = []
        plain = [bytes(t) for t in texts]
        for start, end in common.chunks([len(t) for t in plain], common.CHUNK):
            for _, found, _ in scan(plain[start:end], shared.value):
                out.append([{"first": a, "end": b} for a, b in found])
        return pd.Series(out)

    ranges.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return ranges


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (word ranges), separators before them kept."""
    words = Words([text.encode()])
    raw, out, last = words.buffer[:-1], [], 0
    for first, end in spans:
        out.append(raw[last : int(words.starts[first])])
        last = int(words.ends[end - 1])
    return b"".join([*out, raw[last:]]).decode()


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return verdicts(hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))
