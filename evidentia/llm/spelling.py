"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them equal, that
is, if common prefix plus common suffix reach the longer length minus one. In the frame of
the longer length M the edit lies in one of four windows, so near words agree before and
behind that window: every word gets a key per window, as the longer word (M its length) and
as the shorter one (M its length plus one). Words of one key are put into padded matrices of
code points, and blocks of rows are compared pair by pair. A pair whose edit could be placed
in several windows counts in the one that holds the end of its common prefix, so each pair is
seen once; only counts and the best partner leave a task, never a list of pairs.

Keys held by more words than ``limit`` are split: their window is halved, until groups are
small or the window is one character, where a group has at most one word per letter and one
without. So no group is unbounded and no word is capped.

Following forms: ``form`` has at least twice the count of its word, so a chain has at most
one step per bit of the count, and pointers that double reach its end in six rounds.

Null text: no runs. A null ``doc_id`` is the empty string in the rule that deletes letters.
Repeated rows count as often as they occur. Other columns are ignored. Ties for the best near
word go to the smallest in code-point order. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 97
MIN_CHARS = 5
MIN_COUNT = 3
#: Windows of a frame at the start; words of one key at most before its window is halved.
WINDOWS = 4
LIMIT = 2048
#: Rows of a block of the dense comparison, and code points of its matrix.
BLOCK = 256
AREA = 1 << 20
#: Different words a task counts before it hands them on.
HELD = 400_000


def planted(run: str, doc: str, every: int = EVERY) -> str:
    """``run`` without one code point where the rule of the contract says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words of all texts with their occurrences; counted in the tasks first."""

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                doc = doc.as_py()
                # Bytes lower-case A-Z only.
                for run, n in Counter(RUN.findall(text.as_py().lower().decode())).items():
                    word = planted(run, doc)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield counted(held)
                    held = Counter()
        yield counted(held)

    texts = documents.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("binary").alias("text")
    )
    rows = texts.mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


KEY = ("m", "i", "j", "rest")


def _keyed(rows: DataFrame) -> DataFrame:
    """Keys of rows word, n, is_long, m, i, j: what lies outside the window [i, j) of the frame of length m."""
    size = F.length("word")
    behind = F.col("m") - F.col("j")
    tail = size - behind
    ends = F.col("is_long") & (behind > 0)
    return rows.withColumn(
        "rest", F.concat(F.substring("word", 1, F.col("i")), F.lit("|"), F.substring("word", tail + 1, behind))
    ).select(
        *KEY, "word", "n", "is_long",
        F.substring("word", F.col("i") + 1, tail - F.col("i")).alias("window"),
        (ends & (F.substring("word", F.col("j"), F.lit(1)) == F.substring("word", F.col("j") + 1, F.lit(1)))).alias("runs_on"),
    )


def _windows(m: Column, start: Column, end: Column, parts: int) -> Column:
    """Windows that cut [start, end) into ``parts``, without the empty ones."""
    width = end - start
    bound = lambda k: start + F.floor(width * k / parts).cast("int")
    return F.filter(
        F.array(*[F.struct(m.alias("m"), bound(k).alias("i"), bound(k + 1).alias("j")) for k in range(parts)]),
        lambda w: w["j"] > w["i"],
    )


def first_keys(words: DataFrame) -> DataFrame:
    """Every word in its windows, as the longer and as the shorter word of a pair."""
    size = F.length("word").cast("int")

    def placed(is_long: bool, m: Column) -> Column:
        return F.transform(
            _windows(m, F.lit(0), m, WINDOWS),
            lambda w: F.struct(F.lit(is_long).alias("is_long"), w["m"].alias("m"), w["i"].alias("i"), w["j"].alias("j")),
        )

    roles = [placed(True, size), placed(False, size + 1)]
    rows = words.select("word", "n", F.explode(F.concat(*roles)).alias("w"))
    return _keyed(rows.select("word", "n", "w.*"))


def _halved(keys: DataFrame) -> DataFrame:
    halves = _windows(F.col("m"), F.col("i"), F.col("j"), 2)
    return _keyed(keys.select("word", "n", "is_long", F.explode(halves).alias("w")).select("word", "n", "is_long", "w.*"))


def bounded_keys(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of ``first_keys`` where every key has at most ``limit`` words or a window of one character."""
    keys, done = first_keys(words), None
    while True:
        hot = keys.groupBy(*KEY).agg(F.count("*").alias("words")).where((F.col("words") > limit) & (F.col("j") - F.col("i") > 1))
        hot = common.stored(hot.select(*KEY))
        if hot.isEmpty():
            return keys if done is None else done.unionByName(keys)
        small = keys.join(hot, list(KEY), "left_anti")
        done = small if done is None else done.unionByName(small)
        keys = _halved(keys.join(hot, list(KEY), "left_semi"))


def _codes(windows: list[str], width: int) -> np.ndarray:
    return np.array(windows, dtype=f"U{width}").view(np.uint32).reshape(len(windows), width)


class Block:
    """Neighbouring rows with their windows as two padded matrices, from the left and from the right."""

    def __init__(self, start: int, windows: list[str], group: np.ndarray, is_long: np.ndarray, runs_on: np.ndarray, need: np.ndarray):
        self.start, self.group, self.is_long, self.runs_on, self.need = start, group, is_long, runs_on, need
        self.width = max(1, max(map(len, windows)))
        self.left = _codes(windows, self.width)
        self.right = _codes([w[::-1] for w in windows], self.width)


def _common(a: np.ndarray, b: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` and every row of ``b``, where ``live``."""
    size = np.zeros(live.shape, dtype=np.int32)
    live = live.copy()
    for c in range(min(a.shape[1], b.shape[1])):
        x, y = a[:, c], b[:, c]
        live &= (x[:, None] == y[None, :]) & (x != 0)[:, None]
        if not live.any():
            break
        size += live
    return size


def near_in(one: Block, two: Block) -> tuple[np.ndarray, np.ndarray]:
    """Near rows of two blocks (or of one with itself), as places in the stream."""
    live = one.group[:, None] == two.group[None, :]
    live &= one.is_long[:, None] | two.is_long[None, :]
    if one is two:
        live &= np.tri(len(one.group), k=-1, dtype=bool).T
    if not live.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prefix = _common(one.left, two.left, live)
    suffix = _common(one.right, two.right, live)
    need = one.need[:, None]
    near = live & (prefix + suffix >= need)
    # A shorter word used up, and the longer one goes on alike behind the window: the pair counts there.
    mixed = one.is_long[:, None] != two.is_long[None, :]
    near &= ~(mixed & (prefix == need) & (one.runs_on[:, None] | two.runs_on[None, :]))
    a, b = np.nonzero(near)
    return a + one.start, b + two.start


PARTIAL = "word string, near long, best_n long, best string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Blocks are kept only while their last key may go on."""
    waiting: list[Block] = []  # blocks whose last group may continue
    words: list[str] = []
    counts: list[int] = []
    base, last, group = 0, None, 0  # place of words[0] in the stream; the last key and its number
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def results(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        one = np.concatenate([src, dst]) - base
        two = np.concatenate([dst, src]) - base
        frame = pd.DataFrame({"at": one, "n": [counts[k] for k in two], "word": [words[k] for k in two]})
        frame = frame.sort_values(["at", "n", "word"], ascending=[True, False, True], kind="stable")
        first = frame.drop_duplicates("at")
        near = np.bincount(one)
        at = first["at"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in at], pa.string()), pa.array(near[at], pa.int64()),
             pa.array(first["n"].to_numpy(), pa.int64()), pa.array(first["word"].tolist(), pa.string())],
            ["word", "near", "best_n", "best"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in KEY]
        new = np.ones(batch.num_rows, dtype=bool)
        if batch.num_rows > 1:
            changed = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns]
            new[1:] = np.logical_or.reduce(changed)
        key = tuple(c[0].as_py() for c in columns)
        new[0] = key != last
        last = tuple(c[batch.num_rows - 1].as_py() for c in columns)
        groups = group + np.cumsum(new)
        group = int(groups[-1])
        windows = batch.column("window").to_pylist()
        is_long = batch.column("is_long").to_numpy(zero_copy_only=False)
        runs_on = batch.column("runs_on").to_numpy(zero_copy_only=False)
        need = columns[2].to_numpy() - columns[1].to_numpy() - 1
        place = base + len(words)
        words += batch.column("word").to_pylist()
        counts += batch.column("n").to_pylist()
        start = 0
        while start < batch.num_rows:
            end = start + 1
            width = len(windows[start])
            while end < batch.num_rows and end - start < BLOCK:
                width = max(width, len(windows[end]))
                if width * (end - start + 1) > AREA:
                    break
                end += 1
            cut = slice(start, end)
            block = Block(place + start, windows[cut], groups[cut], is_long[cut], runs_on[cut], need[cut])
            waiting = [b for b in waiting if b.group[-1] == block.group[0]]
            found += [near_in(b, block) for b in [*waiting, block]]
            waiting.append(block)
            start = end
        src = np.concatenate([f[0] for f in found])
        dst = np.concatenate([f[1] for f in found])
        found = []
        if len(src):
            yield results(src, dst)
        keep = min([b.start for b in waiting if b.group[-1] == group], default=base + len(words))
        words, counts, base = words[keep - base :], counts[keep - base :], keep


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, best_n, best: words with a near word, their number and the most frequent one."""
    keys = bounded_keys(words, limit)
    partial = keys.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_compare, PARTIAL)
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), F.col("best"))).alias("b")
    return partial.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "b.best_n", "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain word -> form; counts at least double along it."""
    now = common.stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(6):  # 2**6 steps: more than the bits of a count
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = common.stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def variants(words: DataFrame, ratio: int = 2, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; words differ)."""
    words = words.select("word", "n")
    found = common.stored(
        words.join(near_words(words, limit), "word", "left").withColumn("has", F.col("best_n") >= ratio * F.col("n"))
    )
    form = F.when(F.col("has"), F.col("best"))
    ends = roots(found.where("has").select("word", F.col("best").alias("form")))
    return found.join(ends, "word", "left").select(
        "word", form.alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n"),
    )


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(common.stored(word_counts(common.table(spark, sf_dir, "documents"))))
