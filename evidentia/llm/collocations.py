"""Phrase collocations by direct-address tiling.

Texts become blocks of word ids, a bounded number of words each. Word ids follow the global
frequency (the most frequent word of all has the smallest), so the pairs of a block fall into
square tiles of which those near the origin are full: full tiles are counted with a dense
``bincount``, the pairs of the others as sorted coordinates with counts. Spark adds up the
counts of a pair over the blocks. Frequent pairs are ranked by frequency in turn and stand in
the blocks where they start; neighbouring ranked pairs are the next longer phrases. A phrase
can be frequent only if its first and its last words are, so nothing else has to be counted.

Ids meet the blocks by joins on (block, word) and (block, pair), one row per block and
different word or pair: a word that a third of all texts repeat is one row per block, and no
dictionary is broadcast or collected. Blocks, counts and ranks are written to the shared
folder after every length.

Null text: empty. Null lang: ``und``, together with rows of that language. Words are counted
even if their piece has no phrase. ``doc_id`` and other columns are ignored; repeated rows
count as often as they occur. Ties in the ranking go to the larger count, then to the smaller
phrase in UTF-8 byte order. Empty tables give no rows. A text is never cut, so a block holds
one text at least, however long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import common

#: Characters that end a piece. Fixed values of the contract.
BREAKS = b".,;:!?\n\x0b\x0c\r"
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000

#: Words of a block; side of a square tile of pairs; pairs from which a tile is counted densely.
BLOCK = 1_000_000
SIDE = 1024
FULL = SIDE * SIDE // 8

_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS)
)


class _Words(dict):
    """Numbers of words in order of arrival; a number given to a word is never given again."""

    def __init__(self, language: str, all_words: list[tuple[str, bytes]]):
        super().__init__({b"": -2, b"\n": -1})
        self.language, self.all_words = language, all_words

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.all_words)
        self.all_words.append((self.language, word))
        return number


#: A block is one row with its words as numbers, and one row per different word.
BLOCKS = "block string, at binary, number int, lang string, word string, n long"


def _blocks(size: int):
    def flush(parts: list[np.ndarray], all_words: list[tuple[str, bytes]]) -> pa.RecordBatch:
        at = np.concatenate(parts)
        n = len(all_words)
        counts = np.bincount(at[at >= 0], minlength=n)
        name = uuid.uuid4().hex
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (n + 1), pa.string()),
                pa.array([at.tobytes()] + [None] * n, pa.binary()),
                pa.array([None, *range(n)], pa.int32()),
                pa.array([None, *(w[0] for w in all_words)], pa.string()),
                pa.array([None, *(w[1].decode() for w in all_words)], pa.string()),
                pa.array([None, *counts.tolist()], pa.int64()),
            ],
            ["block", "at", "number", "lang", "word", "n"],
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, all_words, words = [], 0, [], {}
        edge = np.array([-1], dtype=np.int32)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if lang not in words:
                    words[lang] = _Words(lang, all_words)
                marked = text.as_py().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
                at = np.fromiter(map(words[lang].__getitem__, marked), dtype=np.int32, count=len(marked))
                at = at[at != -2]
                parts += [at, edge]
                held += len(at) + 1
                if held >= size:
                    yield flush(parts, all_words)
                    parts, held, all_words, words = [], 0, [], {}
        if parts:
            yield flush(parts, all_words)

    return encode


def count_pairs(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of 32-bit numbers below ``size`` and how often each occurs, by tiles."""
    tiles = size // SIDE + 1
    tile = x // SIDE * tiles + y // SIDE
    filled = np.bincount(tile, minlength=tiles * tiles)
    full = np.flatnonzero(filled >= FULL)
    out = []
    if len(full):
        place = np.full(tiles * tiles, -1, dtype=np.int32)
        place[full] = np.arange(len(full))
        place = place[tile]
        inside = x % SIDE * SIDE + y % SIDE
        for k, t in enumerate(full):
            cells = np.bincount(inside[place == k], minlength=SIDE * SIDE)
            cell = np.flatnonzero(cells)
            out.append((t // tiles * SIDE + cell // SIDE, t % tiles * SIDE + cell % SIDE, cells[cell]))
        x, y = x[place < 0], y[place < 0]
    codes, counts = np.unique(x.astype(np.int64) * size + y, return_counts=True)
    out.append((codes // size, codes % size, counts))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _neighbours(at: np.ndarray) -> np.ndarray:
    """Places whose number and next number both stand for something frequent."""
    return np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring ids, from blocks (block, ids, at)."""
    for batch in batches:
        for block, ids, at in zip(*(batch.column(c) for c in ("block", "ids", "at")), strict=True):
            ids, at = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(at.as_py(), np.int32)
            p = _neighbours(at)
            if not len(p):
                continue
            x, y, n = count_pairs(at[p], at[p + 1], len(ids))
            for k in range(0, len(n), 1 << 16):
                cut = slice(k, k + (1 << 16))
                names = pa.array([block.as_py()] * len(n[cut]), pa.string())
                columns = [names, *map(pa.array, (ids[x[cut]], ids[y[cut]], n[cut].astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "left", "right", "n"])


def _ranked(counted: DataFrame) -> DataFrame:
    """Rows with an ``id`` that grows as the count ``n`` falls; kept in the shared folder."""
    ordered = counted.orderBy(F.desc("n"))
    return common.stored(ordered.withColumn("id", F.monotonically_increasing_id()))


def _one(table: pa.Table, column: str) -> pa.Scalar | None:
    """The value of ``column`` in a table of one row."""
    return table.column(column)[0] if table.num_rows else None


def _block_row(block: str, ids: np.ndarray, at: np.ndarray) -> pa.Table:
    """A block whose numbers are places in ``ids``, the sorted frequent ids that occur in it.

    Only neighbours matter, so a run of places without a frequent id is kept as one: a block
    is not larger than what is frequent in it.
    """
    held = at >= 0
    held[1:] |= at[:-1] >= 0
    at = at[held]
    columns = [pa.array([block]), pa.array([ids.tobytes()], pa.binary()), pa.array([at.astype(np.int32).tobytes()], pa.binary())]
    return pa.Table.from_arrays(columns, ["block", "ids", "at"])


ROWS = "block string, ids binary, at binary"
_NONE = pa.table({"block": pa.array([], pa.string()), "ids": pa.array([], pa.binary()), "at": pa.array([], pa.binary())})


def _with_words(block: pa.Table, known: pa.Table) -> pa.Table:
    """Numbers of a block's words replaced by places in its sorted ids."""
    if not (block.num_rows and known.num_rows):
        return _NONE
    at = np.frombuffer(_one(block, "at").as_py(), np.int32)
    number, ids = known.column("number").to_numpy(), known.column("id").to_numpy()
    order = np.argsort(ids)
    place = np.full(max(int(at.max()), int(number.max())) + 2, -1, dtype=np.int32)  # the last one for edges
    place[number[order]] = np.arange(len(order))
    return _block_row(_one(block, "block").as_py(), ids[order], place[at])


def _with_pairs(block: pa.Table, known: pa.Table) -> pa.Table:
    """Neighbouring ids of a block replaced, where the first stands, by the place of their pair."""
    if not (block.num_rows and known.num_rows):
        return _NONE
    ids = np.frombuffer(_one(block, "ids").as_py(), np.int64)
    at = np.frombuffer(_one(block, "at").as_py(), np.int32)
    pair = known.column("id").to_numpy()
    order = np.argsort(pair)
    left = np.searchsorted(ids, known.column("left").to_numpy()[order])
    right = np.searchsorted(ids, known.column("right").to_numpy()[order])
    codes = left.astype(np.int64) * len(ids) + right
    sort = np.argsort(codes)
    p = _neighbours(at)
    code = at[p].astype(np.int64) * len(ids) + at[p + 1]
    slot = np.minimum(np.searchsorted(codes[sort], code), len(codes) - 1)
    hit = codes[sort][slot] == code
    new = np.full(len(at), -1, dtype=np.int32)
    new[p[hit]] = sort[slot[hit]]
    return _block_row(_one(block, "block").as_py(), pair[order], new)


def _renumbered(blocks: DataFrame, known: DataFrame, how) -> DataFrame:
    known = known.withColumnRenamed("block", "home")
    return common.stored(blocks.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(how, ROWS))


def phrases(
    documents: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 2 to ``max_words`` words, and the words of every language.

    Phrases: lang, words, a, firsts, lasts, absorbed. ``firsts[k]`` and ``lasts[k]`` are the
    counts of the first and of the last k + 1 words, up to the phrase itself; ``absorbed``
    says that a longer phrase with the same count holds it. Languages: lang, total.
    """
    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    raw = common.stored(texts.mapInArrow(_blocks(block), BLOCKS))
    words = raw.where(F.col("word").isNotNull())
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    one = _ranked(counted)
    known = words.select("block", "number", "lang", "word").join(one.select("lang", "word", "id"), ["lang", "word"])
    blocks = _renumbered(raw.where(F.col("at").isNotNull()).select("block", "at"), known.select("block", "number", "id"), _with_words)
    here = one.select(
        "id", "lang", F.array("word").alias("words"), F.col("n").alias("a"),
        F.array("n").alias("firsts"), F.array("n").alias("lasts"),
    )
    found = []
    for length in range(2, max_words + 1):
        pairs = blocks.mapInArrow(_pairs, "block string, left long, right long, n long")
        ranks = _ranked(pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
        # What a phrase is part of: its first and its last words, with the count of the whole.
        parents = ranks.select(F.explode(F.array("left", "right")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("inside"))
        if length > 2:
            absorbed = F.coalesce(F.col("inside") >= F.col("a"), F.lit(False))
            found.append(here.join(parents, "id", "left").withColumn("absorbed", absorbed).drop("inside", "id"))
        head = here.select(F.col("id").alias("left"), "lang", F.col("words").alias("head"), "firsts")
        tail = here.select(F.col("id").alias("right"), F.element_at("words", -1).alias("tail"), "lasts")
        here = common.stored(
            ranks.join(head, "left").join(tail, "right").select(
                "id", "lang", F.array_append("head", F.col("tail")).alias("words"), F.col("n").alias("a"),
                F.array_append("firsts", F.col("n")).alias("firsts"), F.array_append("lasts", F.col("n")).alias("lasts"),
            )
        )
        if length < max_words:
            kept = pairs.join(ranks.select("left", "right", "id"), ["left", "right"]).select("block", "left", "right", "id")
            blocks = _renumbered(blocks, kept, _with_pairs)
    found.append(here.withColumn("absorbed", F.lit(False)).drop("id"))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole, totals


def _weakest_cut(max_words: int):
    """The cut of the lowest score as struct(score, k, l, r); ties to the smallest k.

    Products may pass 64 bits, so they are decimals of 38 digits, which hold them exactly.
    """
    cuts = []
    for k in range(1, max_words):
        left, right = f"firsts[{k - 1}]", f"lasts[size(lasts) - {k + 1}]"
        score = f"(1000 * cast(a AS decimal(17,0)) * cast(total AS decimal(17,0))) div (cast({left} AS decimal(19,0)) * {right})"
        cuts.append(f"IF(size(words) > {k}, named_struct('score', {score}, 'k', {k}, 'l', {left}, 'r', {right}), NULL)")
    return F.expr(f"array_min(array_compact(array({', '.join(cuts)})))")


def collocations(
    documents: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, block: int = BLOCK
) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = phrases(documents, min_count, max_words, block)
    scored = (
        found.where(~F.col("absorbed"))
        .join(totals, "lang")
        .withColumn("cut", _weakest_cut(max_words))
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within (lang, salt), so that no task sorts all phrases of a language.
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    final = near.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return final.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))
