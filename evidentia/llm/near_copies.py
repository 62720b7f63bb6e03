"""Groups of near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The pipeline's near-duplicate stage; ``op5_simhash_dedup`` alone keeps its two-bit links, and
these links hold here too. A fingerprint is a vertex, as there; so documents are linked by
fingerprints within two bits, by equal sets, or by similar sets.

Candidates for similar sets are MinHash bands: ``BANDS`` keys of ``ROWS`` least hashes each. A
pair of similarity s shares no key with probability (1 - s**ROWS)**BANDS: 0.00003 at 0.8.
Every candidate pair is checked with the whole sets.

A bucket forms no square of pairs. First each member is compared with the smallest one. In
buckets whose members are not all linked by then, members that are not linked are compared:
all of them in buckets of at most ``SMALL``, with ``LEADERS`` of them in larger ones. What is
still apart in a larger bucket then meets by shingles, which misses no pair: two sets of
similarity 0.8 share one of the rarest fifth (and one) of the shingles of either, and enough
shingles are left behind the first one they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common, simhash_dedup

WORDS = 5
BANDS, ROWS = 20, 4
SMALL, LEADERS = 16, 8

_BYTE = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_SEEDS = common.mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _SEEDS[: BANDS * ROWS], _SEEDS[BANDS * ROWS :] | np.uint64(1)
_BLOCK = 1 << 9
#: Sets of too different sizes are never similar.
NEAR = "least(size, other) * 5 >= greatest(size, other) * 4"
#: Classes of sizes, about 2 % wide.
_CLASS = "CAST(floor(50 * ln({})) AS int)"


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of all 5-word shingles in order; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = min(WORDS, len(words)) - 1
    sums = common.prefix_sums(_BYTE[np.frombuffer(b" ".join(words), dtype=np.uint8)])
    return np.unique(common.span_hashes(sums, starts[: len(words) - n], ends[n:]))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), _BLOCK):
        block = (hashes[at : at + _BLOCK, None] ^ _XOR) * _TIMES
        least = np.minimum(least, block.min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = common.mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def vertex(hashes: np.ndarray) -> int:
    """One number for a set."""
    turned = common.mixed(hashes * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
    return int(common.mixed(turned.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, v, size, keys = [], [], [], []
        for text in batch.column("text").to_pylist():
            hashes = shingles(text or b"")
            fp.append(simhash_dedup.signed(simhash_dedup.fingerprint(text or b"")))
            v.append(vertex(hashes))
            size.append(len(hashes))
            keys.append(band_keys(hashes))
        names = [n for n in batch.schema.names if n != "text"]
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
        columns = [pa.array(fp, pa.int64()), pa.array(v, pa.int64()), pa.array(size, pa.int64()), lists]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "fp", "v", "size", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(t or b"").view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("v"), sets], ["v", "set"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more."""
    left, right = sets.select(F.col("v").alias("a"), F.col("set").alias("x")), sets.select(F.col("v").alias("b"), F.col("set").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    # shared / (x + y - shared) >= 4 / 5
    return pairs.join(left, "a").join(right, "b").where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def by_rare_shingles(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different roots that can be similar, among all rows (v, size, root).

    A pair meets at the shingles that both hold, rarest first. At the first one, ``i`` shingles of
    one set and ``at`` of the other lie before it and are not shared, so at most ``size - i`` and
    ``other - at`` are; a pair that cannot reach 4/9 of both sizes with these does not meet there.
    The larger set of a pair names the classes of sizes that it can meet at a shingle.
    """
    words = sets.join(apart, "v").select("v", "size", "root", F.explode("set").alias("shingle"))
    count = words.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A shingle of one set alone is the rarest; it takes a place of the prefix and meets nobody.
    ranked = words.join(count, "shingle").groupBy("v", "size", "root")
    ranked = ranked.agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    ranked = ranked.withColumn("alone", F.col("size") - F.size("common"))
    places = F.greatest(F.expr("size div 5 + 1 - alone"), F.lit(0)).cast("int")
    held = ranked.select("v", "size", "root", "alone", F.posexplode(F.slice("common", F.lit(1), places)["shingle"]).alias("i", "shingle"))
    held = common.cut(held.withColumn("i", F.col("alone") + F.col("i")).drop("alone"))
    smaller = held.where("9 * i <= size").select(
        "shingle", F.expr(_CLASS.format("size")).alias("class"),
        F.col("v").alias("w"), F.col("size").alias("other"), F.col("root").alias("its"), F.col("i").alias("at"),
    )
    larger = held.selectExpr("*", "(4 * size + 4) div 5 AS low", "least(size, (5 * size - 9 * i) div 4) AS high").where("low <= high")
    classes = F.expr(f"sequence({_CLASS.format('low')}, {_CLASS.format('high')})")
    larger = larger.select("v", "size", "root", "i", "shingle", F.explode(classes).alias("class"))
    pairs = larger.join(smaller, ["shingle", "class"]).where("root != its AND (other < size OR other = size AND w < v)").where(NEAR)
    pairs = pairs.where("9 * least(size - i, other - at) >= 4 * (size + other)")
    return pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def set_links(vertices: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between vertices (v, size, row, keys); ``texts`` has (row, text)."""
    dealt = vertices.select("v", "size", "row", F.posexplode("keys").alias("band", "key"))
    bucket = ["band", "key"]
    shared = dealt.groupBy(bucket).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    held = common.cut(dealt.join(shared.where("low < high").drop("high"), bucket))
    rows = held.select("v", "row").distinct()
    of_row = texts.join(rows, "row").dropDuplicates(["v"]).select("v", F.col("text").cast("binary").alias("text"))
    sets = common.cut(of_row.mapInArrow(_sets, "v long, set array<long>"))
    sizes = sets.select(F.col("v").alias("low"), F.size("set").alias("other"))
    first = held.where("low < v").select("low", "v", "size").distinct().join(sizes, "low").where(NEAR)
    first = common.cut(similar(first.select(F.col("low").alias("a"), F.col("v").alias("b")), sets))

    roots = simhash_dedup.components(first)
    left = held.join(roots.withColumnRenamed("vertex", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    several = left.groupBy(bucket).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select(bucket)
    left = common.cut(left.join(several, bucket, "left_semi").select("v", "size", "root", "n", *bucket))
    leaders = left.where(F.col("n") > SMALL).groupBy(*bucket, F.pmod(F.xxhash64("v", "band"), F.lit(LEADERS)).alias("salt"))
    leaders = leaders.agg(F.min(F.struct("v", "size", "root")).alias("x")).select(*bucket, "x.*")
    leaders = left.where(F.col("n") <= SMALL).select(*bucket, "v", "size", "root").unionByName(leaders)
    leaders = leaders.select(*bucket, F.col("v").alias("w"), F.col("size").alias("other"), F.col("root").alias("its"))
    more = left.join(leaders, bucket).where("root != its").where(NEAR)
    more = more.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    found = common.cut(first.unionByName(similar(more, sets)))

    large = left.where(F.col("n") > SMALL).drop("root")
    if large.isEmpty():
        return found
    roots = simhash_dedup.components(found)
    large = large.join(roots.withColumnRenamed("vertex", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    several = large.groupBy(bucket).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select(bucket)
    apart = common.cut(large.join(several, bucket, "left_semi").select("v", "size", "root").distinct())
    return found.unionByName(similar(by_rare_shingles(apart, sets), sets))


def members(rows: DataFrame) -> DataFrame:
    """(doc_id, row, fp, root) of rows (doc_id, text, row): root is the same for all rows of a group."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fp long, v long, size long, keys array<long>"
    prints = common.cut(rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(_prints, schema))
    vertices = common.cut(
        prints.groupBy("v").agg(F.min(F.struct("fp", "row", "size", "keys")).alias("x")).select("v", "x.fp", "x.row", "x.size", "x.keys")
    )
    found = set_links(vertices.where("size > 0"), rows.select("row", "text"))
    fp_of = vertices.select("v", "fp")
    similar_sets = found.join(fp_of.toDF("a", "p"), "a").join(fp_of.toDF("b", "q"), "b")
    equal_sets = prints.select("v", F.col("fp").alias("q")).distinct().join(fp_of.withColumnRenamed("fp", "p"), "v")
    edges = similar_sets.select("p", "q").unionByName(equal_sets.select("p", "q")).where("p != q")
    edges = edges.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    edges = edges.unionByName(simhash_dedup.links(prints.select("fp").distinct())).distinct()
    roots = simhash_dedup.components(edges)
    found = prints.select("doc_id", "row", "fp").join(roots, prints.fp == roots.vertex, "left")
    return found.select("doc_id", "row", "fp", F.coalesce("root", "fp").alias("root"))
