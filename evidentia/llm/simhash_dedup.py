"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of all
3-word shingles. Fingerprints that differ in at most ``RADIUS`` bits are linked.

Candidate search. Bits are dealt to the 7 points of the Fano plane: every point is a
vector of GF(2)^3 other than zero. Table v keeps the bits whose vector has an odd
product with v. Two differing bits name two vectors, and some v is orthogonal to
both, so every pair within the radius agrees on all bits that table v keeps: no pair is
lost. A bucket that holds one fingerprint needs no more work.

Inside a bucket no pairs are formed. A fingerprint sends itself and its variants with
one masked-out bit flipped. Two fingerprints differ in at most two bits exactly if they
share a variant, and a variant is shared by at most 65 fingerprints, so every variant
group is small and all its members are linked: a star around its smallest member
keeps the same components. This holds for buckets of any size.

Equal fingerprints are one vertex, so copies cost nothing beyond their first grouping.
Components are found by alternating large-star and small-star rounds on a table of
links; every round is a checkpoint.

Null and empty texts have no shingle and fingerprint zero, linked like any other. Null
``doc_id`` comes after all others: a component of null ids alone has a null component.
Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

RADIUS = 2
SEED = 42
SHINGLE = 3


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks() -> list[int]:
    """Bits that each of the 2**(RADIUS + 1) - 1 tables keeps."""
    points = range(1, 1 << (RADIUS + 1))
    vector = [1 + i % len(points) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in points]


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(plain, SEED)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        hash_of = xxhash.xxh64_intdigest
        pairs = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        hashes = [hash_of(plain[a:b], SEED) for a, b in pairs]
    counts = np.zeros(64, dtype=np.int64)
    all_hashes = np.array(hashes, dtype="<u8")
    for at in range(0, len(all_hashes), 1 << 15):
        block = all_hashes[at : at + (1 << 15)]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.flatnonzero(2 * counts > len(hashes)).tolist()
    return sum(1 << i for i in over)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [signed(fingerprint(t or b"")) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.int64())], [*names, "fp"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """All columns but ``text``, and the fingerprint ``fp`` as a signed long; one row per row."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["fp long"])
    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(_fingerprints, schema)


def links(vertices: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between different ``fp`` values: a star for each shared variant."""
    tables = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for t, mask in enumerate(masks())
    ]
    dealt = vertices.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.key")
    shared = dealt.groupBy("t", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    shared = shared.where("low < high").select("t", "key")
    flips = F.array(*[F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64) if not mask >> i & 1]) for mask in masks()])
    variants = (
        dealt.join(shared, ["t", "key"], "left_semi")
        .select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    )
    # At most 65 members: a variant and its neighbours.
    groups = variants.groupBy("variant").agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    star = groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    return star.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, root) for all vertices of links (a, b): root is the smallest vertex of the component.

    Large-star links all larger neighbours of a vertex to its smallest one, small-star does so
    with the smaller ones. A hub's smallest neighbour is a partial aggregate, and its join is
    one that adaptive execution can split.
    """
    current = common.cut(edges.select("a", "b"))
    last = None
    for _ in range(rounds):
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Every link now is (m, b) with m < b; small-star: the smaller neighbours of b and b itself.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select("m", F.explode(F.array("a", "b")).alias("v")).where("m < v")
        current = common.cut(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == last:
            return current.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
        last = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def members(rows: DataFrame) -> DataFrame:
    """Rows (doc_id and any others but text) with fp, component_id and root.

    ``component_id`` is the smallest doc_id linked, itself included; ``root`` is the
    component's smallest fingerprint and tells components of null ids apart.
    """
    prints = common.cut(fingerprints(rows))
    vertices = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(vertices))
    labelled = vertices.join(roots, vertices.fp == roots.vertex, "left")
    labelled = labelled.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(labelled.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def keep_first(documents: DataFrame, grouped: Callable[[DataFrame], DataFrame] = members) -> DataFrame:
    """``documents`` with all their columns, one row of each component that ``grouped`` finds.

    The row of the smallest doc_id stays (null last); of several such rows the one with
    the smallest text hash, and one of rows that repeat it.
    """
    row = F.struct(F.xxhash64("doc_id", "text").alias("x"), F.hash("text", "doc_id").alias("y"))
    found = grouped(documents.select("doc_id", "text", row.alias("row")))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("row"))
    first = found.groupBy("root").agg(F.min(rank).alias("first")).select("first.row")
    # How many rows repeat the one that stays: only those are shuffled with all columns again.
    winners = found.join(first, "row", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("__rows"))
    winners = winners.withColumnRenamed("row", "__row")
    stay = documents.withColumn("__row", row).join(winners, "__row")
    single, several = stay.where("__rows = 1"), stay.where("__rows > 1").dropDuplicates(["__row"])
    return single.unionByName(several).select(*[F.col(f"`{c}`") for c in documents.columns])


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = members(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


