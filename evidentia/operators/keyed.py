"""Per-key ranking, running values and order statistics that survive hot keys.

A plain window over a key sorts that key in one task. Where a key may hold a large
share of all rows, the helpers below work in two steps: inside (key, bucket), then
over one summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import cut_lineage


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a map-side aggregate."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def earliest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_k_items(df: DataFrame, keys: list[str], item: str, k: int, salt: int = 32) -> DataFrame:
    """The ``k`` smallest ``item`` values per key as a sorted array ``items``.

    Rows are first cut to ``k`` per (key, salt), so no task holds a whole hot key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salt)))
    near = Window.partitionBy(*keys, "_salt").orderBy(item)
    cut = salted.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
    return cut.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("items"))


def _buckets(df: DataFrame, keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_b")


def ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_b``, the number of the range of (keys, order) that a row lies in.

    Split points are sampled from the full order, so a key with most rows, or rows of one
    day, spread over many ranges as long as ``order`` tells them apart. The rows are kept in
    the shared folder: split points must be the same for all that is built on them.
    """
    columns = [*keys, *order]
    placed = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return cut_lineage(placed.withColumn("_b", F.spark_partition_id()))


def _marked(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None) -> DataFrame:
    return ranges(df, keys, order) if bucket is None else df.withColumn("_b", bucket)


def number_in_key(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, name: str
) -> DataFrame:
    """1, 2, ... within ``keys`` by ``order``.

    ``bucket`` must not decrease along the order; without one, sampled ranges are used.
    """
    marked = _marked(df, keys, order, bucket)
    counts = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = _buckets(df, keys).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift")
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        marked.withColumn("_i", F.row_number().over(inner))
        .join(shifts, [*keys, "_b"])
        .withColumn(name, (F.col("_i") + F.col("_shift")).cast("long"))
        .drop("_b", "_i", "_shift")
    )


def previous_in_key(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, column: str, name: str
) -> DataFrame:
    """``column`` of the preceding row of the key."""
    marked = _marked(df, keys, order, bucket)
    last = marked.groupBy(*keys, "_b").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_b", F.lag("_last").over(_buckets(df, keys)).alias("_carry"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        marked.withColumn("_p", F.lag(column).over(inner))
        .join(carried, [*keys, "_b"])
        .withColumn(name, F.coalesce("_p", "_carry"))
        .drop("_b", "_p", "_carry")
    )


def running_max_before(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, column: str, name: str
) -> DataFrame:
    """Greatest ``column`` among all preceding rows of the key."""
    marked = _marked(df, keys, order, bucket)
    peak = marked.groupBy(*keys, "_b").agg(F.max(column).alias("_peak"))
    earlier = _buckets(df, keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = peak.select(*keys, "_b", F.max("_peak").over(earlier).alias("_carry"))
    inner = (
        Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        marked.withColumn("_p", F.max(column).over(inner))
        .join(carried, [*keys, "_b"])
        .withColumn(name, F.greatest("_p", "_carry"))
        .drop("_b", "_p", "_carry")
    )


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bucket: Column
) -> DataFrame:
    """Exact values at 1-based ranks per key.

    ``ranks`` maps an output name to a rank expression over ``n``, the rows per key.
    Only (key, bucket) groups that hold a wanted rank are sorted.
    """
    marked = df.where(F.col(value).isNotNull()).withColumn("_b", bucket)
    counts = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    upto = _buckets(df, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn(
        "n", F.sum("_c").over(Window.partitionBy(*keys))
    )
    wanted = spread.select(
        *keys,
        "_b",
        (F.col("_upto") - F.col("_c")).alias("_before"),
        F.col("_upto"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
        ).alias("_w"),
    ).where((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_upto")))
    inner = Window.partitionBy(*keys, "_b").orderBy(value)
    touched = marked.join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    numbered = touched.withColumn("_i", F.row_number().over(inner)).select(*keys, "_b", "_i", value)
    hits = numbered.join(wanted, [*keys, "_b"]).where(
        F.col("_i") == F.col("_w.rank") - F.col("_before")
    )
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_w.name") == k, F.col(value))).alias(k) for k in ranks]
    )
