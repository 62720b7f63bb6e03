"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from evidentia.session import cut_lineage, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder that the session names."""
    return cut_lineage(df)


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of neighbouring items of at most ``limit`` in sum, one item at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


#: Bytes of text that vectorised code works on at a time, to stay in processor caches.
CHUNK = 1 << 20

_R = 0x9E3779B97F4A7C15  # any odd number has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[i] * R**i`` before each place, one longer than ``values``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) from ``prefix_sums``; equal spans hash equally."""
    down = powers(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read again: its rows stay the same on every use."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
