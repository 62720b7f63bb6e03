"""A Parquet table that takes every key once, however often batches are sent again.

Rows lie in slots, chosen by the hash of ``slot_by``, below a folder per commit. Beside them
lies a key filter: the bits of four hashes per key, as bitmaps of 4 KB per (slot, bucket). A
batch looks up its keys in the filters of its own slots; only keys whose bits are all set can
be stored already, and only the slots of those keys are read, key columns alone. So what a
batch reads follows its own slots and repeats, not the size of the table.

A commit has a name, given by the caller, and counts when its line in the ledger is written,
which happens last. A batch that failed before is written anew under its name; one that has
its line adds nothing. Readers see committed rows only. One writer per table at a time.

Null keys are equal to each other. Rows of a batch with equal keys become one. More slots or
bits cost filter space only; the number of slots and the key are fixed when a table begins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.sources import writers

PROBES = 4
BITS = 32768  # of one bitmap


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    slot_by: tuple[str, ...]
    slots: int = 64
    buckets: int = 32  # bitmaps of a slot
    unique: bool = False  # the rows of a batch have different keys already, so they need not meet

    # ---- reading -----------------------------------------------------------------

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        """A part of the table with its partition columns, or no rows before the first commit."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """commit, rows: what has been committed."""
        return self._read("ledger", T.StructType.fromDDL("rows long, commit string"))

    def _parts(self) -> DataFrame:
        placed = T.StructType([*self.schema.fields, *T.StructType.fromDDL("commit string, slot int").fields])
        return self._read("data", placed).join(self.ledger().select("commit"), "commit", "left_semi")

    def rows(self) -> DataFrame:
        return self._parts().select(*self.schema.names)

    def committed(self, commit: str) -> DataFrame:
        """The rows one commit added."""
        return self._parts().where(F.col("commit") == commit).select(*self.schema.names)

    def filters(self) -> DataFrame:
        """slot, bucket, bits of all committed keys."""
        stored = self._read("filters", T.StructType.fromDDL("bucket int, bits binary, commit string, slot int"))
        known = stored.join(self.ledger().select("commit"), "commit", "left_semi")
        return known.groupBy("slot", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    # ---- keys --------------------------------------------------------------------

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("slot"), *self.slot_by), F.lit(self.slots)).cast("int")

    def _probes(self, keyed: DataFrame) -> DataFrame:
        """slot, key, bucket, position: the places of each key's bits."""
        places = F.array(
            *[
                F.pmod(F.xxhash64(F.lit(k), *self.keys), F.lit(self.buckets * BITS)).cast("long")
                for k in range(PROBES)
            ]
        )
        one = keyed.select("slot", F.struct(*self.keys).alias("key"), F.explode(F.array_distinct(places)).alias("place"))
        return one.select(
            "slot", "key", F.floor(F.col("place") / BITS).cast("int").alias("bucket"), (F.col("place") % BITS).cast("int").alias("position")
        )

    def candidates(self, batch: DataFrame) -> DataFrame:
        """slot and key columns of the batch rows whose key may be stored already."""
        probes = self._probes(batch.withColumn("slot", self._slot()).select("slot", *self.keys).distinct())
        touched = [r[0] for r in probes.select("slot").distinct().collect()]  # at most ``slots`` numbers
        octet = F.conv(F.hex(F.substring("bits", F.floor(F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(octet, F.col("position") % 8) == 1
        found = probes.join(self.filters().where(F.col("slot").isin(touched)), ["slot", "bucket"], "left")
        return (
            found.groupBy("slot", "key")
            .agg(F.bool_and(F.coalesce(is_set, F.lit(False))).alias("all"))
            .where("all")
            .select("slot", "key.*")
        )

    # ---- writing -----------------------------------------------------------------

    def append(self, batch: DataFrame, commit: str) -> bool:
        """Store the rows of ``batch`` whose key is new, as ``commit``; False if it was committed before."""
        done = self.ledger()
        if not done.where(F.col("commit") == commit).isEmpty():
            return False
        keys, rows = list(self.keys), batch.select(*self.schema.names)
        placed = rows if self.unique else rows.dropDuplicates(keys)
        data, filters = f"{self.path}/data/commit={commit}", f"{self.path}/filters/commit={commit}"
        # One candidate slot is enough to read; nothing of the others is.
        hit = [] if done.isEmpty() else [r[0] for r in self.candidates(batch).select("slot").distinct().collect()]
        if hit:
            known = self._parts().where(F.col("slot").isin(hit)).select(*keys)
            # Keys alone first: of a batch that is stored already nothing else moves.
            fresh, _ = writers.split_new(rows.select(*keys), known, keys)
            placed = placed.limit(0) if fresh.isEmpty() else writers.split_new(placed, known, keys)[0]
        # Rows are written where they are: a task has a file for each of its slots.
        placed.withColumn("slot", self._slot()).write.mode("overwrite").option("compression", "zstd").partitionBy("slot").parquet(data)
        stored = self._written(data)
        # A slot's bits come from what was written, so a repeated run cannot differ from it.
        bits = self._probes(stored).groupBy("slot", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        bits.write.mode("overwrite").partitionBy("slot").parquet(filters)
        line = self.spark.createDataFrame([(stored.count(),)], "rows long")
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/commit={commit}")
        return True

    def _written(self, folder: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("slot", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(folder)
