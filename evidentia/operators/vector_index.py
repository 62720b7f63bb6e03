"""An index over vectors: coarse cells, compact codes, exact ranking of a shortlist.

``fit`` clusters a bounded sample into cells and measures on it how many cells a query has
to visit for the recall asked for. ``build`` puts every row into its nearest cell and stores
two tables, both sorted by cell: the vectors, and blocks of one-byte codes an eighth of their
size. ``search`` sends each query as part of a block to the cells it visits, where it meets
blocks of codes in one matrix product per pair of blocks; the best candidates then fetch
their vectors, and only these are ranked, exactly as the full scan ranks them.

Queries never pass through the driver, and nothing that grows with the rows is broadcast:
the model is ``cells`` times the width of a vector. A cell that holds a third of all rows is
many blocks, which tasks share. On data without clusters the measured number of visits comes
near all cells; what is saved then is the size of the codes, not the visits.

Rows without a vector, and zero vectors, are not indexed; a query without a vector, or with
a zero vector, finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import keyed
from evidentia.session import shared_folder

#: Rows the model is fitted on at most, by smallest hash of the id; queries the visits are measured with.
SAMPLE_ROWS = 20_000
TRIAL_QUERIES = 200
CODE_BLOCK = 4096
QUERY_ROWS = 256


@dataclass
class Model:
    """Unit centroids, the value a code of 127 stands for, and the cells a query visits."""

    centroids: np.ndarray
    scale: float
    visits: int


@dataclass
class Index:
    model: Model
    vectors: DataFrame  # cell, document_id, embedding
    codes: DataFrame  # cell, ids, codes


def unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and a mask of those rows."""
    known = np.array([r is not None and len(r) > 0 for r in rows], dtype=bool)
    if not known.any():
        return np.empty((0, 0)), known
    matrix = np.array([r for r, k in zip(rows, known, strict=True) if k], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    known[known] = norms > 0
    return matrix[norms > 0] / norms[norms > 0, None], known


def clustered(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of the sample by spherical k-means, the same for the same sample."""
    centroids = sample[np.random.default_rng(0).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centroids)
    return centroids


def visits_for(sample: np.ndarray, centroids: np.ndarray, recall: float, share: float, k: int) -> int:
    """Cells to visit so that ``recall`` of the nearest rows of the sample's queries are in them.

    ``share`` is the sample's part of all rows: the k nearest of all are about k * share here.
    """
    queries = sample[:TRIAL_QUERIES]
    home = np.argmax(sample @ centroids.T, axis=1)
    order = np.argsort(-(queries @ centroids.T), axis=1)
    turn = np.empty_like(order)  # at which visit a query reaches a cell
    np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    near = min(len(sample), max(10, round(k * share)) + 1)
    nearest = np.argsort(-(queries @ sample.T), axis=1)[:, :near]
    reached = np.sort(np.take_along_axis(turn, home[nearest], axis=1).ravel())
    return int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))]) + 1


def fit(
    docs: DataFrame, cells: int = 256, recall: float = 0.95, k: int = 60, sample_rows: int = SAMPLE_ROWS
) -> Model:
    """The model of ``docs`` (document_id, embedding), from at most ``sample_rows`` of them."""
    known = docs.where(F.col("embedding").isNotNull())
    total = known.count()
    rows = known.orderBy(F.xxhash64("document_id"), "document_id").select("embedding").limit(sample_rows).collect()
    sample, _ = unit([r[0] for r in rows])
    if not len(sample):
        return Model(np.empty((0, 0)), 1.0, 0)
    centroids = clustered(sample, max(1, min(cells, len(sample) // 4)))
    visits = visits_for(sample, centroids, recall, len(sample) / total, k)
    return Model(centroids, float(np.abs(sample).max()), visits)


def build(docs: DataFrame, model: Model) -> Index:
    """Every row of ``docs`` in its cell, stored in the shared folder."""
    spark = docs.sparkSession
    id_type = docs.schema["document_id"].dataType.simpleString()
    centroids, scale = model.centroids, model.scale

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, known = unit(list(batch["embedding"]))
            if len(vectors):
                rows = batch[known]
                cell = np.argmax(vectors @ centroids.T, axis=1)
                yield pd.DataFrame({"cell": cell, "document_id": rows["document_id"], "embedding": rows["embedding"]})

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            vectors, _ = unit(batch.column("embedding").to_pylist())
            bounds = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            out: list[list] = [[], [], []]
            for a, b in zip(bounds, bounds[1:]):
                for at in range(a, b, CODE_BLOCK):
                    part = slice(at, min(at + CODE_BLOCK, b))
                    out[0].append(int(cell[at]))
                    out[1].append(batch.column("document_id")[part].to_pylist())
                    out[2].append(np.clip(np.rint(vectors[part] * (127 / scale)), -127, 127).astype(np.int8).tobytes())
            ids = pa.list_(batch.schema.field("document_id").type)
            arrays = [pa.array(out[0], pa.int32()), pa.array(out[1], ids), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "ids", "codes"])

    source = docs.where(F.col("embedding").isNotNull()).select("document_id", "embedding")
    vector_type = source.schema["embedding"].dataType.simpleString()
    schema = f"cell int, document_id {id_type}, embedding {vector_type}"
    code_schema = f"cell int, ids array<{id_type}>, codes binary"
    folder = shared_folder(spark)
    placed = source.mapInPandas(place, schema) if len(centroids) else spark.createDataFrame([], schema)
    # Ranges of (cell, document): a crowded cell is several ranges.
    ranged = placed.repartitionByRange("cell", "document_id").sortWithinPartitions("cell", "document_id")
    ranged.write.parquet(f"{folder}/vectors")
    vectors = spark.read.schema(schema).parquet(f"{folder}/vectors")
    vectors.mapInArrow(shorten, code_schema).write.parquet(f"{folder}/codes")
    return Index(model, vectors, spark.read.schema(code_schema).parquet(f"{folder}/codes"))


def query_blocks(queries: DataFrame, model: Model) -> DataFrame:
    """cell, query_ids, matrix: the queries that visit a cell, up to ``QUERY_ROWS`` in a row; made in the tasks."""
    id_type = queries.schema["query_id"].dataType.simpleString()
    centroids, visits = model.centroids, model.visits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, known = unit(batch.column("vector").to_pylist())
            if not len(vectors):
                continue
            ids = batch.column("query_id").filter(pa.array(known))
            order = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :visits]
            row, cell = np.repeat(np.arange(len(vectors)), order.shape[1]), order.ravel()
            by_cell = np.argsort(cell, kind="stable")
            row, cell = row[by_cell], cell[by_cell]
            bounds = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(bounds, bounds[1:]):
                for at in range(a, b, QUERY_ROWS):
                    part = row[at : min(at + QUERY_ROWS, b)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(cell[at])], pa.int32()),
                            pa.array([ids.take(pa.array(part)).to_pylist()], pa.list_(ids.type)),
                            pa.array([vectors[part].astype(np.float32).tobytes()], pa.binary()),
                        ],
                        ["cell", "query_ids", "matrix"],
                    )

    return queries.select("query_id", "vector").mapInArrow(deal, f"cell int, query_ids array<{id_type}>, matrix binary")


def candidates(index: Index, queries: DataFrame, size: int) -> DataFrame:
    """query_id, cell, document_id, about: the best ``size`` of every pair of blocks by code."""
    model, width = index.model, index.model.centroids.shape[1]
    id_type = queries.schema["query_id"].dataType.simpleString()
    doc_type = index.vectors.schema["document_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("cell", "ids", "codes", "query_ids", "matrix")]
            for cell, ids, codes, query_ids, matrix in zip(*columns, strict=True):
                rows = np.frombuffer(codes.as_py(), np.int8).reshape(-1, width).astype(np.float32)
                sims = (rows @ np.frombuffer(matrix.as_py(), np.float32).reshape(-1, width).T) * (model.scale / 127)
                best = np.argsort(-sims, axis=0, kind="stable")[:size]
                ids, query_ids = ids.values, query_ids.values
                asked = np.repeat(np.arange(sims.shape[1]), len(best))
                found = best.T.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        query_ids.take(pa.array(asked)),
                        pa.array(np.full(len(found), cell.as_py(), np.int32)),
                        ids.take(pa.array(found)),
                        pa.array(sims[found, asked].astype(np.float64)),
                    ],
                    ["query_id", "cell", "document_id", "about"],
                )

    pairs = index.codes.join(query_blocks(queries, model), "cell")
    return pairs.select("cell", "ids", "codes", "query_ids", "matrix").mapInArrow(
        compare, f"query_id {id_type}, cell int, document_id {doc_type}, about double"
    )


def shortlist(index: Index, queries: DataFrame, size: int) -> DataFrame:
    """query_id, cell, document_id of the ``size`` best candidates of every query."""
    items = candidates(index, queries, size).select(
        "query_id", F.struct((-F.col("about")).alias("o"), "document_id", "cell").alias("item")
    )
    top = keyed.top_k_items(items, ["query_id"], "item", size)
    return top.select("query_id", F.explode("items").alias("item")).select("query_id", "item.cell", "item.document_id")


def search(index: Index, queries: DataFrame, limit: int = 20, spare: int = 2) -> DataFrame:
    """query_id, document_id, similarity, rank: about the best max(3 * limit, 20) documents per query.

    ``spare`` times as many candidates are ranked by their vectors. Similarities are exact.
    """
    k = max(3 * limit, 20)
    if not len(index.model.centroids):
        doc_type = index.vectors.schema["document_id"].dataType.simpleString()
        id_type = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame(
            [], f"query_id {id_type}, document_id {doc_type}, similarity double, rank long"
        )
    listed = shortlist(index, queries, spare * k)
    exact = (
        listed.join(index.vectors, ["cell", "document_id"])
        .join(queries.select("query_id", "vector"), "query_id")
        .select("query_id", "document_id", F.round(X.cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))
    )
    items = exact.select("query_id", F.struct((-F.col("similarity")).alias("o"), "document_id").alias("item"))
    top = keyed.top_k_items(items, ["query_id"], "item", k)
    return top.select("query_id", F.posexplode("items").alias("p", "item")).select(
        "query_id", "item.document_id", (-F.col("item.o")).alias("similarity"), (F.col("p") + 1).cast("long").alias("rank")
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, hits: how many of the exact results each query found."""
    both = found.select("query_id", "document_id", F.lit(1).alias("hit"))
    return (
        exact.join(both, ["query_id", "document_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    )
