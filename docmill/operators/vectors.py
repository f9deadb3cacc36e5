"""Approximate neighbours over a stored vector index: cells, small codes, exact re-ranking.

Below the index's folder lie Parquet tables:

``centroids``  the cells' centres, trained on a bounded sample of the vectors (``SAMPLE`` rows), and
               how many cells a query has to visit: measured on the sample, for ``RECALL`` of its neighbours;
``codes``      every vector in 8 bits a number, by cell: a quarter of the vectors' size;
``vectors``    every vector as it is, by cell.

A search ranks the cells of each query by their centres and scans the codes of the nearest
ones; other cells' files are not read.  Each task keeps a query's best ``RERANK`` times k
codes, all tasks together as many; only these are fetched as vectors and scored exactly.
With all cells visited the result is that of the exact search, as a code's error is far
below the distance from the k-th neighbour to the last candidate.

Rows without a vector, and vectors of another length than the first, are not indexed;
zero vectors are nobody's neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.operators.retrieval import BROADCAST_QUERIES, cosine
from docmill.sources.tables import if_small, read_or_empty
from docmill.workers import map_arrow

SAMPLE, ASKED, MOST_CELLS = 50_000, 200, 4096  # rows to train on, and of those to ask; cells at most
RECALL, RERANK = 0.97, 10
CENTROIDS = "cell int, centre array<double>, probes int"
CODES, VECTORS = "id long, code binary, cell int", "id long, embedding array<float>, cell int"


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def codes_of(rows: np.ndarray) -> np.ndarray:
    """Vectors of unit length as signed bytes; the largest number of a vector is 127."""
    top = np.abs(rows).max(axis=1, keepdims=True)
    return np.rint(np.divide(rows * 127, top, out=np.zeros_like(rows), where=top > 0)).astype(np.int8)


def needed_probes(rows: np.ndarray, centres: np.ndarray, k: int = 20) -> int:
    """Cells to visit so that sample rows find ``RECALL`` of their k nearest ones in the sample."""
    asked = rows[:: max(1, len(rows) // ASKED)][:ASKED]
    near = np.argsort(-(asked @ rows.T), axis=1)[:, :k]
    cell, order = (rows @ centres.T).argmax(axis=1), np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell in each query's order
    found = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(RECALL * len(found))))]) + 1


def _coded(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(matrix(batch.column(1), centres.shape[1]))
            cells = (rows @ centres.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes_of(rows)], pa.binary()), pa.array(cells)], names=["id", "embedding", "code", "cell"])

    return run


def _candidates(ids: list, asked: np.ndarray, visits: np.ndarray, most: int):
    """``visits``: whether a query (row) visits a cell (column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0, np.int32))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = unit(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float32))
            for q in np.flatnonzero(visits[:, np.unique(cells)].any(axis=1)):
                here = np.flatnonzero(visits[q, cells])
                scores, held, at = best[q]
                scores, held, at = np.append(scores, codes[here] @ asked[q]), np.append(held, own[here]), np.append(at, cells[here])
                if len(scores) > most:
                    top = np.argpartition(-scores, most - 1)[:most]
                    scores, held, at = scores[top], held[top], at[top]
                best[q] = scores, held, at
        for q, (scores, held, at) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(scores), pa.int64()), pa.array(at.astype(np.int32)), pa.array(held), pa.array(scores.astype(np.float32))], names=["query_id", "cell", "id", "estimate"])

    return run


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, chunks: DataFrame, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Indexes all rows (id, embedding), in place of what the folder held."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where("id is not null and embedding is not null and not exists(embedding, x -> x is null)")
        first = rows.limit(1).collect()
        dim = len(first[0]["embedding"]) if first else 1
        rows = rows.where(F.size("embedding") == dim)
        n = rows.count()
        sample = rows.where(F.rand(seed) < SAMPLE / n) if n > SAMPLE else rows
        taken = unit(np.array([r["embedding"] for r in sample.select("embedding").limit(2 * SAMPLE).collect()], np.float32).reshape(-1, dim))
        taken = taken[np.abs(taken).max(axis=1) > 0] if len(taken) else taken
        cells = min(cells or max(1, round(n**0.5 / 2)), MOST_CELLS, max(1, len(taken)))
        if cells > 1:
            told = self.spark.createDataFrame([(r.tolist(),) for r in taken], "v array<double>").select(array_to_vector("v").alias("v"))
            centres = unit(np.array(KMeans(featuresCol="v", k=cells, seed=seed, distanceMeasure="cosine").fit(told).clusterCenters(), np.float32))
        else:
            centres = taken[:1] if len(taken) else np.zeros((1, dim), np.float32)
        probes = needed_probes(taken, centres) if len(taken) else 1
        self.spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], CENTROIDS).write.mode("overwrite").parquet(f"{self.root}/centroids")
        coded = map_arrow(rows, _coded(centres), "id long, embedding array<float>, code binary, cell int")
        # A cell that holds many rows is written by several tasks.
        slices = F.pmod(F.xxhash64("id"), F.lit(max(1, n // len(centres) // 100_000)))
        coded = coded.repartition("cell", slices)
        coded.select("id", "embedding", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors")
        coded.select("id", "code", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/codes")
        return self

    def search(self, queries: DataFrame, top_k: int = 20, probes: int | None = None) -> DataFrame:
        """Top-k for every query (query_id, query_vector): (query_id, id, score, rank); ``probes`` cells each, or as many as
        the sample asked for.  Queries go to the tasks in blocks of ``BROADCAST_QUERIES`` on average."""
        told = sorted(read_or_empty(self.spark, f"{self.root}/centroids", CENTROIDS).collect(), key=lambda r: r["cell"])
        centres = np.array([r["centre"] for r in told], np.float32).reshape(len(told), -1)
        queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<float>").alias("query_vector")).where(F.size("query_vector") == centres.shape[1])
        n = queries.count()
        blocks = max(1, -(-n // BROADCAST_QUERIES))
        found = []
        for b in range(blocks):
            rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
            if not rows:
                continue
            asked = unit(np.array([r["query_vector"] for r in rows], np.float32))
            order = np.argsort(-(asked @ centres.T), axis=1)[:, : min(probes or told[0]["probes"], len(told))]
            visits = np.zeros((len(rows), len(told)), bool)
            np.put_along_axis(visits, order, True, axis=1)
            codes = read_or_empty(self.spark, f"{self.root}/codes", CODES).where(F.col("cell").isin(np.flatnonzero(visits.any(axis=0)).tolist()))
            found.append(map_arrow(codes, _candidates([r["query_id"] for r in rows], asked, visits, RERANK * top_k), "query_id long, cell int, id long, estimate float"))
        if not found:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        by = lambda order: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order), "id"))
        chosen = reduce(DataFrame.unionAll, found).withColumn("r", by("estimate")).where(F.col("r") <= RERANK * top_k).select("query_id", "cell", "id").distinct()
        vectors = read_or_empty(self.spark, f"{self.root}/vectors", VECTORS)
        scored = vectors.join(if_small(chosen), ["cell", "id"]).join(if_small(queries), "query_id")
        scored = scored.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query_vector")), 4).alias("score")).where("score is not null")
        return scored.withColumn("rank", by("score")).where(F.col("rank") <= top_k)
