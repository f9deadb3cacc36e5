"""Recall and reads of the vector index, against the exact search over the whole query set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import vectors
from docmill.operators.retrieval import vector_search, vector_search_many
from docmill.operators.vectors import RERANK, VectorIndex


def table(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "id long, embedding array<float>")


def hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.id] = (r["rank"], r.score)
    return out


def recall(got, want):
    return sum(len(got.get(q, {}).keys() & w.keys()) for q, w in want.items()) / sum(len(w) for w in want.values())


def test_recall_over_the_given_vectors(spark, tmp_path):
    """All ids divisible by 50 as queries, at the largest scale: nine tenths found, a quarter of the rows scored at most."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex(spark, str(tmp_path / "index")).build(rows)
    want = hits(vector_search_many(rows, asked, 20))
    assert recall(hits(index.search(asked, 20)), want) >= 0.9
    assert RERANK * 20 / rows.count() < 0.25
    assert hits(index.search(asked, 20, probes=10**6)) == want


def test_clustered_vectors_read_few_cells(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 32))
    data = np.concatenate([c + 0.15 * r.normal(size=(100, 32)) for c in centres])
    rows = table(spark, data)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex(spark, str(tmp_path / "index")).build(rows, cells=20)
    probes = spark.read.parquet(f"{index.root}/centroids").first()["probes"]
    assert probes <= 4
    assert recall(hits(index.search(asked, 10)), hits(vector_search_many(rows, asked, 10))) >= 0.9
    # One query's cells alone are read.
    one = index.search(asked.where("query_id = 0"), 10)
    assert one.count() == 10
    seen = {f.split("cell=")[1].split("/")[0] for f in spark.read.parquet(f"{index.root}/codes").where(F.col("cell").isin([1, 2])).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert seen == {"1", "2"}


@pytest.mark.parametrize("block", [10_000, 2])
def test_edges(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", block)
    rows = table(spark, [[1, 0], [0, 1], None, [0, 0], [1, 1], [1, 0], [2, 0], [1, 2, 3]]).unionByName(spark.createDataFrame([(None, [1.0, 1.0]), (0, [1.0, 0.0]), (9, [None, 1.0])], "id long, embedding array<float>"))
    index = VectorIndex(spark, str(tmp_path / "index")).build(rows, cells=2)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "query_id long, query_vector array<float>")
    got = index.search(asked, 3, probes=2)
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got.collect()) == [(1, 1, 0, 1.0), (1, 2, 0, 1.0), (1, 3, 5, 1.0), (2, 1, 1, 1.0), (2, 2, 4, 0.7071), (2, 3, 0, 0.0)]
    # As the exact search, which leaves zero vectors out likewise.
    exact = vector_search_many(rows.where("id is not null and size(embedding) = 2 and not exists(embedding, x -> x is null)"), asked.where("size(query_vector) = 2"), 3)
    assert sorted(map(tuple, exact.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, got.collect()))
    assert vector_search(rows.where("id is not null and size(embedding) = 2"), [1.0, 0.0], 9).where("id = 3").count() == 0
    empty = VectorIndex(spark, str(tmp_path / "empty")).build(rows.limit(0))
    assert empty.search(asked, 3).collect() == []


def by_columns(rows, asked, k):
    """Every pair scored by the column expression ``cosine``."""
    from pyspark.sql import Window

    from docmill.operators.retrieval import cosine

    pairs = rows.crossJoin(asked).select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query_vector")), 4).alias("score")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sorted(map(repr, map(tuple, pairs.withColumn("rank", rank).where(F.col("rank") <= k).collect())))


@pytest.mark.parametrize("pairs", [10**6, 7])
def test_many_queries_are_scored_in_matrices_with_the_rows_of_the_columns(spark, monkeypatch, pairs):
    """Ties, copies, zero and null vectors, several lengths, numbers out of range; no pair passes through a join."""
    from docmill.operators import retrieval

    monkeypatch.setattr(retrieval, "PAIRS", pairs)
    r = np.random.default_rng(5)
    data = [list(map(float, v)) for v in r.integers(-2, 3, size=(60, 3))] + [[1.0, 2.0, 3.0]] * 30
    odd = [[1.0, None, 2.0], None, [], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e-200] * 3, [1e200] * 3]
    rows = spark.createDataFrame([*enumerate(data + odd), (None, [1.0, 2.0, 3.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([*((f"q{i}", v) for i, v in enumerate(data[:20] + odd)), (None, [1.0, 0.0, 0.0])], "query_id string, query_vector array<double>")
    found = vector_search_many(rows, asked, 4)
    assert sorted(map(repr, map(tuple, found.select("query_id", "id", "score", "rank").collect()))) == by_columns(rows, asked, 4)
    assert vector_search_many(rows, asked.limit(0), 4).collect() == [] == vector_search_many(rows.limit(0), asked, 4).collect()
    assert not any(j in found._jdf.queryExecution().optimizedPlan().toString() for j in ("Join Cross", "zip_with"))


def test_rounding_is_that_of_the_columns(spark):
    from docmill.operators.retrieval import half_up

    x = np.append(np.arange(-2000, 2000) / 2e4, np.random.default_rng(1).normal(size=2000))
    told = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 4)).collect()]
    assert (half_up(x) / 1e4).tolist() == told
