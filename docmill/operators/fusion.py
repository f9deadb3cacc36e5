"""Fusion of vector and keyword hits, ranking, and the search that composes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import is_list_query
from docmill.operators.retrieval import keyword_list, keyword_search, long_enough, vector_search

FLOOR, FLOOR_FROM, MOST = 0.85, 0.5, 20
KEY = ("file_hash", "chunk_index")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Full outer join by chunk: the vector hit's row wins, keyword scores add; both sides are top lists of known length."""
    v = vector_hits.where(long_enough(F.col("text")))
    others = [c for c in v.columns if c not in (*KEY, "score") and c in keyword_hits.columns]
    joined = v.alias("v").join(keyword_hits.alias("k"), list(KEY), "full_outer")
    return joined.select(
        *KEY,
        *(F.coalesce(F.col(f"v.{c}"), F.col(f"k.{c}")).alias(c) for c in others),
        F.coalesce("v.score", F.lit(0.0)).alias("score"),
        F.coalesce("k.kw_score", F.lit(0.0)).alias("kw_score"),
    )


def by_fusion(hits: DataFrame) -> DataFrame:
    """Hits that hold every keyword first, then 0.6 vector and 0.4 keyword score."""
    mixed = F.round(F.col("score") * 0.6 + F.col("kw_score") * 0.4, 10)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy((F.col("kw_score") >= 1).desc(), mixed.desc(), "id")))


def by_fallback(hits: DataFrame) -> DataFrame:
    """The order when a reranker fails: 0.7 vector and 0.3 keyword score."""
    mixed = F.round(F.col("score") * 0.7 + F.col("kw_score") * 0.3, 10)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(mixed.desc(), "id")))


def by_rerank(hits: DataFrame) -> DataFrame:
    """By ``rerank_score``; hits with half of the keywords get 0.85 of the best score at least."""
    best = F.max("rerank_score").over(Window.partitionBy())
    lifted = F.when(F.col("kw_score") >= FLOOR_FROM, F.greatest("rerank_score", best * FLOOR)).otherwise(F.col("rerank_score"))
    out = hits.withColumn("rerank_score", lifted)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "id")))


def effective_k(query: Column, top_k: Column) -> Column:
    """Twice as many hits, twenty at most, where a list is asked for."""
    return F.when(is_list_query(query), F.least(2 * top_k, F.lit(MOST))).otherwise(top_k)


def multi_stage(chunks: DataFrame, query: str, vector: list[float], top_k: int = 5, file_name: str | None = None, category: str | None = None, reranker: Callable[[DataFrame, str], DataFrame] | None = None, segment=None) -> DataFrame:
    """Four times k vector hits and twice k keyword hits, fused, ranked and cut to k.

    ``reranker`` adds ``rerank_score`` to the candidates; if it raises, fusion scores decide.
    """
    vectors = vector_search(chunks, vector, 4 * top_k, file_name, category).drop("embedding")
    words = keyword_search(chunks.drop("embedding"), keyword_list(chunks.sparkSession, query, segment), 2 * top_k, file_name, category)
    hits = fuse(vectors, words)
    if reranker is None:
        ranked = by_fusion(hits)
    else:
        try:
            ranked = by_rerank(reranker(hits, query))
        except Exception:
            ranked = by_fallback(hits)
    return ranked.where(F.col("rank") <= top_k)


def mode_of(query: Column, n_hits: Column, any_keyword: Column, reranked: Column) -> Column:
    """What found the hits, and whether a list was asked for."""
    mode = F.when(n_hits == 0, "empty").when(reranked, "rerank").when(any_keyword, "hybrid").otherwise("vector")
    return F.concat(F.when(is_list_query(query), "list_").otherwise(""), mode)


def smart_search(chunks: DataFrame, query: str, vector: list[float], top_k: int = 5, file_name: str | None = None, category: str | None = None, reranker=None, segment=None) -> tuple[DataFrame, str]:
    """Hits and the mode that found them."""
    spark, asked = chunks.sparkSession, F.lit(query)
    k = spark.range(1).select(effective_k(asked, F.lit(top_k))).first()[0]
    found = multi_stage(chunks, query, vector, k, file_name, category, reranker, segment)
    rows = found.collect()  # k at most
    held = any(r["kw_score"] > 0 for r in rows)
    mode = spark.range(1).select(mode_of(asked, F.lit(len(rows)), F.lit(held), F.lit(reranker is not None))).first()[0]
    return spark.createDataFrame(rows, found.schema), mode
