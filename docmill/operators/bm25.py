"""BM25 over a postings table: built once, joined by query terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docmill.functions.text import bm25_tokens
from docmill.operators.retrieval import scoped
from docmill.workers import map_arrow

K1, B = 1.2, 0.75
POOL = 1000
PAIRS = 500_000  # pairs of a query and a document of a task
TASKS, LEAST = 48, 2048  # few pairs make up to so many tasks, of so many documents at least
COUNTS = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())]))
BROADCAST_TERMS = 200_000  # query terms that may be broadcast; beyond them the join shuffles


def row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, dl, tokens) -> (doc_id, dl, terms): array<struct<term, tf>> in order, null without tokens, by grouping all tokens of a batch."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        counts = pa.table({"row": row, "term": lists.flatten()}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).sort_by([("row", "ascending"), ("term", "ascending")])
        ends = np.append(0, np.cumsum(np.bincount(counts["row"].to_numpy(), minlength=len(sizes)))).astype(np.int32)
        told = pa.StructArray.from_arrays([counts["term"].combine_chunks().cast(pa.string()), counts["count_all"].combine_chunks().cast(pa.int64())], ["term", "tf"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), told, mask=pa.array(sizes == 0))], names=[batch.schema.names[0], "dl", "terms"])


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf); documents without tokens have no rows."""
    return docs.select(doc_id, F.explode(bm25_tokens(text)).alias("term")).groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(post: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return post.groupBy(doc_id).agg(F.sum("tf").alias("dl"))


def frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def statistics(doc_lengths: DataFrame) -> DataFrame:
    """One row: number of documents with tokens, and their mean length."""
    return doc_lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def search(docs: DataFrame, queries: DataFrame, top_k: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Top-k documents of every query (query_id, query): (query_id, doc_id, score, rank).

    Lengths come with the tokens, so postings join by term alone; only the terms of the queries,
    a stated set, leave the first stage.  Tasks grow in number with the pairs of queries and documents.
    Repeated query words count repeatedly.
    """
    tokens = bm25_tokens(text)
    held = docs.select(doc_id, tokens.alias("tokens")).where(F.size("tokens") > 0).withColumn("dl", F.size("tokens").cast("long"))
    stats = statistics(held)
    n_queries, n_docs = queries.count(), docs.count()
    terms = queries.select("query_id", F.explode(bm25_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = terms.select("term").distinct()
    few = terms.count() <= BROADCAST_TERMS
    counted = map_arrow(held.select(doc_id, "dl", "tokens"), row_counts, StructType([held.schema[doc_id], held.schema["dl"], StructField("terms", COUNTS)]))
    found = counted.select(doc_id, "dl", F.explode("terms").alias("t")).select(doc_id, "dl", "t.term", "t.tf").join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    # All of a document meets in one of as many tasks as keep a task's pairs few; both uses share this shuffle.
    post = found.repartition(max(1, -(-n_queries * n_docs // PAIRS), min(TASKS, n_docs // LEAST)), doc_id).groupBy(doc_id, "dl", "term").agg(F.sum("tf").alias("tf"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # The one row of statistics is a broadcast of known size.
    asked = frequencies(post).join(terms, "term").crossJoin(F.broadcast(stats))
    if few:
        asked = F.broadcast(asked)  # then postings stay with their document, and pairs are summed where they are
    scored = post.join(asked, "term")
    scored = scored.groupBy("query_id", doc_id).agg(F.round(F.sum(F.col("qtf") * idf * weight), 4).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), doc_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k)


def pool_search(chunks: DataFrame, query: str, top_k: int = 20, file_name: str | None = None, category: str | None = None, pool: int = POOL) -> DataFrame:
    """Search within the first ``pool`` chunks by id of a scope, whose statistics alone count."""
    own = scoped(chunks, file_name, category).orderBy("id").limit(pool)
    queries = chunks.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    found = search(own, queries, top_k, doc_id="id")
    return found.join(own, "id").drop("query_id")


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    """The document of an id, or no row."""
    return docs.where(F.col("doc_id") == doc_id)
