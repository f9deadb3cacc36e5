"""Vector and keyword retrieval over a table of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from docmill.functions.text import KEYWORDS_MATCHED, LEAST_TEXT, keywords, keywords_of, utrim
from docmill.workers import map_arrow

HIT_COLUMNS = ("file_name", "file_hash", "category", "page", "block_type", "heading_path", "table_headers", "chunk_index", "text")
BROADCAST_QUERIES = 10_000
PAIRS = 2_000_000  # pairs of a query and a row that are estimated at once
MARGIN = 1.5e-4  # between an estimate and a rounded score


def scoped(chunks: DataFrame, file_name: str | None = None, category: str | None = None) -> DataFrame:
    """Equality filters; an empty or missing value filters nothing."""
    for name, value in (("file_name", file_name), ("category", category)):
        if value:
            chunks = chunks.where(F.col(name) == value)
    return chunks


def project(chunks: DataFrame) -> DataFrame:
    """The output columns of a hit, with their defaults."""
    defaults = {"page": F.lit(1), "block_type": F.lit("text"), "chunk_index": F.lit(0)}
    return chunks.select("id", *(F.coalesce(c, defaults[c]).alias(c) if c in defaults else F.coalesce(c, F.lit("")).alias(c) for c in HIT_COLUMNS))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero: it points nowhere."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def normalised(v: Column) -> Column:
    """A vector of unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_search(chunks: DataFrame, query: list[float], top_k: int = 20, file_name: str | None = None, category: str | None = None) -> DataFrame:
    """The exact top-k by cosine, filters first: one scan and a bounded heap per task."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    rows = scoped(chunks, file_name, category).where("embedding is not null")
    return rows.withColumn("score", F.round(cosine(F.col("embedding"), vector), 4)).where("score is not null").orderBy(F.desc("score"), "id").limit(top_k)


def half_up(x: np.ndarray) -> np.ndarray:
    """Ten-thousandths, rounded as ``F.round(x, 4)`` does: half up from the decimal that a double is written as."""
    scaled = np.abs(x) * 1e4
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        whole[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(whole, x)


def _square(rows: np.ndarray) -> np.ndarray:
    """Dot products of rows with themselves, summed from the first number on as ``dot`` does."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * rows[:, d]
    return out


def _unit(rows: np.ndarray, square: np.ndarray) -> np.ndarray:
    return (rows / np.sqrt(square)[:, None]).astype(np.float32)


def _nearest(asked: list[list[float]], top_k: int, schema: pa.Schema):
    """The best ``top_k`` rows (id, embedding) of every query in a task, as (q, id, score) with its place in ``asked``.

    A product of matrices in single precision says which pairs may be among the best; only these are scored
    in double precision, in the order of ``dot``, so scores and ties are those of ``cosine``."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(asked):
        by_size.setdefault(len(v), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for size, places in by_size.items():
            rows = np.array([asked[i] for i in places], np.float64).reshape(-1, size)
            square = _square(rows)
            sides[size] = np.array(places), np.ascontiguousarray(rows.T), square, _unit(rows, square)
        floor = np.full(len(asked), -np.inf, np.float32)  # what an estimate must reach to count
        held, waiting, n_waiting = schema.empty_table().append_column("key", pa.array([], pa.float64())), [], 0

        def best(tables: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(tables)
            order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start")
            table = table.take(order)
            q = table["q"].to_numpy()
            first = np.searchsorted(q, q)
            kept = table.filter(pa.array(np.arange(len(q)) - first < top_k))
            q, key, last = kept["q"].to_numpy(), kept["key"].to_numpy(), np.bincount(kept["q"].to_numpy(), minlength=len(asked))
            full = np.flatnonzero(last >= top_k)
            at = np.searchsorted(q, full) + top_k - 1
            floor[full] = np.maximum(floor[full], np.minimum(key[at], 1e4) / 1e4 - MARGIN)
            return kept

        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in set(sizes.tolist()) & sides.keys():
                at = np.flatnonzero(sizes == size)
                ids, rows = batch.column(0).take(pa.array(at)), lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                places, asked_t, asked_square, asked_unit = sides[size]
                step = max(1, PAIRS // len(places))
                for begin in range(0, len(rows), step):
                    some = rows[begin : begin + step]
                    square = _square(some)
                    estimate = asked_unit @ _unit(some, square).T
                    least = floor[places]
                    new = np.flatnonzero(np.isneginf(least))
                    if len(new) and len(some) >= top_k:
                        kth = np.partition(np.nan_to_num(estimate[new], nan=-2.0), len(some) - top_k, axis=1)[:, len(some) - top_k]
                        least[new] = kth - MARGIN
                    q, r = np.nonzero(~(estimate < least[:, None]))
                    total, across = np.zeros(len(q)), np.ascontiguousarray(some.T)
                    for d in range(size):
                        total += across[d][r] * asked_t[d][q]
                    norm = np.sqrt(square[r] * asked_square[q])
                    q, r, score = q[norm != 0], r[norm != 0], total[norm != 0] / norm[norm != 0]
                    key = np.nan_to_num(half_up(score), nan=2e4, posinf=2e4)  # not a number comes first, as in Spark
                    waiting.append(pa.Table.from_arrays([pa.array(places[q], pa.int32()), ids.take(pa.array(begin + r)).cast(schema.field("id").type), pa.array(score), pa.array(key + 0.0)], schema=held.schema))
                    n_waiting += len(q)
                    if n_waiting > len(held) or len(new):
                        held, waiting, n_waiting = best([held, *waiting]), [], 0
        yield from best([held, *waiting]).drop_columns(["key"]).to_batches(max_chunksize=10_000)

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):  # zero vectors and numbers beyond a double's range
            yield from run(batches)

    return quiet


def vector_search_many(chunks: DataFrame, queries: DataFrame, top_k: int = 20) -> DataFrame:
    """Top-k for every query (query_id, query_vector), in blocks by a hash of the id, of nine tenths of
    ``BROADCAST_QUERIES`` on average: each block goes to all tasks and is searched against all chunks, and each
    task keeps k rows a query before the shuffle.  Rows without a vector take no part on either side, nor do zero vectors."""
    whole = lambda rows, v: rows.where((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())).withColumn(v, F.col(v).cast("array<double>"))
    queries, chunks = whole(queries.select("query_id", "query_vector"), "query_vector"), whole(chunks.select("id", "embedding"), "embedding")
    n = queries.count()
    blocks = 1 if n <= BROADCAST_QUERIES else -(-10 * n // (9 * BROADCAST_QUERIES))
    schema = StructType([StructField("q", IntegerType()), StructField("id", chunks.schema["id"].dataType), StructField("score", DoubleType())])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = []
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        hits = map_arrow(chunks, _nearest([r["query_vector"] for r in own], top_k, to_arrow_schema(schema)), schema)
        names = chunks.sparkSession.createDataFrame([(q, r["query_id"]) for q, r in enumerate(own)], StructType([schema["q"], queries.schema["query_id"]]))
        scored = hits.join(F.broadcast(names), "q").select("query_id", "id", F.round("score", 4).alias("score"))
        found.append(scored.withColumn("rank", rank).where(F.col("rank") <= top_k))
    return reduce(DataFrame.unionAll, found)


def keyword_list(spark, query: str, segment: Callable[[str], list[str]] | None = None) -> list[str]:
    """The keywords of a query, cut by ``segment`` if there is one."""
    found = keywords_of(F.array(*map(F.lit, segment(query))).cast("array<string>")) if segment else keywords(F.lit(query))
    return list(spark.range(1).select(found.alias("k")).first()["k"])


def long_enough(text: Column) -> Column:
    return F.length(utrim(F.coalesce(text, F.lit("")))) >= LEAST_TEXT


def keyword_search(chunks: DataFrame, words: list[str], top_k: int = 20, file_name: str | None = None, category: str | None = None) -> DataFrame:
    """Chunks that hold one of the first five words, by id; ``kw_score`` is the share of all words held."""
    if not words:
        return chunks.limit(0).withColumns({"score": F.lit(0.0), "kw_score": F.lit(0.0)})
    match = reduce(lambda a, b: a | b, (F.contains("text", F.lit(w)) for w in words[:KEYWORDS_MATCHED]))
    rows = scoped(chunks, file_name, category).where((F.col("text") != "") & match).orderBy("id").limit(top_k)
    held = reduce(lambda a, b: a + b, (F.contains("text", F.lit(w)).cast("int") for w in words))
    return rows.where(long_enough(F.col("text"))).withColumns({"score": F.lit(0.0), "kw_score": held / F.lit(len(words))})
