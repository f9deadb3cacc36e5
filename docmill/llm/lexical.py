"""Ranked lexical search by WAND over document shards (operator 11).

A text's terms are its runs of digits, letters and non-ASCII characters, with A-Z
lower-cased.  With N documents that hold a term, L their terms in all, n a document's
terms, df the documents that hold a term and tf its occurrences in one of them:

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))          m = 50 + (50 n N) div L
    score = sum over the query's distinct terms of  w * ((10^9 tf) div (1000 tf + 20 m))

1. Every text is read once.  A task turns it into shards of at most 4,096 documents and
   16 MB of text, each one row of a written table: ids, lengths and, by term, the
   documents that hold it in ascending order with their counts.  Only terms that some
   query asks are kept where these take 16 MB at most; beyond that all terms are.
2. N, L and df are sums over the shards' rows, pre-aggregated by term.
3. Shards are searched for all queries.  In a shard a term's bound is its weight times
   its largest impact there.  Lists are ordered by bound; the pivot is the first list
   from which on all bounds together stay below the query's threshold (the score of its
   k-th best document so far).  Documents that no list before the pivot holds can't beat
   the heap and are never looked at; the others leave as soon as what they have and
   the bounds still to come stay below it.  The pivot is chosen for a window of 1,024
   documents at a time, so that numpy does the sums, and anew for each window.  A task
   keeps one heap a query over all its shards.
4. Heaps are merged in two steps, of some tasks and of all, so no group grows with their number.

Queries are searched in blocks of 16 MB of (query, term) rows on average, each against
the written shards; a query's own terms stay together.

Result: one row for each query and one of its k best documents with a score above 0:
``item_id``, ``rank`` (int, from 1, unique, highest first), ``doc_id``, ``score`` (long).

Edges: null and empty texts hold no term, so they count nowhere and rank nowhere; queries
without a term that some document holds have no rows; equal scores rank by ascending id,
null ids first; rows that repeat an id are documents (or queries) of their own and
rank apart; further columns are left out; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import broadcast_if_small, map_arrow, materialize, table

K = 50
SHARD_DOCS, SHARD_BYTES, WINDOW = 4096, 16_000_000, 1024
TERM_BYTES = 16_000_000  # of terms, and of a block of queries on average, that go to the tasks
MERGED = 256  # groups of tasks whose heaps are merged first
RESULT = "item_id long, rank int, doc_id long, score long"

_SHARD = "n long, total long, ids array<long>, lengths array<long>, terms array<binary>, dfs array<long>, docs binary, tfs binary"
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
#: Letters A-Z fold (they stand in no break range), breaks become spaces, all other bytes stay.
_FOLD = bytes.maketrans(_BREAKS + _UPPER, b" " * len(_BREAKS) + _UPPER.lower())


def coded_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All terms of the texts (UTF-8): the text's number and the term's code for each, and the terms by code."""
    folded = pa.array([t.translate(_FOLD).strip() for t in texts], pa.binary())
    lists = pc.ascii_split_whitespace(folded.view(pa.string()))
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    words = lists.flatten().view(pa.binary())
    kept = pc.not_equal(pc.binary_length(words), 0)  # an empty text is split into one empty word
    words, text = words.filter(kept).dictionary_encode(), text[kept.to_numpy(zero_copy_only=False)]
    return text, words.indices.to_numpy().astype(np.int64), words.dictionary


def shard(ids: list[int | None], texts: list[bytes], wanted: pa.Array | None) -> pa.RecordBatch | None:
    """The row of some documents, or None if they hold no term."""
    text, code, distinct = coded_terms(texts)
    if not len(text):
        return None
    lengths = np.bincount(text, minlength=len(texts))
    held = np.flatnonzero(lengths)
    place = np.cumsum(lengths > 0) - 1
    if wanted is not None:
        found = pc.index_in(distinct, value_set=wanted).fill_null(-1).to_numpy()
        text, code = text[found[code] >= 0], code[found[code] >= 0]
    keys, tfs = np.unique(code * len(held) + place[text], return_counts=True)
    codes, starts = np.unique(keys // len(held), return_index=True)
    row = {
        "n": pa.array([len(held)], pa.int64()),
        "total": pa.array([int(lengths.sum())], pa.int64()),
        "ids": pa.array([[ids[i] for i in held]], pa.list_(pa.int64())),
        "lengths": pa.array([lengths[held].tolist()], pa.list_(pa.int64())),
        "terms": pa.array([distinct.take(pa.array(codes)).to_pylist()], pa.list_(pa.binary())),
        "dfs": pa.array([np.diff([*starts, len(keys)]).tolist()], pa.list_(pa.int64())),
        "docs": pa.array([(keys % len(held)).astype("<u2").tobytes()], pa.binary()),
        "tfs": pa.array([tfs.astype("<u4").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def _shards(wanted: pa.Array | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if len(ids) == SHARD_DOCS or size >= SHARD_BYTES:
                    if (row := shard(ids, texts, wanted)) is not None:
                        yield row
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1])
        if ids and (row := shard(ids, texts, wanted)) is not None:
            yield row

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(0).to_numpy()
        text, code, distinct = coded_terms(batch.column(1).cast(pa.binary()).to_pylist())
        keys = np.unique(text * max(1, len(distinct)) + code)
        yield pa.RecordBatch.from_arrays([pa.array(items[keys // max(1, len(distinct))], pa.int64()), distinct.take(pa.array(keys % max(1, len(distinct))))], names=["item", "term"])


class Best:
    """The k best documents of a query so far: highest scores, then null ids, then ascending ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.named = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def threshold(self) -> int:
        """The least score that may still enter; an equal one may, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        scores, ids, named = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.named, named])
        order = np.lexsort((ids, named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[order], ids[order], named[order]


Lists = list[tuple[int, np.ndarray, np.ndarray, int]]  # weight, documents ascending, their impacts, the largest


def wand(lists: Lists, ids: np.ndarray, named: np.ndarray, best: Best) -> None:
    """Offers the documents of a shard that may enter the heap."""
    lists = sorted(lists, key=lambda x: -x[0] * x[3])
    rest = np.append(np.cumsum([w * top for w, _, _, top in lists][::-1])[::-1], 0).astype(np.int64)
    for start in range(0, len(ids), WINDOW):
        least = best.threshold
        pivot = int(np.count_nonzero(rest >= least))  # lists from here on can't reach the threshold by themselves
        if not pivot:
            return
        end = min(start + WINDOW, len(ids))
        scores = np.zeros(end - start, np.int64)
        for w, docs, impacts, _ in lists[:pivot]:
            a, b = np.searchsorted(docs, (start, end))
            scores[docs[a:b] - start] += w * impacts[a:b]
        held = np.flatnonzero(scores + rest[pivot] >= least)
        for i, (w, docs, impacts, _) in enumerate(lists[pivot:], pivot + 1):
            if not len(held):
                break
            at = np.searchsorted(docs, held + start)
            found = at < len(docs)
            found[found] = docs[at[found]] == held[found] + start
            scores[held[found]] += w * impacts[at[found]]
            held = held[scores[held] + rest[i] >= least]
        if len(held):
            best.offer(scores[held], ids[start + held], named[start + held])


def _searched(queries: dict[int, list[tuple[bytes, int]]], n: int, total: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in queries}
        asked = pa.array(sorted({t for terms in queries.values() for t, _ in terms}), pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda name: batch.column(name)[row]  # noqa: B023, E731
                ids = of("ids").values
                named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                lengths, which = np.unique(of("lengths").values.to_numpy(), return_inverse=True)
                m = np.array([50 + 50 * int(x) * n // total for x in lengths], np.int64)[which]
                docs, tfs = np.frombuffer(of("docs").as_py(), "<u2").astype(np.int64), np.frombuffer(of("tfs").as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(of("dfs").values.to_numpy())
                starts = np.append(0, ends[:-1])
                terms, lists = of("terms").values, {}
                for i in np.flatnonzero(pc.is_in(terms, value_set=asked).to_numpy(zero_copy_only=False)):
                    own, tf = docs[starts[i] : ends[i]], tfs[starts[i] : ends[i]]
                    impacts = 1_000_000_000 * tf // (1000 * tf + 20 * m[own])
                    lists[terms[int(i)].as_py()] = (own, impacts, int(impacts.max()))
                for item, weights in queries.items():
                    if held := [(w, *lists[t]) for t, w in weights if t in lists]:
                        wand(held, ids, named, best[item])
        for item, b in best.items():
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), item)), pa.array(b.ids, mask=~b.named), pa.array(b.scores)], names=["item", "doc_id", "score"])

    return run


def index(spark: SparkSession, docs: DataFrame, wanted: list[bytes] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of shards, of the wanted terms or of all."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return materialize(spark, map_arrow(rows, _shards(None if wanted is None else pa.array(sorted(wanted), pa.binary())), _SHARD), "shards")


def _best(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = K, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """See the module's docstring."""
    items = queries.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(query, F.lit("")).alias("query"))
    items = materialize(spark, items.withColumn("item", F.monotonically_increasing_id()), "items")
    asked = materialize(spark, map_arrow(items.select("item", "query"), _query_terms, "item long, term binary"), "asked")
    terms = asked.select("term").distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    shards = index(spark, docs, [bytes(r[0]) for r in terms.collect()] if size <= TERM_BYTES else None, doc_id=doc_id, text=text)
    n, total = shards.agg(F.sum("n"), F.sum("total")).first()
    if not n or not size:
        return spark.createDataFrame([], RESULT)
    frequencies = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(spark, asked.join(frequencies, "term").select("item", "term", weight.alias("w")).where("w > 0"), "weights")
    blocks = -(-(weights.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // TERM_BYTES)
    found = []
    for b in range(blocks):
        block: dict[int, list[tuple[bytes, int]]] = {}
        for item, term, w in weights.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():
            block.setdefault(item, []).append((bytes(term), w))
        found.append(map_arrow(shards, _searched(block, n, total, k), "item long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], RESULT)
    merged = _best(reduce(DataFrame.unionAll, found).withColumn("part", F.spark_partition_id() % MERGED), k, "item", "part")
    best = _best(merged.select("item", "doc_id", "score"), k, "item")
    return best.join(broadcast_if_small(items.select("item", "item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
