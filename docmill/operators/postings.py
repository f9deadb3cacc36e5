"""BM25 over a stored inverted index: texts are tokenised once, when they are added.

Below the index's folder lie Parquet tables, each partitioned by batch:

``blocks``   one row for each term and block of about 64 documents, by bucket of the term's hash: the
             documents with their term counts and lengths, how many there are, and the largest
             count and smallest length, which bound what the block can add to a score;
``forward``  every document that was added, with its number of tokens and its terms' counts;
``gone``     deleted documents, each with the batch up to which it is hidden;
``totals``   what a batch adds to the number of documents with tokens and to their tokens.

A batch counts once its totals are there, which are written last; a batch that is written
again replaces itself.  A deletion is a batch of its own, whose block rows hold no documents
but lower the terms' frequencies, so statistics are those of an index of what is left.

A search of few queries reads block bounds first.  The most promising blocks of a query are
scored; their k-th best score is a floor, and only blocks whose terms' bounds together reach
it are scored at all.  Many queries over many blocks reach nearly all of them: their terms'
rows then meet by block in one shuffle, and each task scores its blocks and keeps the best
of every query.  Both results are exact.  There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from docmill.functions.text import bm25_tokens
from docmill.operators.bm25 import K1, B, row_counts
from docmill.operators.chunking import bound
from docmill.operators.retrieval import half_up
from docmill.sources.tables import if_small, new_dir, read_or_empty
from docmill.workers import ROWS, map_arrow

BUCKETS = 64  # partitions of the terms
BLOCK = 64  # documents of a block, on average
SLICE = 32_768  # documents of a batch for each task, and so for each file of a bucket; a small batch has up to
TASKS, LEAST = 48, 8192  # so many tasks of so many documents at least
FIRST = 4  # blocks of a query that are scored for its floor, at least
SMALL = 1_000_000  # rows (ids, or a query's terms) that may be broadcast; beyond them joins shuffle
SLACK = 0.001  # scores are rounded to four places
FEW = 100_000  # pairs of a query and a block, up to which blocks are chosen by their bounds
TRIPLES, CELLS = 2_000_000, 4_000_000  # terms of pairs, and pairs of a query and a document, that a task holds at once

BLOCKS = "term string, block int, ids array<long>, tfs array<long>, dls array<long>, df long, most_tf long, least_dl long, batch int, bucket int"
FORWARD = "doc_id long, dl long, terms array<struct<term:string,tf:bigint>>, batch int"
GONE = "doc_id long, upto int, batch int"
TOTALS = "docs long, tokens long, batch int"


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a text's tokens, from their sorted runs."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return bound(starts, lambda s: F.transform(s, lambda a, i: F.struct(F.get(words, a).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(words)) - a).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, bound(F.array_sort(tokens), runs))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, dl, block, terms, tfs) in the order of their blocks -> block rows, without bucket.

    The last block of a batch waits for the next one, unless too many rows wait: a block in two rows stays right."""

    def rows(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = docs.sort_by([("doc_id", "ascending"), ("dl", "ascending")]).combine_chunks()
        at = pa.array(np.repeat(np.arange(len(docs)), pc.list_value_length(docs["terms"]).to_numpy()))
        flat = pa.table({"block": docs["block"].take(at), "term": pc.list_flatten(docs["terms"]), "ids": docs["doc_id"].take(at), "tfs": pc.list_flatten(docs["tfs"]), "dls": docs["dl"].take(at)})
        told = flat.group_by(["block", "term"], use_threads=False).aggregate([("ids", "list"), ("tfs", "list"), ("dls", "list"), ([], "count_all"), ("tfs", "max"), ("dls", "min")])
        yield from told.select(["term", "block", "ids_list", "tfs_list", "dls_list", "count_all", "tfs_max", "dls_min"]).rename_columns(["term", "block", "ids", "tfs", "dls", "df", "most_tf", "least_dl"]).to_batches(max_chunksize=10_000)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(2).to_numpy()
        whole = int(np.searchsorted(block, block[-1]))
        if whole or (waiting and waiting[-1].column(2)[-1].as_py() != block[0]) or len(waiting) > 4:
            yield from rows(pa.Table.from_batches([*waiting, batch.slice(0, whole)]))
            waiting = []
        waiting.append(batch.slice(whole))
    if waiting:
        yield from rows(pa.Table.from_batches(waiting))


def _best(mean: float, top_k: int, gone: tuple[np.ndarray, np.ndarray] | None, kind: pa.DataType):
    """Block rows (batch, block, ids, tfs, dls, queries, weights), those of a block one after another -> (query_id, doc_id, score, batch).

    With ``gone`` (ids ascending, and the batch up to which each is hidden) the task's best of each query that are left;
    without it every pair, for a join to say which are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}  # of the queries
        floor = np.zeros(0)  # the k-th best score so far, in ten-thousandths
        held: list[np.ndarray] = [np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]  # query, score, document, batch
        fresh: list[list[np.ndarray]] = []

        def kept() -> list[np.ndarray]:
            q, score, doc, batch = (np.concatenate(c) for c in zip(held, *fresh))
            if gone is None:
                return [q, score, doc, batch]
            points = half_up(score)
            order = np.lexsort((doc, -points, q))
            order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < top_k]
            first = np.searchsorted(q[order], np.arange(len(floor)))
            last = np.searchsorted(q[order], np.arange(len(floor)), "right")
            full = np.flatnonzero(last - first >= top_k)
            floor[full] = points[order][last[full] - 1]
            return [q[order], score[order], doc[order], batch[order]]

        def out() -> Iterator[pa.RecordBatch]:
            names = list(codes)
            for at in range(0, len(held[0]), 10_000):
                q, score, doc, batch = (c[at : at + 10_000] for c in held)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], kind), pa.array(doc), pa.array(score), pa.array(batch.astype(np.int32))], names=["query_id", "doc_id", "score", "batch"])

        def scored(rows: pa.Table) -> None:
            """Adds the pairs of some whole blocks to ``fresh``."""
            nonlocal floor
            rows = rows.combine_chunks()
            asked = pc.list_flatten(rows["queries"]).combine_chunks().dictionary_encode()
            own = np.array([codes.setdefault(v, len(codes)) for v in asked.dictionary.to_pylist()], np.int64)
            floor = np.append(floor, np.zeros(len(codes) - len(floor)))
            asked, weights = asked.indices.to_numpy(), pc.list_flatten(rows["weights"]).to_numpy()
            n_posts, n_asks = pc.list_value_length(rows["ids"]).to_numpy(), pc.list_value_length(rows["queries"]).to_numpy()
            ids, tf, dl = (pc.list_flatten(rows[c]).to_numpy() for c in ("ids", "tfs", "dls"))
            row = np.repeat(np.arange(len(n_posts)), n_posts)
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (mean or 1.0)))
            batch = rows["batch"].to_numpy()[row]
            _, one, doc = np.unique(np.stack([batch, ids], 1), axis=0, return_index=True, return_inverse=True) if len(set(batch.tolist())) > 1 else np.unique(ids, return_index=True, return_inverse=True)
            doc, ask_from, each = doc.ravel(), (np.cumsum(n_asks) - n_asks)[row], n_asks[row]
            total, ends, begin = np.zeros(len(own) * len(one)), np.cumsum(each), 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TRIPLES, "right")))
                n = each[begin:end]
                post = np.repeat(np.arange(begin, end), n)
                ask = ask_from[post] + np.arange(len(post)) - np.repeat(np.cumsum(n) - n, n)
                total += np.bincount(asked[ask] * len(one) + doc[post], weights[ask] * gain[post], len(total))
                begin = end
            total = total.reshape(len(own), len(one))
            q, d = np.nonzero((total > 0) & (total * 1e4 >= (floor[own] - 1)[:, None]))
            score, ids, batch = total[q, d], ids[one][d], batch[one][d].astype(np.int64)
            if gone is not None and len(gone[0]):
                at = np.minimum(np.searchsorted(gone[0], ids), len(gone[0]) - 1)
                left = ~((gone[0][at] == ids) & (batch <= gone[1][at]))
                q, score, ids, batch = q[left], score[left], ids[left], batch[left]
            fresh.append([own[q], score, ids, batch])

        def pieces() -> Iterator[pa.Table]:
            """Whole blocks, as many as make up some rows."""
            waiting, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                place = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
                starts = np.flatnonzero(place[1:] != place[:-1]) + 1
                before = waiting and waiting[-1].num_rows and (waiting[-1].column(0)[-1].as_py() << 32 | waiting[-1].column(1)[-1].as_py())
                cut = int(starts[-1]) if len(starts) else 0 if waiting and before != place[0] else None
                if cut is not None and n + cut >= max(ROWS, min(16 * ROWS, CELLS // (BLOCK * max(1, len(codes))) * ROWS)):
                    yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
                    waiting, n = [], 0
                    batch = batch.slice(cut)
                waiting.append(batch)
                n += batch.num_rows
            if waiting:
                yield pa.Table.from_batches(waiting)

        for piece in pieces():
            scored(piece)
            if gone is None or sum(len(f[0]) for f in fresh) > max(200_000, len(held[0])):
                held, fresh = kept(), []
            if gone is None:
                yield from out()
                held = [c[:0] for c in held]
        held, fresh = kept(), []
        yield from out()

    return run


def _if_small(df: DataFrame) -> DataFrame:
    return if_small(df, SMALL)


def bucket_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


class StoredIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str, batches: list[int] | None = None) -> DataFrame:
        """The rows of finished batches; a caller that reads several tables looks the batches up once."""
        return read_or_empty(self.spark, f"{self.root}/{name}", schema).where(F.col("batch").isin(self.batches() if batches is None else batches))

    def batches(self) -> list[int]:
        """Numbers of the finished batches, ascending."""
        return sorted(r[0] for r in read_or_empty(self.spark, f"{self.root}/totals", TOTALS).select("batch").distinct().collect())

    def next_batch(self) -> int:
        return max(self.batches(), default=0) + 1

    def forward(self) -> DataFrame:
        """(doc_id, dl, terms, batch) of all documents that are not deleted, those without tokens included."""
        return self._left(self._table("forward", FORWARD))

    def _gone(self, batches: list[int] | None = None) -> DataFrame:
        """(doc_id, upto) of the deletions."""
        return _if_small(self._table("gone", GONE, batches).groupBy("doc_id").agg(F.max("upto").alias("upto")))

    def _left(self, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Rows (doc_id, batch, ...) that no deletion hides."""
        return rows.join(self._gone() if gone is None else gone, "doc_id", "left").where("upto is null or batch > upto").drop("upto")

    def frequencies(self) -> DataFrame:
        """(term, df) of all documents that are not deleted."""
        return self._table("blocks", BLOCKS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self, batches: list[int] | None = None) -> tuple[int, float]:
        """Number of documents with tokens, and their mean length."""
        n, tokens = self._table("totals", TOTALS, batches).agg(F.sum("docs"), F.sum("tokens")).first()
        return n or 0, tokens / n if n else 0.0

    def _write(self, rows: DataFrame, table: str, batch: int, *partitions: str) -> None:
        rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.root}/{table}/batch={batch}")

    def _written(self, table: str, schema: str, batch: int) -> DataFrame:
        return self.spark.read.schema(schema.removesuffix(", batch int")).parquet(f"{self.root}/{table}/batch={batch}")

    def _total(self, rows: DataFrame, batch: int, sign: int) -> None:
        sums = rows.where("dl > 0").agg((sign * F.count(F.lit(1))).cast("long").alias("docs"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).cast("long").alias("tokens"))
        self._write(sums, "totals", batch)

    def add(self, docs: DataFrame, batch: int | None = None, doc_id: str = "doc_id", text: str = "text") -> int:
        """Adds documents that the index doesn't hold, as a batch; one of a given number replaces itself.

        Null texts count as empty; empty ones are remembered as added but never found.
        """
        words = F.coalesce(bm25_tokens(text), F.array().cast("array<string>"))
        tokens = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words.alias("tokens"))
        return self._add(map_arrow(tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens"), row_counts, FORWARD.removesuffix(", batch int")), batch or self.next_batch())

    def _add(self, forward: DataFrame, batch: int) -> int:
        self._write(forward, "forward", batch)
        held = self._written("forward", FORWARD, batch)
        self._write(self._blocks(held, held.count()), "blocks", batch, "bucket")
        self._total(held, batch, 1)
        return batch

    def _blocks(self, forward: DataFrame, n: int) -> DataFrame:
        """Block rows of documents: one shuffle of documents by their blocks; each task packs and sorts the rows of its own."""
        blocks, parts = -(-n // BLOCK) or 1, max(1, -(-n // SLICE), min(TASKS, -(-n // LEAST)))
        placed = forward.where("dl > 0").select("doc_id", "dl", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.col("terms.term").alias("terms"), F.col("terms.tf").alias("tfs"))
        rows = map_arrow(placed.repartition(parts, "block").sortWithinPartitions("block"), _packed, BLOCKS.removesuffix(", batch int, bucket int"))
        return rows.withColumn("bucket", bucket_of("term")).sortWithinPartitions("bucket", "term", "block")

    def delete(self, ids: DataFrame, batch: int | None = None) -> int:
        """Deletes the documents (doc_id) as a batch of its own; unknown ids are no fault."""
        batch = batch or self.next_batch()
        upto = max((b for b in self.batches() if b < batch), default=0)
        known = self.forward().where(F.col("batch") <= upto).drop("batch")
        self._write(known.join(_if_small(ids.select(F.col("doc_id").cast("long")).distinct()), "doc_id", "left_semi"), "lost", batch)
        lost, none = self._written("lost", FORWARD, batch), F.array().cast("array<long>")
        lowered = lost.select(F.explode("terms").alias("t")).groupBy("t.term").agg((-F.count(F.lit(1))).alias("df")).withColumn("bucket", bucket_of("term"))
        unknown = F.lit(None).cast("long")
        rows = lowered.select("term", F.lit(None).cast("int").alias("block"), none.alias("ids"), none.alias("tfs"), none.alias("dls"), "df", unknown.alias("most_tf"), unknown.alias("least_dl"), "bucket")
        self._write(rows.repartition("bucket"), "blocks", batch, "bucket")
        self._write(lost.select("doc_id", F.lit(upto).alias("upto")), "gone", batch)
        self._total(lost, batch, -1)
        return batch

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """Top-k documents of every query (query_id, query): (query_id, doc_id, score, rank), as ``bm25.search`` gives them."""
        batches = self.batches()
        (n, mean), gone = self.statistics(batches), self._gone(batches)
        key, place = ["bucket", "term"], ["batch", "block"]
        words = queries.select("query_id", F.explode(bm25_tokens("query")).alias("term"))
        terms = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).withColumn("bucket", bucket_of("term"))
        blocks = self._table("blocks", BLOCKS, batches).join(_if_small(terms.select(*key).distinct()), key, "left_semi")
        known = blocks.groupBy(*key).agg(F.sum("df").alias("df")).where("df > 0")
        asked = terms.join(known, key).select("query_id", *key, (F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).alias("w"))
        many, told = queries.count() * (n // BLOCK + 1) > FEW, new_dir(self.spark, "asked")
        if many:  # frequencies are then summed once
            asked.write.parquet(told)
            asked = self.spark.read.schema(asked.schema).parquet(told)
        asked = _if_small(asked)
        blocks = blocks.where("block is not null")

        def gain(tf: str, dl: str) -> Column:
            return F.sum(F.col("w") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(mean or 1.0))))

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        if many:
            found = self._of_blocks(blocks, asked, gone, n, mean, top_k, queries.schema["query_id"])
            return found.withColumn("rank", rank).where(F.col("rank") <= top_k)
        bounds = blocks.select(*key, *place, "most_tf", "least_dl").join(asked, key).groupBy("query_id", *place).agg(gain("most_tf", "least_dl").alias("most"))

        def scored(chosen: DataFrame) -> DataFrame:
            held = blocks.join(chosen.select("query_id", *place).join(asked, "query_id"), [*key, *place])
            held = held.select("query_id", "batch", "w", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
            held = self._left(held.select("query_id", "batch", "w", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")), gone)
            return held.groupBy("query_id", "doc_id").agg(F.round(gain("tf", "dl"), 4).alias("score")).where("score > 0")

        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), *place))
        first = bounds.withColumn("r", best).where(F.col("r") <= max(FIRST, -(-2 * top_k // BLOCK)))
        floor = scored(first).withColumn("r", rank).where(F.col("r") == top_k).select("query_id", F.col("score").alias("floor"))
        hopeful = bounds.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") + SLACK >= F.col("floor")))
        return scored(hopeful).withColumn("rank", rank).where(F.col("rank") <= top_k)

    def _of_blocks(self, blocks: DataFrame, asked: DataFrame, gone: DataFrame, n: int, mean: float, top_k: int, query: StructField) -> DataFrame:
        """(query_id, doc_id, score): the rows of the asked terms meet by block, and tasks keep what may be among the best."""
        key, place, held = ["bucket", "term"], ["batch", "block"], ["ids", "tfs", "dls"]
        parts = max(1, -(-n // (SLICE // 2)), min(TASKS, -(-n // (LEAST // 4))))
        rows = blocks.select(*key, *place, "ids", F.col("tfs").cast("array<int>").alias("tfs"), F.col("dls").cast("array<int>").alias("dls"))
        asks = asked.groupBy(*key).agg(F.collect_list("query_id").alias("queries"), F.collect_list("w").alias("weights"))
        few = asked.limit(SMALL + 1).count() <= SMALL
        # What is broadcast joins after the shuffle, which then carries the postings alone.
        rows = rows.repartition(parts, *place).join(F.broadcast(asks), key) if few else rows.join(asks, key).repartition(parts, *place)
        hidden = None
        if gone.limit(SMALL + 1).count() <= SMALL:
            told = gone.where("doc_id is not null").orderBy("doc_id").toArrow()
            hidden = told["doc_id"].to_numpy(), told["upto"].to_numpy()
        schema = StructType([StructField("query_id", query.dataType), StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("batch", IntegerType())])
        pairs = map_arrow(rows.select(*place, *held, "queries", "weights").sortWithinPartitions(*place), _best(mean, top_k, hidden, to_arrow_type(query.dataType)), schema)
        left = pairs.drop("batch") if hidden is not None else self._left(pairs, gone).drop("batch")
        return left.select("query_id", "doc_id", F.round("score", 4).alias("score")).where("score > 0")

    def compact(self, root: str, upto: int | None = None) -> StoredIndex:
        """An index of what is left, of batches up to a number, in one batch of the last one's number below another
        folder; no text is read."""
        new, last = StoredIndex(self.spark, root), max((b for b in self.batches() if upto is None or b <= upto), default=1)
        batches = [b for b in self.batches() if b <= last]
        new._add(self._left(self._table("forward", FORWARD, batches), self._gone(batches)).drop("batch"), last)
        return new

    def follow(self, old: StoredIndex) -> list[int]:
        """Takes over the batches, additions and deletions, that another index got after this one's last; their numbers."""
        own, taken = max(self.batches(), default=0), []
        for batch in (b for b in old.batches() if b > own):
            gone = old._table("gone", GONE).where(F.col("batch") == batch)
            if gone.limit(1).count():
                self.delete(gone.select("doc_id"), batch)
            else:
                self._add(old._table("forward", FORWARD).where(F.col("batch") == batch).drop("batch"), batch)
            taken.append(batch)
        return taken


SWITCHES = "number int, folder string"


def current(spark: SparkSession, base: str) -> StoredIndex:
    """The index that readers and writers of ``base`` use now."""
    told = read_or_empty(spark, f"{base}/switches", SWITCHES).orderBy(F.desc("number")).limit(1).collect()
    return StoredIndex(spark, f"{base}/{told[0]['folder'] if told else 'v0'}")


def reindex(spark: SparkSession, base: str, between=None) -> StoredIndex:
    """Builds the index of ``base`` anew from a snapshot and switches to it.

    Batches that come while it is built are taken over before the switch, and once more after it, for those that
    came between the last look and the switch.  The switch is one small append: it is seen whole or not at all, and
    a build that died before it leaves the old index in use.  ``between`` is called while the build runs (for tests).
    """
    old = current(spark, base)
    number = (read_or_empty(spark, f"{base}/switches", SWITCHES).agg(F.max("number")).first()[0] or 0) + 1
    new = old.compact(f"{base}/v{number}", max(old.batches(), default=0))
    if between is not None:
        between()
    while new.follow(old):
        pass
    spark.createDataFrame([(number, f"v{number}")], SWITCHES).coalesce(1).write.mode("append").parquet(f"{base}/switches")
    new.follow(old)
    return new
