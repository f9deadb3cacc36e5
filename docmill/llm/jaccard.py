"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

Two documents are linked if the sets of their five-word shingles (words stand
between white space; a text of fewer words is one shingle) have a Jaccard
similarity of 0.8 or more.

1. Every text gives its number of shingles, a 128-bit key of the shingle set
   and 128 MinHash values.  Equal keys are copies: they form one class, which
   takes part once, with its smallest id and its number of copies.
2. Classes that agree in any of 32 bands of four values share a bucket (a pair
   at the threshold shares none with probability 5e-8).  In a bucket, values are
   compared 32 at a time; a pair is dropped once the posterior probability of
   reaching the threshold, under a uniform prior, is below 1e-7.  Surviving
   pairs are walked breadth first, so a bucket hands on a spanning forest, never
   its pairs.
3. The forests' components hold all true links.  Classes of a component are
   brought together with their shingles; pairs that survive the same pruning are
   verified exactly (on 64-bit shingle hashes) and only counted: each class
   gets its number of linked documents and the root of its linked part.

Buckets and components above a size are cut into blocks and handled by pairs of
blocks, so no task holds an unbounded group; counts of blocks add up and roots of
blocks are joined by another components run.  Nothing is collected to the driver.

Result: one row per document: ``doc_id``, ``class_id`` (smallest id of the
transitively linked group), ``copy_of`` (smallest id with the same shingle set),
``n_links`` (documents linked to this one, copies included), ``n_shingles``.

Edges: null texts count as empty; empty texts have no shingles and are copies of
each other only; rows with a null id are returned without a class and with no
links; rows that repeat an id count as further documents of their text's class;
further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import components, grouped, map_arrow, materialize, mix64, table

WORDS, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, Fraction(4, 5), 32, 4, 32, 1e-7
HASHES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000  # members, and shingles, of a block
BROADCAST_ROWS = 1_000_000  # candidates (two longs each) that may be broadcast; beyond it the join shuffles
_MULTIPLY = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) < 64:
            self[word] = value
        return value


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(a) - words + 1)
    out = np.full(n, min(words, len(a)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(a))):
            out = mix64(out + a[k : k + n])
    return np.unique(out)


def min_hashes(values: np.ndarray) -> np.ndarray:
    """128 MinHash values (upper halves of 64-bit multiply-add hashes)."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 2048):
            out = np.minimum(out, (values[i : i + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return (out >> np.uint64(32)).astype("<u4")


def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After 32, 64, ... compared values: the least number of matches at which the posterior
    probability of the threshold, P(Binomial(n + 1, t) <= matches), is not below the tolerance."""
    out, t = [], float(threshold)
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(signatures: np.ndarray, i: int, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Of ``others``, those whose MinHash values keep the threshold probable against row i."""
    matches = np.zeros(len(others), np.int32)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (signatures[others, part] == signatures[i, part]).sum(axis=1, dtype=np.int32)
        kept = matches >= need
        others, matches = others[kept], matches[kept]
        if not len(others):
            break
    return others


def forest(signatures: np.ndarray, least: list[int]) -> list[list[int]]:
    """Connected parts, of two rows or more, of the graph of surviving pairs, by breadth-first search."""
    left, out = np.arange(len(signatures)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        part = [queue[0]]
        while queue and len(left):
            found = survivors(signatures, queue.pop(), left, least)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                queue += found.tolist()
                part += found.tolist()
        if len(part) > 1:
            out.append(part)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    hashes = WordHashes()
    for batch in batches:
        keys, n, signatures = [], [], []
        for text in batch.column(1):
            values = shingles(text.as_py() or "", hashes)
            keys.append(xxhash.xxh3_128_digest(values.tobytes()))
            n.append(len(values))
            signatures.append(min_hashes(values).tobytes() if len(values) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "key", "n", "signature"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    hashes = WordHashes()
    for batch in batches:
        values = [shingles(t.as_py() or "", hashes) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in values], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], names=["doc_id", "key", "shingles"])


def _bucket_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, i, j, node, signature), sorted by group -> edges to the smallest node of each part."""
    least, a, b = least_matches(), [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for _, rows in grouped(batches, 3):
        if rows.num_rows < 2:
            continue
        ids = rows.column(3).to_numpy()
        signatures = np.frombuffer(b"".join(rows.column(4).to_pylist()), "<u4").reshape(-1, HASHES)
        for part in forest(signatures, least):
            root = int(ids[part].min())
            a += ids[part].tolist()
            b += [root] * len(part)
        if len(a) > 50_000:
            yield flush()
            a, b = [], []
    yield flush()


def verified(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents of every row, and the number of the row of smallest id that its links
    lead to; ``across``: only pairs of different sides count."""
    m, least, threshold = len(ids), least_matches(), THRESHOLD
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.int32)
    links, parent = np.zeros(m, np.int64), list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(m - 1):
        others = np.arange(i + 1, m)
        if across:
            others = others[side[others] != side[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = survivors(signatures, i, others[small * threshold.denominator >= large * threshold.numerator], least)
        if not len(others):
            continue
        own = flat[offsets[i] : offsets[i + 1]]
        mark[own] = 1
        if len(others) * 4 > m - i:
            shared = np.add.reduceat(mark[flat[offsets[i + 1] :]], offsets[i + 1 : m] - offsets[i + 1])[others - i - 1]
        else:
            shared = np.array([int(mark[flat[offsets[j] : offsets[j + 1]]].sum()) for j in others])
        mark[own] = 0
        union = sizes[others] + sizes[i] - shared
        others = others[shared * threshold.denominator >= union * threshold.numerator]
        links[i] += copies[others].sum()
        links[others] += copies[i]
        for j in others.tolist():
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y, key=lambda r: ids[r])] = min(x, y, key=lambda r: ids[r])
    return links, np.array([find(i) for i in range(m)])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, i, j, side, blocks, node, class_id, copies, signature, shingles) -> links, and node and id of the roots."""
    for (_, i, j), rows in grouped(batches, 3):
        nodes, ids, copies = rows.column(5).to_numpy(), rows.column(6).to_numpy(), rows.column(7).to_numpy()
        signatures = np.frombuffer(b"".join(rows.column(8).to_pylist()), "<u4").reshape(-1, HASHES)
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in rows.column(9)]
        links, roots = verified(ids, copies, rows.column(3).to_numpy(), signatures, sets, bool(i != j))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), rows.column(4).combine_chunks(), pa.array(links, pa.int64()), pa.array(nodes[roots]), pa.array(ids[roots])], names=["node", "blocks", "links", "root", "group_id"])


def in_blocks(rows: DataFrame, itself: bool) -> DataFrame:
    """Adds ``i``, ``j``, ``side``: members of a group of several ``blocks`` are dealt by hash and
    copied to each pair of blocks (with ``itself``, also a block with itself)."""
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("side", side)
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("__other", other).where((F.col("blocks") == 1) | (F.col("__other") != F.col("side")) | F.lit(itself))
    return rows.withColumns({"i": F.least("side", "__other"), "j": F.greatest("side", "__other")}).drop("__other")


def similar(spark: SparkSession, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """See the module's docstring; ``docs`` needs ``doc_id`` and the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(spark, map_arrow(docs.where("doc_id is not null"), _signed, "doc_id long, key binary, n long, signature binary"), "signed")
    classes = signed.groupBy("key").agg(F.min(F.struct("doc_id", "n", "signature")).alias("own"), F.count(F.lit(1)).alias("copies"))
    # Ids may repeat over different texts, so classes are told apart by numbers that the written table fixes.
    classes = classes.select("key", F.monotonically_increasing_id().alias("node"), F.col("own.doc_id").alias("class_id"), F.col("own.n").alias("n"), "copies", F.col("own.signature").alias("signature"))
    classes = materialize(spark, classes, "classes")

    # Buckets of two classes or more.
    bucket = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(signature, b * {4 * ROWS} + 1, {4 * ROWS}))))")
    banded = classes.where("n > 0").select("node", bucket.alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = banded.join(shared, "bucket").select("bucket", "node", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = in_blocks(members, False).join(classes.select("node", "signature"), "node")
    members = members.select("bucket", "i", "j", "node", "signature").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = components(spark, map_arrow(members, _bucket_forests, "a long, b long")).select("node", F.col("root").alias("component"))

    # The classes of a component with their shingles, in blocks.
    candidates = materialize(spark, found.join(classes, "node").select("node", "class_id", "key", "n", "copies", "signature", "component"), "candidates")
    wanted = candidates.select(F.col("class_id").alias("doc_id")).distinct()
    if candidates.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = map_arrow(docs.join(wanted, "doc_id", "left_semi"), _shingled, "doc_id long, key binary, shingles binary").drop("doc_id").dropDuplicates(["key"])
    sizes = candidates.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = in_blocks(candidates.join(sizes, "component"), True).join(sets, "key")
    blocks = blocks.select("component", "i", "j", "side", "blocks", "node", "class_id", "copies", "signature", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    linked = materialize(spark, map_arrow(blocks, _block_links, "node long, blocks int, links long, root long, group_id long"), "linked")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"), F.min("group_id").alias("group_id"))
    split = linked.where("blocks > 1")
    if split.limit(1).count():
        # Roots of blocks that share a member are one group; its id is the smallest of theirs.
        whole = materialize(spark, components(spark, split.select(F.col("node").alias("a"), F.col("root").alias("b"))), "whole")
        least = whole.join(links, "node").groupBy("root").agg(F.min("group_id").alias("least"))
        links = links.join(whole.join(least, "root").select("node", "least"), "node", "left").withColumn("group_id", F.coalesce("least", "group_id"))

    told = classes.join(links.select("node", "links", "group_id"), "node", "left").select(
        "key", F.coalesce("group_id", "class_id").alias("class_id"), F.col("class_id").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("n").alias("n_shingles")
    )
    out = signed.select("doc_id", "key").join(told, "key").select("doc_id", "class_id", "copy_of", "n_links", "n_shingles")
    unnamed = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("n_shingles"))
    return out.unionByName(unnamed)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, table(spark, sf_dir, "documents"))
