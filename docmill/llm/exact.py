"""Exact deduplication by counting quotient filters (operator 12).

Texts are equal if they are identical after lower-casing A-Z only.  Of equal texts, the
row with the largest id stays.

1. Every normalised text has a fingerprint of 64 bits.  A task enters the fingerprints of
   its rows into counting quotient filters: the leading bits of a fingerprint name the
   filter's segment, the next ones its quotient; the remainder stands in the sorted run
   of its quotient, beside how often it was seen.
2. Filters of a segment from all tasks are merged.  A filter gives its fingerprints back
   whole and in order, so the merge is that of sorted remainders with counts summed, and
   loses nothing.  A text that fills a third of the table is one slot in each filter.
3. Rows whose fingerprint counts more than one are written with their normalised text,
   the others without.  The written texts are compared by their bytes: grouped by
   fingerprint and text, combined before the shuffle.  Texts that share a fingerprint by
   chance fall apart here.
4. Groups go back to their rows by fingerprint and SHA-256; those of so many rows that
   there can be only 100,000 of them are broadcast, so no key brings many rows to a task.

Result: one row per row of the input: ``doc_id``, ``keep_id`` (id of the row that stays),
``group_size`` (rows with an equal text), ``kept``, ``text_sha256`` (lower-case hex of
the normalised text in UTF-8).

Edges: a null text counts as empty, and all empty texts are equal; a null id is smaller
than any other, so such a row stays only where all rows of its text have null ids; of rows that
repeat both text and largest id exactly one stays; texts are compared whole, of any
length; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import HUB, HUBS, grouped, map_arrow, materialize, table

BITS = 64
SEGMENTS, SEGMENT_ROWS = 64, 1_000_000  # least number of segments; rows of the table for each beyond that
HELD = 1_000_000  # fingerprints that a task holds before it hands filters on
BROADCAST_ROWS = 1_000_000  # repeated fingerprints (a long each) that may be broadcast; beyond it the join shuffles

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEAD = struct.Struct("<BBQQ")


def normalised(text: str | Column) -> Column:
    """The text with A-Z lower-cased; null is empty.  ``lower`` is the faster way, and the same for ASCII alone."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = -(-n // 8)
    return np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n, bitorder="little").astype(bool), at + size


def _slot(bits: int) -> np.dtype:
    return np.dtype("<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8")


def build(values: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A filter of distinct ascending values of ``width`` bits (uint64) and their counts.

    Quotients have as many bits as give each value a slot.  Stored are which quotients
    occur, where a quotient's run of remainders ends, the remainders, and counts above one.
    """
    n = len(values)
    q = min(width, max(0, int(n - 1).bit_length()))
    r = width - q
    quotients = values >> np.uint64(r) if r < 64 else np.zeros(n, np.uint64)
    remainders = values & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotients.astype(np.int64)] = True
    ends = np.append(quotients[1:] != quotients[:-1], True)[:n]
    many = counts > 1
    return b"".join([_HEAD.pack(width, q, n, int(many.sum())), _bits(occupied), _bits(ends), remainders.astype(_slot(r)).tobytes(), _bits(many), counts[many].astype("<i8").tobytes()])


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values of a filter, ascending, and their counts."""
    width, q, n, repeated = _HEAD.unpack_from(data)
    occupied, at = _flags(data, _HEAD.size, 1 << q)
    ends, at = _flags(data, at, n)
    kind = _slot(width - q)
    remainders = np.frombuffer(data, kind, n, at).astype(np.uint64)
    many, at = _flags(data, at + n * kind.itemsize, n)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<i8", repeated, at)
    run = np.cumsum(ends) - ends  # number of the run that a slot stands in
    quotients = np.flatnonzero(occupied).astype(np.uint64)[run]
    return (quotients << np.uint64(width - q) if width - q < 64 else np.zeros(n, np.uint64)) | remainders, counts


def merged(filters: list[bytes], width: int) -> bytes:
    """One filter of all entries: runs of sorted remainders are merged, counts of equal ones add up."""
    parts = [entries(f) for f in filters]
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")  # merges the sorted runs
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return build(values[first], np.add.reduceat(counts, first) if len(first) else counts, width)


def _filtered(segment_bits: int):
    width = BITS - segment_bits

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        segments = (values >> np.uint64(width)).astype(np.int64)
        found, starts = np.unique(segments, return_index=True)
        rest = values & np.uint64((1 << width) - 1)
        filters = [build(rest[a:b], counts[a:b], width) for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(filters, pa.binary())], names=["segment", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _repeated(segment_bits: int):
    width = BITS - segment_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (segment,), rows in grouped(batches, 1):
            values, counts = entries(merged(rows.column(1).to_pylist(), width))
            own = values[counts > 1] | (np.uint64(segment) << np.uint64(width))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts[counts > 1])], names=["fingerprint", "seen"])

    return run


def repeated_fingerprints(spark: SparkSession, fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fingerprint, seen) of those that occur more than once in the one column of ``fingerprints``; written."""
    bits = max(SEGMENTS, -(-rows // SEGMENT_ROWS)) - 1
    bits = bits.bit_length()
    filters = map_arrow(fingerprints, _filtered(bits), "segment long, filter binary")
    dealt = filters.repartition("segment").sortWithinPartitions("segment")
    return materialize(spark, map_arrow(dealt, _repeated(bits), "fingerprint long, seen long"), "repeated")


def duplicates(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fingerprint=F.xxhash64) -> DataFrame:
    """See the module's docstring.  ``fingerprint`` turns the column of texts into one of longs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("text"))
    n = rows.count()
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    repeated = repeated_fingerprints(spark, rows.select("fingerprint"), n)
    hot = F.col("seen") > max(HUB, n // HUBS)
    if repeated.count() <= BROADCAST_ROWS:
        routed = rows.join(F.broadcast(repeated), "fingerprint", "left")
    else:
        # Frequent fingerprints, HUBS at most, are broadcast; the others' rows are few each and meet by a shuffle.
        frequent = rows.join(F.broadcast(repeated.where(hot)), "fingerprint", "left")
        rare = frequent.where("seen is null").drop("seen").join(repeated.where(~hot), "fingerprint", "left")
        routed = rare.unionByName(frequent.where("seen is not null"))
    marked = routed.select(
        "doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("seen").isNotNull(), F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    marked = materialize(spark, marked, "marked")

    # The bytes decide; the written row numbers tell rows apart that repeat text and id.
    top = F.max(F.struct("doc_id", "row")).alias("top")
    groups = marked.where("text is not null").groupBy("fingerprint", "text").agg(top, F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select("fingerprint", F.sha2("text", 256).alias("text_sha256"), "top", "group_size")
    groups = materialize(spark, groups, "groups")
    large, key = F.col("group_size") > max(HUB, n // HUBS), ["fingerprint", "text_sha256"]
    narrow = marked.drop("text")
    found = narrow.join(F.broadcast(groups.where(large)), key, "left")
    out = found.where("top is null").select(*narrow.columns).join(groups.where(~large), key, "left").unionByName(found.where("top is not null"))
    alone = F.col("top").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark, table(spark, sf_dir, "documents"))
