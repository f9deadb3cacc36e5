"""Order MinHash fingerprints (operator 8).

A text is a sequence of units: words between white space; words of more than 32
characters and those of scripts without spaces are cut into pieces of some four
characters, where the characters themselves say so.  Its k-mers, pairs of following units, are numbered by occurrence, so
repeats differ.  For each of 96 hash functions the two numbered k-mers of smallest
hash are selected, put back into text order and hashed as a tuple: a value of
the signature.  Equal values need the same k-mers in the same order, so the share
of equal values follows edit distance, not just content.  Two k-mers agree about
as often as the square of the k-mers' Jaccard similarity j; the likeness is the
share of the texts' length that j stands for, 2 j / (1 + j): 1 for equal texts, near
one half when half of a text is replaced, 0 for unrelated ones.

Every text is also held against the text that follows it by ascending id, and
against an edited version of itself whose second half is replaced by the
beginning of the following text.  Ids are cut into ranges at approximate
percentiles; each range is one sorted stretch, and gets a copy of the row that
begins the next range, so all texts are shuffled once and no window spans the table.

Edges: null texts count as empty; a text without units has an empty fingerprint,
alike only to another such; a text of one unit has one k-mer.  Null ids come
before all others; rows that share an id follow each other by text.  A single row
follows itself; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import map_arrow, mix64, table
from docmill.llm.jaccard import WordHashes

HASHES, KMER, TUPLE, PIECE = 96, 2, 2, 32
#: Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint32(0xFFFFFFFF)
_HALF = np.uint64(32)
_MULTIPLY = (mix64(np.arange(5001, HASHES + 5001, dtype=np.uint64) * _GOLDEN) >> _HALF).astype(np.uint32) | np.uint32(1)
_ADD = (mix64(np.arange(7001, HASHES + 7001, dtype=np.uint64) * _GOLDEN) >> _HALF).astype(np.uint32)


def units(text: str) -> list[str]:
    """Words; those of more than ``PIECE`` characters, or of scripts without spaces, are cut where their
    characters say so, so that pieces far from an edit stay as they are."""
    words = text.split()
    if len(text) > PIECE and any(len(w) > PIECE for w in words) or _UNSPACED.search(text):
        words = [u for w in words for u in (_pieces(w) if len(w) > PIECE or _UNSPACED.search(w) else (w,))]
    return words


def _pieces(word: str) -> list[str]:
    """Pieces that begin where the hash of two neighbouring characters is divisible by four, of ``PIECE`` characters at most."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        begins = np.flatnonzero(mix64(codes[1:] * _GOLDEN + codes[:-1]) & np.uint64(3) == 0) + 1
    begins = np.concatenate([[0], begins, [len(codes)]]).tolist()
    return [word[j : min(j + PIECE, end)] for i, end in zip(begins, begins[1:], strict=False) for j in range(i, end, PIECE)]


def numbered_kmers(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in text order."""
    found = units(text)
    if not found:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(a) - KMER + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(KMER, len(a))):
            h = mix64(h + a[k : k + n] + _GOLDEN)
        order = np.argsort(h, kind="stable")
        same = h[order]
        first = np.concatenate([[True], same[1:] != same[:-1]])
        begins = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (np.arange(n) - begins).astype(np.uint64)
        return mix64(h ^ (occurrence * _GOLDEN))


def signature(text: str, hashes: WordHashes) -> np.ndarray:
    """96 values of 32 bits; empty for a text without units."""
    h = numbered_kmers(text, hashes)
    if not len(h):
        return np.empty(0, "<u4")
    short = (h >> _HALF).astype(np.uint32)  # ranks need half of the bits; ties go to the earlier place
    least = np.full((HASHES, TUPLE), _MOST, np.uint32)
    places = np.full((HASHES, TUPLE), len(h), np.int64)
    rows = np.arange(HASHES)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 2048):
            part = short[at : at + 2048]
            values = _MULTIPLY[:, None] * part + _ADD[:, None]
            for _ in range(min(TUPLE, len(part))):
                i = values.argmin(axis=1)
                least = np.column_stack([least, values[rows, i]])
                places = np.column_stack([places, at + i])
                values[rows, i] = _MOST
            keep = np.argsort(least, axis=1, kind="stable")[:, :TUPLE]
            least, places = np.take_along_axis(least, keep, 1), np.take_along_axis(places, keep, 1)
        places.sort(axis=1)
        padded = np.append(h, np.uint64(0))  # a text of fewer k-mers than a tuple has
        out = np.arange(HASHES, dtype=np.uint64)
        for k in range(TUPLE):
            out = mix64(out * _GOLDEN + padded[places[:, k]])
    return (out >> _HALF).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two signatures: the share of equal values, scaled to the share of common text."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    j = float((a == b).mean()) ** (1 / TUPLE)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the following text's beginning, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the rising bounds are below a value, by binary search."""
    if not bounds:
        return F.lit(0)
    n, given = len(bounds), F.array(*map(F.lit, bounds)).cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.element_at(given, F.least(at + step, F.lit(n))) < value), at + step).otherwise(at))


def in_id_order(spark: SparkSession, docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (range, guest, doc_id, text), each range in one partition and in order, ended by the row that follows it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = (docs.agg(F.percentile_approx("doc_id", shares, 20_000)).first()[0] if shares else None) or []
    bounds = sorted(set(bounds))
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(bounds, F.col("doc_id")))
    begins = docs.select("doc_id", own.alias("range")).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("first")).collect()
    begins = sorted((r[0], r[1][1]) for r in begins)  # a row for each range
    before = [(begins[i][1], begins[i - 1][0]) for i in range(len(begins))]
    firsts = F.broadcast(spark.createDataFrame(before, "begin_id long, host int"))
    rows = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["begin_id"]), "left")
    dealt = F.explode(F.filter(F.array(F.struct(own.alias("range"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))), lambda x: x["range"].isNotNull()))
    rows = rows.select(dealt.alias("to"), "doc_id", "text").select("to.range", "to.guest", "doc_id", "text")
    # Each range is a partition by its number, so ranges, which hold about as many rows each, never pile up.
    return rows.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "guest", "doc_id", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    before = None  # (range, doc_id, text, signature) of a row that waits for the one that follows it
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for span, guest, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if guest and (before is None or before[0] != span):
                continue  # a further row with the id that ends this range
            t = text.as_py()
            s = signature(t, hashes)
            if before is not None and before[0] == span:
                _, own_id, own, mine = before
                changed = edited(own, t)
                theirs = signature(changed, hashes)
                for name, value in zip(out, (own_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mine.tobytes().hex(), theirs.tobytes().hex(), likeness(mine, theirs), likeness(mine, s)), strict=True):
                    out[name].append(value)
            before = None if guest else (span, doc_id, t, s)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def fingerprints(spark: SparkSession, docs: DataFrame, *, text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: fingerprints as hex, and likeness to the edited and to the following text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(in_id_order(spark, docs, text, ranges), _pairs, schema)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))
