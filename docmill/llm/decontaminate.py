"""Benchmark decontamination by greedy string tiling (operator 9).

Texts and benchmark items are folded words.  Every five-word window of an item
is a seed; a document whose windows hit an item's seeds is a candidate if those
seeds cover enough of the item.  Candidates are tiled: the longest common runs of
words, found by running Karp-Rabin hashes over both sides, are marked first, then
shorter ones and what is left of longer ones, down to five words, each word at most
once.  A document is contaminated by an item if tiles cover at least half of the
item's words, in whatever order its passages stand.

The benchmark is read in blocks of bounded size; each block is broadcast and all
documents pass it, row by row.

Edges: null texts count as empty; an item of fewer than five words matches where it
stands as a whole, and one without a word never; repeated items and documents each get their
own result; items without a text are left out; one without an id is searched, but not
listed in ``items``; an empty benchmark leaves all
documents clean; input columns named like added ones give way to them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import folded_words, map_arrow, materialize, mix64, room_for, table, with_fields

SEED, COVERAGE, BLOCK_BYTES = 5, 0.5, 16_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:  # by doubling
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[: min(done, n - done)] * step
            done *= 2
    return out


class Rolling:
    """Karp-Rabin hashes of any window of a word sequence from one running sum modulo 2^64."""

    def __init__(self, words: np.ndarray):
        """``words``: word numbers from 1; 0 stands for a word that no item has."""
        self.words, n = words, len(words)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words.astype(np.uint64)) * _powers(_BASE, n), dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, n)

    def windows(self, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        starts = np.arange(max(0, len(self.words) - length + 1)) if starts is None else starts
        with np.errstate(over="ignore"):
            return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _runs(item: np.ndarray, text: Rolling, starts: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, item position, text position) of all common runs that can't be made longer."""
    words, m, n = text.words, len(item), len(text.words)
    own = Rolling(item).windows(least)
    order = np.argsort(own, kind="stable")
    own = own[order]
    hashes = text.windows(least, starts)
    first = np.searchsorted(own, hashes)
    count = np.searchsorted(own, hashes, side="right") - first
    ends = np.cumsum(count)
    at = 0
    while at < len(starts):  # some millions of pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, side="right")))
        p, t = order[_ranges(first[at:to], count[at:to])], np.repeat(starts[at:to], count[at:to])
        begins = (p == 0) | (t == 0) | (item[p - 1] != words[t - 1])  # else the run begins further left
        for i, j in zip(p[begins].tolist(), t[begins].tolist(), strict=True):
            most = min(m - i, n - j)
            differ = item[i : i + most] != words[j : j + most]
            run = int(differ.argmax()) if differ.any() else most
            if run >= least:
                yield run, i, j
        at = to


def tiles(item: np.ndarray, text: Rolling, starts: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item against a text: (length, item position, text position).

    ``starts``: text positions at which a window of ``least`` words of the item begins; Karp-Rabin
    hashes find the runs from there.  The longest run goes first, of equally long ones the first in
    item, then text; what earlier tiles leave of a run waits for its turn by its own length.
    """
    heap = [(-run, p, t) for run, p, t in _runs(item, text, starts, least)]
    heapq.heapify(heap)
    used_item, used_text, out = np.zeros(len(item), bool), np.zeros(len(text.words), bool), []
    while heap:
        run, p, t = heapq.heappop(heap)
        run = -run
        used = used_item[p : p + run] | used_text[t : t + run]
        if not used.any():
            used_item[p : p + run] = used_text[t : t + run] = True
            out.append((run, p, t))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], used, [1]])))  # begins and ends of what is free
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i >= least:
                heapq.heappush(heap, (i - j, p + i, t + i))
    return out


class Items:
    """A block of the benchmark with its seeds."""

    def __init__(self, rows: list[tuple[int | None, str]], coverage: float):
        self.coverage, self.vocabulary = coverage, {}
        self.ids, self.items = [], []
        #: Items of fewer words than a seed, by length and hash.
        self.short: dict[int, dict[int, list[tuple[int | None, np.ndarray]]]] = {}
        number = self.vocabulary.setdefault
        for i, text in rows:
            item = np.array([number(w, len(self.vocabulary) + 1) for w in folded_words(text or "")], np.int64)
            if len(item) >= SEED:
                self.ids.append(i)
                self.items.append(item)
            elif len(item):
                self.short.setdefault(len(item), {}).setdefault(int(Rolling(item).windows(len(item))[0]), []).append((i, item))
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        hashes = [Rolling(x).windows(SEED) for x in self.items]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.seeds, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))

    def matches(self, text: str) -> list[tuple[int | None, float]]:
        """(item id, share of the item's words in tiles) of every item over the coverage."""
        get = self.vocabulary.get
        found = folded_words(text)
        words = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        if not words.any():
            return []
        rolling = Rolling(words)
        out = [x for length, known in self.short.items() for x in self._whole(rolling, length, known)]
        unknown = np.concatenate([[0], np.cumsum(words == 0)])
        starts = np.flatnonzero(unknown[SEED:] == unknown[:-SEED])
        if not len(starts) or not len(self.seeds):
            return out
        hashes = rolling.windows(SEED, starts)
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[at] == hashes
        starts, at = starts[hit], at[hit]
        if not len(at):
            return out
        # Items by their distinct seeds in the text: those whose windows can't cover enough go before any tiling.
        seeds = np.unique(at)
        count = self.last[seeds] - self.first[seeds]
        rows = _ranges(self.first[seeds], count)
        owner, seed = self.owner[rows], np.repeat(seeds, count)
        order = np.argsort(owner, kind="stable")
        owner, seed, place = owner[order], seed[order], self.place[rows][order]
        items, begin, n = np.unique(owner, return_index=True, return_counts=True)
        enough = SEED * n >= self.coverage * self.lengths[items]
        for e, i, k in zip(items[enough].tolist(), begin[enough].tolist(), n[enough].tolist(), strict=True):
            item = self.items[e]
            bound = np.zeros(len(item) + 1, np.int64)
            np.add.at(bound, place[i : i + k], 1)
            np.add.at(bound, place[i : i + k] + SEED, -1)
            if (np.cumsum(bound) > 0).sum() < self.coverage * len(item):
                continue
            covered = sum(run for run, _, _ in tiles(item, rolling, starts[np.isin(at, seed[i : i + k])]))
            if covered >= self.coverage * len(item):
                out.append((self.ids[e], covered / len(item)))
        return out

    @staticmethod
    def _whole(text: Rolling, length: int, known: dict[int, list[tuple[int | None, np.ndarray]]]) -> Iterator[tuple[int | None, float]]:
        """Short items that stand in the text as a whole."""
        hashes = text.windows(length)
        for t in np.unique(hashes, return_index=True)[1].tolist() if len(hashes) else ():
            for i, item in known.get(int(hashes[t]), ()):
                if np.array_equal(text.words[t : t + length], item):
                    yield i, 1.0


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (all columns) plus ``contaminated``, ``items`` (ids, ascending) and ``coverage`` (largest, 0 if none).

    A benchmark of one block is broadcast and all documents pass it.  Of several blocks, each has
    a job of its own, which writes the hits by row number; so no more than one is held at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    added = "items array<long>, coverage double"
    own = room_for(docs.columns, added + ", contaminated boolean, row__ long")

    def search(rows: DataFrame, b: int, hits_only: bool) -> tuple[DataFrame, Broadcast]:
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shipped = spark.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1])), coverage))
        at, schema = rows.columns.index(text), with_fields(rows.schema, added)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shipped.value.matches(t.as_py() or "") for t in batch.column(at)]
                if hits_only:
                    kept = [i for i, f in enumerate(found) if f]
                    batch, found = batch.take(pa.array(kept, pa.int64())), [found[i] for i in kept]
                ids = [sorted(i for i, _ in f if i is not None) for f in found]
                shares = [max([0.0, *(c for _, c in f)]) for f in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.float64())], names=schema.names)

        return map_arrow(rows, run, schema), shipped

    if blocks == 1:
        out, _ = search(docs.select(*own), 0, False)
        return out.withColumn("contaminated", F.col("coverage") > 0)
    rows = materialize(spark, docs.select(*own, F.monotonically_increasing_id().alias("row__")), "rows")
    parts = []
    for b in range(blocks):
        found, shipped = search(rows.select("row__", text), b, True)
        parts.append(materialize(spark, found.select("row__", "items", "coverage"), "hits"))
        shipped.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy("row__").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items"), F.max("coverage").alias("coverage"))
    out = rows.join(hits, "row__", "left").drop("row__")
    return out.select(*own, F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")).withColumn("contaminated", F.col("coverage") > 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(spark, docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "items", "coverage")
