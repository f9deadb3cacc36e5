"""Toxicity scores from nearest labelled examples (operator 2).

A text is a TF-IDF vector over all its lower-cased words.  Indicative terms weigh
more: words, and word beginnings of four and five bytes, that distinct toxic examples
have ``LIFT`` times as often as clean ones, and significantly so (log-likelihood ratio above
twice the logarithm of the number of terms tested), share ``SHARE`` of the squared length
of a text that has any; a text without one has all its length in its words, so copies of
any example are found.  Document frequencies are counted over all documents; a
word that no example has counts as one of a single document, and in the length
alone.  The neighbours are the exact ones by cosine, found in an inverted index with
block maxima.  They vote with weight ``cosine ** 4``; a logistic curve fitted to
leave-one-out votes calibrates the score, and the neighbours' ids are returned as
evidence.

Fitting uses at most ``max_examples`` labelled rows (those with the smallest
hash of the id), with all their words, and ``max_terms`` indicative terms; scoring
covers every row and the whole text.  Learning never sees rows that ``learn_from``
excludes.

Nulls and edges: a null text counts as empty; a text that shares no word with an
example gets the base rate of examples without an indicative term; null
labels and null ids are never learned from; a document labelled more than once
counts as toxic if any of its labels is; equal texts get equal scores; ties
beyond the k-th neighbour are cut by the order of entries; input columns named like
added ones give way to them; an empty table gives no rows.  Without any
labelled row all scores are the smoothed prior of 0.05.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import coded_words, folded_words, map_arrow, room_for, spare_name, table, with_fields

MAX_EXAMPLES, MAX_TERMS, NEIGHBOURS, POWER = 12_000, 4_096, 15, 4
BLOCK, HEADS, QUERIES = 8, 128, 64  # entries of a block, lists kept in blocks, queries bounded at once
SHARE, LIFT = 0.9, 3  # indicative terms' part of the squared length; how many times as often toxic examples hold one
FLUSH = 200_000  # distinct terms that a task counts before it hands them on
THRESHOLD = 0.3


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """Features of a word: itself and its beginnings, marked by a caret."""
    return (word, *(b"^" + word[:n] for n in (4, 5) if len(word) > n))


def doc_terms(text: str) -> set[bytes]:
    return {t for w in set(folded_words(text)) for t in terms_of(w)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> partial document counts by term; the empty term counts documents."""
    toxic, clean = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(doc_terms(text.as_py() or "") | {b""})
            if len(toxic) + len(clean) > FLUSH:
                yield flush()
    yield flush()


class Vectors:
    """Sparse rows: row r has ``terms`` and ``values`` from ``starts[r]`` to ``starts[r + 1]``, by rising term."""

    __slots__ = ("starts", "terms", "values")

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.starts, self.terms, self.values = starts, terms, values

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[r], self.starts[r + 1])
        return self.terms[own], self.values[own]

    def rows(self) -> np.ndarray:
        """The row of every term."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Vectors:
        starts = np.cumsum([0, *(len(t) for t, _ in rows)], dtype=np.int64)
        return cls(starts, np.concatenate([t for t, _ in rows] or [np.empty(0, np.int32)]), np.concatenate([v for _, v in rows] or [np.empty(0)]))


class Features:
    """Maps texts to counts of numbered terms: every word of the examples, then the indicative terms."""

    def __init__(self, words: list[bytes], indicative: list[bytes]):
        self.words, self.told = words, indicative
        self.ids = {w: i for i, w in enumerate(words)}
        self.n = len(words) + len(indicative)
        number = {t: len(words) + i for i, t in enumerate(indicative)}
        self.whole = {t: i for t, i in number.items() if t[:1] != b"^"}
        self.beginnings = {n: {t[1:]: i for t, i in number.items() if t[:1] == b"^" and len(t) == n + 1} for n in (4, 5)}

    def __reduce__(self):
        return _features, (b" ".join(self.words), b" ".join(self.told))  # no term holds a space

    def counts(self, texts: list[str]) -> tuple[Vectors, np.ndarray]:
        """Counts of the known terms, and by text the sum of ``(1 + log(count)) ** 2`` over words that no example has."""
        text, code, distinct = coded_words(texts)
        size = max(len(distinct), 1)
        key, n = np.unique(text * size + code, return_counts=True)
        text, code = key // size, key % size
        ids = np.fromiter(map(self.ids.get, distinct, repeat(-1)), np.int64, len(distinct))[code] if len(distinct) else code
        new = ids < 0
        unseen = np.bincount(text[new], (1 + np.log(n[new])) ** 2, len(texts)).astype(float)
        parts = [(text[~new], ids[~new], n[~new])]
        told = [np.fromiter(map(self.whole.get, distinct, repeat(-1)), np.int64, len(distinct))] if self.whole else []
        told += [np.array([known.get(w[:k], -1) if len(w) > k else -1 for w in distinct], np.int64) for k, known in self.beginnings.items() if known]
        parts += [(text[has], t[code[has]], n[has]) for t in told if len(distinct) for has in [t[code] >= 0]]
        text, ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, place = np.unique(text * max(self.n, 1) + ids, return_inverse=True)
        total = np.bincount(place, n, len(key)).astype(np.int32)
        starts = np.searchsorted(key // max(self.n, 1), np.arange(len(texts) + 1))
        return Vectors(starts, (key % max(self.n, 1)).astype(np.int32), total), unseen


def _features(words: bytes, indicative: bytes) -> Features:
    return Features(words.split(b" ") if words else [], indicative.split(b" ") if indicative else [])


class BlockMaxIndex:
    """An inverted index of entries (rows without negative weights) for exact searches by cosine.

    Entries stand by their number of terms, so that those of a block weigh their terms
    alike.  The ``HEADS`` longest lists are cut into blocks of ``BLOCK`` entries with the
    block's largest weight.  A search adds up the short lists of a query's terms and bounds
    the rest by the block maxima; the best entries of the blocks with the highest sums so far
    are scored in full and give a threshold, and of all others only blocks whose bound reaches
    it are.  Entries have weights of single precision; sums are of double precision, and bounds
    have room for their rounding."""

    ERROR = 1e-5

    def __init__(self, entries: Vectors, block: int = BLOCK, heads: int = HEADS):
        self.entries, self.block, self.heads, self.ready = Vectors(entries.starts, entries.terms, entries.values.astype(np.float32)), block, heads, False

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "block": self.block, "heads": self.heads, "ready": False}

    def prepare(self, keep: bool = True) -> None:
        """Builds what is not shipped to workers: the lists, which may take the entries' place."""
        own, lengths = self.entries, np.diff(self.entries.starts)
        n = len(own)
        blocks = max(1, -(-n // self.block))
        # Of the entries by length, each ``block`` make a block; its first ones stand first, then all second ones, and so on.
        self.order = np.full(blocks * self.block, -1)
        rank = np.arange(n)
        place = np.empty(n, np.int32)
        place[np.argsort(lengths, kind="stable")] = rank % self.block * blocks + rank // self.block
        self.order[place] = rank
        size = int(own.terms.max()) + 1 if len(own.terms) else 0
        often = np.bincount(own.terms, minlength=size)
        longest = np.argsort(-often, kind="stable")[: self.heads]
        self.column = np.full(size, -1, np.int32)
        self.column[longest] = np.arange(len(longest))
        owner = np.repeat(place, lengths)
        long = np.flatnonzero(self.column[own.terms] >= 0)
        self.long = np.zeros((blocks * self.block, len(longest)), np.float32)
        self.long[owner[long], self.column[own.terms[long]]] = own.values[long]
        self.maxima = np.ascontiguousarray(self.long.reshape(self.block, blocks, -1).max(axis=0).T)
        del long
        short = np.flatnonzero(self.column[own.terms] < 0).astype(np.int32)
        short = short[np.argsort(own.terms[short], kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.where(self.column < 0, often, 0), dtype=np.int64)])
        pairs = np.empty((len(short), 2), np.int32)
        pairs[:, 0], pairs[:, 1] = owner[short], own.values[short].view(np.int32)
        self.lists = pairs.view(np.int64).ravel()  # owner and bits of the weight, which are copied as one
        if not keep:
            self.entries = Vectors.of([])
        self.ready = True

    def top(self, queries: Vectors, k: int) -> list[list[tuple[float, int]]]:
        """For each query the k entries of highest positive cosine, by falling cosine, then entry number: exact."""
        if not self.ready:
            self.prepare()
        out: list[list[tuple[float, int]]] = []
        for i in range(0, len(queries), QUERIES):
            own = [(t[known], w[known]) for t, w in map(queries.row, range(i, min(i + QUERIES, len(queries)))) for known in [t < len(self.column)]]
            heads = np.zeros((len(own), len(self.maxima)))
            for row, (t, w) in zip(heads, own, strict=True):
                at = self.column[t]
                row[at[at >= 0]] = w[at >= 0]
            bounds = heads.astype(np.float32) @ self.maxima
            out += [self._best(t, w, q, bound, k) for (t, w), q, bound in zip(own, heads, bounds, strict=True)]
        return out

    def _best(self, terms: np.ndarray, weights: np.ndarray, heads: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[float, int]]:
        short = self.column[terms] < 0
        t, w = terms[short], weights[short]
        starts, ends = self.first[t], self.first[t + 1]
        sums = np.zeros(len(self.long))
        if len(t):
            found = np.concatenate([self.lists[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            sums = np.bincount(found.view(np.int32)[::2], np.repeat(w, ends - starts) * found.view(np.float32)[1::2], len(self.long))
        by_block = sums.reshape(self.block, -1)
        highest = by_block.max(axis=0)
        least, tried = 0.0, 2 * k + 2
        if len(highest) > tried:
            blocks = np.argpartition(highest, len(highest) - tried)[len(highest) - tried :]
            first = by_block[:, blocks].argmax(axis=0) * len(highest) + blocks
            least = float(np.partition(sums[first] + self.long[first] @ heads, tried - k)[tried - k]) - self.ERROR
        most = highest + bound
        blocks = np.flatnonzero((most > 0) & (most >= least))
        slot, at = np.nonzero(by_block[:, blocks] + bound[blocks] >= least)
        found = slot * len(highest) + blocks[at]
        scores = sums[found] + self.long[found] @ heads
        if len(found) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - self.ERROR
            found, scores = found[near], scores[near]
        best = sorted((-round(s, 12), e) for s, e in zip(scores[scores > 0].tolist(), self.order[found[scores > 0]].tolist(), strict=True))[:k]
        return [(-s, e) for s, e in best]


class Model:
    def __init__(self, features: Features, idf: np.ndarray, unseen: float, entries: Vectors, ids: list[int], n: list[int], toxic: list[int], base: tuple[int, int]):
        """``entries``: distinct unit vectors of the examples, with the smallest example id, the number
        of examples and of toxic ones; ``base``: examples, and toxic ones, without an indicative term."""
        self.features, self.idf, self.unseen, self.ids = features, idf, unseen, ids
        self.n, self.toxic = n, toxic
        self.index = BlockMaxIndex(entries)
        self.base = (base[1] + 0.5) / (base[0] + 10)
        self.curve = (1.0, 0.0)

    def vectors(self, texts: list[str]) -> Vectors:
        return unit_vectors(*self.features.counts(texts), self.idf, self.unseen, len(self.features.words))

    def vote(self, top: list[tuple[float, int]], without: tuple[int, int] | None = None) -> tuple[float, list[int]]:
        """Share of distance-weighted votes for toxic; ``without`` takes one example of an entry out."""
        total, yes = 1.0, self.base
        for cosine, e in top:
            n, y = self.n[e], self.toxic[e]
            if without and e == without[0]:
                n, y = n - 1, y - without[1]
            total += n * cosine**POWER
            yes += y * cosine**POWER
        return yes / total, [self.ids[e] for _, e in top]

    def left_out(self, first: int, end: int) -> list[tuple[float, int, int]]:
        """(logit of the vote, label, examples) of the entries in a range, each by the votes of all others."""
        out, index = [], self.index
        starts = index.entries.starts
        own = Vectors(starts[first : end + 1] - starts[first], index.entries.terms[starts[first] : starts[end]], index.entries.values[starts[first] : starts[end]])
        for e, top in zip(range(first, end), index.top(own, NEIGHBOURS), strict=True):
            out += [(_logit(self.vote(top, (e, label))[0]), label, n) for label, n in ((1, self.toxic[e]), (0, self.n[e] - self.toxic[e])) if n]
        return out

    def calibrate(self, spark: SparkSession) -> None:
        """Platt scaling of leave-one-out votes, which the workers count, by Newton steps with a little shrinkage."""
        n = len(self.index.entries)
        if not n:
            return
        features, self.features = self.features, None  # votes need the index alone
        shipped, step = spark.sparkContext.broadcast(self), 256
        self.features = features

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    found = shipped.value.left_out(first, min(first + step, n))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), (pa.float64(), pa.int32(), pa.int64()), strict=True)], names=["vote", "label", "n"])

        parts = max(1, min(spark.sparkContext.defaultParallelism, -(-n // step)))
        got = map_arrow(spark.range(0, n, step, parts), votes, "vote double, label int, n long").groupBy("vote", "label").agg(F.sum("n").alias("n")).orderBy("vote", "label").toArrow()
        shipped.unpersist()
        x, y, w = (got.column(i).to_numpy().astype(float) for i in range(3))
        X = np.stack([x, np.ones(len(x))], 1)
        beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
            grad = X.T @ (w * (p - y)) + (beta - prior)
            hess = (X * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ X + np.eye(2)
            move = np.linalg.solve(hess, grad)
            beta -= np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-9:
                break
        if beta[0] > 0:
            self.curve = (float(beta[0]), float(beta[1]))

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        out = []
        a, b = self.curve
        if not self.index.ready:
            self.index.prepare(keep=False)
        for top in self.index.top(self.vectors(texts), NEIGHBOURS):
            raw, ids = self.vote(top)
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, a * _logit(raw) + b)))), ids) if top else (self.base, []))
        return out


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def unit_vectors(counts: Vectors, unseen: np.ndarray, idf: np.ndarray, unseen_idf: float, words: int) -> Vectors:
    """Weights from counts.  A text's words share ``1 - SHARE`` of its squared length and its
    indicative terms the rest; without such terms, the words have all of it.  Words of
    no example count in the length alone, since no entry holds them."""
    row, told = counts.rows(), counts.terms >= words
    raw = (1 + np.log(counts.values)) * idf[counts.terms]
    square = [np.bincount(row[part], raw[part] ** 2, len(counts)).astype(float) for part in (~told, told)]
    square[0] += unseen * unseen_idf**2
    share = [np.where(square[1] > 0, 1 - SHARE, 1.0), SHARE]
    own, telling = (np.sqrt(s / np.where(q > 0, q, 1.0)) for s, q in zip(share, square, strict=True))
    return Vectors(counts.starts, counts.terms, raw * np.where(told, telling[row], own[row]))


def _idf(total: int, df: np.ndarray | float):
    """Inverse document frequency; the little that every term has keeps texts of nothing but common words apart from empty ones."""
    return np.log((1 + total) / (1 + df)) + 0.01


def _indicative(counts: DataFrame, max_terms: int) -> list[bytes]:
    """Terms whose toxic document count is raised beyond chance, at most ``max_terms``, most telling first."""
    docs = counts.where(F.length("term") == 0).agg(F.sum("toxic"), F.sum("clean"), F.lit(0)).first()
    p, n = float(docs[0] or 0), float(docs[1] or 0)
    if not p:
        return []
    tested = counts.count()
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    share = (a + b) / (p + n)
    g = 2 * (part(a, share * p) + part(b, share * n) + part(p - a, (1 - share) * p) + part(n - b, (1 - share) * n))
    kept = counts.where((F.length("term") > 0) & (a >= 2) & (a * n >= LIFT * b * p)).select("term", g.alias("g")).where(F.col("g") >= 2 * math.log(max(tested, 2)))
    return [bytes(r[0]) for r in kept.orderBy(F.desc("g"), "term").limit(max_terms).collect()]


def _pieces(texts: pa.Array, most: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in lists of no more than ``most`` characters, or of one text."""
    held, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def fit(documents: DataFrame, labels: DataFrame, *, learn_from: Column, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """``documents`` (doc_id, text), ``labels`` (doc_id, toxic); ``learn_from`` is a condition on doc_id."""
    spark, documents = documents.sparkSession, documents.select("doc_id", "text")
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn_from).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = documents.join(F.broadcast(chosen), "doc_id")  # ids and labels of max_examples rows at most
    distinct = examples.groupBy("text").agg(F.max("toxic").alias("toxic"))  # else the words of a text with many copies would all seem telling
    counts = map_arrow(distinct, _count_terms, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).cache()
    try:
        indicative = _indicative(counts, max_terms)
        words = sorted(counts.where((F.length("term") > 0) & (F.substring("term", 1, 1) != F.lit(b"^"))).select("term").toArrow().column(0).to_pylist())
    finally:
        counts.unpersist()
    features = Features(words, indicative)
    shipped = spark.sparkContext.broadcast(features)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shipped.value
        df, n = np.zeros(features.n, np.int64), 0
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                df += np.bincount(features.counts(texts)[0].terms, minlength=features.n)
                n += len(texts)
        found = np.flatnonzero(df).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, np.int32(-1))), pa.array(np.append(df[found], n))], names=["term", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own.row(r) for texts in _pieces(batch.column(2)) for own, _ in [shipped.value.counts(texts)] for r in range(len(own))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], names=["doc_id", "toxic", "terms", "counts"])

    df, total = np.zeros(features.n), 0
    got = map_arrow(documents.select("text"), frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = (got.column(i).to_numpy() for i in (0, 1))
    df[at[at >= 0]], total = n[at >= 0], int(n[at < 0].sum())
    idf, unseen = _idf(total, df), float(_idf(total, min(1, total)))
    rows = map_arrow(examples.select("doc_id", "toxic", "text"), counted, "doc_id long, toxic int, terms binary, counts binary").toArrow()
    shipped.unpersist()
    base = [0, 0]
    entries: dict[tuple[bytes, bytes], list[int]] = {}
    for doc, toxic, terms, own in sorted(zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True)):
        last = int(np.frombuffer(terms, np.int32)[-1]) if terms else -1
        if last < len(words):
            base = [base[0] + 1, base[1] + toxic]
        if terms:
            e = entries.setdefault((terms, own), [doc, 0, 0])
            e[1] += 1
            e[2] += toxic
    del rows
    found = Vectors.of([(np.frombuffer(t, np.int32), np.frombuffer(c, np.int32)) for t, c in entries])
    told = list(entries.values())
    del entries
    model = Model(features, idf, unseen, unit_vectors(found, np.zeros(len(found)), idf, unseen, len(words)), *([e[i] for e in told] for i in range(3)), (base[0], base[1]))
    model.calibrate(spark)
    return model


def score(spark: SparkSession, documents: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) plus ``score``, ``predicted`` and ``evidence``
    (ids of the nearest examples).  One pass without a shuffle; the model, bounded by
    the texts of ``max_examples``, is broadcast."""
    added = "score double, predicted int, evidence array<long>"
    keep = room_for([c for c in documents.columns if c != text] if keep is None else keep, added)
    shipped = spark.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)
    schema = with_fields(documents.select(*keep).schema, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [g for texts in _pieces(batch.column(at)) for g in shipped.value.scores(texts)]
            values = [s for s, _ in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.float64()), pa.array([int(s >= THRESHOLD) for s in values], pa.int32()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=schema.names)

    return map_arrow(documents.select(*keep, *[documents[text].alias(spare_name(keep))] * (at == len(keep))), run, schema)


def in_fold(c: Column | str = "doc_id") -> Column:
    """True for rows that are held out: crc32 of the id as text leaves 2 modulo 4."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"), learn_from=~in_fold())
    return score(spark, documents, model).select("doc_id", in_fold().alias("held_out"), "score", "predicted", "evidence")
