"""Ranked lexical search against a plain scorer, and its shards against each other."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from docmill.llm import lexical
from docmill.llm.lexical import Best, search, wand

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def corpus(n, seed=5):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 900}"
    docs = [(i, " ".join(word() for _ in range(r.choice([1, 5, 40, 200])))) for i in range(n)]
    docs += [(7, docs[7][1]), (7, "other W1 text"), (None, docs[3][1]), (None, docs[3][1]), (n, ""), (n + 1, None), (n + 2, " .,;\n"), (n + 3, "Ünï-CÖDE Ünï 东京, w1_w2"), (n + 4, "w1 rare " * 40_000)]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 30])))) for i in range(25)]
    return docs, items + [(100, None), (101, ""), (102, "absent"), (103, "Ünï cÖDE 东京"), (None, "w1 W1 w2"), (5, "w3 w4"), (104, "rare w1")]


@pytest.mark.parametrize("shard,window,merged", [(4096, 1024, 256), (16, 4, 3)])
def test_same_as_brute_force(spark, monkeypatch, shard, window, merged):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "MERGED", merged)
    docs, items = corpus(300)
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, term string, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double").repartition(2)
    for k in (5, 50):
        assert Counter(tuple(r) for r in search(spark, rows, asked, k).collect()) == brute(docs, items, k)


def test_all_terms_and_blocks_of_queries(spark, monkeypatch):
    """Queries of more terms than may go to the tasks at once: all terms are kept, and queries searched in blocks."""
    monkeypatch.setattr(lexical, "TERM_BYTES", 700)
    docs, items = corpus(120, seed=6)
    rows, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in search(spark, rows, asked, 10).collect()) == brute(docs, items, 10)


def test_ties_rank_by_id(spark):
    docs = [(i, "same words here") for i in (9, 3, 5, 1, 8)] + [(20 + i, f"else {i}") for i in range(20)]
    found = search(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "same here")], "item_id long, text string"), 3)
    assert [(r["rank"], r.doc_id) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 5)]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(spark, none, some).collect() == []
    assert search(spark, some.toDF("doc_id", "text"), none.toDF("item_id", "text")).collect() == []
    assert search(spark, spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), some).collect() == []
    assert search(spark, none, some).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_documents_below_the_pivot_are_not_scored():
    """A document that holds frequent terms alone is skipped once the heap's threshold is above their bounds."""
    ids, named, best = np.arange(3000), np.ones(3000, bool), Best(2)
    common = (1, np.arange(3000), np.full(3000, 10), 10)
    rare = (100, np.array([5, 6]), np.array([50, 60]), 60)
    offered = []
    offer = best.offer
    best.offer = lambda s, i, n: (offered.extend(i.tolist()), offer(s, i, n))
    wand([common, rare], ids, named, best)
    assert best.scores.tolist() == [6010, 5010] and best.ids.tolist() == [6, 5]
    assert max(offered) < lexical.WINDOW  # later windows hold no list before the pivot
