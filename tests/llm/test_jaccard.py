import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from docmill.llm import jaccard
from docmill.llm.jaccard import WordHashes, forest, least_matches, min_hashes, shingles, similar, survivors


def brute(rows):
    """(class, links) by row number, on true shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent, n = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or ["none"]:
            by[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in (s or ["none"]) for j in by[g] if j > i)
        for j, k in shared.items():
            union = len(s) + len(sets[j]) - k
            if not s or 5 * k >= 4 * union:
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                parent[b] = a
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return Counter((rows[i][0], least[find(i)], n[i]) for i in range(len(rows)))


def near_copies(n, seed=2, words=120, most=7):
    r = random.Random(seed)
    base = [str(r.randrange(5000)) for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, most)):
            w[r.randrange(words)] = str(r.randrange(10**6))
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(str(r.randrange(10**6)) for _ in range(50))) for i in range(40)]
    return rows + [(2000, ""), (2001, None), (2002, " \n"), (3000, "a b"), (3001, "a b"), (3002, "a"), (3003, "w " * 30_000)]


@pytest.mark.parametrize("block", [1024, 30])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(150)
    got = similar(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_repeated_ids_nulls_and_extra_columns(spark):
    one, other = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, one, "k"), (1, one, "k"), (1, other, "k"), (2, other, "k"), (3, "z " * 9, "k")]
    df = spark.createDataFrame([*rows, (None, one, "k")], "doc_id long, text string, class_id string")
    got = similar(spark, df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == Counter([(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0)])
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    assert similar(spark, df.limit(0)).count() == 0


def test_posterior_rule():
    for n, m in zip(range(32, 129, 32), least_matches(), strict=True):
        below = lambda k: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert below(m) >= 1e-7 > below(m - 1)


def test_pruning_keeps_links_and_drops_strangers():
    hashes = WordHashes()
    texts = [t for _, t in near_copies(60) if t]
    sets = [shingles(t, hashes) for t in texts]
    signatures = np.stack([min_hashes(s) for s in sets])
    for i in range(0, 60, 7):
        kept = set(survivors(signatures, i, np.arange(len(sets)), least_matches()).tolist())
        linked = {j for j in range(len(sets)) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert linked <= kept and not kept & set(range(60, 100))
    assert [sorted(p) for p in forest(signatures[:60], least_matches())][0][:1] == [0]
