"""Exact deduplication against plain grouping, and filters against exact counts."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import exact
from docmill.llm.exact import build, duplicates, entries, merged


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[fold(t)].append(d)
    out = Counter()
    for t, ids in by.items():
        ids.sort(key=lambda d: (d is not None, d or 0))
        for i, d in enumerate(ids):
            out[(d, ids[-1], len(ids), i == len(ids) - 1, sha256(t.encode()).hexdigest())] += 1
    return out


def sample():
    rows = [(i, f"Text number {i % 37} of ÄÖÜ") for i in range(120)] + [(1000 + i, f"text Number {i} of Äöü") for i in range(60)]
    rows += [(2000 + i, "The SAME" if i % 2 else "the same") for i in range(400)]
    rows += [(5, "once"), (5, "once"), (5, "ONCE"), (None, "once"), (None, "nameless"), (None, "Nameless"), (None, None), (3000, ""), (3001, None), (3002, " "), (3003, "ß"), (3004, "SS"), (3005, "É"), (3006, "é"), (3007, "A" * 2_000_000), (3008, "a" * 2_000_000), (-4, "İ"), (-5, "İ")]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize("small", [False, True])
def test_same_as_brute_force(spark, monkeypatch, bits, small):
    """With few bits, different texts share fingerprints; with low bounds, nothing but frequent fingerprints is broadcast."""
    if small:
        monkeypatch.setattr(exact, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(exact, "HUB", 20)
    rows = sample()
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, row int, fingerprint string").repartition(6)
    few = F.xxhash64 if bits == 64 else lambda t: F.shiftleft(F.xxhash64(t) % (1 << bits), 55)
    out = duplicates(spark, df, fingerprint=few)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == brute(rows)


def test_empty_table(spark):
    assert duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("width", [64, 58, 20, 9, 1])
def test_filters_lose_nothing(width):
    r = np.random.default_rng(width)
    parts = [r.integers(0, 1 << min(width, 12 if width < 30 else 63), r.integers(0, 900), dtype=np.uint64) for _ in range(7)]
    parts[3] = np.append(parts[3], np.array([0, (1 << width) - 1, (1 << width) - 1], np.uint64))
    filters = [build(*np.unique(p, return_counts=True), width) for p in parts]
    for p, f in zip(parts, filters, strict=True):
        values, counts = entries(f)
        assert Counter(dict(zip(values.tolist(), counts.tolist(), strict=True))) == Counter(p.tolist())
    values, counts = entries(merged(filters, width))
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())
    assert (np.diff(values.astype(object)) > 0).all()
    # However the filters are merged, the result is the same.
    assert merged([merged(filters[:3], width), merged(filters[3:], width)], width) == merged(filters, width)


def test_filter_is_compact():
    """About the remainder and three bits a slot: 100,000 fingerprints of 40 bits fit in 4 bytes and some each."""
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    assert len(build(values, np.ones(len(values), np.int64), 40)) < 4.6 * len(values)
