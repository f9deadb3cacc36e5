import hashlib
import random
from collections import Counter

import numpy as np

from docmill.llm.fingerprint import _ADD, _MULTIPLY, HASHES, WordHashes, edited, fingerprints, likeness, numbered_kmers, signature, units

H = WordHashes()


MASK = 2**64 - 1
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x):
    """splitmix64's finaliser on Python integers."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_kmers(words):
    """Hashes of numbered pairs of words, one at a time."""
    seen, out = Counter(), []
    for pair in zip(words, words[1:]) if len(words) > 1 else [tuple(words)]:
        h = 0
        for w in pair:
            h = mixed((h + int(H[w]) + GOLDEN) & MASK)
        out.append(mixed(h ^ (seen[pair] * GOLDEN & MASK)))
        seen[pair] += 1
    return out


def brute(text):
    """The two least numbered k-mers of every hash function, in text order."""
    h = plain_kmers(text.split())
    out = []
    for i in range(HASHES):
        least = sorted(((int(_MULTIPLY[i]) * (x >> 32) + int(_ADD[i])) % 2**32, p) for p, x in enumerate(h))[:2]
        out.append(tuple(h[p] for p in sorted(p for _, p in least)))
    return out


def test_signatures_are_ordered_minima():
    text = " ".join(str(k % 997) for k in range(5000))
    cut = text[:9000]
    same = np.array([x == y for x, y in zip(brute(text), brute(cut), strict=True)])
    assert ((signature(text, H) == signature(cut, H)) == same).all() and 0 < same.sum() < HASHES


def test_repeats_are_numbered():
    assert len(set(numbered_kmers("a b " * 50, H).tolist())) == 99


def test_likeness_follows_edit_distance():
    r = random.Random(1)
    words = [str(r.randrange(10**6)) for _ in range(400)]
    own = signature(" ".join(words), H)
    few = words[:]
    few[100:110] = ["x"] * 10
    half = words[:200] + [str(r.randrange(10**6)) for _ in range(200)]
    turned = words[::-1]
    like = [likeness(own, signature(" ".join(w), H)) for w in (words, few, half, turned)]
    assert like[0] == 1 and like[1] > 0.85 and 0.3 < like[2] < 0.7 and like[3] < 0.2


def test_rows_follow_ids(spark):
    r = random.Random(2)
    rows = [(i * 3, " ".join(str(r.randrange(300)) for _ in range(r.randrange(80))) + "é👍") for i in range(300)]
    rows += [(None, "null id"), (7, None), (7, "b"), (7, "b"), (100_000, "y" * 100_000)]
    r.shuffle(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = edited(t, nxt)
        s = [signature(x, H) for x in (t, e, nxt)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), s[0].tobytes().hex(), s[1].tobytes().hex(), likeness(s[0], s[1]), likeness(s[0], s[2])))
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, fingerprint string").repartition(5)
    key = lambda x: repr(x)
    for ranges in (1, 3, 40):
        assert sorted((tuple(x) for x in fingerprints(spark, df, ranges=ranges).collect()), key=key) == sorted(want, key=key)
    assert fingerprints(spark, df.limit(0)).count() == 0
    (single,) = fingerprints(spark, df.where("doc_id = 0")).collect()
    assert single.near_next == 1


def test_texts_without_spaces_follow_edit_distance():
    r = random.Random(6)
    for make in (lambda: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(2000)), lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))):
        text, other = make(), make()
        own = signature(text, H)
        like = [likeness(own, signature(t, H)) for t in ("\u4e00" + text, text[:900] + text[905:], edited(text, other), other)]
        assert like[0] > 0.95 and like[1] > 0.9 and 0.3 < like[2] < 0.7 and like[3] < 0.2
        assert "".join(units(text)) == text and max(map(len, units(text))) <= 32
    assert units("y" * 100) in (["y" * 32] * 3 + ["y" * 4], ["y"] * 100)
