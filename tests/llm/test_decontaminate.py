import random
import time

import numpy as np

from docmill.llm.decontaminate import Items, Rolling, contaminated, tiles

R = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(R.choice(VOCABULARY) for _ in range(40))) for i in range(12)]


def brute_tiles(a, b, least):
    """Greedy string tiling by trying all pairs of positions, longest first."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for p in range(len(a)):
            for t in range(len(b)):
                k = 0
                while p + k < len(a) and t + k < len(b) and a[p + k] == b[t + k] and not used_a[p + k] and not used_b[t + k]:
                    k += 1
                if k > best:
                    best, found = k, [(p, t)]
                elif k == best and k >= least:
                    found.append((p, t))
        if not found:
            return total
        for p, t in found:
            if not any(used_a[p : p + best]) and not any(used_b[t : t + best]):
                used_a[p : p + best] = used_b[t : t + best] = [True] * best
                total += best


def test_tilings_cover_like_brute_force():
    r = random.Random(9)
    for _ in range(150):
        item = [r.randrange(1, 6) for _ in range(r.randrange(5, 25))]
        text = [r.randrange(0, 6) for _ in range(r.randrange(5, 60))]
        at = r.randrange(len(text))
        text[at:at] = item[: r.randrange(len(item))]
        windows = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        starts = np.array([t for t in range(len(text) - 4) if tuple(text[t : t + 5]) in windows], np.int64)
        got = tiles(np.array(item), Rolling(np.array(text)), starts)
        assert all(item[p : p + n] == text[t : t + n] for n, p, t in got)
        covered = [x for n, p, _ in got for x in range(p, p + n)]
        assert len(covered) == len(set(covered))
        assert sum(n for n, _, _ in got) == brute_tiles(item, text, 5)


def test_passages_in_any_order():
    block, words = Items(ITEMS, 0.5), ITEMS[3][1].split()
    other = " ".join(random.Random(1).choice(VOCABULARY) for _ in range(60))
    assert block.matches(f"{other} {ITEMS[3][1]} {other}") == [(3, 1.0)]
    assert block.matches(f"{other} {' '.join(words[20:])}. {other} {' '.join(words[:20]).upper()}!")[0] == (3, 1.0)
    assert block.matches(f"{other} {' '.join(words[:22])}")[0][1] == 22 / 40
    assert block.matches(f"{other} {' '.join(words[:15])} {other}") == [] and block.matches(other) == [] and block.matches("") == []


def test_rows_and_blocks(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50_000), (4, f"{ITEMS[0][1]} {ITEMS[5][1]}"), (4, f"{ITEMS[0][1]} {ITEMS[5][1]}"), (None, ITEMS[7][1])]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([*ITEMS, (90, None), (None, "a b c d e f g"), (91, "too short")], "item_id long, text string")
    want = [(1, [], 0.0), (2, [], 0.0), (3, [], 0.0), (4, [0, 5], 1.0), (4, [0, 5], 1.0), (None, [7], 1.0)]
    for size in (16_000_000, 300):  # one block, and several
        got = sorted(contaminated(spark, docs, bench, block_bytes=size).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        assert [(r.doc_id, r["items"], r.coverage) for r in got] == want and [r.contaminated for r in got] == [bool(w[1]) for w in want]
    assert contaminated(spark, docs, bench.limit(0)).where("contaminated").count() == 0
    assert contaminated(spark, docs.limit(0), bench).count() == 0


def test_items_without_an_id_count(spark):
    words = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "nothing of it"), (3, f"{words} and {ITEMS[3][1]}")], "doc_id long, text string")
    bench = spark.createDataFrame([*ITEMS, (None, words)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"], r.coverage) for r in contaminated(spark, docs, bench).collect()}
    assert got == {1: (True, [], 1.0), 2: (False, [], 0.0), 3: (True, [3], 1.0)}


def test_verdicts_equal_brute_force():
    """Whole documents against a benchmark of items that share passages, are short, or repeat one word."""
    r = random.Random(12)
    words = [f"v{i}" for i in range(60)]
    phrase = " ".join(r.choice(words) for _ in range(8))
    items = [(i, " ".join([phrase] * (i % 2) + [r.choice(words) for _ in range(r.randrange(1, 30))])) for i in range(40)] + [(40, "same " * 20), (41, "v1 v2"), (42, "v3 v3 v3")]
    block = Items(items, 0.5)
    for _ in range(60):
        text = [r.choice(words + ["x", "same"]) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(4)):
            own, at = r.choice(items)[1].split(), r.randrange(len(text) + 1)
            begin = r.randrange(len(own))
            text[at:at] = own[begin : begin + r.randrange(1, 25)]
        want = []
        for i, item in items:
            item = item.split()
            if len(item) < 5:
                if any(text[t : t + len(item)] == item for t in range(len(text))):
                    want.append((i, 1.0))
            elif 2 * brute_tiles(item, text, 5) >= len(item):
                want.append((i, brute_tiles(item, text, 5) / len(item)))
        assert sorted(block.matches(" ".join(text))) == want


def test_repeated_words_take_no_cubic_time():
    block = Items([(1, "same " * 300)] + [(i, "one two three four five six " + f"seven{i} eight{i}") for i in range(2, 20_000)], 0.9)
    began = time.perf_counter()
    assert block.matches("same " * 2000) == [(1, 1.0)]
    assert block.matches("one two three four five six " * 50 + "seven7 eight7") == [(7, 1.0)]
    assert time.perf_counter() - began < 2
