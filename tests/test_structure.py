"""Heading paths in parts, and merged ranges, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.functions.structure import with_heading_path
from docmill.operators.chunking import expand_merged


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_heading_paths_in_parts(spark, size):
    r = random.Random(size)
    rows = [(f, i, r.choice([0, 0, 0, 1, 2, 3, 9]), f"t{f}.{i}") for f in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "file string, ord int, level int, text string")
    want, stack = {}, []
    for f, i, level, text in rows:
        if i == 0:
            stack = []
        if level:
            stack = [s for s in stack if s[0] < level] + [(level, text)]
        want[f, i] = " > ".join(t for _, t in stack)
    whole = with_heading_path(df, "file", "ord")
    parts = with_heading_path(df, "file", "ord", part=F.floor(F.col("ord") / size))
    assert parts.columns == whole.columns
    for told in (whole, parts):
        assert {(x.file, x.ord): x.heading_path for x in told.collect()} == want


def test_merged_ranges_of_any_size(spark):
    """A range of a million rows, nested and overlapping ones, one without a first cell; held against all pairs."""
    r = random.Random(2)
    places = {(s, r.randrange(1, 2000), r.randrange(1, 9)) for s in "xy" for _ in range(400)} | {("x", 1, 1), ("x", 999_000, 3), ("z", 5, 5)}
    cells = [(s, a, b, r.choice([f"{s}{a},{b}", None])) for s, a, b in sorted(places)]
    cells = [c if c[:3] != ("x", 1, 1) else ("x", 1, 1, "first") for c in cells]
    ranges = [("x", 1, 1, 1_000_000, 4), ("z", 1, 1, 9, 9)]
    for s in "xy":
        for _ in range(60):
            a, b = r.randrange(1, 2000), r.randrange(1, 9)
            ranges.append((s, a, b, a + r.choice([0, 1, 3, 40, 700]), b + r.randrange(3)))
    value = {c[:3]: c[3] or "" for c in cells}
    want = {}
    for s, a, b, v in cells:
        held = [(r1, c1) for t, r1, c1, r2, c2 in ranges if t == s and r1 <= a <= r2 and c1 <= b <= c2]
        want[s, a, b] = max(((r1, c1, value.get((s, r1, c1), "")) for r1, c1 in held), default=(0, 0, v or ""))[2]
    got = expand_merged(spark.createDataFrame(cells, "sheet string, row int, col int, value string"), spark.createDataFrame(ranges, "sheet string, r1 int, c1 int, r2 int, c2 int"))
    assert {(x.sheet, x.row, x.col): x.value for x in got.collect()} == want
    assert want["x", 999_000, 3] == "first"
