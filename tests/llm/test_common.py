import random
from collections import defaultdict

import pyarrow as pa
import pytest

from docmill.llm import common
from docmill.llm.common import clear, components, grouped, materialize, own_dir, room_for, spare_name


@pytest.mark.parametrize("hub", [1000, 5])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)  # the small one makes hubs of many nodes
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        if node not in want:
            queue = [node]
            while queue:
                x = queue.pop()
                if x not in want:
                    want[x] = node
                    queue += near[x]
    got = components(spark, spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {x.node: x.root for x in got} == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_go_on_from_batch_to_batch():
    make = lambda rows: pa.RecordBatch.from_pydict({"a": [x for x, _ in rows], "b": [y for _, y in rows]})
    batches = [make([(1, "x"), (1, "y")]), make([(1, "z"), (2, "p")]), make([(3, "q"), (3, "r")])]
    assert [(k, t.column(1).to_pylist()) for k, t in grouped(batches, 1)] == [((1,), ["x", "y", "z"]), ((2,), ["p"]), ((3,), ["q", "r"])]
    assert list(grouped([], 1)) == []


def test_names():
    assert room_for(["a", "Score", "b"], "score double") == ["a", "b"]
    assert spare_name(["TEXT__", "x"]) == "text___"


def test_tables_outlive_their_source_until_cleared(spark):
    df = materialize(spark, spark.range(5), "numbers")
    assert df.count() == 5 and "/docmill-" in own_dir(spark, "x")
    clear(spark)
    again = materialize(spark, spark.range(3), "numbers")
    assert again.count() == 3
