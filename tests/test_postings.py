"""The stored index against a search that tokenises everything anew."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import bm25, postings
from docmill.operators.postings import StoredIndex, current, reindex, term_counts


def corpus(n, seed=3):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.8)) % 400}"
    return [(i, " ".join(word() for _ in range(r.choice([3, 20, 80])))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "the of"), (n + 3, "w1 " * 3000)]


def queries(spark, seed=4):
    r = random.Random(seed)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.8)) % 400}" for _ in range(r.choice([1, 4, 20])))) for i in range(15)]
    return spark.createDataFrame([*rows, (90, "absent"), (91, ""), (92, None), (93, "w1 w1 w2")], "query_id long, query string")


def same(spark, index, rows, k=10):
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), queries(spark)
    found = sorted(map(tuple, index.search(asked, k).select("query_id", "doc_id", "score", "rank").collect()))
    assert found == sorted(map(tuple, bm25.search(docs, asked, k).select("query_id", "doc_id", "score", "rank").collect())) and found
    assert sorted(map(tuple, index.frequencies().collect())) == sorted(map(tuple, bm25.frequencies(bm25.postings(docs)).collect()))
    n, mean = index.statistics()
    told = bm25.statistics(bm25.lengths(bm25.postings(docs))).first()
    assert (n, round(mean, 9)) == (told["n"], round(told["avgdl"], 9))


@pytest.mark.parametrize("small", [10**6, 0])
def test_batches_deletions_and_rebuild(spark, tmp_path, monkeypatch, small):
    """Added in batches, deleted, added again: always as a rebuild; with joins broadcast or shuffled."""
    monkeypatch.setattr(postings, "SMALL", small)
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "SLICE", 40)
    rows = corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    index.add(df.where("doc_id < 70"))
    same(spark, index, [r for r in rows if r[0] < 70])
    index.add(df.where("doc_id >= 70"))
    index.delete(spark.createDataFrame([(i,) for i in (3, 5, 71, 999)], "doc_id long"))
    left = [r for r in rows if r[0] not in (3, 5, 71)]
    same(spark, index, left)
    index.add(spark.createDataFrame([(5, "w1 w2 new")], "doc_id long, text string"))
    left.append((5, "w1 w2 new"))
    same(spark, index, left, 3)
    assert index.batches() == [1, 2, 3, 4]
    same(spark, index.compact(f"file://{tmp_path}/compact"), left)


def test_a_batch_replaces_itself_and_counts_once_its_totals_are_there(spark, tmp_path):
    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.add(df.where("doc_id < 20"), 1)
    broken = StoredIndex(spark, index.root)
    broken._total = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.add(df.where("doc_id >= 20"))
    same(spark, index, [r for r in rows if r[0] < 20])
    for _ in range(2):
        index.add(df.where("doc_id >= 20"), 2)
    same(spark, index, rows)


def test_blocks_below_the_floor_are_not_scored(spark, tmp_path, monkeypatch):
    """A rare term's blocks set the floor; blocks of the frequent term alone are skipped."""
    monkeypatch.setattr(postings, "BLOCK", 4)
    rows = [(i, "common word") for i in range(400)] + [(500 + i, "common rare") for i in range(3)]
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = []
    left = index._left
    monkeypatch.setattr(index, "_left", lambda held, gone=None: (seen.append(held), left(held, gone))[1])
    found = index.search(spark.createDataFrame([(1, "rare common")], "query_id long, query string"), 3)
    assert {r.doc_id for r in found.collect()} == {500, 501, 502}
    assert seen[-1].select("doc_id").distinct().count() < 40  # of 403


def test_reindex_takes_over_what_comes_meanwhile(spark, tmp_path):
    """Additions and deletions during the build are found after the switch; a build that dies leaves the old index."""
    base, rows = f"file://{tmp_path}/kb", corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = current(spark, base)
    old.add(df.where("doc_id < 30"))
    old.delete(spark.createDataFrame([(2,)], "doc_id long"))

    def meanwhile():
        assert current(spark, base).root == old.root
        old.add(df.where("doc_id >= 30"))
        old.delete(spark.createDataFrame([(4,), (31,)], "doc_id long"))

    with pytest.raises(ZeroDivisionError):
        reindex(spark, base, lambda: 1 / 0)
    assert current(spark, base).root == old.root
    new = reindex(spark, base, meanwhile)
    assert current(spark, base).root == new.root != old.root and new.batches() == [2, 3, 4]
    same(spark, current(spark, base), [r for r in rows if r[0] not in (2, 4, 31)])
    current(spark, base).add(spark.createDataFrame([(2, "w1 again")], "doc_id long, text string"))
    same(spark, reindex(spark, base), [r for r in rows if r[0] not in (2, 4, 31)] + [(2, "w1 again")])


def test_nothing_stored(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "none"))
    assert index.batches() == [] and index.search(queries(spark)).collect() == [] and index.statistics() == (0, 0.0)
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    assert index.batches() == [1] and index.search(queries(spark)).collect() == []


def test_term_counts(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["x"],)], "t array<string>")
    found = [r[0] for r in rows.select(term_counts(F.col("t"))).collect()]
    assert [x and [tuple(p) for p in x] for x in found] == [[("a", 1), ("b", 2)], None, None, [("x", 1)]]


@pytest.mark.parametrize("small", [10**6, 0])
@pytest.mark.parametrize("least", [1, 10**6])
def test_many_queries_are_scored_block_by_block(spark, tmp_path, monkeypatch, small, least):
    """Beyond a few pairs of queries and blocks: no row of a term and a document, and no pair, passes through a shuffle."""
    for name, value in {"SMALL": small, "BLOCK": 8, "SLICE": 40, "FEW": 0, "TRIPLES": least, "CELLS": least, "ROWS": 1}.items():
        monkeypatch.setattr(postings, name, value)
    rows = corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = StoredIndex(spark, f"file://{tmp_path}/index")
    index.add(df.where("doc_id < 70"))
    index.add(df.where("doc_id >= 70"))
    same(spark, index, rows)
    index.delete(spark.createDataFrame([(i,) for i in (3, 5, 71, 999)], "doc_id long"))
    left = [r for r in rows if r[0] not in (3, 5, 71)]
    same(spark, index, left)
    index.add(spark.createDataFrame([(5, "w1 w2 new")], "doc_id long, text string"))
    same(spark, index, [*left, (5, "w1 w2 new")], 3)
    if small:
        plan = index.search(queries(spark), 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "explode(arrays_zip" not in plan


def test_blocks_are_packed_in_tasks(spark, tmp_path, monkeypatch):
    """One shuffle, of documents; every block row holds its documents by id, however batches cut the blocks."""
    monkeypatch.setattr(postings, "BLOCK", 16)
    rows = corpus(3000)
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    told = spark.read.parquet(f"{index.root}/blocks")
    assert told.groupBy("term", "block").count().where("count > 1").count() == 0
    assert told.where("ids <> array_sort(ids) or df <> size(ids) or most_tf <> array_max(tfs) or least_dl <> array_min(dls)").count() == 0
    got = told.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("p.ids", "term", "p.tfs")
    want = bm25.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    plan = index._blocks(index._written("forward", postings.FORWARD, 1), 3000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan and "explode" not in plan
