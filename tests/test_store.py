"""Numbers, ids, deletions and compaction of the store."""

import pytest
from pyspark.sql import functions as F

from docmill.operators.retrieval import vector_search_many
from docmill.plans.engine import Engine
from docmill.sources.store import Store, numbered


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "kb"))


def batch(spark, *names, text="some words that are long enough"):
    rows = spark.createDataFrame([(n, f"/in/{n}", f"hash {n}", i, f"{text} {n} {i}") for n in names for i in range(3)], "file_name string, file_path string, file_hash string, chunk_index int, text string")
    return rows.withColumn("category", F.lit("c")), rows.select("file_name", "file_path", "file_hash").distinct()


def names(store):
    return {r.file_name for r in store.chunks().collect()}


def listed(store):
    return {r.file_name for r in store.files().collect()}


def test_a_noted_number_is_given_to_no_other_batch(spark, store):
    """A named batch that died before it wrote; an unnamed one, then another stream's, then the replay."""
    first, _ = store.begin("watch-0")
    store.add(*batch(spark, "b"))
    other, _ = store.begin("other-0")
    store.add(*batch(spark, "c"), other)
    again, _ = store.begin("watch-0")
    assert again == first and len({first, other}) == 2
    store.add(*batch(spark, "a"), again)
    store.add(*batch(spark, "d"))
    assert names(store) == listed(store) == {"a", "b", "c", "d"}
    store.add(*batch(spark, "a"), again)  # once more: nothing else is lost
    assert names(store) == listed(store) == {"a", "b", "c", "d"} and store.chunks().count() == 12


def test_ids_of_thousands_of_tasks(spark, tmp_path):
    """3,000 tasks in one batch, one row in the next: the rows are numbered one by one."""
    path = str(tmp_path / "rows")
    spark.range(0, 6000, 1, 3000).select(F.monotonically_increasing_id().alias("id")).write.parquet(path)
    one = numbered(spark.read.parquet(path), 1).collect()
    two = numbered(spark.createDataFrame([(0,)], "id long"), 2).collect()
    ids = [r.id for r in one]
    assert sorted(ids) == list(range(1 << 40, (1 << 40) + 6000)) and two[0].id == 2 << 40


def test_ids_of_chunks_and_files_are_told_apart(spark, store):
    chunks, files = batch(spark, *(f"f{i}" for i in range(40)))
    store.add(chunks.repartition(20), files.repartition(20))
    store.add(*batch(spark, "x", "y"))
    assert store.chunks().select("id").distinct().count() == 126
    assert store.files().select("id").distinct().count() == 42


def test_compaction_keeps_what_is_left(spark, store):
    for n in ("a", "b", "c"):
        store.add(*batch(spark, n))
    store.delete("hash b")
    waiting, _ = store.begin("late")
    store.add(*batch(spark, "d"))
    before = sorted(map(tuple, store.chunks().collect()), key=str)
    assert store.compact() == waiting - 1 == 3
    assert sorted(map(tuple, store.chunks().collect()), key=str) == before
    store.add(*batch(spark, "e"), waiting)  # the batch that was noted before the compaction
    store.add(*batch(spark, "b"))
    store.delete("hash a")
    assert names(store) == listed(store) == {"b", "c", "d", "e"}
    left = {r.id for r in store.chunks().collect()}
    store.compact()
    assert {r.id for r in store.chunks().collect()} == left and store.compact() == 6
    assert names(store) == {"b", "c", "d", "e"}


def test_unfinished_compaction_is_not_seen(spark, store, tmp_path):
    store.add(*batch(spark, "a"))
    store.add(*batch(spark, "b"))
    n = store.compact()
    (tmp_path / f"kb/compact/n={n}/_SUCCESS").unlink()
    assert names(store) == {"a", "b"} and store.chunks().count() == 6
    store.compact()
    assert names(store) == {"a", "b"} and store.chunks().count() == 6


def test_engine_reads_the_store(spark, store):
    engine = Engine.over(store, lambda text: [1.0, 0.0], model=None)
    chunks, files = batch(spark, "a.pdf", "b.pdf")
    store.add(chunks.withColumn("embedding", F.array(F.lit(1.0), F.col("chunk_index") * 0.1).cast("array<float>")), files)
    assert {r.file_name for r in engine.search("some words")[0].collect()} == {"a.pdf", "b.pdf"}
    engine.delete_file("a.pdf")
    assert {r.file_name for r in engine.search("some words")[0].collect()} == {"b.pdf"} and listed(store) == {"b.pdf"}
    with pytest.raises(KeyError):
        engine.delete_file("a.pdf")
    engine.reset()
    assert engine.chunks.count() == 0 and engine.health()["store"]


def test_chunks_without_a_vector_are_no_hits(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, query_vector array<float>")
    found = vector_search_many(rows, asked, 5)
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == [(7, 1, 1), (7, 3, 2)]
