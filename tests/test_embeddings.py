import pytest
from pyspark.sql import functions as F

from docmill.operators.plugins import embed_column, hashing_embedder
from docmill.sources.embeddings import EmbeddingCache


@pytest.fixture
def counting(tmp_path):
    """An embedder that notes every text that it is asked for."""
    log = f"{tmp_path}/calls"

    def make():
        embed = hashing_embedder(8)

        def noted(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t!r}\n" for t in texts))
            return embed(texts)

        return noted

    def calls():
        try:
            with open(log) as f:
                return sorted(f.read().splitlines())
        except FileNotFoundError:
            return []

    return make, calls


def test_a_text_is_embedded_once(spark, tmp_path, counting):
    make, calls = counting
    cache = EmbeddingCache(spark, f"{tmp_path}/kb", "m", lambda t: embed_column(t, make))
    want = lambda t: [pytest.approx(x) for x in hashing_embedder(8)([t or ""])[0]]
    # A third of the rows share one text; null and empty are one text; a column of the added one's name is there.
    one = spark.createDataFrame([(i, "hot words") for i in range(40)] + [(100 + i, f"text {i}") for i in range(80)] + [(200, None), (201, ""), (202, "x " * 50_000)], "id int, text string").withColumn("embedding", F.lit("old"))
    rows = cache.added(one.repartition(7)).collect()
    assert len(rows) == one.count() and all(r.embedding == want(r.text) for r in rows)
    assert calls() == sorted({repr(r.text or "") for r in rows})
    n = len(calls())
    two = spark.createDataFrame([(1, "text 3"), (2, "new"), (3, "new"), (4, "hot words")], "id int, text string")
    assert {r.id: r.embedding for r in cache.added(two).collect()} == {i: want(t) for i, t in ((1, "text 3"), (2, "new"), (3, "new"), (4, "hot words"))}
    assert len(calls()) == n + 1 and cache.fill(two) == 0 and cache.fill(two.limit(0)) == 0 and len(calls()) == n + 1
    # Another model has vectors of its own.
    other = EmbeddingCache(spark, f"{tmp_path}/kb", "m2", lambda t: embed_column(t, make))
    assert other.fill(two) == 3 and len(calls()) == n + 4


def test_unfinished_and_repeated_batches(spark, tmp_path, counting):
    make, calls = counting
    cache = EmbeddingCache(spark, f"{tmp_path}/kb", "m", lambda t: embed_column(t, make))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, text string")
    assert cache.fill(docs) == 10
    # A write that died is not seen; one that came twice gives each text once.
    (batch,) = cache._batches()
    cache._keep(spark.read.parquet(f"{cache.path}/batch={batch}"))
    dead = cache._keep(docs.select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(9.0).cast("float")).alias("embedding")))
    cache._fs.delete(cache._place(f"{cache.path}/batch={dead}/_SUCCESS"), False)
    assert cache.known().count() == 10 and all(len(r.embedding) == 8 for r in cache.added(docs).collect())
    before = {r.text_hash: r.embedding for r in cache.known().collect()}
    cache.compact()
    assert len(cache._batches()) == 1 and {r.text_hash: r.embedding for r in cache.known().collect()} == before
    assert cache.added(docs).count() == 10 and len(calls()) == 10
