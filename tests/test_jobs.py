"""The jobs over growing input: what a run takes, what it leaves alone, and what a run that died leaves behind."""

import logging
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docmill.operators.chunking import smart_chunk
from jobs import answer_questions, ingest_corpus
from jobs.common import settings

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def ingest_options(tmp_path):
    return {"input": f"file://{tmp_path}/in", "output": f"file://{tmp_path}/out", "checkpoint": f"file://{tmp_path}/mark"}


def test_ingest_takes_only_what_is_new(spark, docs, tmp_path, caplog):
    options = ingest_options(tmp_path)
    docs.where("doc_id < 80").coalesce(2).write.parquet(options["input"])
    first = rows(ingest_corpus.run(spark, options))
    assert first and {r.batch for r in ingest_corpus.read_or_empty(spark, options["output"] + "/catalog", ingest_corpus.CATALOG).collect()} == {0}
    assert rows(ingest_corpus.run(spark, options)) == first
    # Further files: new documents, and copies of what is there.
    extra = spark.createDataFrame([(9001, docs.where("doc_id = 3").first().text, "x"), (9002, None, None), (9003, "brand new", ""), (9004, "brand new", "y"), (None, "no id", "z"), (9003, "brand new", "")], ingest_corpus.INPUT)
    docs.where("doc_id >= 80").select("doc_id", "text", "source").unionByName(extra).coalesce(1).write.mode("append").parquet(options["input"])
    with caplog.at_level(logging.INFO):
        every = ingest_corpus.run(spark, options)
    assert "batch 1: read" in caplog.text
    catalog = ingest_corpus.read_or_empty(spark, options["output"] + "/catalog", ingest_corpus.CATALOG)
    status = {(r.doc_id, r.status) for r in catalog.where("batch = 1").collect()}
    assert {(9001, "duplicate"), (9002, "empty"), (9003, "indexed"), (9004, "duplicate"), (9003, "duplicate"), (None, "indexed")} <= status
    assert Counter(r.category for r in every.where("doc_id = 9003").collect()) == {"unknown": 1}
    # Each text once, with the chunks that the operator gives, and as many as the catalog says.
    found = {}
    for r in every.orderBy("chunk_index").collect():
        found.setdefault((r.doc_id, r.file_hash), []).append(r.text)
    assert len({h for _, h in found}) == len(found)
    told = {(r.doc_id, r.file_hash): r.n_chunks for r in catalog.where("status = 'indexed'").collect()}
    assert {k: len(v) for k, v in found.items()} == told
    clean = docs.select("doc_id", ingest_corpus.clean_text("text").alias("t")).select("doc_id", smart_chunk(F.col("t")).alias("cs"))
    whole = {r.doc_id: r.cs for r in clean.collect()}
    assert all(v == whole[d] for (d, _), v in found.items() if d in whole)
    assert rows(ingest_corpus.run(spark, options)) == rows(every)


def test_ingest_in_one_run_or_many(spark, docs, tmp_path):
    """The same texts are chunked, whether files come at once or one by one."""
    once, often = tmp_path / "once", tmp_path / "often"
    got = []
    for where, limit in ((once, 0), (often, 1)):
        options = ingest_options(where) | {"files_per_batch": limit}
        docs.select("doc_id", "text", "source").repartition(3, "doc_id").write.parquet(options["input"])
        got.append(ingest_corpus.run(spark, options))
    assert got[1].select("batch").distinct().count() == 3
    assert rows(got[0].select("file_hash", "chunk_index", "text")) == rows(got[1].select("file_hash", "chunk_index", "text"))


def test_ingest_that_died_is_taken_up(spark, docs, tmp_path, monkeypatch):
    options = ingest_options(tmp_path)
    docs.select("doc_id", "text", "source").write.parquet(options["input"])
    read = ingest_corpus.read_or_empty
    calls = []

    def dies(*a):
        calls.append(a)
        if len(calls) == 2:  # after chunks and catalog are written, before the stream notes the batch as done
            raise RuntimeError("lost")
        return read(*a)

    monkeypatch.setattr(ingest_corpus, "read_or_empty", dies)
    with pytest.raises(Exception, match="lost"):
        ingest_corpus.run(spark, options)
    monkeypatch.setattr(ingest_corpus, "read_or_empty", read)
    again = ingest_corpus.run(spark, options)
    whole = ingest_options(tmp_path / "whole") | {"input": options["input"]}
    assert rows(again) == rows(ingest_corpus.run(spark, whole))


def test_answers_grow_with_the_documents(spark, docs, tmp_path, caplog):
    options = {"documents": f"file://{tmp_path}/docs", "questions": f"{DIR}/benchmark.parquet", "output": f"file://{tmp_path}/out", "top_k": 3, "passage_chars": 200}
    docs.where("doc_id % 2 = 0").write.parquet(options["documents"])
    first = rows(answer_questions.run(spark, options))
    assert first and {r[0] % 2 for r in first} == {0}  # columns by name: doc_id is the first
    extra = [(None, "nameless", "en", "x"), (9000, None, "", None), (9001, "twice", "en", "x"), (9001, "twice told", None, None)]
    docs.where("doc_id % 2 = 1").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, answer_questions.DOCUMENTS)).write.mode("append").parquet(options["documents"])
    with caplog.at_level(logging.INFO):
        grown = rows(answer_questions.run(spark, options))
    assert f"read {docs.where('doc_id % 2 = 1').count() + 2} new documents" in caplog.text and "wrote batch 2" in caplog.text
    caplog.clear()
    with caplog.at_level(logging.INFO):
        assert rows(answer_questions.run(spark, options)) == grown
    assert "no new documents" in caplog.text
    # As if all had been there from the start.
    assert rows(answer_questions.run(spark, options | {"output": f"file://{tmp_path}/anew"})) == grown
    assert all(r[5] in range(1, 4) for r in grown)


def test_answers_of_many_questions_shuffle_no_pairs(spark, docs, tmp_path, monkeypatch):
    """Scored block by block: the answers are those of chosen blocks."""
    from docmill.operators import postings

    options = {"documents": f"{DIR}/documents.parquet", "questions": f"{DIR}/benchmark.parquet", "output": f"file://{tmp_path}/out"}
    want = rows(answer_questions.run(spark, options))
    monkeypatch.setattr(postings, "FEW", 0)
    assert rows(answer_questions.run(spark, options)) == want and want


def test_best_passage_is_the_first_with_most_words(spark):
    text = "alpha beta.\n\ngamma delta alpha.\n\nalpha gamma delta."
    row = spark.createDataFrame([(text, ["alpha", "gamma", "delta"])], "text string, words array<string>")
    assert row.select(answer_questions.best_passage("text", "words", 20)["chunk"]).first()[0].endswith("gamma delta alpha.")


def test_settings():
    options = settings(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs", "ingest_corpus.toml"), {"input": "/elsewhere", "output": None})
    assert options["input"] == "/elsewhere" and options["chunk_chars"] == 1200 and options["output"] == "/data/knowledge-base"


def test_command_line(tmp_path):
    """A run as a user starts it, with its own session."""
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = ["--input", f"{DIR}/documents.parquet*", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run([sys.executable, "-m", "jobs.ingest_corpus", "--config", f"{top}/jobs/ingest_corpus.toml", *paths], cwd=top, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read 200 documents" in done.stderr and (tmp_path / "out" / "catalog").exists()
