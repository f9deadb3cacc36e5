"""Answers a table of questions from a growing table of documents: the best passages of each.

A BM25 index of the documents is kept below ``output``/index.  A run adds the documents
that the index doesn't hold yet, as one batch, and nothing where there are none; texts in
the index are not read again.  Then all questions (item_id, text) are searched, and the
hits, with the part of the document that suits the question best, replace those of the
last run:

    hits/lang=<lang>/     item_id, rank, doc_id, score, source, passage, n_chars

The passage is the document's chunk with most of the question's distinct words, the first
of several.  A run that died is taken up by the next: its unfinished batch is written anew,
and hits are written in whole.  One run at a time may write to an output.

    python -m jobs.answer_questions --config jobs/answer_questions.toml --documents /data/documents --questions /data/questions --output /data/answers

Edges: null and empty texts are entered and never found; a question without a known word
has no hits; documents of a null or empty language are under ``unknown``; rows that repeat an id
are one document, the largest text; rows without an id are left out, as nothing could
cite them; of rows that repeat a question's id, the largest text counts; further columns are ignored.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import bm25_tokens
from docmill.operators.chunking import CHUNK, smart_chunk
from docmill.operators.postings import StoredIndex
from docmill.sources.tables import if_small, read_or_empty

log = logging.getLogger("answer_questions")

CONFIG = "jobs/answer_questions.toml"
DOCUMENTS = "doc_id long, text string, lang string, source string"
QUESTIONS = "item_id long, text string"
HITS = "item_id long, rank int, doc_id long, score double, source string, passage string, n_chars long, lang string"


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the one of the largest text: a maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, "text")]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), *rest)).alias("r")).select(key, "r.*")


def best_passage(text: str, words: str, most: int):
    """The chunk of a text that holds most of the words, the first of several, as struct<held, at, chunk>."""
    chunks = smart_chunk(F.col(text), most)
    told = F.transform(chunks, lambda c, i: F.struct((-F.size(F.array_intersect(bm25_tokens(c), F.col(words)))).alias("held"), i.alias("at"), c.alias("chunk")))
    return F.array_min(told)


def answer(spark: SparkSession, index: StoredIndex, docs: DataFrame, questions: DataFrame, top_k: int, most: int, staged: str) -> DataFrame:
    """The hits of all questions; the search runs once, into ``staged``."""
    asked = questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index.search(asked, top_k).write.mode("overwrite").parquet(staged)
    found = spark.read.schema("query_id long, doc_id long, score double, rank int").parquet(staged).join(asked.select("query_id", F.array_distinct(bm25_tokens("query")).alias("words")), "query_id")
    held = one_each(docs.join(if_small(found.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id")
    cited = found.join(held, "doc_id").withColumn("best", best_passage("text", "words", most))
    return cited.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score", F.coalesce("source", F.lit("")).alias("source"), F.col("best.chunk").alias("passage"), F.length("text").cast("long").alias("n_chars"), F.when(F.col("lang") != "", F.col("lang")).otherwise("unknown").alias("lang"))


def run(spark: SparkSession, options: dict) -> DataFrame:
    """Indexes what is new, answers all questions and returns the table of hits."""
    output, top_k, most = options["output"].rstrip("/"), options.get("top_k", 5), options.get("passage_chars", CHUNK)
    docs = spark.read.schema(DOCUMENTS).parquet(options["documents"])
    questions = one_each(spark.read.schema(QUESTIONS).parquet(options["questions"]), "item_id")
    index = StoredIndex(spark, f"{output}/index")
    # Ids alone are compared; texts are read for the new ones.
    new = docs.select("doc_id").where("doc_id is not null").join(index.forward().select("doc_id"), "doc_id", "left_anti").distinct()
    if n := new.count():
        batch = index.add(one_each(docs.join(if_small(new), "doc_id", "left_semi"), "doc_id"))
        log.info("read %d new documents of %s; wrote batch %d of %s/index", n, options["documents"], batch, output)
    else:
        log.info("no new documents in %s", options["documents"])
    answer(spark, index, docs, questions, top_k, most, f"{output}/found").repartition("lang", "item_id").write.mode("overwrite").partitionBy("lang").parquet(f"{output}/hits")
    hits = read_or_empty(spark, f"{output}/hits", HITS)
    log.info("read %d questions of %s; wrote %d hits to %s/hits", questions.count(), options["questions"], hits.count(), output)
    return hits


if __name__ == "__main__":
    from jobs.common import main

    main("answer_questions", run, CONFIG, ("documents", "questions", "output"))
