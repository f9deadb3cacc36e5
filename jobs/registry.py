"""The jobs as queries: each runs twice into one new folder and returns the whole output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.operators.chunking import CHUNK
from docmill.plans.registry import _TOKENS, _search_sql, _smart, _trim
from docmill.sources.tables import new_dir
from jobs import answer_questions, ingest_corpus


def job1_ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "ingest_corpus")
    # A pattern, as the table may be a folder or one file, which a stream takes only so.
    options = {"input": f"{sf_dir}/documents.parquet*", "output": f"{folder}/output", "checkpoint": f"{folder}/checkpoint"}
    ingest_corpus.run(spark, options)
    return ingest_corpus.run(spark, options)


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "answer_questions")
    options = {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/benchmark.parquet", "output": f"{folder}/output"}
    answer_questions.run(spark, options)
    return answer_questions.run(spark, options)


QUERIES = {"job1_ingest_corpus": job1_ingest_corpus, "job2_answer_questions": job2_answer_questions}

_CLEAN = _trim(r"regexp_replace(regexp_replace(coalesce(text, ''), '([一-鿿])[\s\p{Z}]+([一-鿿])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_FIRST = f"(SELECT min(doc_id) AS id, c AS text FROM (SELECT doc_id, {_CLEAN} AS c FROM documents) WHERE c <> '' GROUP BY c)"
_WHOLE = "(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)"
_HITS = _search_sql("(SELECT item_id AS query_id, text AS query FROM benchmark)", "(SELECT doc_id AS id, text FROM documents)", 5)

ORACLE_SQL = {
    "job1_ingest_corpus": f"""{_smart(_FIRST, CHUNK)},
  c AS (SELECT id, unnest(cs) AS text, generate_subscripts(cs, 1) AS i FROM every)
SELECT doc_id, sha256(s.text) AS file_hash, CAST(i - 1 AS INTEGER) AS chunk_index, length(c.text) AS n_chars, c.text, 0 AS batch, CASE WHEN source <> '' THEN source ELSE 'unknown' END AS category
FROM c JOIN src s USING (id) JOIN documents d ON d.doc_id = c.id""",
    "job2_answer_questions": f"""{_smart(_WHOLE, CHUNK)},
  hits AS ({_HITS}),
  words AS (SELECT item_id, list_distinct({_TOKENS}) AS ws FROM benchmark),
  c AS (SELECT id, unnest(cs) AS text, generate_subscripts(cs, 1) AS i FROM every WHERE id IN (SELECT doc_id FROM hits)),
  t AS (SELECT id, i, text, {_TOKENS} AS ts FROM c),
  best AS (SELECT query_id, id, arg_min(text, (-len(list_intersect(ts, ws))) * 1000000 + i) AS passage FROM hits JOIN words ON item_id = query_id JOIN t ON t.id = hits.doc_id GROUP BY query_id, id)
SELECT h.query_id AS item_id, rank, h.doc_id, score, coalesce(source, '') AS source, passage, length(d.text) AS n_chars, CASE WHEN lang <> '' THEN lang ELSE 'unknown' END AS lang
FROM hits h JOIN best b ON b.query_id = h.query_id AND b.id = h.doc_id JOIN documents d ON d.doc_id = h.doc_id""",
}
