"""Inputs of the queries: views over the driver's tables, the same in Spark and in SQL.

Documents, their lines, conversations and orders take the parts of files, headings,
table cells, recognised boxes, questions and replies; by number and length they get the
marks that the rules look at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(number: str, *texts: str, other: str) -> str:
    """One of the expressions, by remainder; beyond them the other."""
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + f" ELSE {other} END"


_TURN = "conv_id * 1000 + turn AS id"
_QUESTION = _pick("(conv_id + turn) % 7", "'列出所有' || text", "'请问 温度 2023 BDO 指标？' || text", "'统计 汇总，' || text", "''", "'有哪些 ' || text", other="text")
_WORDS = " || ' ' || ".join(f"split_part(line, ' ', {i})" for i in (1, 2, 3))

#: name -> SQL in the words that both engines have; lists, splits and digests are written LIST(..), SPLIT(.., ..) and SHA(..).
VIEWS: dict[str, str] = {
    "texts": "SELECT doc_id AS id, " + _pick("doc_id % 7", "'中 文 字 符 and ' || text || ' 温 度　上升'", "'  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'b ' || chr(9)", "''", "'　第一章 总则　' || text || '　'", "'列 1' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || text", other="text") + " AS text FROM documents",
    "cells": "SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_orderkey % 7 = 0 THEN ' ' || l_returnflag || ' b ' WHEN l_orderkey % 7 = 6 THEN '' END AS text, " + _pick("l_orderkey % 7", "NULL", "floor(l_extendedprice)", "floor(l_extendedprice) + l_linenumber * 0.125", "-(l_linenumber * 0.5)", other="NULL") + " AS number, CASE WHEN l_orderkey % 7 = 4 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END AS day FROM lineitem",
    "grids": "SELECT doc_id AS id, SPLIT('名 ' || split_part(text, chr(10), 1), ' ') AS headers, SPLIT(split_part(text, chr(10), 2), ' ') AS cells FROM documents",
    "headings": "SELECT doc_id * 100000 + ord AS id, " + _pick("(doc_id + ord) % 14", f"'1.2.3 ' || {_WORDS}", f"'1.2 ' || {_WORDS}", f"'1、' || {_WORDS}", f"'1.1: ' || {_WORDS}", "'1.1'", "'第一章 总则' || line", "'一、范围' || line", f"'2024 ' || {_WORDS}", "'3.14 ' || line", f"'第十 ' || {_WORDS}", _WORDS, other="line")
    + " AS text, " + _pick("doc_id % 7", "'Heading 3'", "'Subtitle'", "'标题 2'", "'Normal'", other="''") + " AS style, CAST(CASE WHEN (doc_id + ord) % 5 = 0 THEN (doc_id + ord) % 9 END AS INT) AS outline, CAST(10 + length(line) % 10 AS DOUBLE) AS size, length(line) % 2 = 0 AS bold FROM lines",
    "outline": "SELECT doc_id AS doc, ord, CAST(length(line) % 5 AS INT) AS level, line AS text FROM lines",
    "paragraphs": "SELECT doc_id AS doc, ord, CASE WHEN line = '' THEN 'blank' WHEN length(line) % 3 = 0 THEN 'list' WHEN length(line) % 7 = 1 THEN 'heading' ELSE 'plain' END AS kind, line AS text FROM lines",
    "captions": "SELECT doc_id AS doc, ord, CASE WHEN length(line) % 3 = 0 THEN 'table' ELSE 'paragraph' END AS kind, " + _pick("(doc_id + ord) % 6", "'表 1 ' || line", "'see Table 2 ' || line", "' '", "'表三 ' || line", other="line") + " AS text FROM lines",
    "sheet": "SELECT 'orders_' || (o_orderkey - o_orderkey % 500) || '.xlsx' AS file_name, o_orderstatus AS sheet, o_orderkey AS row, CASE WHEN o_orderkey % 7 = 0 THEN LIST('', '') ELSE LIST(CAST(o_custkey AS STRING), o_orderpriority) END AS cells FROM orders",
    "merged_cells": " UNION ALL ".join(f"SELECT CAST(doc_id AS STRING) AS sheet, ord AS row, {i} AS col, CASE WHEN (ord + {i}) % 5 = 0 THEN NULL ELSE split_part(line, ' ', {i}) END AS value FROM lines" for i in (1, 2, 3)),
    "merged_ranges": "SELECT CAST(doc_id AS STRING) AS sheet, ord AS r1, 1 AS c1, ord + 1 AS r2, 2 AS c2 FROM lines WHERE ord % 4 = 1 UNION ALL SELECT CAST(doc_id AS STRING), ord, 2, ord, 3 FROM lines WHERE ord % 4 = 3",
    "boxes": "SELECT image, ord, x1, y1, x1 + 20 + ord % 16 AS x2, y1 + 12 AS y2, text FROM (SELECT o_custkey AS image, o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN 100 ELSE 0 END + (o_orderkey * 37) % 211 + CAST(o_orderkey AS DOUBLE) / 1048576 AS x1, CAST((o_orderkey * 11) % CASE WHEN o_custkey % 3 = 0 THEN 1200 ELSE 120 END AS DOUBLE) AS y1, o_orderpriority AS text FROM orders) AS b",
    "ocr_texts": "SELECT doc_id AS id, " + _pick("doc_id % 4", "text", "' '", "NULL", other="''") + " AS first, " + _pick("doc_id % 3", "text", "NULL", other="'  '") + " AS second, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'a 1 x' || chr(10) || 'b 2 y' || chr(10) || text END AS third FROM documents",
    "images": "SELECT SHA(text) AS file_hash, CAST(1 + n_chars % 3 AS INT) AS page, CAST(n_chars % 5 AS INT) AS xref, " + _pick("n_chars % 4", "'x.png'", "'统计.png'", "'Table1.PNG'", other="'z.jpg'") + " AS file_name, CAST(n_chars % 600 AS INT) AS width, CAST(n_chars % 400 AS INT) AS height FROM documents",
    "replies": "SELECT doc_id AS id, " + _pick("doc_id % 6", "source", "'全部'", "'类别' || source", "''", """'"' || source || '"'""", other="'zzz'") + " AS reply, CASE WHEN doc_id % 7 = 0 THEN LIST(source) ELSE LIST('src1', 'src12', source) END AS categories FROM documents",
    "queries": f"SELECT {_TURN}, {_QUESTION} AS query FROM conversations",
    "modes": f"SELECT {_TURN}, {_QUESTION} AS query, CAST(length(text) % 3 AS INT) AS n_hits, length(text) % 2 = 0 AS any_keyword, length(text) % 5 = 0 AS reranked, CAST(1 + length(text) % 20 AS INT) AS top_k FROM conversations",
    "batch": "SELECT 'doc_' || doc_id || '.pdf' AS file_name, SHA(text) AS file_hash, CAST(doc_id AS INT) AS arrival, CAST(doc_id % 4 AS INT) AS n_chunks, " + _pick("doc_id % 7", "'bad zip'", "'ocr_unavailable'", other="NULL") + " AS error FROM documents",
    "known": "SELECT DISTINCT SHA(text) AS file_hash, CASE WHEN n_chars % 3 = 0 THEN 'indexed' ELSE 'pending' END AS status FROM documents",
    "names": "SELECT doc_id AS id, " + _pick("doc_id % 9", "'doc_' || doc_id || '.PDF'", "'a/doc_' || doc_id || '.docx'", "source || '.tar.xlsx'", "'doc_' || doc_id || '.xls'", "'doc.' || doc_id || '.jpeg'", "source || '.txt'", "source", "'.hidden'", other="lang || '.png'") + " AS file_name FROM documents",
    "tables": "SELECT 'doc_' || doc_id || '.pdf' AS file_name, CAST(1 + ord % 3 AS INT) AS page, line AS text FROM lines WHERE length(line) % 4 = 0",
    "text_blocks": "SELECT 'doc_' || doc_id || '.pdf' AS file_name, CAST(1 + ord % 3 AS INT) AS page, ord, line AS text FROM lines",
    "long_texts": f"SELECT {_TURN}, replace(replace(text, '. ', '。'), chr(10), chr(10) || chr(10)) AS text FROM conversations",
}

TABLES = ("documents", "conversations", "orders", "lineitem")
_LINES = "(SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents)"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a view."""
    told = re.sub(r"SHA\((\w+)\)", r"sha2(\1, 256)", VIEWS[name]).replace("LIST(", "array(").replace("SPLIT(", "split(")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", told)}
    if re.search(r"\blines\b", told):
        tables["lines"] = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("ord"), "line")
    for t in tables:
        told = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", told)
    return spark.sql(told, **tables)


def sql(name: str) -> str:
    """The view as a SQL table expression."""
    told = VIEWS[name].replace("SHA(", "sha256(").replace("LIST(", "list_value(").replace("SPLIT(", "string_split(")
    return "(" + re.sub(r"\bFROM lines\b", f"FROM {_LINES} AS lines", told) + ")"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as raw files in order of arrival."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name"), F.sha2("text", 256).alias("file_hash"), F.upper("lang").alias("file_type"), F.col("source").alias("category"), F.col("doc_id").alias("arrival"), "text"
    )


FILES_SQL = "(SELECT doc_id AS id, 'doc_' || doc_id AS file_name, sha256(text) AS file_hash, upper(lang) AS file_type, source AS category, doc_id AS arrival, text FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document, with its embedding if it has one."""
    own = files(spark, sf_dir).select("id", "file_name", "file_hash", "category", "text")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    defaults = {"page": F.lit(1), "block_type": F.lit("text"), "heading_path": F.lit(""), "table_headers": F.lit(""), "chunk_index": F.lit(0)}
    return own.join(vectors, "id", "left").withColumns(defaults)


CHUNKS_SQL = f"(SELECT f.id, f.file_name, f.file_hash, f.category, 1 AS page, 'text' AS block_type, '' AS heading_path, '' AS table_headers, 0 AS chunk_index, f.text, e.embedding FROM {FILES_SQL} f LEFT JOIN embeddings e ON e.vec_id = f.id)"
