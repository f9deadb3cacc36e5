"""Queries of the retrieval engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import structure as st
from docmill.functions import text as tx
from docmill.functions.segment import DOMAIN_WORDS, occurrences, segmenter
from docmill.operators import bm25, catalog, chunking, fusion, layout, respond, retrieval
from docmill.operators.plugins import segment_column
from docmill.operators.postings import StoredIndex
from docmill.operators.vectors import VectorIndex
from docmill.plans.fixtures import CHUNKS_SQL, FILES_SQL, chunks, documents, files, frame
from docmill.plans.fixtures import sql as fixture
from docmill.sources.embeddings import EmbeddingCache
from docmill.sources.tables import new_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


# ---- text -------------------------------------------------------------------------------------




def _trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


@query("SELECT id, " + _trim(r"regexp_replace(regexp_replace(text, '([一-鿿])[\s\p{Z}]+([一-鿿])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + f" AS text FROM {fixture('texts')}")
def clean_text(spark, sf_dir):
    return frame(spark, sf_dir, "texts").select("id", tx.clean_text("text").alias("text"))


@query("SELECT doc_id, md5(" + _trim(r"regexp_replace(regexp_replace(text, '([一-鿿])[\s\p{Z}]+([一-鿿])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + ") AS cleaned FROM documents")
def clean_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.clean_text("text")).alias("cleaned"))


@query("SELECT id, " + _trim(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')") + f" AS text FROM {fixture('texts')}")
def clean_text_table(spark, sf_dir):
    return frame(spark, sf_dir, "texts").select("id", tx.clean_table_text("text").alias("text"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.content_hash("text").alias("file_hash"))


@query(
    f"""SELECT id, coalesce(day, CASE WHEN number = floor(number) THEN CAST(CAST(number AS HUGEINT) AS VARCHAR)
        ELSE regexp_replace(regexp_replace(CAST(CAST(number AS DECIMAL(38, 12)) AS VARCHAR), '0+$', ''), '\\.$', '') END, trim(text), '') AS value FROM {fixture("cells")}"""
)
def fmt_cell(spark, sf_dir):
    return frame(spark, sf_dir, "cells").select("id", tx.format_cell(F.col("text"), F.col("number"), F.col("day").cast("date")).alias("value"))


@query(
    f"""SELECT id, array_to_string(list_filter(list_transform(range(1, least(len(headers), len(cells)) + 1),
            lambda i: CASE WHEN trim(coalesce(cells[i], '')) <> '' THEN
                CASE WHEN trim(coalesce(headers[i], '')) = '' THEN '列' || i ELSE replace(trim(headers[i]), chr(10), ' ') END || ': ' || replace(trim(cells[i]), chr(10), ' ') END),
            lambda p: p IS NOT NULL), ' | ') AS line FROM {fixture("grids")}"""
)
def fmt_row(spark, sf_dir):
    return frame(spark, sf_dir, "grids").select("id", tx.format_row(tx.header_names(F.col("headers")), F.col("cells")).alias("line"))


_KEYWORDS = r"""WITH words AS (
    SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, regexp_split_to_array({trim}, '[\s\p{{Z}}，。！？；、,.!?;]+') AS w FROM {source})),
  kept AS (SELECT id, w, min(i) AS i FROM words WHERE length(w) >= 2 AND w NOT IN ({stop}) AND NOT regexp_matches(w, '^[^\p{{L}}\p{{N}}_]+$') GROUP BY id, w),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(w) DESC, i) AS r FROM kept)
SELECT s.id, coalesce(string_agg(r.w, '|' ORDER BY r.r), '') AS keywords FROM {source} s LEFT JOIN ranked r ON r.id = s.id AND r.r <= 8 GROUP BY s.id"""


@query(_KEYWORDS.format(trim=_trim("query"), source=fixture("queries"), stop=_quoted(tx.KEYWORD_STOP_WORDS)))
def kw_tokenize(spark, sf_dir):
    return frame(spark, sf_dir, "queries").select("id", F.array_join(tx.keywords("query"), "|").alias("keywords"))


@query(_KEYWORDS.format(trim=_trim("text"), source="(SELECT item_id AS id, text FROM benchmark)", stop=_quoted(tx.KEYWORD_STOP_WORDS)))
def kw_tokenize_benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.array_join(tx.keywords("text"), "|").alias("keywords"))


@query()
def kw_segment(spark, sf_dir):
    """Keywords of questions that a dictionary cuts, words of the trade planted among them; tests hold the paths against brute force."""
    words = [*DOMAIN_WORDS, "排污"]
    planted = F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int"))
    asked = frame(spark, sf_dir, "queries").select("id", F.concat("query", F.lit("请问"), planted, F.lit("的有效期和综合能耗")).alias("query"))
    cut = segment_column(F.col("query"), segmenter)
    return asked.select("id", F.array_join(tx.keywords_of(cut), "|").alias("keywords"))


@query(
    "WITH w AS (SELECT unnest(["
    + _quoted(["the", "and", "ther", "ción", "thion", "排污口"])
    + "]) AS word) SELECT word, CAST(sum((length(text) - length(replace(text, word, ''))) / length(word)) AS BIGINT) AS n FROM w, documents GROUP BY word"
)
def word_occurrences(spark, sf_dir):
    return occurrences(documents(spark, sf_dir), ["the", "and", "ther", "ción", "thion", "排污口"])


@query(f"SELECT id, ({' OR '.join(f'contains(query, {chr(39)}{w}{chr(39)})' for w in tx.LIST_QUERY_WORDS)}) AS is_list FROM {fixture('queries')}")
def list_query(spark, sf_dir):
    return frame(spark, sf_dir, "queries").select("id", tx.is_list_query("query").alias("is_list"))


@query(f"SELECT id, upper(regexp_extract(file_name, '[^/.][^/]*\\.([^./]*)$', 1)) AS file_type FROM {fixture('names')}")
def file_type(spark, sf_dir):
    return frame(spark, sf_dir, "names").select("id", tx.file_type("file_name").alias("file_type"))


# ---- structure ----------------------------------------------------------------------------------

_LIKELY = r"""(CASE WHEN length(text) BETWEEN 4 AND 80 AND NOT regexp_matches(text, '[:：]') THEN
    CASE WHEN regexp_matches(text, '^\p{Nd}+\.\p{Nd}+\.\p{Nd}+') THEN 3 WHEN regexp_matches(text, '^\p{Nd}+\.\p{Nd}+') THEN 2 WHEN regexp_matches(text, '^\p{Nd}+[、\s]') THEN 2 ELSE 0 END ELSE 0 END)"""
_NUMBERED = "(CASE WHEN regexp_matches(text, '^第[一二三四五六七八九十百]+[章节部分]') THEN 1 WHEN regexp_matches(text, '^[一二三四五六七八九十]+[、．.]') THEN 2 ELSE 0 END)"
_BY_TEXT = f"(CASE WHEN length(text) > 120 THEN 0 WHEN {_LIKELY} > 0 THEN {_LIKELY} ELSE {_NUMBERED} END)"
_DOCX_VISUAL = "(CASE WHEN size >= 16 OR (size >= 14 AND bold) THEN CASE WHEN size >= 18 THEN 1 WHEN size >= 16 THEN 2 ELSE 3 END END)"
_PDF_VISUAL = "(CASE WHEN size >= 16 OR (size >= 13 AND bold AND length(text) < 80) THEN CASE WHEN size >= 18 THEN 1 WHEN size >= 15 THEN 2 ELSE 3 END END)"
_STYLE = r"""(CASE WHEN regexp_extract(replace(lower(style), ' ', ''), '^(?:heading|标题)([0-9])', 1) <> '' THEN CAST(regexp_extract(replace(lower(style), ' ', ''), '^(?:heading|标题)([0-9])', 1) AS INTEGER)
    WHEN contains(replace(lower(style), ' ', ''), 'title') THEN 1 END)"""


@query(f"SELECT id, {_LIKELY} AS level FROM {fixture('headings')}")
def likely_heading(spark, sf_dir):
    return frame(spark, sf_dir, "headings").select("id", st.likely_heading(F.col("text")).alias("level"))


@query(f"SELECT id, CASE WHEN length(text) > 120 THEN 0 ELSE coalesce(least(outline + 1, CASE WHEN outline IS NOT NULL THEN 6 END), {_STYLE}, {_DOCX_VISUAL}, {_BY_TEXT}) END AS level FROM {fixture('headings')}")
def heading_level(spark, sf_dir):
    return frame(spark, sf_dir, "headings").select("id", st.docx_level(F.col("text"), F.col("style"), F.col("outline"), F.col("size"), F.col("bold")).alias("level"))


@query(f"SELECT id, {_DOCX_VISUAL} AS level FROM {fixture('headings')}")
def visual_heading_docx(spark, sf_dir):
    return frame(spark, sf_dir, "headings").select("id", st.docx_visual(F.col("size"), F.col("bold")).alias("level"))


@query(f"SELECT id, CASE WHEN {_BY_TEXT} > 0 THEN {_BY_TEXT} ELSE coalesce({_PDF_VISUAL}, 0) END AS level FROM {fixture('headings')}")
def visual_heading_pdf(spark, sf_dir):
    return frame(spark, sf_dir, "headings").select("id", st.pdf_level(F.col("text"), F.col("size"), F.col("bold")).alias("level"))


@query("SELECT doc_id AS id, CAST(sum(level) AS BIGINT) AS total FROM (SELECT doc_id, " + _BY_TEXT + " AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)) GROUP BY doc_id")
def heading_lines(spark, sf_dir):
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("text"))
    return lines.groupBy("id").agg(F.sum(st.by_text(F.col("text"))).alias("total"))


@query(
    f"""WITH RECURSIVE rows AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS n FROM {fixture("outline")}),
  walk AS (
    SELECT doc, ord, n, CASE WHEN level > 0 THEN [{{'l': level, 't': text}}] ELSE [] END AS stack FROM rows WHERE n = 1
    UNION ALL
    SELECT r.doc, r.ord, r.n, CASE WHEN r.level > 0 THEN list_append(list_filter(w.stack, lambda s: s.l < r.level), {{'l': r.level, 't': r.text}}) ELSE w.stack END FROM walk w JOIN rows r ON r.doc = w.doc AND r.n = w.n + 1)
SELECT doc, ord, coalesce(array_to_string(list_transform(stack, lambda s: s.t), ' > '), '') AS heading_path FROM walk"""
)
def heading_path(spark, sf_dir):
    return st.with_heading_path(frame(spark, sf_dir, "outline"), "doc", "ord").select("doc", "ord", "heading_path")


_AT = "CASE WHEN level = {0} THEN {{'place': place, 'text': text}} END"
_LAST = ", ".join(f"last_value({_AT.format(n)} IGNORE NULLS) OVER w AS h{n}" for n in range(1, 5))
_IN_FORCE = ", ".join(f"CASE WHEN h{n} IS NOT NULL{''.join(f' AND coalesce(h{n}.place > h{m}.place, TRUE)' for m in range(1, n))} THEN h{n}.text END" for n in range(1, 5))


@query(
    f"""WITH l AS (SELECT doc * 100000 + ord AS place, level, text FROM {fixture("outline")}),
  h AS (SELECT place, {_LAST} FROM l WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT place, md5(array_to_string(list_filter([{_IN_FORCE}], lambda t: t IS NOT NULL), ' > ')) AS heading_path FROM h"""
)
def heading_path_one_file(spark, sf_dir):
    """All lines of all documents as one file, cut into parts."""
    lines = frame(spark, sf_dir, "outline").select(F.lit(0).alias("file"), (F.col("doc") * 100_000 + F.col("ord")).alias("place"), "level", "text")
    told = st.with_heading_path(lines, "file", "place", part=F.floor(F.col("place") / 5_000_000))
    return told.select("place", F.md5("heading_path").alias("heading_path"))


@query(
    f"""WITH kept AS (SELECT *, kind = 'list' AS l FROM {fixture("paragraphs")} WHERE kind <> 'blank'),
  marked AS (SELECT *, CASE WHEN l AND coalesce(lag(l) OVER (PARTITION BY doc ORDER BY ord), FALSE) THEN 0 ELSE 1 END AS b FROM kept),
  islands AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY ord) AS g FROM marked)
SELECT doc, min(ord) AS ord, bool_or(l) AS is_list, string_agg(CASE WHEN l THEN '• ' || text ELSE text END, chr(10) ORDER BY ord) AS text FROM islands GROUP BY doc, g"""
)
def list_merge(spark, sf_dir):
    return st.merge_lists(frame(spark, sf_dir, "paragraphs"), "doc", "ord")


@query(
    """WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
  body AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, text FROM lines),
  walk AS (
    SELECT doc_id, ord, text AS held, length(text) AS n FROM body WHERE ord = 1
    UNION ALL
    SELECT b.doc_id, b.ord, CASE WHEN w.n >= 400 THEN b.text ELSE w.held || chr(10) || b.text END, CASE WHEN w.n >= 400 THEN length(b.text) ELSE w.n + length(b.text) END
    FROM walk w JOIN body b ON b.doc_id = w.doc_id AND b.ord = w.ord + 1),
  told AS (SELECT *, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS later FROM walk)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS part, md5(held) AS text FROM told WHERE n >= 400 OR later IS NULL"""
)
def pdf_body_merge(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("is_heading", F.lit(False))
    return st.merge_body(lines, ["doc_id"], "ord").select("doc_id", "part", F.md5("text").alias("text"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS paragraph, CAST(greatest(1, floor(i / 40)) AS INTEGER) AS page FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def docx_pages(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("paragraph"), st.docx_page(F.col("at") + 1).alias("page"))


@query(
    f"""WITH seen AS (SELECT *, lag(kind) OVER w AS k, lag(text) OVER w AS t FROM {fixture("captions")} WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc ORDER BY ord))
SELECT doc, ord, CASE WHEN k = 'paragraph' AND (regexp_matches(t, '表\\s*\\p{{Nd}}') OR regexp_matches(t, '[Tt]able\\s*\\p{{Nd}}') OR regexp_matches(t, '表\\s*[一二三四五六七八九十百]')) THEN '[' || t || ']' || chr(10) || text ELSE text END AS text
FROM seen WHERE kind = 'table'"""
)
def table_caption(spark, sf_dir):
    return st.with_caption(frame(spark, sf_dir, "captions"), "doc", "ord")


@query(f"SELECT b.* FROM {fixture('text_blocks')} b WHERE NOT EXISTS (SELECT 1 FROM {fixture('tables')} t WHERE t.file_name = b.file_name AND t.page = b.page AND substr(t.text, 1, 200) = substr(b.text, 1, 200))")
def table_text_antijoin(spark, sf_dir):
    return st.without_table_text(frame(spark, sf_dir, "text_blocks"), frame(spark, sf_dir, "tables")).select("file_name", "page", "ord", "text")


# ---- chunking -------------------------------------------------------------------------------------


def _pack(units: str, most: int, joiner: str) -> str:
    """SQL of a greedy packing: a fold over one-unit accumulators."""
    return f"""(SELECT CASE WHEN a IS NULL THEN [] ELSE list_append(a.done, array_to_string(a.held, {joiner})) END FROM (SELECT list_reduce(list_transform({units}, lambda u: {{'done': []::VARCHAR[], 'held': [u], 'n': length(u)}}),
      lambda x, y: CASE WHEN x.n + y.n > {most} THEN {{'done': list_append(x.done, array_to_string(x.held, {joiner})), 'held': [x.held[-1], y.held[1]], 'n': length(x.held[-1]) + y.n}}
        ELSE {{'done': x.done, 'held': list_concat(x.held, y.held), 'n': x.n + y.n}} END) AS a))"""


def _smart(source: str, most: int) -> str:
    blank = r"regexp_replace(c, '[\s\p{Z}]+', '', 'g') <> ''"
    parts = r"list_concat(regexp_extract_all(p, '[^。！？；\n]*[。！？；\n]|[^。！？；\n]+$'), CASE WHEN regexp_matches(p, '[。！？；\n]$') THEN [''] ELSE [] END)"
    return f"""WITH src AS (SELECT id, text FROM {source}),
  paras AS (SELECT id, p, i FROM (SELECT id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM (SELECT id, regexp_split_to_array(text, '\\n\\n+') AS ps FROM src WHERE length(text) > {most})), LATERAL (SELECT {_trim("raw")} AS p) WHERE p <> ''),
  cut AS (SELECT id, i, CASE WHEN length(p) <= {most} THEN [p] ELSE {_pack(parts, most, "''")} END AS us FROM paras),
  units AS (SELECT id, flatten(list(us ORDER BY i)) AS us FROM cut GROUP BY id),
  packed AS (SELECT id, {_pack("us", most, "chr(10) || chr(10)")} AS cs FROM units),
  every AS (SELECT id, [text] AS cs FROM src WHERE length(text) <= {most} UNION ALL SELECT id, list_filter(cs, lambda c: {blank}) FROM packed)"""


@query(_smart(fixture("long_texts"), 8) + " SELECT id, array_to_string(cs, '¶') AS chunks FROM every")
def smart_chunk_small(spark, sf_dir):
    return frame(spark, sf_dir, "long_texts").select("id", F.array_join(chunking.smart_chunk(F.col("text"), 8), "¶").alias("chunks"))


@query(_smart("(SELECT doc_id AS id, text FROM documents)", chunking.CHUNK) + " SELECT id, CAST(len(cs) AS INTEGER) AS n, md5(array_to_string(cs, '¶')) AS chunks FROM every")
def smart_chunk(spark, sf_dir):
    cut = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), chunking.smart_chunk(F.col("text")).alias("cs"))
    return cut.select("id", F.size("cs").alias("n"), F.md5(F.array_join("cs", "¶")).alias("chunks"))


@query(_smart("(SELECT doc_id AS id, text FROM documents)", chunking.CHUNK) + " SELECT id, CAST(i - 1 AS INTEGER) AS chunk_index, length(c) AS n_chars FROM (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM every)")
def chunk_numbering(spark, sf_dir):
    cut = chunking.chunks(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    return cut.select("id", "chunk_index", F.length("chunk").cast("long").alias("n_chars"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]+$', '')), lambda x: x <> '')"


def _windows(source: str, size: int, step: int) -> str:
    return f"""SELECT doc_id, CAST(w AS INTEGER) AS part, md5(CASE WHEN len(ls) - 2 <= {size} THEN text ELSE array_to_string(ls[1:2], chr(10)) || chr(10) || array_to_string(ls[3 + w * {step} : 2 + w * {step} + {size}], chr(10)) END) AS chunk
FROM (SELECT doc_id, text, ls, unnest(CASE WHEN len(ls) = 0 THEN [] WHEN len(ls) - 2 <= {size} THEN [0] ELSE range(0, CAST(ceil((len(ls) - 2) / {step}.0) AS BIGINT)) END) AS w FROM (SELECT doc_id, text, {_LINES} AS ls FROM {source}))"""


@query(_windows("documents", 4, 2))
def ocr_table_windows(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.ocr_table_chunks(F.col("text"))).alias("part", "c"))
    return cut.select("doc_id", "part", F.md5("c").alias("chunk"))


@query(
    """WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: 'line: ' || x) AS rows FROM documents),
  cut AS (SELECT doc_id, rows, unnest(CASE WHEN len(rows) <= 30 THEN [0] ELSE range(0, CAST(ceil(len(rows) / 15.0) AS BIGINT)) END) AS w FROM t)
SELECT doc_id, CAST(w AS INTEGER) AS part, md5(CASE WHEN len(rows) <= 30 THEN '[表格] line' || chr(10) || array_to_string(rows, chr(10))
  ELSE '[表格第' || (w * 15 + 1) || '~' || (w * 15 + len(rows[w * 15 + 1 : w * 15 + 30])) || '行] line' || chr(10) || array_to_string(rows[w * 15 + 1 : w * 15 + 30], chr(10)) END) AS chunk FROM cut"""
)
def pdf_table_windows(spark, sf_dir):
    rows = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("line: "), x))
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.pdf_table_chunks(F.array(F.lit("line")), rows)).alias("part", "c"))
    return cut.select("doc_id", "part", F.md5("c").alias("chunk"))


@query(
    f"""WITH kept AS (SELECT *, row_number() OVER (PARTITION BY file_name, sheet ORDER BY row) - 1 AS n FROM {fixture("sheet")} WHERE len(list_filter(cells, lambda c: c <> '')) > 0),
  head AS (SELECT file_name, sheet, cells AS headers, array_to_string(cells, ' | ') AS line FROM kept WHERE n = 0),
  body AS (SELECT file_name, sheet, CAST(floor((n - 1) / 50) AS INTEGER) AS b, count(*) AS k, string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY n) AS lines FROM kept WHERE n > 0 GROUP BY ALL)
SELECT h.file_name, h.sheet, coalesce(b + 1, 1) AS page, 'Sheet: ' || h.sheet || coalesce(' / 行' || (b * 50 + 2) || '~' || (b * 50 + 1 + k), '') AS heading_path, array_to_string(headers, '|') AS headers,
  CASE WHEN b IS NULL THEN '[Sheet: ' || h.sheet || ']' || chr(10) || line ELSE '[Sheet: ' || h.sheet || ']（行' || (b * 50 + 2) || '~' || (b * 50 + 1 + k) || '）' || chr(10) || line || chr(10) || lines END AS text
FROM head h LEFT JOIN body USING (file_name, sheet)"""
)
def xlsx_batches(spark, sf_dir):
    return chunking.sheet_batches(frame(spark, sf_dir, "sheet")).withColumn("headers", F.array_join("headers", "|"))


@query(f"SELECT id, array_to_string(headers, '|') AS headers, array_to_string(list_filter([array_to_string(headers, ' | '), array_to_string(list_transform(cells, lambda c: trim(coalesce(c, ''))), ' | ')], lambda r: replace(replace(r, ' ', ''), '|', '') <> ''), chr(10)) AS text FROM {fixture('grids')}")
def docx_table_text(spark, sf_dir):
    told = frame(spark, sf_dir, "grids").select("id", chunking.docx_table(F.array("headers", "cells")).alias("t"))
    return told.select("id", F.array_join("t.headers", "|").alias("headers"), "t.text")


@query(
    f"""SELECT c.sheet, c.row, c.col, coalesce(CASE WHEN r.sheet IS NOT NULL THEN coalesce(f.value, '') END, c.value, '') AS value FROM {fixture("merged_cells")} c
LEFT JOIN {fixture("merged_ranges")} r ON r.sheet = c.sheet AND c.row BETWEEN r.r1 AND r.r2 AND c.col BETWEEN r.c1 AND r.c2
LEFT JOIN {fixture("merged_cells")} f ON f.sheet = r.sheet AND f.row = r.r1 AND f.col = r.c1"""
)
def expand_merged_cells(spark, sf_dir):
    return chunking.expand_merged(frame(spark, sf_dir, "merged_cells"), frame(spark, sf_dir, "merged_ranges"))


# ---- layout ---------------------------------------------------------------------------------------

_TABULAR = r"""(len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_matches(x, '\p{Nd}') AND (regexp_matches(x, '[,.]') OR len(list_filter(regexp_split_to_array(x, '[\s\p{Z}]+'), lambda w: w <> '')) > 2))) / len(ls) > 0.4)"""
_NONBLANK = r"list_filter(string_split(coalesce({0}, ''), chr(10)), lambda x: regexp_replace(x, '[\s\p{{Z}}]+', '', 'g') <> '')"


@query(f"SELECT id, coalesce(nullif({_trim('first')}, ''), nullif({_trim('second')}, ''), nullif({_trim('third')}, ''), '') AS text FROM {fixture('ocr_texts')}")
def ocr_engine_chain(spark, sf_dir):
    return frame(spark, sf_dir, "ocr_texts").select("id", layout.engine_chain(F.col("first"), F.col("second"), F.col("third")).alias("text"))


@query(f"SELECT id, {_TABULAR} AS is_table FROM (SELECT id, {_NONBLANK.format('coalesce(first, third)')} AS ls FROM {fixture('ocr_texts')})")
def is_table_text(spark, sf_dir):
    return frame(spark, sf_dir, "ocr_texts").select("id", layout.is_table_text(F.coalesce("first", "third", F.lit(""))).alias("is_table"))


@query(f"SELECT doc_id, {_TABULAR} AS is_table FROM (SELECT doc_id, {_NONBLANK.format('text')} AS ls FROM documents)")
def is_table_document(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", layout.is_table_text(F.col("text")).alias("is_table"))


@query(f"SELECT DISTINCT file_hash, page, xref, ({' OR '.join(f'contains(lower(file_name), {chr(39)}{w}{chr(39)})' for w in layout.TABLE_IMAGE_WORDS)} OR (width > 1.2 * height AND width * height > 80000)) AS is_table FROM {fixture('images')}")
def is_table_image(spark, sf_dir):
    return frame(spark, sf_dir, "images").select("file_hash", "page", "xref", layout.is_table_image(F.col("file_name"), F.col("width"), F.col("height")).alias("is_table")).distinct()


@query(f"SELECT DISTINCT file_hash, page, xref FROM {fixture('images')} WHERE width >= 100 AND height >= 100")
def image_filter(spark, sf_dir):
    return layout.kept_images(frame(spark, sf_dir, "images")).select("file_hash", "page", "xref")


def _walk(gap: str, compare: str) -> str:
    """SQL of rows by their first item's y: (image, n, row, text, x1, ...)."""
    return f"""WITH RECURSIVE b AS (SELECT *, (y1 + y2) / 2 AS y, (x1 + x2) / 2 AS c, row_number() OVER (PARTITION BY image ORDER BY (y1 + y2) / 2, ord) AS n FROM {fixture("boxes")}),
  g AS (SELECT image, {gap} AS gap, greatest(avg(x2 - x1) * 1.2, 20) AS wide FROM b GROUP BY image),
  walk AS (SELECT image, n, y AS anchor, 1 AS r FROM b WHERE n = 1
    UNION ALL SELECT b.image, b.n, CASE WHEN abs(b.y - w.anchor) {compare} g.gap THEN w.anchor ELSE b.y END, CASE WHEN abs(b.y - w.anchor) {compare} g.gap THEN w.r ELSE w.r + 1 END FROM walk w JOIN b ON b.image = w.image AND b.n = w.n + 1 JOIN g ON g.image = b.image),
  placed AS (SELECT b.*, w.r FROM b JOIN walk w USING (image, n))"""


@query(
    _walk("15", "<")
    + f""", firsts AS (SELECT image, r, arg_min(x1, x1) AS fx, arg_min(text, x1) AS ft FROM placed GROUP BY image, r),
  probe AS (SELECT image, count(*) >= 10 AND count(*) FILTER (WHERE fx > 60) >= count(*) * 0.8 AND count(*) FILTER (WHERE contains(ft, '月')) = 0 AS patch FROM firsts WHERE r BETWEEN 5 AND 16 GROUP BY image),
  lines AS (SELECT image, r, string_agg(text, '  ' ORDER BY x1, n) AS line FROM placed WHERE trim(text) <> '' GROUP BY image, r)
SELECT image, string_agg(CASE WHEN coalesce(patch, FALSE) AND r BETWEEN 5 AND 18 THEN [{_quoted(layout.MONTH_ROWS)}][r - 4] || '  ' || line ELSE line END, chr(10) ORDER BY r) AS text FROM lines LEFT JOIN probe USING (image) GROUP BY image"""
)
def ocr_rows(spark, sf_dir):
    return layout.rows_to_text(frame(spark, sf_dir, "boxes"))


@query(
    _walk("greatest(avg(y2 - y1) * 0.6, 10)", "<=")
    + """, sorted AS (SELECT image, c, row_number() OVER (PARTITION BY image ORDER BY c) AS k FROM b),
  cols AS (SELECT image, k, [c] AS centres FROM sorted WHERE k = 1
    UNION ALL SELECT s.image, s.k, CASE WHEN s.c - q.centres[-1] > g.wide THEN list_append(q.centres, s.c) ELSE list_append(q.centres[1 : len(q.centres) - 1], (q.centres[-1] + s.c) / 2) END
    FROM cols q JOIN sorted s ON s.image = q.image AND s.k = q.k + 1 JOIN g ON g.image = s.image),
  final AS (SELECT image, arg_max(centres, k) AS centres FROM cols GROUP BY image),
  cells AS (SELECT p.*, centres, list_position(list_transform(centres, lambda z: abs(z - p.c)), list_min(list_transform(centres, lambda z: abs(z - p.c)))) AS col FROM placed p JOIN final USING (image)),
  grid AS (SELECT image, r, col, arg_max(text, {'x': x1, 'n': n}) AS text FROM cells GROUP BY image, r, col),
  lines AS (SELECT a.image, a.r, string_agg(coalesce(g.text, '-'), '  ' ORDER BY k) AS line FROM (SELECT DISTINCT image, r, unnest(range(1, len(centres) + 1)) AS k FROM cells) a LEFT JOIN grid g ON g.image = a.image AND g.r = a.r AND g.col = a.k GROUP BY a.image, a.r)
SELECT image, CASE WHEN max(r) < 2 THEN (SELECT string_agg(text, ' ' ORDER BY x1, n) FROM placed p WHERE p.image = l.image) ELSE string_agg(line, chr(10) ORDER BY r) END AS text FROM lines l GROUP BY image"""
)
def ocr_table_grid(spark, sf_dir):
    return layout.rebuild_table(frame(spark, sf_dir, "boxes"))


# ---- catalog --------------------------------------------------------------------------------------


def _indexed(spark, sf_dir) -> DataFrame:
    """A catalog: the first file of every content below id 600, some pending."""
    rows = files(spark, sf_dir)
    first = rows.groupBy("file_hash").agg(F.min("id").alias("id"))
    return rows.join(first, ["file_hash", "id"]).select("id", "file_name", "file_hash", "file_type", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("category")).alias("category"), (F.col("id") % 9).cast("int").alias("chunk_count"), F.when(F.col("id") % 7 == 0, "pending").otherwise("indexed").alias("status"), F.col("id").alias("created_at"), F.col("id").alias("updated_at"))


_INDEXED = f"""(SELECT id, file_name, file_hash, file_type, CASE WHEN id % 11 = 0 THEN '' ELSE category END AS category, CAST(id % 9 AS INTEGER) AS chunk_count, CASE WHEN id % 7 = 0 THEN 'pending' ELSE 'indexed' END AS status, id AS created_at, id AS updated_at
  FROM {FILES_SQL} WHERE (file_hash, id) IN (SELECT (sha256(text), min(doc_id)) FROM documents GROUP BY sha256(text)))"""


@query(f"SELECT id, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e = 'docx' THEN 'docx' WHEN e IN ('xlsx', 'xls') THEN 'sheet' WHEN e IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp') THEN 'image' END AS parser FROM (SELECT id, lower(regexp_extract(file_name, '\\.([^./]*)$', 1)) AS e FROM {fixture('names')})")
def ext_dispatch(spark, sf_dir):
    return frame(spark, sf_dir, "names").select("id", catalog.parser_of(F.col("file_name")).alias("parser"))


@query(f"SELECT f.id, f.file_hash FROM {FILES_SQL} f WHERE f.file_hash NOT IN (SELECT file_hash FROM {_INDEXED} WHERE status = 'indexed') AND f.arrival = (SELECT min(arrival) FROM {FILES_SQL} g WHERE g.file_hash = f.file_hash)")
def ingest_dedup(spark, sf_dir):
    return catalog.new_files(files(spark, sf_dir), _indexed(spark, sf_dir)).select("id", "file_hash")


@query(
    f"""WITH b AS (SELECT *, max(CASE WHEN error IS NULL AND n_chunks > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_hash ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, file_hash IN (SELECT file_hash FROM {fixture("known")} WHERE status = 'indexed') AS k FROM {fixture("batch")}),
  s AS (SELECT *, CASE WHEN k OR e = 1 THEN 'skipped' WHEN error = 'ocr_unavailable' THEN 'ocr_unavailable' WHEN error IS NOT NULL OR n_chunks = 0 THEN 'failed' ELSE 'success' END AS status FROM b)
SELECT file_name, file_hash, arrival, status, CASE status WHEN 'skipped' THEN 'already indexed' WHEN 'failed' THEN coalesce(error, 'no content') WHEN 'ocr_unavailable' THEN 'no OCR engine' ELSE '' END AS reason FROM s"""
)
def ingest_status(spark, sf_dir):
    return catalog.ingest_status(frame(spark, sf_dir, "batch"), frame(spark, sf_dir, "known"))


@query(_smart("(SELECT doc_id AS id, text FROM documents)", chunking.CHUNK) + " SELECT 'doc_' || id AS file_name, CAST(len(cs) AS BIGINT) AS chunk_count, CASE WHEN id % 2 = 0 AND len(cs) > 1 THEN 'heading,text' WHEN id % 2 = 0 THEN 'heading' ELSE 'text' END AS types FROM every WHERE len(cs) > 0")
def ingest_summary(spark, sf_dir):
    cut = chunking.chunks(files(spark, sf_dir).select("id", "file_name", "text"))
    return catalog.file_summary(cut.withColumn("block_type", F.when((F.col("id") % 2 == 0) & (F.col("chunk_index") == 0), "heading").otherwise("text")))


@query(f"SELECT file_name, file_hash, file_type, category, chunk_count, created_at FROM {_INDEXED} WHERE status = 'indexed'")
def list_files(spark, sf_dir):
    return catalog.list_files(_indexed(spark, sf_dir))


@query(f"SELECT DISTINCT category FROM {_INDEXED} WHERE category <> ''")
def list_categories(spark, sf_dir):
    return catalog.list_categories(_indexed(spark, sf_dir))


@query(f"SELECT id FROM {FILES_SQL} WHERE file_hash IN (SELECT file_hash FROM {_INDEXED} WHERE status = 'indexed')")
def is_indexed(spark, sf_dir):
    return catalog.are_indexed(files(spark, sf_dir), _indexed(spark, sf_dir)).select("id")


_NEW = f"SELECT id + 100000 AS id, file_name, file_hash, file_type, 'new' AS category, 1 AS chunk_count, 'indexed' AS status, -1 AS created_at, -1 AS updated_at FROM {_INDEXED} WHERE id % 10 = 0 UNION ALL SELECT 200000, 'fresh', 'fresh-hash', 'PDF', 'new', 1, 'indexed', -1, -1"


@query(f"SELECT * FROM {_INDEXED} WHERE file_hash NOT IN (SELECT file_hash FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def catalog_upsert(spark, sf_dir):
    known = _indexed(spark, sf_dir)
    changed = known.where("id % 10 = 0").select((F.col("id") + 100000).alias("id"), "file_name", "file_hash", "file_type")
    new = changed.unionByName(spark.createDataFrame([(200000, "fresh", "fresh-hash", "PDF")], "id long, file_name string, file_hash string, file_type string"))
    new = new.withColumns({"category": F.lit("new"), "chunk_count": F.lit(1), "status": F.lit(""), "updated_at": F.lit(-1).cast("long")})
    return catalog.upsert(known, new)


@query(f"SELECT id, file_name FROM {_INDEXED} WHERE file_hash <> (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def delete_by_hash(spark, sf_dir):
    target = files(spark, sf_dir).where("id = 5").first()["file_hash"]
    return catalog.delete_by_hash(_indexed(spark, sf_dir), target).select("id", "file_name")


@query(f"SELECT id, file_name FROM {FILES_SQL} WHERE file_hash NOT IN (SELECT file_hash FROM {_INDEXED} WHERE file_name = 'doc_8' ORDER BY id LIMIT 1)")
def delete_by_name(spark, sf_dir):
    return catalog.delete_by_name(files(spark, sf_dir), _indexed(spark, sf_dir), "doc_8").select("id", "file_name")


@query(f"SELECT file_hash FROM {_INDEXED} WHERE file_name = 'doc_3' ORDER BY id LIMIT 1")
def hash_by_name(spark, sf_dir):
    return catalog.hash_by_name(_indexed(spark, sf_dir), "doc_3")


@query("SELECT doc_id AS id, substr(source, 1, 256) AS category, substr(repeat(source, 200), 1, 512) AS file_name, md5(substr(text, 1, 4000)) AS text FROM documents")
def store_truncation(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.repeat("source", 200).alias("file_name"), "text")
    return catalog.stored(rows).withColumn("text", F.md5("text"))


# ---- retrieval ------------------------------------------------------------------------------------

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COSINE = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({0} AS DOUBLE[])), 4)"


def _vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == vec_id).first()["embedding"])


@query(f"SELECT id, file_name, {_COSINE.format(_Q)} AS score FROM {CHUNKS_SQL} ORDER BY score DESC, id LIMIT 20")
def vector_topk(spark, sf_dir):
    return retrieval.vector_search(chunks(spark, sf_dir), _vector(spark, sf_dir)).select("id", "file_name", "score")


@query(f"SELECT id, category, {_COSINE.format(_Q)} AS score FROM {CHUNKS_SQL} WHERE category = 'src3' ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return retrieval.vector_search(chunks(spark, sf_dir), _vector(spark, sf_dir), 10, category="src3", file_name="").select("id", "category", "score")


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, c.id, {_COSINE.replace("embedding", "c.embedding").format("q.embedding")} AS score FROM {CHUNKS_SQL} c CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 20"""
)
def vector_topk_multi(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.vector_search_many(chunks(spark, sf_dir), own)


@query(f"SELECT vec_id AS id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) * (x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))))), 4) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS first FROM embeddings")
def embed_normalize(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), retrieval.normalised(F.col("embedding")).alias("v"))
    return v.select("id", F.round(retrieval.dot(F.col("v"), F.col("v")), 4).alias("norm"), F.round(F.col("v")[0], 4).alias("first"))


_COUNTS = "length(coalesce(text, '')) AS n_chars, len(regexp_extract_all(coalesce(text, ''), 'th')) AS n_th"


@query(f"SELECT 'document' AS kind, doc_id AS id, {_COUNTS} FROM documents UNION ALL SELECT 'turn' AS kind, conv_id AS id, {_COUNTS} FROM conversations")
def embed_cached(spark, sf_dir):
    """Documents, then turns of conversations, through one cache of vectors; the vectors count characters, for SQL to say."""
    counted = lambda t: F.array(F.length(t), F.size(F.regexp_extract_all(t, F.lit("th"), F.lit(0))))
    cache = EmbeddingCache(spark, new_dir(spark, "embeddings"), "counts-1", counted)
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "text")
    rows = cache.added(own).unionByName(cache.added(turns))
    return rows.select("kind", "id", *(F.col("embedding")[i].cast("long").alias(n) for i, n in enumerate(("n_chars", "n_th"))))


def _vector_index(spark, sf_dir) -> VectorIndex:
    """An index of all vectors in a folder of its own."""
    return VectorIndex(spark, new_dir(spark, "vectors")).build(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id"))


def _asked(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query()
def lsh_knn(spark, sf_dir):
    """Approximate neighbours of one vector from the stored index."""
    one = _asked(spark, sf_dir).where("query_id = 0")
    return _vector_index(spark, sf_dir).search(one, 20).select("id", "score")


@query()
def vector_index_multi(spark, sf_dir):
    """Approximate neighbours of every vector whose id is divisible by 50; tests measure the recall."""
    return _vector_index(spark, sf_dir).search(_asked(spark, sf_dir), 20)


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COSINE.replace("embedding", "c.embedding").format("q.embedding")} AS score FROM embeddings c CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 20"""
)
def vector_index_all_cells(spark, sf_dir):
    """The same with every cell visited: codes choose, vectors decide, and the result is exact."""
    return _vector_index(spark, sf_dir).search(_asked(spark, sf_dir), 20, probes=1 << 20)


_WORDS = ("the", "and", "thion", "ther")
_HELD = " + ".join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in _WORDS)


def _kw(limit: int) -> str:
    match = " OR ".join(f"contains(text, '{w}')" for w in _WORDS)
    return f"""SELECT id, file_name, file_hash, category, page, block_type, heading_path, table_headers, chunk_index, text, CAST(({_HELD}) AS DOUBLE) / {len(_WORDS)} AS kw_score FROM (
  SELECT * FROM {CHUNKS_SQL} WHERE text <> '' AND ({match}) ORDER BY id LIMIT {limit}) WHERE length({_trim("text")}) >= 10"""


@query(f"SELECT id, file_name, kw_score FROM ({_kw(20)})")
def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(chunks(spark, sf_dir), list(_WORDS)).select("id", "file_name", "kw_score")


@query(f"SELECT id, file_name, coalesce(category, '') AS category, page, block_type, heading_path, table_headers, chunk_index, md5(text) AS text FROM {CHUNKS_SQL}")
def projection(spark, sf_dir):
    return retrieval.project(chunks(spark, sf_dir)).drop("file_hash").withColumn("text", F.md5("text"))


# ---- BM25 -----------------------------------------------------------------------------------------

_TOKENS = rf"list_filter(regexp_split_to_array(lower(regexp_replace(text, '[\p{{P}}\p{{S}}]+', ' ', 'g')), '[\s\p{{Z}}]+'), lambda t: t <> '' AND t NOT IN ({_quoted(tx.BM25_STOP_WORDS)}))"
_POST = f"tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL), len AS (SELECT doc_id, len(t) AS dl FROM tok WHERE len(t) > 0), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len)"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n, md5(array_to_string({_TOKENS}, '|')) AS tokens FROM documents")
def bm25_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.bm25_tokens("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens"))


@query(f"WITH {_POST} SELECT doc_id, term, tf FROM post")
def bm25_postings(spark, sf_dir):
    return bm25.postings(documents(spark, sf_dir))


@query(f"WITH {_POST} SELECT term, df FROM df")
def bm25_df(spark, sf_dir):
    return bm25.frequencies(bm25.postings(documents(spark, sf_dir)))


@query(f"WITH {_POST} SELECT n, round(avgdl, 4) AS avgdl FROM st")
def bm25_stats(spark, sf_dir):
    return bm25.statistics(bm25.lengths(bm25.postings(documents(spark, sf_dir)))).select("n", F.round("avgdl", 4).alias("avgdl"))


def _search_sql(queries: str, docs: str, top: int) -> str:
    tokens = _TOKENS
    return f"""WITH d AS (SELECT id AS doc_id, text FROM {docs}), tok AS (SELECT doc_id, {tokens} AS t FROM d), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL), len AS (SELECT doc_id, len(t) AS dl FROM tok WHERE len(t) > 0),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
  q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens}) AS term FROM (SELECT query_id, query AS text FROM {queries})) GROUP BY ALL),
  s AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 4) AS score FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN st GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= {top}"""


@query(_search_sql("(SELECT 0 AS query_id, 'thion and heation of thing' AS query)", "(SELECT doc_id AS id, text FROM documents)", 10))
def bm25_search(spark, sf_dir):
    return bm25.search(documents(spark, sf_dir), spark.range(1).select(F.lit(0).alias("query_id"), F.lit("thion and heation of thing").alias("query")))


@query(_search_sql("(SELECT item_id AS query_id, text AS query FROM benchmark)", "(SELECT doc_id AS id, text FROM documents)", 10))
def bm25_search_multi(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.search(documents(spark, sf_dir), own)


@query(_search_sql("(SELECT item_id AS query_id, text AS query FROM benchmark)", "(SELECT doc_id AS id, text FROM documents)", 10))
def bm25_index_search(spark, sf_dir):
    """The same rows from the stored index, to which the documents came in two batches."""
    index, late = StoredIndex(spark, new_dir(spark, "postings")), F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    index.add(documents(spark, sf_dir).where(~late))
    index.add(documents(spark, sf_dir).where(late))
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query(_search_sql("(SELECT item_id AS query_id, text AS query FROM benchmark)", "(SELECT doc_id AS id, text FROM documents WHERE source <> 'src3')", 10))
def bm25_index_deleted(spark, sf_dir):
    """All documents are entered, one source's are deleted: statistics and hits are those of the rest."""
    index = StoredIndex(spark, new_dir(spark, "postings"))
    index.add(documents(spark, sf_dir))
    index.delete(documents(spark, sf_dir).where("source = 'src3'"))
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query(f"SELECT doc_id AS id, score, rank FROM ({_search_sql(chr(40) + 'SELECT 0 AS query_id, ' + chr(39) + 'thion her ther' + chr(39) + ' AS query)', f'(SELECT * FROM {CHUNKS_SQL} WHERE category = {chr(39)}src2{chr(39)} ORDER BY id LIMIT 1000)', 20)})")
def bm25_pool_filtered(spark, sf_dir):
    return bm25.pool_search(chunks(spark, sf_dir), "thion her ther", category="src2").select("id", "score", "rank")


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE doc_id = 17")
def bm25_document(spark, sf_dir):
    return bm25.document(documents(spark, sf_dir), 17).select("doc_id", F.md5("text").alias("text"))


# ---- fusion and answers -----------------------------------------------------------------------------

_VEC = f"SELECT *, {_COSINE.format(_Q)} AS score FROM {CHUNKS_SQL} ORDER BY score DESC, id LIMIT 20"
_FUSED = f"""WITH v AS ({_VEC}), vl AS (SELECT * FROM v WHERE length({_trim("text")}) >= 10), k AS ({_kw(10)}),
  f AS (SELECT coalesce(vl.id, k.id) AS id, coalesce(vl.file_name, k.file_name) AS file_name, coalesce(vl.category, k.category) AS category, coalesce(vl.text, k.text) AS text, coalesce(vl.score, 0.0) AS score, coalesce(k.kw_score, 0.0) AS kw_score FROM vl FULL OUTER JOIN k ON vl.file_hash = k.file_hash AND vl.chunk_index = k.chunk_index),
  r AS (SELECT *, CAST(row_number() OVER (ORDER BY (kw_score >= 1) DESC, round(score * 0.6 + kw_score * 0.4, 10) DESC, id) AS INTEGER) AS rank FROM f)"""


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    own = chunks(spark, sf_dir)
    return retrieval.vector_search(own, _vector(spark, sf_dir), 20).drop("embedding"), retrieval.keyword_search(own.drop("embedding"), list(_WORDS), 10)


@query(_FUSED + " SELECT id, file_name, score, kw_score FROM f")
def hybrid_fusion(spark, sf_dir):
    return fusion.fuse(*_hits(spark, sf_dir)).select("id", "file_name", "score", "kw_score")


@query(_FUSED + " SELECT id, file_name, category, score, kw_score, rank FROM r WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    hits = fusion.multi_stage(chunks(spark, sf_dir), " ".join(_WORDS), _vector(spark, sf_dir), 5)
    return hits.select("id", "file_name", "category", "score", "kw_score", "rank")


@query(_FUSED + " SELECT rank AS id, file_name, category, 1 AS page, 'text' AS block_type, '' AS heading_path, substr(text, 1, 300) AS text_snippet, round(score, 4) AS score FROM r WHERE rank <= 5")
def search_citations(spark, sf_dir):
    return respond.citations(fusion.multi_stage(chunks(spark, sf_dir), " ".join(_WORDS), _vector(spark, sf_dir), 5))


#: The best chunks by vector, with the share of words that they hold and a reranker's stand-in score.
_HITS = f"""(SELECT id, file_name, category, page, block_type, heading_path, text, score, ({' + '.join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in _WORDS)}) / {len(_WORDS)}.0 AS kw_score, CAST(length(text) % 100 AS DOUBLE) / 100 AS rerank FROM ({_VEC}))"""


def _scored(spark, sf_dir) -> DataFrame:
    held = sum((F.contains("text", F.lit(w)).cast("int") for w in _WORDS), F.lit(0))
    hits = retrieval.vector_search(chunks(spark, sf_dir), _vector(spark, sf_dir), 20)
    return hits.withColumns({"kw_score": held.cast("double") / len(_WORDS), "rerank": (F.length("text") % 100).cast("double") / 100})


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY (kw_score >= 1) DESC, round(score * 0.6 + kw_score * 0.4, 10) DESC, id) AS INTEGER) AS rank FROM {_HITS}")
def fusion_order(spark, sf_dir):
    return fusion.by_fusion(_scored(spark, sf_dir)).select("id", "rank")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY round(score * 0.7 + kw_score * 0.3, 10) DESC, id) AS INTEGER) AS rank FROM {_HITS}")
def rerank_fallback_order(spark, sf_dir):
    return fusion.by_fallback(_scored(spark, sf_dir)).select("id", "rank")


@query(f"SELECT id, round(s, 4) AS rerank_score, CAST(row_number() OVER (ORDER BY s DESC, id) AS INTEGER) AS rank FROM (SELECT id, CASE WHEN kw_score >= 0.5 THEN greatest(rerank, 0.85 * max(rerank) OVER ()) ELSE rerank END AS s FROM {_HITS})")
def rerank_floor(spark, sf_dir):
    return fusion.by_rerank(_scored(spark, sf_dir).withColumnRenamed("rerank", "rerank_score")).select("id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query(f"SELECT CAST(r AS INTEGER) AS id, file_name, category, page, block_type, heading_path, substr(text, 1, 300) AS text_snippet, round(rerank, 4) AS score FROM (SELECT *, row_number() OVER (ORDER BY rerank DESC, id) AS r FROM {_HITS})")
def citations(spark, sf_dir):
    hits = _scored(spark, sf_dir).withColumnRenamed("rerank", "rerank_score")
    return respond.citations(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "id"))))


_LISTY = " OR ".join(f"contains(query, '{w}')" for w in tx.LIST_QUERY_WORDS)


@query(f"SELECT id, CAST(CASE WHEN {_LISTY} THEN least(2 * top_k, 20) ELSE top_k END AS INTEGER) AS k, CASE WHEN {_LISTY} THEN 'list_' ELSE '' END || CASE WHEN n_hits = 0 THEN 'empty' WHEN reranked THEN 'rerank' WHEN any_keyword THEN 'hybrid' ELSE 'vector' END AS mode FROM {fixture('modes')}")
def search_mode(spark, sf_dir):
    asked = frame(spark, sf_dir, "modes")
    mode = fusion.mode_of(F.col("query"), F.col("n_hits"), F.col("any_keyword"), F.col("reranked"))
    return asked.select("id", fusion.effective_k(F.col("query"), F.col("top_k")).alias("k"), mode.alias("mode"))


_RANKED = f"(SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {_HITS})"


def _ranked(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query(
    f"""WITH h AS {_RANKED} SELECT string_agg('[来源' || rank || '] ' || CASE WHEN category <> '' THEN '分类：' || category || ' / ' ELSE '' END || '文件：' || file_name || ' 第' || page || '页' || CASE WHEN heading_path <> '' THEN ' / ' || heading_path ELSE '' END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
  (SELECT string_agg(category, '、' ORDER BY r) FROM (SELECT category, min(rank) AS r FROM h WHERE category <> '' GROUP BY category)) AS categories FROM h"""
)
def prompt_context(spark, sf_dir):
    return respond.prompt_context(_ranked(spark, sf_dir))


@query(f"SELECT '{respond.DIGEST_HEAD}' || chr(10) || chr(10) || string_agg('[来源' || rank || '] ' || file_name || ' 第' || page || '页' || chr(10) || substr(text, 1, 300), chr(10) || chr(10) ORDER BY rank) AS answer FROM {_RANKED}")
def digest_fallback(spark, sf_dir):
    return respond.digest(_ranked(spark, sf_dir))


@query(
    f"""SELECT id, CASE WHEN len(categories) = 1 THEN categories[1] WHEN list_contains(categories, p) THEN p WHEN contains(p, '全部') OR contains(p, '无法') THEN NULL
  ELSE list_filter(categories, lambda c: contains(p, c) OR contains(c, p))[1] END AS category FROM (SELECT id, categories, trim(trim(reply), '"') AS p FROM {fixture("replies")})"""
)
def category_route(spark, sf_dir):
    return frame(spark, sf_dir, "replies").select("id", respond.route(F.col("reply"), F.col("categories")).alias("category"))


_SCOPED = "SELECT 'none' AS scope, id, score FROM (SELECT id, {0} AS score FROM {1} ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT 'src4', id, score FROM (SELECT id, {0} AS score FROM {1} WHERE category = 'src4' ORDER BY score DESC, id LIMIT 5)"


@query(_SCOPED.format(_COSINE.format(_Q), CHUNKS_SQL))
def scoped_fallback(spark, sf_dir):
    own, vector = chunks(spark, sf_dir), _vector(spark, sf_dir)
    everywhere = retrieval.vector_search(own, vector, 5).select("id", "score")
    out = []
    for name in ("none", "src4"):
        hits = respond.scoped_or_all(retrieval.vector_search(own, vector, 5, category=name).select("id", "score"), everywhere)
        out.append(hits.select(F.lit(name).alias("scope"), "id", "score"))
    return out[0].unionByName(out[1])


@query(f"SELECT id, md5(text) AS page_content, file_name, file_hash, CAST(page AS VARCHAR) AS page, CAST(chunk_index AS VARCHAR) AS chunk_index FROM {CHUNKS_SQL}")
def chunk_metadata_map(spark, sf_dir):
    told = respond.chunk_documents(chunks(spark, sf_dir))
    return told.select("id", F.md5("page_content").alias("page_content"), *(F.col("metadata")[k].alias(k) for k in ("file_name", "file_hash", "page", "chunk_index")))
