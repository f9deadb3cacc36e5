"""Citations, prompts, routing and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import location, snippet

# The answers without a model, whose wording callers see.
NO_ANSWER = "知识库中未找到相关内容。"
DIGEST_HEAD = "（LLM 暂不可用，以下为检索到的相关内容）"

# What the model is told.  Sources are quoted as [来源N], which answers cite; 全部 names no category.
PROMPT = """Answer the question below from the numbered passages and from nothing else, in the language of the question.
{hint}Put the mark of the passage, [来源N], behind every statement that rests on it; behind one that rests on several, put all their marks.
If the passages do not answer the question, say so instead of guessing.  Be brief and orderly.

Passages:

{context}

Question: {query}
"""
CATEGORY_HINT = "The passages were filed under: {categories}.  Keep what comes from different files apart.\n"
ROUTE_PROMPT = "A library is filed under these headings: {categories}.\nA reader asks: {query}\nReply with the one heading to look under and no other word; reply 全部 if several would do or none fits."


def citations(hits: DataFrame) -> DataFrame:
    """Ranked hits -> what an answer shows of its sources."""
    score = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    return hits.select(F.col("rank").cast("int").alias("id"), "file_name", "category", "page", "block_type", "heading_path", snippet("text").alias("text_snippet"), F.round(score, 4).alias("score"))


def _joined(hits: DataFrame, part: Column, separator: str, name: str) -> DataFrame:
    """One row: the parts in rank order.  ``hits`` is a cut top list, so the list is short."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), separator).alias(name))


def prompt_context(hits: DataFrame) -> DataFrame:
    """The sources as the prompt quotes them, and their distinct categories in order of rank."""
    source = F.concat(F.lit("[来源"), F.col("rank").cast("string"), F.lit("] "), location(F.col("file_name"), F.col("page"), F.col("category"), F.col("heading_path")), F.lit("\n"), F.col("text"))
    firsts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]))
    ordered = F.array_sort(F.collect_list(F.struct("rank", source.alias("part"))))
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n---\n\n").alias("context"), F.array_join(F.filter(firsts, lambda c: c != ""), "、").alias("categories"))


def digest(hits: DataFrame) -> DataFrame:
    """The answer without a model: the beginnings of the sources."""
    part = F.concat(F.lit("[来源"), F.col("rank").cast("string"), F.lit("] "), "file_name", F.lit(" 第"), F.col("page").cast("string"), F.lit("页\n"), snippet("text"))
    return _joined(hits, part, "\n\n", "body").select(F.concat(F.lit(DIGEST_HEAD + "\n\n"), "body").alias("answer"))


def route(reply: Column, categories: Column) -> Column:
    """The category that a model's reply names; null searches everywhere.

    ``categories`` is sorted; a single one needs no reply, and an empty reply, being part of any name, takes the first.
    """
    plain = F.regexp_replace(F.trim(reply), '^"+|"+$', "")
    near = F.get(F.filter(categories, lambda c: F.contains(plain, c) | F.contains(c, plain)), F.lit(0))
    return F.when(F.size(categories) == 1, categories[0]).when(F.array_contains(categories, plain), plain).when(F.contains(plain, F.lit("全部")) | F.contains(plain, F.lit("无法")), None).otherwise(near)


def scoped_or_all(in_scope: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Hits in scope, or those of the whole corpus where there are none (both are cut top lists)."""
    some = in_scope.select(F.lit(1).alias("__some")).limit(1)
    return in_scope.unionByName(everywhere.join(F.broadcast(some), F.lit(True), "left_anti"))


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunks as page content with a map of metadata."""
    names = [c for c in ("file_name", "file_path", "file_hash", "page", "block_type", "heading_path", "chunk_index") if c in chunks.columns]
    pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
    return chunks.select("id", F.col("text").alias("page_content"), F.create_map(*pairs).alias("metadata"))


def answer(hits: DataFrame, query: str, model: Callable[[str], str] | None) -> tuple[str, bool]:
    """(answer, whether a model gave it): the only step that leaves the cluster, for a list of at most 20 hits."""
    row = prompt_context(hits).first()
    if not row["context"]:
        return NO_ANSWER, False
    hint = CATEGORY_HINT.format(categories=row["categories"]) if row["categories"] else ""
    try:
        if model is None:
            raise RuntimeError("no language model")
        return model(PROMPT.format(hint=hint, context=row["context"], query=query)), True
    except Exception:
        return digest(hits).first()["answer"], False
