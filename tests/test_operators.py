"""Hand-made cases and properties of the retrieval engine's operators."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from docmill.functions import structure as st
from docmill.functions import text as tx
from docmill.operators import bm25, chunking, fusion, layout, respond, retrieval
from docmill.operators.plugins import embed_column, hashing_embedder, recognise_column, rerank_with, segment_column
from docmill.plans.engine import Engine

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


BOXES = (
    "image int, ord int, x1 double, y1 double, x2 double, y2 double, text string",
    [
        (1, 1, 0.0, 0.0, 20.0, 20.0, "A"),
        (1, 2, 100.0, 0.0, 120.0, 20.0, "B"),
        (1, 3, 200.0, 2.0, 220.0, 22.0, "C"),
        (1, 4, 0.0, 50.0, 20.0, 70.0, "1"),
        (1, 5, 200.0, 50.0, 220.0, 70.0, "3"),
        (2, 1, 50.0, 10.0, 90.0, 30.0, "right"),
        (2, 2, 0.0, 12.0, 40.0, 30.0, "left"),
        (2, 3, 0.0, 24.0, 40.0, 42.0, "low"),
        (2, 4, 5.0, 80.0, 45.0, 99.0, "end"),
        (3, 1, 0.0, 0.0, 30.0, 10.0, "one"),
        (3, 2, 40.0, 1.0, 70.0, 11.0, "row"),
        *[(4, r * 2 + k, 100.0 + 80 * k, 30.0 * r, 150.0 + 80 * k, 30.0 * r + 12, f"{'v' if r > 3 else 't'}{r}{k}") for r in range(18) for k in range(2)],
    ],
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def twin(text: str, most: int) -> list[str]:
    """Chunking restated as a walk over units, to hold the folds against."""

    def pack(units, joiner):
        out, held = [], []
        n = 0
        for u in units:
            if held and n + len(u) > most:
                out.append(joiner.join(held))
                held, n = [held[-1]], len(held[-1])
            held, n = [*held, u], n + len(u)
        return out + [joiner.join(held)] * bool(held)

    if len(text) <= most:
        return [text]
    units = []
    for p in filter(None, (p.strip() for p in re.split("\n\n+", text))):
        units += [p] if len(p) <= most else pack(re.split("(?<=[。！？；\n])", p), "")
    return [c for c in pack(units, "\n\n") if c.strip()]


@SLOW
@given(hs.lists(hs.text(alphabet="ab。\n 中；", max_size=60), min_size=1, max_size=20), hs.integers(3, 20))
def test_chunks_are_the_twins(spark, texts, most):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", chunking.smart_chunk(F.col("t"), most).alias("c")).collect():
        assert r.c == twin(r.t, most)
        if len(r.t) > most:  # nothing but white space is lost
            assert set("".join(r.c)) - set(" \n") == set(r.t) - set(" \n")


@pytest.mark.parametrize(("text", "most", "want"), [("", 5, [""]), ("aaaa\n\nbbbb\n\ncccc", 8, ["aaaa\n\nbbbb", "bbbb\n\ncccc"]), ("abcdefghijkl", 5, ["abcdefghijkl"]), ("一二三。四五六。七八九。", 8, ["一二三。四五六。", "一二三。四五六。\n\n四五六。七八九。"])])
def test_chunk_cases(spark, text, most, want):
    assert one(spark, chunking.smart_chunk(F.lit(text), most)) == want


def test_windows_cover_all_rows(spark):
    rows = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: x.cast("string"))
    got = one(spark, chunking.row_windows(rows, 4, 2))
    assert [(w.start, w.rows) for w in got] == [(0, list("0123")), (2, list("2345")), (4, list("456")), (6, ["6"])]


def test_keywords(spark):
    assert one(spark, tx.keywords(F.lit("aa bbb cccc aa ddddd ee ff gg hh ii"))) == ["ddddd", "cccc", "bbb", "aa", "ee", "ff", "gg", "hh"]
    assert one(spark, tx.keywords(F.lit("  "))) == []
    assert one(spark, tx.keywords(F.lit("你好，所有 —— BDO"))) == ["BDO", "你好"]


@SLOW
@given(hs.text(alphabet="ab 中,。.!-_", max_size=80))
def test_keywords_are_distinct_and_fall_in_length(spark, t):
    got = one(spark, tx.keywords(F.lit(t)))
    assert len(got) == len(set(got)) <= 8 and [len(w) for w in got] == sorted(map(len, got), reverse=True)


def test_clean_text_takes_pairs_once(spark):
    assert one(spark, tx.clean_text(F.lit("中 文 字 符"))) == "中文 字符"
    assert one(spark, tx.clean_text(F.lit("　a\n\n\n\nb "))) == "a\n\nb"


def test_heading_paths(spark):
    rows = spark.createDataFrame([(1, i, lv, t) for i, (lv, t) in enumerate([(1, "A"), (2, "B"), (3, "C"), (2, "D"), (1, "E")])], "doc int, ord int, level int, text string")
    assert [r.heading_path for r in st.with_heading_path(rows, "doc", "ord").orderBy("ord").collect()] == ["A", "A > B", "A > B > C", "A > D", "E"]


@SLOW
@given(hs.lists(hs.integers(0, 5), min_size=1, max_size=25))
def test_heading_paths_are_a_stack(spark, levels):
    rows = spark.createDataFrame([(1, i, lv, f"t{i}") for i, lv in enumerate(levels)], "doc int, ord int, level int, text string")
    stack, want = [], []
    for i, lv in enumerate(levels):
        if lv:
            stack = [x for x in stack if x[0] < lv] + [(lv, f"t{i}")]
        want.append(" > ".join(t for _, t in stack))
    assert [r.heading_path for r in st.with_heading_path(rows, "doc", "ord").orderBy("ord").collect()] == want


def test_bm25_scores(spark):
    docs = spark.createDataFrame([(1, "spark sql engine"), (2, "spark streaming"), (3, "vector search engine"), (4, "...")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "spark engine")], "query_id int, query string")
    assert [(r.doc_id, r.score) for r in bm25.search(docs, q).orderBy("rank").collect()] == [(1, 0.8943), (2, 0.5235), (3, 0.4471)]
    twice = spark.createDataFrame([(0, "spark spark")], "query_id int, query string")
    assert bm25.search(docs, twice).count() == 2
    assert bm25.search(docs.limit(0), q).count() == 0


def test_fusion_orders(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.2), (2, 0.1, 1.0), (3, 0.5, 0.9)], "id int, score double, kw_score double")
    assert [r.id for r in fusion.by_fusion(rows).orderBy("rank").collect()] == [2, 3, 1]
    rr = spark.createDataFrame([(1, 0.0, 0.9), (2, 0.5, 0.1), (3, 0.4, 0.5)], "id int, kw_score double, rerank_score double")
    assert {r.id: round(r.rerank_score, 4) for r in fusion.by_rerank(rr).collect()} == {1: 0.9, 2: 0.765, 3: 0.5}
    k = lambda query, top_k: one(spark, fusion.effective_k(F.lit(query), F.lit(top_k)))
    assert (k("列表 x", 5), k("列表 x", 15), k("plain", 5)) == (10, 20, 5)


def test_layout_cases(spark):
    got = {r.image: r.text for r in layout.rebuild_table(spark.createDataFrame(BOXES[1], BOXES[0])).collect()}
    assert got[1] == "A  B  C\n1  -  3"
    lines = {r.image: r.text.split("\n") for r in layout.rows_to_text(spark.createDataFrame(BOXES[1], BOXES[0])).collect()}
    assert lines[4][3] == "t30  t31" and lines[4][4] == "1月  v40  v41" and lines[4][17] == "累计均价  v170  v171"


def test_routes(spark):
    cats = F.array(F.lit("A"), F.lit("B"))
    assert [one(spark, respond.route(F.lit(r), cats)) for r in ("B", "全部", "类别A", "", "zzz")] == ["B", None, "A", "A", None]


def corpus(spark):
    rows = [(i, f"f{i}.pdf", f"h{i}", ["法规", "报告"][i % 2], 1, "text", "", "", 0, t) for i, t in enumerate(["排污 许可证 管理 办法 全文", "能源 管理 报告 二零二三年度", "short", "绿色 工厂 评价 导则 正文"])]
    df = spark.createDataFrame(rows, "id int, file_name string, file_hash string, category string, page int, block_type string, heading_path string, table_headers string, chunk_index int, text string")
    files = df.select(F.col("id").cast("long").alias("id"), "file_name", "file_hash", F.lit("PDF").alias("file_type"), "category", F.lit(1).alias("chunk_count"), F.lit("indexed").alias("status"), F.lit(0).alias("created_at"))
    return df.withColumn("embedding", embed_column(F.col("text"), hashing_embedder)), files


def test_engine_answers(spark):
    chunks, files = corpus(spark)
    embed = lambda t: hashing_embedder()([t])[0]
    engine = Engine(spark, chunks, files, embed)
    hits, mode = engine.search("排污 许可证", 2)
    assert mode == "hybrid" and hits.orderBy("id").first().file_name == "f0.pdf"
    assert engine.query("许可证", category="没有")["citations"][0]["id"] == 1  # falls back to the whole corpus
    assert engine.query("能源 管理", 3)["answer"].startswith(respond.DIGEST_HEAD)
    told = Engine(spark, chunks, files, embed, model=lambda p: "报告" if "one heading" in p else "答案").query("能源 管理")
    assert told["answer"] == "答案" and told["llm_available"] and {c["category"] for c in told["citations"]} == {"报告"}
    assert Engine(spark, chunks.limit(0), files, embed).query("x y")["answer"] == respond.NO_ANSWER
    assert engine.health()["status"] == "degraded"
    with pytest.raises(ValueError, match="top_k"):
        engine.search("x", 21)
    engine.delete_file("f0.pdf")
    assert engine.files().count() == 3 and [r[0] for r in engine.categories().collect()] == ["报告", "法规"]
    with pytest.raises(KeyError):
        engine.delete_file("f0.pdf")


def test_rerankers(spark):
    chunks, _ = corpus(spark)
    vector = hashing_embedder()(["能源 管理"])[0]
    ranked = fusion.multi_stage(chunks, "能源 管理", vector, 3, reranker=rerank_with(lambda pairs: [float(len(t)) for _, t in pairs]))
    assert ranked.where("rank = 1").first().rerank_score > 0

    def broken(hits, query):
        raise RuntimeError("no model")

    assert fusion.multi_stage(chunks, "能源 管理", vector, 2, reranker=broken).count() == 2


def test_recognisers_chain(spark):
    def bad(data, name):
        raise OSError

    df = spark.createDataFrame([(bytearray(b"x"), "a.png"), (bytearray(b""), "b.png")], "image binary, name string")
    got = df.select(recognise_column(F.col("image"), F.col("name"), [bad, lambda d, n: " ", lambda d, n: n.upper() if d else ""]).alias("t")).collect()
    assert [r.t for r in got] == ["A.PNG", ""]


def test_keyword_search_bounds(spark):
    chunks, _ = corpus(spark)
    assert retrieval.keyword_search(chunks.drop("embedding"), []).count() == 0
    assert all(0 <= r.kw_score <= 1 for r in retrieval.keyword_search(chunks.drop("embedding"), ["管理", "报告"]).collect())


def test_vector_search_takes_any_number_of_queries(spark, monkeypatch):
    vectors = [(i, [float(i % 7 - 3), float(i % 5 + 1), float(i * i % 11)]) for i in range(60)]
    chunks = spark.createDataFrame(vectors, "id long, embedding array<float>")
    queries = spark.createDataFrame(vectors, "query_id long, query_vector array<float>")
    search = lambda: sorted(tuple(r) for r in retrieval.vector_search_many(chunks, queries, 4).collect())
    whole = search()
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 10)
    assert len(whole) == 240 and search() == whole


def test_bm25_tasks_grow_with_pairs_of_queries_and_documents(spark, monkeypatch):
    """A task holds few pairs, and documents that repeat an id are one if they are as long."""
    from docmill.operators import bm25

    docs = spark.createDataFrame([*((i, f"w{i % 7} w{i % 3} w1") for i in range(60)), (5, "w5 w2 w9"), (None, "w1 w4"), (61, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} w1 w1") for i in range(8)], "query_id long, query string")
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = rows(bm25.search(docs, asked, 5))
    monkeypatch.setattr(bm25, "PAIRS", 50)
    found = bm25.search(docs, asked, 5)
    assert rows(found) == want
    assert "RepartitionByExpression [doc_id" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and f", {-(-8 * 63 // 50)}" in plan
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    assert rows(bm25.search(docs, asked, 5)) == want
