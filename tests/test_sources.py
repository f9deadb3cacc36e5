"""Office files, their chunks, and ingest in batches and as a stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.plans.ingest import chunk_blocks, chunked, ingest, ingest_into
from docmill.schemas import BLOCKS, FILES
from docmill.sources.embeddings import EmbeddingCache
from docmill.sources.files import blocks, docx_blocks, read_files, sheet_blocks
from docmill.sources.store import Store
from docmill.streaming.ingest import watch

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(files: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)  # a fixed time, so equal content has equal bytes
    return out.getvalue()


def p(text: str, style: str = "", size: int = 0, bold: bool = False, inner: str = "") -> str:
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    run = f"<w:rPr>{'<w:b/>' if bold else ''}{f'<w:sz w:val="{size}"/>' if size else ''}</w:rPr>"
    return f"<w:p>{props}<w:r>{run}<w:t>{text}</w:t>{inner}</w:r></w:p>"


def docx() -> bytes:
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (("k", "v"), ("", ""), ("a", "1"))) + "</w:tbl>"
    image = p("", inner='<a:blip r:embed="r1"/>')
    body = p("Report", "H1") + p("intro text") + p("one", "LP") + p("") + p("two", "LP") + p("2.1 Scope", size=24) + p("表 1 values") + table + p("big", size=40) + image + p("three", "LP")
    return zipped(
        {
            "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
            "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="LP"><w:name w:val="List Paragraph"/></w:style></w:styles>',
            "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/image" Target="media/i.png"/></Relationships>',
            "word/media/i.png": b"picture",
        }
    )


def xlsx() -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> value </t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3.50</v></c></row><row r="3"><c r="B3" s="1"><v>45351</v></c></row><row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5"><v>1200</v></c></row>'
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><r><t>al</t></r><r><t>pha</t></r></si></sst>",
            "xl/styles.xml": f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>',
        }
    )


def test_sheets_are_typed_and_merged():
    (b,) = sheet_blocks(xlsx())
    assert b["text"] == "Data" and b["grid"] == [["name", "value"], ["alpha", "3.5"], ["alpha", "2024-02-29"], ["", ""], ["True", "1200"]]


def test_documents_keep_their_order():
    got = list(docx_blocks(docx()))
    assert [b["kind"] for b in got] == ["paragraph"] * 7 + ["table", "paragraph", "image", "paragraph", "paragraph"]
    assert got[0]["style"] == "heading 1" and got[7]["grid"] == [["k", "v"], ["", ""], ["a", "1"]] and got[8]["avg_size"] == 20.0 and got[9]["image"] == b"picture"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.docx").write_bytes(docx())
    (tmp_path / "in/sub/copy.docx").write_bytes(docx())
    (tmp_path / "in/b.xlsx").write_bytes(xlsx())
    (tmp_path / "in/broken.xlsx").write_bytes(b"not a zip")
    (tmp_path / "in/c.txt").write_text("ignored")
    return tmp_path


def test_ingest(spark, folder):
    known = spark.createDataFrame([], "file_hash string, status string")
    files = read_files(spark, str(folder / "in"))
    assert {r.file_name: r.parser for r in files.collect()} == {"a.docx": "docx", "copy.docx": "docx", "b.xlsx": "sheet", "broken.xlsx": "sheet", "c.txt": None}
    errors = blocks(files).where("error is not null").collect()
    assert [e.file_name for e in errors] == ["broken.xlsx"] and "BadZipFile" in errors[0].error
    chunks, fresh = ingest(spark, files, known, "cat", recognise=lambda image, name: F.lit("recognised words"))
    rows = [(r.chunk_index, r.block_type, r.heading_path, r.text) for r in chunks.where("file_name like '%.docx'").orderBy("chunk_index").collect()]
    assert rows == [
        (0, "heading", "Report", "Report"),
        (1, "text", "Report", "intro text"),
        (2, "text", "Report", "• one\n• two"),
        (3, "heading", "Report > 2.1 Scope", "2.1 Scope"),
        (4, "text", "Report > 2.1 Scope", "表 1 values"),
        (5, "table", "Report > 2.1 Scope", "[表 1 values]\nk | v\na | 1"),
        (6, "heading", "big", "big"),
        (7, "image", "big", "recognised words"),
        (8, "text", "big", "• three"),
    ]
    sheet = chunks.where("file_name = 'b.xlsx'").collect()
    assert [(r.heading_path, r.text, r.table_headers, r.page, r.category) for r in sheet] == [("Sheet: Data / 行2~4", "[Sheet: Data]（行2~4）\nname | value\nalpha | 3.5\nalpha | 2024-02-29\nTrue | 1200", "name|value", 1, "cat")]
    again, left = ingest(spark, files, fresh.select("file_hash", F.lit("indexed").alias("status")))
    assert left.count() == 0 and again.count() == 0


def test_pdf_blocks(spark):
    rows = [
        ("h", "f.pdf", "/f.pdf", 1, 0, "paragraph", "1.1 Title", "", None, 18.0, True, None, None, None),
        ("h", "f.pdf", "/f.pdf", 1, 1, "paragraph", "short", "", None, 10.0, False, None, None, None),
        ("h", "f.pdf", "/f.pdf", 1, 2, "paragraph", "more body", "", None, 10.0, False, None, None, None),
        ("h", "f.pdf", "/f.pdf", 1, 3, "paragraph", "a | b", "", None, 10.0, False, None, None, None),
        ("h", "f.pdf", "/f.pdf", 1, 4, "table", None, "", None, None, None, [["a", "b"], ["1", "2"], ["", ""]], None, None),
        ("h", "f.pdf", "/f.pdf", 2, 0, "ocr_page", "scanned words", "", None, None, None, None, None, None),
        ("h", "f.pdf", "/f.pdf", 2, 1, "paragraph", "not seen", "", None, 10.0, False, None, None, None),
        ("h", "f.pdf", "/f.pdf", 3, 0, "paragraph", "x" * 410, "", None, 10.0, False, None, None, None),
        ("h", "f.pdf", "/f.pdf", 3, 1, "paragraph", "tail", "", None, 10.0, False, None, None, None),
    ]
    got = chunk_blocks(spark.createDataFrame(rows, BLOCKS)).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page, r.block_type, r.heading_path, r.text) for r in got] == [
        (0, 1, "table", "", "[表格] a | b\na: 1 | b: 2"),
        (1, 1, "heading", "1.1 Title", "1.1 Title"),
        (2, 1, "text", "1.1 Title", "short\nmore body"),
        (3, 2, "image", "1.1 Title", "scanned words"),
        (4, 3, "text", "1.1 Title", "x" * 410),
        (5, 3, "text", "1.1 Title", "tail"),
    ]


def test_images_of_a_page_are_read_once_and_not_when_small(spark, tmp_path):
    """As a reader of paged files gives them: a repeated reference, a narrow image, one without a size."""

    def pages(data):
        for ref, width in ((1, 300), (1, 300), (2, 99), (3, 100), (None, None)):
            yield {"kind": "image", "page": 1, "text": f"image {ref}", "image": b"x", "xref": ref, "width": width, "height": width}
        yield {"kind": "image", "page": 2, "text": "image 1 again", "image": b"x", "xref": 1, "width": 300, "height": 300}

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"data")
    files = read_files(spark, str(tmp_path / "in"))
    chunks, _ = ingest(spark, files, spark.createDataFrame([], FILES), "c", extractors={"pdf": pages}, recognise=lambda image, text: text)
    assert sorted((r.page, r.text) for r in chunks.collect()) == [(1, "image 1"), (1, "image 3"), (1, "image None"), (2, "image 1 again")]


def test_stream_skips_copies_and_tries_failures_again(spark, folder):
    store = Store(spark, str(folder / "kb"))
    args = (str(folder / "in"), str(folder / "kb"), str(folder / "ck"))
    watch(spark, *args, "cat").awaitTermination()
    first = store.chunks().count()
    assert {r.file_name for r in store.files().collect()} == {"a.docx", "b.xlsx"}  # neither the broken nor the unread one
    status = {r.file_name: (r.status, r.reason) for r in spark.read.parquet(f"{args[1]}/status").collect()}
    assert {n: s for n, (s, _) in status.items()} == {"a.docx": "success", "copy.docx": "skipped", "b.xlsx": "success", "broken.xlsx": "failed", "c.txt": "failed"}
    assert "BadZipFile" in status["broken.xlsx"][1] and status["c.txt"][1] == "no parser for this type"
    (folder / "in/late.docx").write_bytes(docx())
    watch(spark, *args, "cat").awaitTermination()
    assert first > 5 and store.chunks().count() == first


def test_unreadable_copies_hide_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", docx()), ("b.xlsx", docx()), ("c.docx", docx()), ("d.docx", docx()), ("e.png", b"picture"), ("f.docx", zipped({"word/document.xml": f"<w:document {NS}><w:body/></w:document>"}))):
        (tmp_path / "in" / name).write_bytes(data)
    store, files = Store(spark, str(tmp_path / "kb")), read_files(spark, str(tmp_path / "in"))
    status = {r.file_name: (r.status, r.reason) for r in ingest_into(store, files, "x").collect()}
    assert {n: s for n, (s, _) in status.items()} == {"a.txt": "failed", "b.xlsx": "failed", "c.docx": "success", "d.docx": "skipped", "e.png": "ocr_unavailable", "f.docx": "failed"}
    assert status["f.docx"][1] == "no content" and status["e.png"][1] == "no OCR engine"
    assert [r.file_name for r in store.files().collect()] == ["c.docx"]
    again = {r.file_name: r.status for r in ingest_into(store, files, "x").collect()}
    assert again == {"a.txt": "skipped", "b.xlsx": "skipped", "c.docx": "skipped", "d.docx": "skipped", "e.png": "ocr_unavailable", "f.docx": "failed"}
    assert {r.status for r in ingest_into(store, files.where("file_name = 'e.png'"), "x", recognise=lambda image, name: F.lit("words")).collect()} == {"success"}


def test_a_batch_run_again_replaces_itself(spark, folder):
    store, files = Store(spark, str(folder / "kb")), read_files(spark, str(folder / "in"))
    one = {r.file_name: r.status for r in ingest_into(store, files, "cat", batch="s-0").collect()}
    n, catalog = store.chunks().count(), {(r.file_name, r.chunk_count) for r in store.files().collect()}
    assert {r.file_name: r.status for r in ingest_into(store, files, "cat", batch="s-0").collect()} == one
    assert store.chunks().count() == n and {(r.file_name, r.chunk_count) for r in store.files().collect()} == catalog
    (folder / "kb/chunks/n=1/_SUCCESS").unlink()  # the first run was lost before its end
    assert store.chunks().count() == 0
    ingest_into(store, files, "cat", batch="s-0")
    assert store.chunks().count() == n
    ingest_into(store, files, "cat", batch="s-1")
    assert store.chunks().count() == n


def test_chunks_through_a_cache_of_vectors(spark, tmp_path):
    """The model sees what an earlier batch had not; every chunk gets its text's vector."""
    rows = [("h", "a.png", "/a.png", 1, i, "image", t, None, None, None, None, None, None, None) for i, t in enumerate(["words of one", "words of two", "words of one"])]
    found = spark.createDataFrame(rows, BLOCKS)
    cache = EmbeddingCache(spark, f"{tmp_path}/vectors", "lengths", lambda t: F.array(F.length(t), F.ascii(t)))
    got = chunked(found, "cat", cache).select("text", "embedding").collect()
    assert len(got) == 3 and all(r.embedding == [len(r.text), ord(r.text[0])] for r in got)
    refused = EmbeddingCache(spark, f"{tmp_path}/vectors", "lengths", lambda t: F.array(F.raise_error(t)))
    assert refused.fill(chunked(found, "cat")) == 0


def test_store(spark, folder):
    store = Store(spark, str(folder / "kb"))
    assert store.files().count() == 0 and store.chunks().count() == 0
    files = read_files(spark, str(folder / "in"))
    chunks, fresh = ingest(spark, files, store.files(), "cat")
    store.add(chunks, fresh)
    n = store.chunks().count()
    assert {(r.file_name, r.status, r.category) for r in store.files().collect()} == {("a.docx", "indexed", "cat"), ("b.xlsx", "indexed", "cat")}
    assert n == sum(r.chunk_count for r in store.files().collect()) and store.chunks().select("id").distinct().count() == n
    again, left = ingest(spark, files, store.files(), "cat")  # only the unreadable file is tried again
    assert left.select("file_name").collect()[0][0] == "broken.xlsx" and again.count() == 0
    store.delete_name("b.xlsx")
    assert {r.file_name for r in store.chunks().select("file_name").distinct().collect()} == {"a.docx"}
    with pytest.raises(KeyError):
        store.delete_name("b.xlsx")
    more, fresh = ingest(spark, files.where("file_name = 'b.xlsx'"), store.files(), "other")
    store.add(more, fresh)
    assert {r.category for r in store.chunks().where("file_name = 'b.xlsx'").collect()} == {"other"}
    (folder / "kb/chunks/n=9").mkdir()  # a write that did not finish
    assert store.chunks().count() == n
    store.reset()
    assert store.files().count() == 0 and store.chunks().count() == 0
