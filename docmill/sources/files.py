"""Files as block streams: office formats from zip and XML, others through plug-ins.

``binaryFile`` lists and reads; each file becomes rows of one block schema, and all
folds after that (headings, lists, tables, chunks) are shared DataFrame operators.
An unreadable file gives one row with its error, so a batch goes on.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.catalog import parser_of
from docmill.schemas import BLOCKS, PLACE
from docmill.workers import map_arrow

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 18), 22, *range(27, 37), *range(50, 59)])
Block = dict
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, by path: file_name, file_path, file_hash, parser, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), parser_of(name).alias("parser"), "content")


def _plain(element) -> str:
    """Text of a paragraph: runs, tabs and line breaks."""
    out = []
    for x in element.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _on(parent, tag: str) -> bool:
    found = parent.find(tag) if parent is not None else None
    return found is not None and found.get(W + "val", "1") not in ("0", "false")


def docx_blocks(data: bytes) -> Iterator[Block]:
    """Paragraphs (with style, outline level, letter size, boldness), tables and images in body order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        styles, images = {}, {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(W + "style"):
                title = s.find(W + "name")
                styles[s.get(W + "styleId")] = title.get(W + "val") if title is not None else ""
        if "word/_rels/document.xml.rels" in names:
            for rel in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).findall(P + "Relationship"):
                if "image" in rel.get("Type", "").lower():
                    images[rel.get("Id")] = "word/" + rel.get("Target", "").lstrip("/").removeprefix("word/")
        n = 0
        for element in body if body is not None else ():
            if element.tag == W + "p":
                n += 1
                page = max(1, n // 40)
                for blip in element.iter(A + "blip"):
                    target = images.get(blip.get(R + "embed"))
                    if target in names:
                        yield {"kind": "image", "page": page, "text": target.rpartition("/")[2], "image": z.read(target)}
                props = element.find(W + "pPr")
                style = props.find(W + "pStyle") if props is not None else None
                outline = props.find(W + "outlineLvl") if props is not None else None
                sizes, bolds = [], []
                for run in element.iter(W + "r"):
                    if _plain(run).strip():
                        own = run.find(W + "rPr")
                        size = own.find(W + "sz") if own is not None else None
                        sizes.append(float(size.get(W + "val")) / 2 if size is not None else 12.0)
                        bolds.append(_on(own, W + "b"))
                yield {
                    "kind": "paragraph",
                    "page": page,
                    "text": _plain(element).strip(),
                    "style": styles.get(style.get(W + "val"), style.get(W + "val")) if style is not None else "",
                    "outline_lvl": int(outline.get(W + "val")) if outline is not None else None,
                    "avg_size": sum(sizes) / len(sizes) if sizes else 12.0,
                    "is_bold": bool(bolds) and sum(bolds) > len(bolds) / 2,
                }
            elif element.tag == W + "tbl":
                grid = [["\n".join(_plain(p) for p in c.findall(W + "p")).strip() for c in row.findall(W + "tc")] for row in element.findall(W + "tr")]
                yield {"kind": "table", "page": max(1, n // 40), "text": "\n".join(" | ".join(r) for r in grid if any(r)), "grid": grid}


def _cell_at(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)([0-9]+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def _number(value: str) -> str:
    from decimal import Decimal

    d = Decimal(value)
    if d == d.to_integral_value():
        return str(int(d))
    return format(d.normalize(), "f")


def sheet_blocks(data: bytes) -> Iterator[Block]:
    """One grid a sheet, typed cells as text, merged ranges filled with their first cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared, dates = [], set()
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")]
        if "xl/styles.xml" in names:
            sheet = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {f.get("numFmtId") for f in sheet.iter(S + "numFmt") if re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            formats = sheet.find(S + "cellXfs")
            dates = {i for i, x in enumerate(formats if formats is not None else ()) if x.get("numFmtId") in own or int(x.get("numFmtId", 0)) in DATE_FORMATS}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall(P + "Relationship")}
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet")):
            root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(R + "id")].lstrip("/").removeprefix("xl/")))
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter(S + "c"):
                value, kind = c.find(S + "v"), c.get("t", "n")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(S + "t")).strip()
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(value.text)].strip()
                elif kind == "n":
                    text = (datetime(1899, 12, 30) + timedelta(days=float(value.text))).strftime("%Y-%m-%d") if int(c.get("s", 0)) in dates else _number(value.text)
                else:
                    text = {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else value.text.strip()
                cells[_cell_at(c.get("r"))] = text
            for merged in root.iter(S + "mergeCell"):
                (r1, c1), (r2, c2) = map(_cell_at, merged.get("ref").split(":"))
                first = cells.get((r1, c1), "")
                cells.update({(r, c): first for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)})
            if cells:
                rows, cols = max(r for r, _ in cells), max(c for _, c in cells)
                yield {"kind": "sheet", "page": n + 1, "text": sheet.get("name"), "grid": [[cells.get((r, c), "") for c in range(1, cols + 1)] for r in range(1, rows + 1)]}


def image_blocks(data: bytes) -> Iterator[Block]:
    yield {"kind": "image", "page": 1, "text": "", "image": data}


#: Extractors by parser name; ``pdf`` needs a plug-in: bytes -> blocks.
EXTRACTORS: dict[str, Callable[[bytes], Iterator[Block]]] = {"docx": docx_blocks, "sheet": sheet_blocks, "image": image_blocks}


def blocks(files: DataFrame, extractors: dict[str, Callable[[bytes], Iterator[Block]]] | None = None) -> DataFrame:
    """Files -> blocks.  Unsupported files give no row, failing ones a row with their error."""
    known = EXTRACTORS | (extractors or {})
    schema = pa.schema([(n, pa.list_(pa.list_(pa.string())) if n == "grid" else _ARROW[t]) for n, t in (f.split() for f in f"{BLOCKS}, {PLACE}".split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                head = {k: f[k] for k in ("file_hash", "file_name", "file_path")}
                try:
                    if f["parser"] not in known:
                        raise ValueError(f"no extractor for {f['parser']}")
                    rows = [head | {"ord": i} | b for i, b in enumerate(known[f["parser"]](f["content"]))]
                except Exception as e:
                    rows = [head | {"ord": 0, "kind": "error", "error": f"{type(e).__name__}: {e}"[:500]}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(files.where("parser is not null"), run, f"{BLOCKS}, {PLACE}")
