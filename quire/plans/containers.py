"""Queries of office containers, each made of a test document's lines and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from quire.plans.catalogue import LINES_SQL
from quire.plans.tables import read
from quire.sources import ooxml

W, S, A, C, MC, R = (f'"{x[1:-1]}"' for x in (ooxml.WORD, ooxml.SHEET, ooxml.DRAWING, ooxml.CHART, ooxml.COMPAT, ooxml.RELATION))


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def cut(line: str, i: int, every: int) -> list[str]:
    """The runs of line i: those of every so many lines have two, cut before the first space."""
    at = line.find(" ")
    return [line[:at], line[at:]] if i % every == 0 and at > 0 else [line]


def docx(lines: list[str]) -> bytes:
    def p(i: int, line: str) -> str:
        return "<w:p>" + "".join(f"<w:r><w:t>{escape(r)}</w:t></w:r>" for r in cut(line, i, 5)) + "</w:p>"

    box = "<w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent>"
    blocks = [f"<w:tbl><w:tr><w:tc>{p(i, x)}</w:tc></w:tr></w:tbl>" if i % 3 == 2 else p(i, x) for i, x in enumerate(lines)]
    body = f"<w:sdt><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent></w:sdt>"
    head = f"<w:hdr xmlns:w={W}><w:p><w:r><w:t>{len(lines)}</w:t></w:r></w:p></w:hdr>"
    return packed({"word/document.xml": f"<w:document xmlns:w={W} xmlns:mc={MC}><w:body>{''.join(blocks)}{body}</w:body></w:document>", "word/header1.xml": head})


def xlsx(lines: list[str]) -> bytes:
    strings = "".join("<si>" + "".join(f"<r><t>{escape(r)}</t></r>" for r in cut(x, i, 4)) + "</si>" for i, x in enumerate(lines))
    sheets = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in ((4, "Data"), (2, "2 024"), (7, "Notes")))
    rels = '<Relationships><Relationship Id="rId4" Target="worksheets/s1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/s9.xml"/></Relationships>'
    chart = f"<c:chart xmlns:c={C} xmlns:a={A}><c:strCache><c:v>cached</c:v></c:strCache><c:tx><c:v>12,5 %</c:v><c:v>bare</c:v></c:tx><a:t>Title</a:t></c:chart>"
    return packed({"xl/workbook.xml": f"<workbook xmlns={S} xmlns:r={R}><sheets>{sheets}</sheets></workbook>", "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f"<sst xmlns={S}>{strings}</sst>", "xl/charts/chart1.xml": chart})


def containers(s, d, make: Callable[[list[str]], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t.split("\n")) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, content binary")


def scanned(make, reader, *columns):
    return lambda s, d: ooxml.scan(containers(s, d, make), reader, "doc_id").select(*columns)


def runs_sql(every: int) -> str:
    """Runs a and b of each line."""
    two = f"seq % {every} = 0 AND strpos(text, ' ') > 1"
    return f"{LINES_SQL}, runs AS (SELECT doc_id, seq, CASE WHEN {two} THEN substr(text, 1, strpos(text, ' ') - 1) ELSE text END AS a, CASE WHEN {two} THEN substr(text, strpos(text, ' ')) ELSE '' END AS b FROM lines)"


DOCX_SQL = f"""WITH {runs_sql(5)}, k AS (SELECT *, seq % 3 = 2 AS cell, row_number() OVER (PARTITION BY doc_id, seq % 3 = 2 ORDER BY seq) - 1 AS n FROM runs)
SELECT doc_id, CASE WHEN cell THEN 'table_cell' ELSE 'paragraph' END AS kind, CASE WHEN cell THEN 'tbl_para_' ELSE 'body_para_' END || n AS id,
 CASE WHEN trim(a) <> '' THEN '[[0]]' || a || '[[/0]]' ELSE '' END || CASE WHEN trim(b) = '' THEN '' WHEN trim(a) <> '' THEN '[[1]]' || b || '[[/1]]' ELSE '[[0]]' || b || '[[/0]]' END AS text FROM k
UNION ALL SELECT doc_id, 'textbox', 'txbx_para_0', '[[0]]box[[/0]]' FROM documents
UNION ALL SELECT doc_id, 'header', 'hdr_header1_h_0', '[[0]]' || count(*) || '[[/0]]' FROM lines GROUP BY 1"""
XLSX_SQL = f"""WITH {runs_sql(4)} SELECT doc_id, 'sharedStrings' AS kind, 'ss_' || seq AS id, '[[0]]' || a || '[[/0]]' || CASE WHEN b <> '' THEN '[[1]]' || b || '[[/1]]' ELSE '' END AS text
 FROM runs WHERE trim(a || b) <> '' AND NOT regexp_matches(replace(replace(replace(trim(a || b), ',', '.'), ' ', ''), '%', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')
UNION ALL SELECT doc_id, unnest(['sheetName', 'sheetName', 'chart', 'chart']), unnest(['sheetname_0', 'sheetname_2', 'chart_chart1_0', 'chart_chart1_1']), unnest(['Data', 'Notes', '[[0]]Title[[/0]]', '[[0]]bare[[/0]]']) FROM documents"""

QUERIES = {
    "src_ooxml_docx": (scanned(docx, ooxml.word, "doc_id", "kind", "id", "text"), DOCX_SQL),
    "src_ooxml_xlsx": (scanned(xlsx, ooxml.workbook, "doc_id", "kind", "id", "text"), XLSX_SQL),
    "chart_text_filter": (scanned(xlsx, ooxml.charts, "doc_id", "seq", "text"), "SELECT doc_id, unnest([0, 1]) AS seq, unnest(['[[0]]Title[[/0]]', '[[0]]bare[[/0]]']) AS text FROM documents"),
    "sheet_targets": (lambda s, d: ooxml.scan(containers(s, d, xlsx), ooxml.targets, "doc_id").select("doc_id", "seq", F.col("id").alias("name"), F.col("text").alias("target")), "SELECT doc_id, unnest([0, 1, 2]) AS seq, unnest(['Data', '2 024', 'Notes']) AS name, unnest(['xl/worksheets/s1.xml', 'xl/worksheets/sheet2.xml', 'xl/worksheets/s9.xml']) AS target FROM documents"),
}
