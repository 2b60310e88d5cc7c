"""Text of office containers (zip files of XML parts), as rows of fragments.

Containers come as rows (key, content), for instance of Spark's ``binaryFile`` reader. Each is opened in
the task that holds its row, and its fragments leave as rows (key, seq, kind, id, text). Ids follow the
order in the parts, so that a text can be put back where it was. Text of several runs is marked
``[[n]]..[[/n]]`` by run. A container that cannot be read gives one row of kind "unreadable" without text.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import count
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name spaces of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
COMPAT = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Fragment = tuple[str, str, str]


class Package:
    """A container's parts by name, read as they are asked for."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def part(self, name: str) -> ET.Element:
        root = ET.fromstring(self.zip.read(name))
        for parent in root.iter():
            for copy in parent.findall(f"{COMPAT}Fallback"):
                parent.remove(copy)
        return root

    def parts(self, pattern: str) -> Iterator[tuple[str, ET.Element]]:
        """(stem, root) of the parts whose whole name matches, by name."""
        for name in sorted(n for n in self.names if re.fullmatch(pattern, n)):
            yield posixpath.basename(name).rsplit(".", 1)[0], self.part(name)


def numeric(text: str) -> bool:
    """Whether a text is a number and nothing else, so that it needs no translation."""
    try:
        float(re.sub("[ \xa0%]", "", text.strip().replace(",", ".")))
    except ValueError:
        return False
    return True


def marked(runs: Iterator[str]) -> str:
    return "".join(f"[[{i}]]{t}[[/{i}]]" for i, t in enumerate(runs))


def word(pkg: Package) -> Iterator[Fragment]:
    """Paragraphs of the body, of table cells, of text boxes, of headers and footers; empty ones too."""
    root = pkg.part("word/document.xml")
    numbers: dict[str, Iterator[int]] = {}

    def paragraph(p: ET.Element, kind: str, prefix: str, name: str = "") -> Fragment:
        texts = ("".join(t.text or "" for t in r.findall(f"{WORD}t")) for r in p.findall(f"{WORD}r"))
        return kind, f"{name}{prefix}_{next(numbers.setdefault(prefix, count()))}", marked(t for t in texts if t.strip())

    body = root.find(f".//{WORD}body")
    for block in root if body is None else body:
        if block.tag == f"{WORD}p":
            yield paragraph(block, "paragraph", "body_para")
        elif block.tag == f"{WORD}tbl":
            cells = (c for row in block.iter(f"{WORD}tr") for c in row.iter(f"{WORD}tc"))
            yield from (paragraph(p, "table_cell", "tbl_para") for c in cells for p in c.findall(f"{WORD}p"))
    for box in root.iter(f"{WORD}txbxContent"):
        yield from (paragraph(p, "textbox", "txbx_para") for p in box.iter(f"{WORD}p"))
    for kind, short in (("header", "hdr"), ("footer", "ftr")):
        for stem, part in pkg.parts(rf"word/{kind}[^/]*\.xml"):
            yield from (paragraph(p, kind, kind[0], f"{short}_{stem}_") for p in part.iter(f"{WORD}p"))


def targets(pkg: Package) -> Iterator[Fragment]:
    """The sheets of a workbook as shown: name, and the part that holds it by the workbook's relations or,
    where they lack it, by the sheet's number."""
    links = {}
    if "xl/_rels/workbook.xml.rels" in pkg.names:
        for r in pkg.part("xl/_rels/workbook.xml.rels"):
            target = r.get("Target", "").lstrip("/")
            if target and r.get("Id"):
                links[r.get("Id")] = target if target.startswith("xl/") else f"xl/{target}"
    if "xl/workbook.xml" in pkg.names:
        for i, s in enumerate(pkg.part("xl/workbook.xml").iter(f"{SHEET}sheet"), 1):
            own = f"xl/worksheets/sheet{s.get('sheetId') or i}.xml"
            yield "sheet", s.get("name") or f"Feuille{i}", links.get(s.get(f"{RELATION}id", ""), own)


def charts(pkg: Package) -> Iterator[Fragment]:
    """Rich text of charts, then values that are neither a cell's cached copy nor a number."""
    for stem, root in pkg.parts(r"xl/charts/chart[^/]*\.xml"):
        found = [t.text for t in root.iter(f"{DRAWING}t") if (t.text or "").strip()]
        todo = [root]
        while todo:
            e = todo.pop()
            if e.tag.rsplit("}", 1)[-1] in ("strCache", "numCache"):
                continue
            if e.tag == f"{CHART}v" and (e.text or "").strip() and not numeric(e.text):
                found.append(e.text)
            todo.extend(reversed(e))
        yield from (("chart", f"chart_{stem}_{i}", marked(iter([t]))) for i, t in enumerate(found))


def workbook(pkg: Package) -> Iterator[Fragment]:
    """Sheet names, shared strings and chart texts of a workbook, numbers left out."""
    for i, (_, name, _) in enumerate(targets(pkg)):
        if name.strip() and not numeric(name):
            yield "sheetName", f"sheetname_{i}", name
    if "xl/sharedStrings.xml" in pkg.names:
        for i, entry in enumerate(pkg.part("xl/sharedStrings.xml").findall(f"{SHEET}si")):
            runs = [t.text or "" for t in entry.iter(f"{SHEET}t")]
            whole = "".join(runs)
            if whole.strip() and not numeric(whole):
                yield "sharedStrings", f"ss_{i}", marked(iter(runs))
    yield from charts(pkg)


def scan(files: DataFrame, read: Callable[[Package], Iterator[Fragment]], key: str = "path") -> DataFrame:
    """(key, seq, kind, id, text) of each container in ``files`` (key, content) by one of the readers above."""
    kept = files.select(key, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in enumerate(b.column("content")):
                try:
                    rows = list(read(Package(content.as_py() or b"")))
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    rows = [("unreadable", None, None)]
                n = len(rows)
                cols = [pa.array([r[c] for r in rows], pa.string()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array([i] * n, pa.int64())), pa.array(range(n), pa.int32()), *cols], [key, "seq", "kind", "id", "text"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, seq int, kind string, id string, text string")


def files(spark, path: str) -> DataFrame:
    """Containers below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path"), "content")
