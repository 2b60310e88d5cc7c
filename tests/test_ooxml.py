"""Containers as files: text boxes, footers, nested text, and files that are none."""

from quire.plans.containers import MC, C, W, packed
from quire.sources import ooxml


def test_files(spark, tmp_path):
    part = f'<w:document xmlns:w={W} xmlns:mc={MC}><w:body><w:p><w:r><w:t>a</w:t><w:t>b</w:t></w:r><w:r><w:t> </w:t></w:r><w:r><w:t>c</w:t></w:r></w:p><w:p/></w:body></w:document>'
    foot = f"<w:ftr xmlns:w={W}><w:p><w:r><w:t>f</w:t></w:r></w:p></w:ftr>"
    (tmp_path / "a.docx").write_bytes(packed({"word/document.xml": part, "word/footer2.xml": foot, "word/footer1.xml": foot}))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(packed({"word/document.xml": "<open"}))
    (tmp_path / "d.docx").write_bytes(packed({"other.xml": "<a/>"}))
    got = ooxml.scan(ooxml.files(spark, str(tmp_path)), ooxml.word).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.path, r.seq)):
        by.setdefault(r.path[-6], []).append((r.kind, r.id, r.text))
    assert by["a"] == [("paragraph", "body_para_0", "[[0]]ab[[/0]][[1]]c[[/1]]"), ("paragraph", "body_para_1", ""), ("footer", "ftr_footer1_f_0", "[[0]]f[[/0]]"), ("footer", "ftr_footer2_f_1", "[[0]]f[[/0]]")]
    assert by["b"] == by["c"] == by["d"] == [("unreadable", None, None)]


def test_charts_and_empty_workbook():
    chart = f"<c:x xmlns:c={C}><c:numCache><c:pt><c:v>deep</c:v></c:pt></c:numCache><c:v>1e3</c:v><c:v> kept </c:v></c:x>"
    assert list(ooxml.charts(ooxml.Package(packed({"xl/charts/chart7.xml": chart})))) == [("chart", "chart_chart7_0", "[[0]] kept [[/0]]")]
    assert list(ooxml.workbook(ooxml.Package(packed({"a": "b"})))) == []
