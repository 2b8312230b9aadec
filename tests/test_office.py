"""Packages made in code: scan, write back, damage."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glotmill.sources import office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body: str, **more: str) -> bytes:
    return package({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', **more})


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    (folder / "a.docx").write_bytes(docx(p("one") + "<w:p><w:r><w:t>two</w:t><w:tab/><w:t>x</w:t></w:r></w:p>" + '<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:t>hidden</w:t><w:fldChar w:fldCharType="end"/></w:r></w:p>', **{"word/media/i.png": "pic"}))
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1"><f>A1</f><v>1</v></c><c r="A2" t="inlineStr"><is><t>in</t></is></c>'
    (folder / "b.xlsx").write_bytes(package({"[Content_Types].xml": "", "xl/workbook.xml": "<w/>", "xl/worksheets/sheet1.xml": f"<s><sheetData><row>{cells}</row></sheetData></s>", "xl/sharedStrings.xml": "<sst><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>", "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Type="x/worksheet" Target="worksheets/../worksheets/sheet1.xml"/></R>', "xl/charts/chart1.xml": "<c/>"}))
    slide = '<p xmlns:a="a" xmlns:p="p"><p:sp><p:cNvPr id="4" name="T"/><p:ph type="title"/><a:p><a:t>Head</a:t><a:br/><a:t>line</a:t></a:p></p:sp><p:graphicFrame><p:cNvPr id="5" name="G"/><a:tbl><a:tr><a:tc><a:p><a:t>c11</a:t></a:p></a:tc><a:tc><a:p><a:t>c12</a:t></a:p></a:tc></a:tr></a:tbl></p:graphicFrame></p>'
    (folder / "c.pptx").write_bytes(package({"[Content_Types].xml": "", "ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide}))
    (folder / "d.docx").write_bytes(b"no zip at all")
    return office.read_packages(spark, str(folder)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0)).cache()


def test_parts_and_features(files):
    rows = {(r.path, r.part): r for r in office.parts(files).collect()}
    assert rows["d.docx", None].error and rows["a.docx", "word/media/i.png"].bytes == 3
    got = {r.path: r for r in office.features(office.parts(files)).collect()}
    assert got["b.xlsx"].charts == 1 and got["a.docx"].media == 1 and got["c.pptx"].charts == 0


def test_text(files):
    parts = office.parts(files)
    assert [(r.ord, r.text) for r in office.all_word_paragraphs(parts).orderBy("ord").collect()] == [(1, "one"), (2, "two\tx"), (3, "[[field 1]]")]
    assert {(r.address, r.text) for r in office.all_cells(parts).collect()} == {("A1", "shared"), ("B1", None), ("A2", "in")}
    got = {(r.slide, r.role, r.row, r.col, r.text) for r in office.all_slide_paragraphs(parts).collect()}
    assert got == {(10, "title", None, None, "Head\vline"), (10, "table", 1, 1, "c11"), (10, "table", 1, 2, "c12")}
    assert [(r.owner, r.target) for r in office.all_relationships(parts).collect()] == [("xl/workbook.xml", "xl/worksheets/sheet1.xml")]


def test_containers(files):
    got = {r.path: r.k for r in files.select("path", office.container_column(F.col("content")).alias("k")).collect()}
    assert got == {"a.docx": "document", "b.xlsx": "workbook", "c.pptx": "slides", "d.docx": "unknown"}
    assert office.cfb(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(600)) == "damaged cfb"
    rec = lambda kind, body=b"": kind.to_bytes(2, "little") + len(body).to_bytes(2, "little") + body
    assert office.biff(rec(0x809, b"1234") + rec(0xA)) == "legacy workbook"
    assert office.biff(rec(0x809) + rec(0x2F)) == "encrypted workbook"
    assert office.biff(rec(0x809)) == "damaged workbook stream"


def test_media(spark, files):
    import hashlib

    swaps = spark.createDataFrame([("a.docx", hashlib.sha256(b"pic").hexdigest(), bytearray(b"new!"))], "path string, sha256 string, new binary")
    got = office.replace_media(files.where("path = 'a.docx'"), swaps)
    assert got.first().replaced == 1
    assert office.parts(got).where("part LIKE '%png'").first().bytes == 4
