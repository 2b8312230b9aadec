"""Workbooks, slides and documents written back: what changes, what stays, what is refused."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glotmill.sources import office, writeback
from tests.test_office import W, docx, p, package

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
CELLS = '<c r="A1" s="3" t="s"><v>0</v></c><c r="B1"><f>Data!A1</f><v>1</v></c><c r="A2" t="inlineStr"><is><t>in</t></is></c><c r="A3" t="s"><v>0</v></c>'
BOOK = {
    "[Content_Types].xml": "",
    "xl/workbook.xml": f'<workbook xmlns="{S}"><sheets><sheet name="Data" sheetId="1"/><sheet name="Other" sheetId="2"/></sheets><definedNames><definedName name="n">Data!$A$1</definedName></definedNames></workbook>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}" xmlns:x14="urn:x14" xmlns:mc="urn:mc" mc:Ignorable="x14"><sheetData><row r="1">{CELLS}</row></sheetData></worksheet>',
    "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>shared</t></si></sst>',
}
SLIDE = '<p:sld xmlns:a="a" xmlns:p="p"><p:sp><p:cNvPr id="4" name="T"/><a:p><a:r><a:rPr b="1"/><a:t>Head</a:t></a:r><a:br/><a:r><a:t>line</a:t></a:r></a:p></p:sp><p:graphicFrame><p:cNvPr id="5" name="G"/><a:tbl><a:tr><a:tc><a:p><a:r><a:t>c11</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame><p:sp><p:cNvPr id="6" name="N"/><a:p><a:fld type="slidenum"><a:t>7</a:t></a:fld></a:p></p:sp></p:sld>'
FIELD = '<w:p><w:r><w:t>Page </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/><w:t>3</w:t><w:fldChar w:fldCharType="end"/></w:r><w:r><w:t> end</w:t></w:r></w:p>'


def one(spark, content: bytes):
    return spark.createDataFrame([("f", bytearray(content))], "path string, content binary")


def part(content: bytes, name: str) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(name).decode()


def sheet_edits(spark, *rows):
    return spark.createDataFrame([("f", *r) for r in rows], "path string, part string, address string, source string, target string")


def test_cells(spark):
    sheet = "xl/worksheets/sheet1.xml"
    books = one(spark, package(BOOK))
    out = writeback.write_workbooks(books, sheet_edits(spark, (sheet, "A1", "shared", " neu <1>"), (sheet, "A2", "in", ""))).cache()
    assert out.first().errors == []
    assert {(r.address, r.text) for r in office.all_cells(office.parts(out)).collect()} == {("A1", " neu <1>"), ("B1", None), ("A2", ""), ("A3", "shared")}
    text = part(bytes(out.first().content), sheet)
    assert 's="3"' in text and 'xmlns:x14="urn:x14"' in text and "ns0" not in text
    assert part(bytes(out.first().content), "xl/workbook.xml") == BOOK["xl/workbook.xml"]


@pytest.mark.parametrize("edit", [("A1", "other", "x"), ("B1", "1", "x"), ("Z9", "a", "x"), ("A1", "shared", None)])
def test_refused_cells_leave_the_package(spark, edit):
    content = package(BOOK)
    got = writeback.write_workbooks(one(spark, content), sheet_edits(spark, ("xl/worksheets/sheet1.xml", *edit), ("xl/worksheets/sheet1.xml", "A2", "in", "y"))).first()
    assert len(got.errors) == 1 and bytes(got.content) == content


def test_two_texts_for_a_cell_and_lost_packages(spark):
    sheet = "xl/worksheets/sheet1.xml"
    edits = sheet_edits(spark, (sheet, "A2", "in", "x"), (sheet, "A2", "in", "y"))
    assert "two texts" in writeback.write_workbooks(one(spark, package(BOOK)), edits).first().errors[0]
    got = {r.path: r for r in writeback.write_workbooks(one(spark, b"no zip"), edits.union(edits.withColumn("path", F.lit("g")))).collect()}
    assert got["g"].errors == ["no package"] and got["g"].content is None
    assert got["f"].errors[0].startswith("unreadable") and bytes(got["f"].content) == b"no zip"


def test_sheet_names(spark):
    books = one(spark, package(BOOK))
    out = writeback.write_workbooks(books, sheet_edits(spark, ("xl/workbook.xml", None, "Data", "Mes données"))).first()
    assert out.errors == []
    book = part(bytes(out.content), "xl/workbook.xml")
    assert 'name="Mes données"' in book and "'Mes données'!$A$1" in book
    assert "'Mes données'!A1" in part(bytes(out.content), "xl/worksheets/sheet1.xml")
    for bad in ("other", "a/b", "x" * 32, ""):
        assert writeback.write_workbooks(books, sheet_edits(spark, ("xl/workbook.xml", None, "Data", bad))).first().errors


def test_slides(spark):
    name = "ppt/slides/slide1.xml"
    schema = "path string, part string, shape_id int, row int, col int, paragraph int, source string, target string"
    decks = one(spark, package({"ppt/presentation.xml": "<p/>", name: SLIDE}))
    rows = [("f", name, 4, None, None, 1, "Head\vline", "Kopf\vZeile\vdrei"), ("f", name, 5, 1, 1, 1, "c11", "z11")]
    out = writeback.write_slides(decks, spark.createDataFrame(rows, schema)).cache()
    assert out.first().errors == []
    assert [r.text for r in office.all_slide_paragraphs(office.parts(out)).orderBy("shape_id").collect()] == ["Kopf\vZeile\vdrei", "z11", "7"]
    assert 'b="1"' in part(bytes(out.first().content), name)
    bad = writeback.write_slides(decks, spark.createDataFrame([("f", name, 6, None, None, 1, "7", "8")], schema)).first()
    assert len(bad.errors) == 1


def test_documents_keep_fields_and_move_tabs(spark):
    name, schema = "word/document.xml", "path string, part string, ord int, source string, target string"
    docs = one(spark, docx(FIELD + "<w:p><w:r><w:t>two</w:t><w:tab/><w:t>x</w:t></w:r></w:p>" + p("s")))
    rows = [("f", name, 1, "Page [[field 1]] end", "Seite [[field 1]] Ende"), ("f", name, 2, "two\tx", "a\tb\nc"), ("f", name, 3, "s", "")]
    out = writeback.write_documents(docs, spark.createDataFrame(rows, schema)).cache()
    assert out.first().errors == []
    assert [r.text for r in office.all_word_paragraphs(office.parts(out)).orderBy("ord").collect()] == ["Seite [[field 1]] Ende", "a\tb\nc", ""]
    assert "fldChar" in part(bytes(out.first().content), name) and f'xmlns:w="{W}"' in part(bytes(out.first().content), name)
    for target in ("no mark", "[[field 2]] x", None):
        assert writeback.write_documents(docs, spark.createDataFrame([("f", name, 1, "Page [[field 1]] end", target)], schema)).first().errors


def test_only_the_edited_part_changes(spark):
    words = one(spark, docx(p("one") + p("two"), **{"word/media/i.png": "pic"}))
    edits = spark.createDataFrame([("f", "word/document.xml", 1, "one", "eins")], "path string, part string, ord int, source string, target string")
    out = writeback.write_documents(words, edits).cache()
    before = {r.part: r.sha256 for r in office.parts(words).collect()}
    after = {r.part: r.sha256 for r in office.parts(out).collect()}
    assert {k for k in before if before[k] != after[k]} == {"word/document.xml"} and list(before) == list(after)
    bad = writeback.write_documents(words, edits.withColumn("source", F.lit("other"))).first()
    assert len(bad.errors) == 1 and bytes(bad.content) == bytes(words.first().content)
