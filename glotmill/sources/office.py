"""Office packages as tables: parts, relationships, and text occurrences of documents, workbooks and slides."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill import fixed

PARTS = "path string, ord int, part string, sha256 string, bytes long, error string, content binary"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as path and content, by Spark's own binary reader."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def route(path: Column) -> Column:
    """STRUCT<format, convert, error> by file extension."""
    suffix = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    fmt, convert = F.lit(None).cast("string"), F.lit(False)
    for name, kind, legacy in fixed.ROUTES:
        fmt = F.when(suffix == name, kind).otherwise(fmt)
        convert = F.when(suffix == name, F.lit(legacy)).otherwise(convert)
    return F.struct(fmt.alias("format"), convert.alias("convert"), F.when(fmt.isNull(), "unsupported file type").alias("error"))


def container(content: bytes) -> str:
    """What a file's bytes are: workbook, macro-workbook, document, slides, zip, cfb, or damaged and unknown ones."""
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return cfb(content)
    if content[:2] != b"PK":
        return "unknown"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if len(names) != len(set(names)):
                return "duplicate parts"
            types = z.read("[Content_Types].xml").decode("utf-8", "replace") if "[Content_Types].xml" in names else ""
    except (zipfile.BadZipFile, KeyError, OSError):
        return "damaged zip"
    macro = any(n.lower().endswith("vbaproject.bin") for n in names) or "macroEnabled" in types
    for main, kind in (("xl/workbook.xml", "workbook"), ("word/document.xml", "document"), ("ppt/presentation.xml", "slides")):
        if main in names:
            return f"macro-{kind}" if macro else kind
    return "zip"


def cfb(content: bytes) -> str:
    """Check a compound file: header, allocation chains without cycles, and the workbook stream's first records."""
    import struct

    if len(content) < 512:
        return "damaged cfb"
    size, mini = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    if size not in (512, 4096) or mini != 64:
        return "damaged cfb"
    n_fat, first_dir = struct.unpack_from("<I", content, 44)[0], struct.unpack_from("<I", content, 48)[0]
    cutoff, first_mini = struct.unpack_from("<I", content, 56)[0], struct.unpack_from("<I", content, 60)[0]
    first_difat = struct.unpack_from("<I", content, 68)[0]
    sector = lambda i: content[(i + 1) * size : (i + 2) * size]
    try:
        heads, at, seen = [*struct.unpack_from("<109I", content, 76)], first_difat, set()
        while at < 0xFFFFFFFA:
            if at in seen:
                return "damaged cfb"
            seen.add(at)
            *more, at = struct.unpack(f"<{size // 4}I", sector(at))
            heads += more
        fat: list[int] = []
        for s in [h for h in heads if h < 0xFFFFFFFA][:n_fat]:
            fat += struct.unpack(f"<{size // 4}I", sector(s))

        def chain(start: int, table: list[int]) -> list[int]:
            out, known = [], set()
            while start < 0xFFFFFFFA:
                if start in known or start >= len(table):
                    raise ValueError("broken chain")
                known.add(start)
                out.append(start)
                start = table[start]
            return out

        directory = b"".join(map(sector, chain(first_dir, fat)))
        entries = [directory[i : i + 128] for i in range(0, len(directory), 128)]
        named = [(e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace"), e) for e in entries if len(e) == 128 and e[66] in (1, 2, 5)]
        books = [e for name, e in named if name in ("Workbook", "Book")]
        if len(books) != 1:
            return "cfb"
        start, length = struct.unpack_from("<I", books[0], 116)[0], struct.unpack_from("<I", books[0], 120)[0]
        if length >= cutoff:
            stream = b"".join(map(sector, chain(start, fat)))[:length]
        else:
            root = next(e for _, e in named if e[66] == 5)
            body = b"".join(map(sector, chain(struct.unpack_from("<I", root, 116)[0], fat)))
            table = [x for s in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(s))]
            stream = b"".join(body[i * 64 : i * 64 + 64] for i in chain(start, table))[:length]
        return biff(stream)
    except (struct.error, ValueError, StopIteration):
        return "damaged cfb"


def biff(stream: bytes) -> str:
    """Walk a workbook stream's records: begin first, no encryption record, an end."""
    at, first = 0, True
    while at + 4 <= len(stream):
        kind, n = int.from_bytes(stream[at : at + 2], "little"), int.from_bytes(stream[at + 2 : at + 4], "little")
        if first and kind not in (0x0809, 0x0009, 0x0209, 0x0409):
            return "damaged workbook stream"
        if kind == 0x002F:
            return "encrypted workbook"
        if kind == 0x000A:
            return "legacy workbook"
        first, at = False, at + 4 + n
    return "damaged workbook stream"


def container_column(content: Column) -> Column:
    """container() of a column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: container(bytes(b)) if b is not None else None)

    return run(content)


def parts(packages: DataFrame) -> DataFrame:
    """A row for each part of each package (PARTS). A file that is no sound ZIP gives one row with an error."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, i, n.filename, hashlib.sha256(b := z.read(n)).hexdigest(), len(b), None, b) for i, n in enumerate(z.infolist()) if not n.is_dir()]
                except (zipfile.BadZipFile, TypeError) as e:
                    rows = [(path, None, None, None, None, str(e) or "no content", None)]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in PARTS.split(", ")]).astype(object)

    return packages.select("path", "content").mapInPandas(scan, PARTS)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def relationships(part: str, content: bytes) -> list[dict]:
    """Internal relationships of a .rels part: owner, id, type, target with `..` resolved."""
    folder, _, name = part.rpartition("/_rels/") if "/_rels/" in part else ("", "", part.removeprefix("_rels/"))
    owner = posixpath.join(folder, name.removesuffix(".rels"))
    out = []
    for r in ET.fromstring(content):
        if r.get("TargetMode") != "External":
            target = r.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(owner), target))
            out.append({"owner": owner, "id": r.get("Id"), "type": r.get("Type", "").rsplit("/", 1)[-1], "target": full})
    return out


def word_paragraphs(content: bytes) -> list[tuple[int, str]]:
    """(ordinal from 1, text) of a Word part's paragraphs: runs, tabs, breaks; results of fields as numbered marks; nested text boxes apart."""
    out = []
    for n, p in enumerate((e for e in ET.fromstring(content).iter() if _local(e.tag) == "p"), 1):
        text, depth, fields, showing = [], 0, 0, False

        def walk(e: ET.Element) -> None:
            nonlocal depth, fields, showing
            for c in e:
                tag = _local(c.tag)
                if tag in ("txbxContent", "p"):
                    continue
                if tag == "fldChar":
                    kind = next((v for k, v in c.attrib.items() if _local(k) == "fldCharType"), "")
                    if kind == "begin":
                        depth += 1
                    elif kind == "end" and depth:
                        depth -= 1
                        if not depth:
                            fields += 1
                            text.append(f"[[field {fields}]]")
                    continue
                if tag == "fldSimple":
                    fields += 1
                    text.append(f"[[field {fields}]]")
                    continue
                if not depth:
                    if tag == "t":
                        text.append(c.text or "")
                    elif tag == "tab" and _local(e.tag) == "r":
                        text.append("\t")
                    elif tag in ("br", "cr"):
                        text.append("\n")
                walk(c)

        walk(p)
        out.append((n, "".join(text).strip()))
    return out


def slide_paragraphs(content: bytes) -> list[dict]:
    """A slide's paragraphs: shape id and name, role, row and column in tables, ordinal, text with breaks as VT."""
    out = []
    for shape in (e for e in ET.fromstring(content).iter() if _local(e.tag) in ("sp", "graphicFrame", "cxnSp")):
        head = next((e for e in shape.iter() if _local(e.tag) == "cNvPr"), None)
        holder = next((e.get("type", "body") for e in shape.iter() if _local(e.tag) == "ph"), None)
        cells = [(r, c, cell) for t in shape.iter() if _local(t.tag) == "tbl" for r, row in enumerate((x for x in t if _local(x.tag) == "tr"), 1) for c, cell in enumerate((x for x in row if _local(x.tag) == "tc"), 1)]
        role = "table" if cells else "title" if holder in ("title", "ctrTitle") else "body"
        for r, c, box in cells or [(None, None, shape)]:
            for n, p in enumerate((e for e in box.iter() if _local(e.tag) == "p"), 1):
                text = "".join("\v" if _local(e.tag) == "br" else e.text or "" for e in p.iter() if _local(e.tag) in ("t", "br")).strip()
                if text:
                    out.append({"shape_id": int(head.get("id", 0)) if head is not None else None, "shape": head.get("name") if head is not None else None, "role": role, "row": r, "col": c, "paragraph": n, "text": text})
    return out


def shared_strings(content: bytes) -> list[str]:
    return ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(content) if _local(si.tag) == "si"]


def sheet_cells(content: bytes) -> list[dict]:
    """A worksheet's cells: address, type, raw value, formula, inline text. Shared strings are joined later by index."""
    out = []
    for c in (e for e in ET.fromstring(content).iter() if _local(e.tag) == "c"):
        kids = {_local(k.tag): k for k in c}
        inline = "".join(t.text or "" for t in kids["is"].iter() if _local(t.tag) == "t") if "is" in kids else None
        out.append({"address": c.get("r"), "type": c.get("t", "n"), "value": kids["v"].text if "v" in kids else None, "formula": kids["f"].text or "" if "f" in kids else None, "inline": inline})
    return out


def _explode(rows: DataFrame, function, schema: str, where: str) -> DataFrame:
    @F.pandas_udf(f"array<struct<{schema}>>")
    def run(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([function(n, bytes(c)) for n, c in zip(names, contents, strict=True)])

    return rows.where(where).select("path", "part", F.inline(run("part", "content")))


def all_relationships(rows: DataFrame) -> DataFrame:
    return _explode(rows, relationships, "owner:string,id:string,type:string,target:string", "part LIKE '%.rels'")


def all_word_paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of the text parts of Word packages: path, part, ord, text."""
    return _explode(rows, lambda _, c: [{"ord": n, "text": t} for n, t in word_paragraphs(c)], "ord:int,text:string", r"part RLIKE '^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments)[.]xml$'")


def all_slide_paragraphs(rows: DataFrame) -> DataFrame:
    """Paragraphs of slides, with the slide's number."""
    got = _explode(rows, lambda _, c: slide_paragraphs(c), "shape_id:int,shape:string,role:string,row:int,col:int,paragraph:int,text:string", r"part RLIKE '^ppt/slides/slide[0-9]+[.]xml$'")
    return got.withColumn("slide", F.regexp_extract("part", r"(\d+)\.xml$", 1).cast("int"))


def all_cells(rows: DataFrame) -> DataFrame:
    """Cells of worksheets with their text: null for formulas; shared strings joined by (path, index)."""
    cells = _explode(rows, lambda _, c: sheet_cells(c), "address:string,type:string,value:string,formula:string,inline:string", r"part RLIKE '^xl/worksheets/[^/]+[.]xml$'")
    strings = _explode(rows, lambda _, c: [{"i": i, "s": s} for i, s in enumerate(shared_strings(c))], "i:int,s:string", "part = 'xl/sharedStrings.xml'").drop("part")
    index = F.when(F.col("type") == "s", F.col("value").try_cast("int"))
    joined = cells.withColumn("i", index).join(strings, ["path", "i"], "left").drop("i")
    text = F.when(F.col("formula").isNotNull(), None).when(F.col("type") == "s", F.col("s")).when(F.col("type") == "inlineStr", F.col("inline")).when(F.col("type") == "str", F.col("value"))
    return joined.withColumn("text", text).drop("s", "inline")


def features(rows: DataFrame) -> DataFrame:
    """Counts of charts, comments, external links, tables, drawings, media and macros of each package, by part name."""
    n = lambda p: F.count_if(F.coalesce(F.col("part").rlike(p), F.lit(False)))
    return rows.groupBy("path").agg(
        n(r"/charts/chart\d*\.xml$").alias("charts"), n(r"/comments[^/]*\.xml$").alias("comments"), n(r"/externalLinks/[^/]+\.xml$").alias("external_links"),
        n(r"/tables/[^/]+\.xml$").alias("tables"), n(r"/drawings/[^/]+\.xml$").alias("drawings"), n(r"/media/").alias("media"), n(r"vbaProject\.bin$").alias("macros"), F.sum("bytes").alias("bytes"),
    )


def replace_media(packages: DataFrame, swaps: DataFrame) -> DataFrame:
    """path, content, replaced: packages whose parts with a given sha256 have new bytes (swaps: path, sha256, new)."""
    grouped = swaps.groupBy("path").agg(F.collect_list(F.struct("sha256", "new")).alias("swaps"))

    @F.pandas_udf("content binary, replaced int")
    def run(contents: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for content, swap in zip(contents, lists, strict=True):
            new_by, out, n = {s["sha256"]: s["new"] for s in (swap if swap is not None else [])}, io.BytesIO(), 0
            with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
                for info in old.infolist():
                    data = old.read(info)
                    found = new_by.get(hashlib.sha256(data).hexdigest())
                    n += found is not None
                    new.writestr(info, data if found is None else bytes(found))
            rows.append((out.getvalue(), n))
        return pd.DataFrame(rows, columns=["content", "replaced"])

    return packages.join(grouped, "path", "left").select("path", run("content", "swaps").alias("r")).select("path", "r.*")
