"""Texts written back into workbooks, slides and documents; a package changes whole or not at all."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.operators.formulas import rename
from glotmill.sources.office import _local, sheet_cells, shared_strings, word_paragraphs

_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_ROOT = re.compile(rb"<[A-Za-z_][^>]*?(?=/?>)")
_DECLARED = re.compile(rb"""xmlns(:[\w.-]+)?\s*=\s*("[^"]*"|'[^']*')""")
#: A part's new bytes by name, and what was wrong.
Changes = tuple[dict[str, bytes], list[str]]


def parse(content: bytes) -> ET.Element:
    """The part's tree; its prefixes are known to render() afterwards."""
    for prefix, uri in _DECLARED.findall(content):
        name = prefix[1:].decode()
        if not re.fullmatch(r"ns\d+", name):
            ET.register_namespace(name, uri[1:-1].decode())
    return ET.fromstring(content)


def render(root: ET.Element, content: bytes) -> bytes:
    """Bytes of a parsed part. Declarations of its old root stay, as attributes may name prefixes that no element uses."""
    out = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    old, new = _ROOT.search(content), _ROOT.search(out)
    known = {p for p, _ in _DECLARED.findall(new.group())}
    uris = {u[1:-1] for _, u in _DECLARED.findall(new.group())}
    lost = [(p, u) for p, u in dict(_DECLARED.findall(old.group())).items() if p not in known and (p or u[1:-1] not in uris)]
    more = b"".join(b" xmlns" + p + b"=" + u for p, u in lost if p)
    return out[: new.end()] + more + out[new.end() :]


def shares(target: str, old: list[str]) -> list[str]:
    """target cut into as many pieces as old has, in proportion to their lengths; all in the last one if they are empty."""
    total, at, cuts = sum(map(len, old)), 0, [0]
    for t in old:
        at += len(t)
        cuts.append(round(len(target) * at / total) if total else 0)
    cuts[-1] = len(target)
    return [target[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def edit_document(content: bytes, edits: dict[int, tuple[str, str]]) -> tuple[bytes, list[int]]:
    """A Word part with new texts by paragraph ordinal, and the ordinals that could not be written.

    Each needs its present text as source. Runs keep their formatting and share the new text in proportion to their old texts.
    Tabs and breaks follow the new text. Fields stay: target must hold the source's field marks in order,
    and the text between two marks goes to the runs between the two fields.
    """
    root, bad = parse(content), []
    now = dict(word_paragraphs(content))
    for n, p in enumerate((e for e in root.iter() if _local(e.tag) == "p"), 1):
        if n not in edits:
            continue
        source, target = edits[n]
        groups: list[list[tuple[ET.Element, ET.Element]]] = [[]]
        marks: list[tuple[ET.Element, ET.Element]] = []
        depth = 0

        def walk(e: ET.Element) -> None:
            nonlocal depth
            for c in list(e):
                tag = _local(c.tag)
                if tag in ("txbxContent", "p"):
                    continue
                if tag == "fldChar":
                    kind = next((v for k, v in c.attrib.items() if _local(k) == "fldCharType"), "")
                    depth += (kind == "begin") - (kind == "end" and depth > 0)
                    if kind == "end" and not depth:
                        groups.append([])
                elif tag == "fldSimple":
                    groups.append([])
                elif not depth and _local(e.tag) == "r" and tag == "t":
                    groups[-1].append((e, c))
                elif not depth and _local(e.tag) == "r" and tag in ("tab", "br", "cr"):
                    marks.append((e, c))
                else:
                    walk(c)

        walk(p)
        texts = re.split(r"\[\[field \d+\]\]", target or "")
        ordered = re.findall(r"\[\[field \d+\]\]", target or "") == re.findall(r"\[\[field \d+\]\]", source or "")
        if target is None or now.get(n) != source or not ordered or len(texts) != len(groups) or any(t and not g for t, g in zip(texts, groups, strict=True)):
            bad.append(n)
            continue
        for run, c in marks:
            run.remove(c)
        for text, group in zip(texts, groups, strict=True):
            for (run, t), piece in zip(group, shares(text, [t.text or "" for _, t in group]), strict=True):
                at = list(run).index(t)
                run.remove(t)
                for part in re.findall(r"[\t\n]|[^\t\n]+", piece):
                    made = ET.Element(t.tag[: -len("t")] + {"\t": "tab", "\n": "br"}.get(part, "t"))
                    if part not in "\t\n":
                        made.text = part
                        made.set(_SPACE, "preserve")
                    run.insert(at, made)
                    at += 1
    return render(root, content), sorted(bad + [n for n in edits if n not in now])


def edit_slide(content: bytes, edits: dict[tuple, tuple[str, str]]) -> tuple[bytes, list[tuple]]:
    """A slide with new texts by (shape id, row, column, paragraph), and the keys that could not be written.

    Runs keep their formatting and share the new text; VT stands for a break. Paragraphs with fields aren't written.
    """
    root, done = parse(content), set()
    for shape in (e for e in root.iter() if _local(e.tag) in ("sp", "graphicFrame", "cxnSp")):
        head = next((e for e in shape.iter() if _local(e.tag) == "cNvPr"), None)
        number = int(head.get("id", 0)) if head is not None else None
        cells = [(r, c, cell) for t in shape.iter() if _local(t.tag) == "tbl" for r, row in enumerate((x for x in t if _local(x.tag) == "tr"), 1) for c, cell in enumerate((x for x in row if _local(x.tag) == "tc"), 1)]
        for r, c, box in cells or [(None, None, shape)]:
            for n, p in enumerate((e for e in box.iter() if _local(e.tag) == "p"), 1):
                key = (number, r, c, n)
                if key not in edits or key in done:
                    continue
                source, target = edits[key]
                runs = [(x, t) for x in p.iter() for t in x if _local(t.tag) == "t"]
                now = "".join("\v" if _local(e.tag) == "br" else e.text or "" for e in p.iter() if _local(e.tag) in ("t", "br")).strip()
                if target is None or now != source or not runs or any(_local(e.tag) == "fld" for e in p):
                    continue
                for gone in [e for e in p if _local(e.tag) == "br"]:
                    p.remove(gone)
                for (run, t), piece in zip(runs, shares(target, [t.text or "" for _, t in runs]), strict=True):
                    first, *rest = piece.split("\v")
                    t.text = first
                    if run is p:  # bare text: breaks stand beside it
                        holder, at = p, list(p).index(t)
                        more = lambda text, t=t: _with_text(copy.copy(t), None, text)
                    else:
                        holder, at = p, list(p).index(run)
                        more = lambda text, run=run, t=t: _with_text(copy.deepcopy(run), t.tag, text)
                    for text in rest:
                        holder.insert(at + 1, ET.Element(t.tag[:-1] + "br"))
                        holder.insert(at + 2, more(text))
                        at += 2
                done.add(key)
    return render(root, content), [k for k in edits if k not in done]


def _with_text(e: ET.Element, tag: str | None, text: str) -> ET.Element:
    (e if tag is None else e.find(tag)).text = text
    return e


def edit_sheet(content: bytes, strings: list[str], edits: dict[str, tuple[str, str]]) -> tuple[bytes, list[str]]:
    """A worksheet with new texts by address, and the addresses that could not be written.

    A text goes into its cell (inline), so that cells sharing the old string keep it; the style stays. Formulas and
    cells whose text isn't the source aren't written.
    """
    root, done = parse(content), set()
    now = {}
    for c in sheet_cells(content):
        if c["formula"] is None:
            index = int(c["value"]) if c["type"] == "s" and (c["value"] or "").isdigit() else len(strings)
            now[c["address"]] = c["inline"] if c["type"] == "inlineStr" else c["value"] if c["type"] == "str" else strings[index] if index < len(strings) else None
    for c in (e for e in root.iter() if _local(e.tag) == "c"):
        address = c.get("r")
        if address not in edits or address in done:
            continue
        source, target = edits[address]
        if target is None or source is None or now.get(address) != source:
            continue
        for old in [k for k in c if _local(k.tag) in ("v", "is")]:
            c.remove(old)
        space = c.tag[:-1]
        made = ET.Element(space + "is")
        t = ET.SubElement(made, space + "t", {_SPACE: "preserve"})
        t.text = target
        c.insert(0, made)
        c.set("t", "inlineStr")
        done.add(address)
    return render(root, content), [a for a in edits if a not in done]


def rename_sheets(parts: dict[str, bytes], names: dict[str, str]) -> Changes:
    """Sheets renamed at once in the workbook, and in defined names, formulas, validations, charts, links and pivot sources."""
    root = parse(parts["xl/workbook.xml"])
    have = [e.get("name") for e in root.iter() if _local(e.tag) == "sheet"]
    then = [names.get(n, n) for n in have]
    errors = [f"no sheet {n}" for n in names if n not in have]
    errors += [f"sheet name {n!r} is not allowed" for n in names.values() if not n or len(n) > 31 or re.search(r"[\[\]:*?/\\]|^'|'$", n)]
    errors += ["two sheets would have one name"] if len({str(n).lower() for n in then}) < len(then) else []
    if errors:
        return {}, errors
    out = {}
    for part, content in parts.items():
        if not re.match(r"xl/(workbook|worksheets/[^/]+|charts/[^/]+|tables/[^/]+|pivotCache/[^/]+)\.xml$", part):
            continue
        tree, changed = (root if part == "xl/workbook.xml" else parse(content)), False
        for e in tree.iter():
            tag = _local(e.tag)
            if tag in ("f", "formula", "formula1", "formula2", "definedName", "calculatedColumnFormula") and e.text:
                new = rename(e.text, names)
                changed, e.text = changed or new != e.text, new
            elif tag == "hyperlink" and e.get("location"):
                new = rename(e.get("location"), names)
                changed = changed or new != e.get("location")
                e.set("location", new)
            elif (tag == "sheet" and e.get("name") in names) or (tag == "worksheetSource" and e.get("sheet") in names):
                key = "name" if tag == "sheet" else "sheet"
                e.set(key, names[e.get(key)])
                changed = True
        if changed:
            out[part] = render(tree, content)
    return out, []


def _by_part(edits: Iterable, key: Callable) -> tuple[dict[str, dict], list[str]]:
    todo: dict[str, dict] = {}
    errors = []
    for e in edits:
        one = (e["source"], e["target"])
        if todo.setdefault(e["part"], {}).setdefault(key(e), one) != one:
            errors.append(f"{e['part']}:{key(e)}: two texts")
    return todo, errors


def _edited(parts: dict[str, bytes], edits: list, key: Callable, editor: Callable) -> Changes:
    todo, errors = _by_part(edits, key)
    out = {}
    for part, now in todo.items():
        if part not in parts:
            errors.append(f"no part {part}")
            continue
        out[part], bad = editor(parts[part], now)
        errors += [f"{part}:{k}: not written" for k in bad]
    return out, errors


def _workbook(parts: dict[str, bytes], edits: list) -> Changes:
    strings = shared_strings(parts["xl/sharedStrings.xml"]) if "xl/sharedStrings.xml" in parts else []
    out, errors = _edited(parts, [e for e in edits if e["address"] is not None], lambda e: e["address"], lambda c, now: edit_sheet(c, strings, now))
    names = {e["source"]: e["target"] for e in edits if e["address"] is None}
    if names and "xl/workbook.xml" not in parts:
        errors.append("no part xl/workbook.xml")
    elif names:
        renamed, more = rename_sheets(parts | out, names)
        out, errors = out | renamed, errors + more
    return out, errors


def _slide_key(e: dict) -> tuple:
    return e["shape_id"], e["row"], e["col"], e["paragraph"]


def _rewritten(content: bytes, edits: list, editor: Callable) -> tuple[bytes, list[str]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as old:
            infos = old.infolist()
            parts = {i.filename: old.read(i) for i in infos}
        changed, errors = editor(parts, edits)
        if errors:
            return content, errors
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for info in infos:
                new.writestr(info, changed.get(info.filename, parts[info.filename]))
        with zipfile.ZipFile(out) as made:
            broken = made.testzip()
        return (content, [f"{broken}: damaged"]) if broken else (out.getvalue(), [])
    except (zipfile.BadZipFile, ET.ParseError) as e:
        return content, [f"unreadable: {e}"]


def _write(packages: DataFrame, edits: DataFrame, fields: tuple[str, ...], editor: Callable) -> DataFrame:
    """path, content, errors. A row for each package, and one without content for edits of a package that isn't there."""
    grouped = edits.groupBy("path").agg(F.collect_list(F.struct(*fields)).alias("edits"))

    @F.pandas_udf("content binary, errors array<string>")
    def run(contents: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for content, edit in zip(contents, lists, strict=True):
            if content is None:
                rows.append((None, ["no package"]))
            elif edit is None or not len(edit):
                rows.append((bytes(content), []))
            else:
                # Arrow may turn numbers beside nulls into floats.
                clean = [{k: (None if v != v else int(v)) if isinstance(v, float) else v for k, v in dict(e).items()} for e in edit]
                rows.append(_rewritten(bytes(content), clean, editor))
        return pd.DataFrame(rows, columns=["content", "errors"])

    joined = packages.select("path", "content").join(grouped, "path", "full")
    return joined.select("path", run("content", "edits").alias("r")).select("path", "r.*")


def write_documents(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """Word packages with edits (path, part, ord, source, target); see _write and edit_document()."""
    return _write(packages, edits, ("part", "ord", "source", "target"), lambda parts, e: _edited(parts, e, lambda x: x["ord"], edit_document))


def write_workbooks(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """Workbooks with edits (path, part, address, source, target) of cells; a null address renames sheet source to target."""
    return _write(packages, edits, ("part", "address", "source", "target"), _workbook)


def write_slides(packages: DataFrame, edits: DataFrame) -> DataFrame:
    """Slide packages with edits (path, part, shape_id, row, col, paragraph, source, target); see edit_slide()."""
    return _write(packages, edits, ("part", "shape_id", "row", "col", "paragraph", "source", "target"), lambda parts, e: _edited(parts, e, _slide_key, edit_slide))
