"""Spreadsheet formulas: tokens, references, renames, row mapping."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glotmill import fixed

_TOKEN = re.compile(
    r"""(?P<text>"(?:[^"]|"")*")"""
    r"""|(?P<sheet>(?:'(?:[^']|'')+'|[^\W\d][\w.]*|\[[^\]]+\][\w.]+)!)?"""
    r"""(?:(?P<area>\$?[A-Za-z]{1,3}\$?\d+:\$?[A-Za-z]{1,3}\$?\d+)|(?P<cols>\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3})(?![\w(])|(?P<rows>\$?\d+:\$?\d+)|(?P<cell>\$?[A-Za-z]{1,3}\$?\d+)(?![\w(.]))"""
    r"""|(?P<name>[^\W\d][\w.]*\(?)|(?P<number>\d+(?:\.\d+)?)|(?P<op>.)""",
    re.S,
)
MAX_ROW, MAX_COL = 1_048_576, 16_384


def _col(letters: str) -> int:
    n = 0
    for c in letters.replace("$", "").upper():
        n = n * 26 + ord(c) - 64
    return n


def _cell(a: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", a).groups()
    return _col(letters), int(digits)


def _name(sheet: str | None) -> str | None:
    if not sheet:
        return None
    s = sheet[:-1]
    return s[1:-1].replace("''", "'") if s.startswith("'") else s


def references(formula: str | None, sheet: str) -> list[dict]:
    """The cells and ranges that a formula names, and its string literals.

    kind is range, literal, external (another workbook) or unresolved (INDIRECT or OFFSET of something that isn't a
    literal). INDIRECT of a literal address is resolved.
    """
    out: list[dict] = []

    def add(kind: str, at: str | None, c0: int = 0, r0: int = 0, c1: int = 0, r1: int = 0, text: str | None = None) -> None:
        out.append({"kind": kind, "sheet": at, "c0": c0, "r0": r0, "c1": c1, "r1": r1, "text": text})

    tokens = [m for m in _TOKEN.finditer(formula or "")]
    for i, m in enumerate(tokens):
        kind, at = m.lastgroup, _name(m.group("sheet")) or sheet
        if kind == "text":
            body = m.group()[1:-1].replace('""', '"')
            called = i and tokens[i - 1].group().upper() == "INDIRECT("
            if called and i + 1 < len(tokens) and tokens[i + 1].group() in ",)" and re.fullmatch(r"(?:[^!]+!)?\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?", body):
                out += references(body, sheet)
            else:
                add("literal", None, text=body)
        elif kind in ("area", "cols", "rows", "cell"):
            if m.group("sheet") and "[" in m.group("sheet"):
                add("external", at, text=m.group())
                continue
            a, _, b = m.group(kind).partition(":")
            b = b or a
            if kind in ("area", "cell"):
                (c0, r0), (c1, r1) = _cell(a), _cell(b)
            elif kind == "cols":
                (c0, r0), (c1, r1) = (_col(a), 1), (_col(b), MAX_ROW)
            else:
                (c0, r0), (c1, r1) = (1, int(a.replace("$", ""))), (MAX_COL, int(b.replace("$", "")))
            add("range", at, min(c0, c1), min(r0, r1), max(c0, c1), max(r0, r1))
        elif kind == "name" and m.group().upper() in ("INDIRECT(", "OFFSET("):
            after = tokens[i + 1].lastgroup if i + 1 < len(tokens) else None
            if m.group().upper() == "OFFSET(" or after != "text":
                add("unresolved", None, text=m.group()[:-1])
    return out


def rename(formula: str | None, names: dict[str, str]) -> str | None:
    """The formula with sheet qualifiers renamed at once; literals and other workbooks' sheets stay."""
    if formula is None:
        return None
    low = {k.casefold(): v for k, v in names.items()}
    out = []
    for m in _TOKEN.finditer(formula):
        q, new = m.group("sheet"), low.get((_name(m.group("sheet")) or "").casefold())
        if not q or "[" in q or new is None:
            out.append(m.group())
            continue
        out.append("'" + new.replace("'", "''") + "'!" + m.group()[len(q) :])
    return "".join(out)


def map_rows(formula: str | None) -> str | None:
    """The formula with each row n as 2n - 1, where paired rows keep their sources.

    None if it calls a function whose result depends on rows (fixed.POSITIONAL), names another workbook, or would pass the last row.
    """
    if formula is None:
        return None
    tokens = [*_TOKEN.finditer(formula)]
    calls = {m.group("name")[:-1].upper().removeprefix("_XLFN.") for m in tokens if (m.group("name") or "").endswith("(")}
    if calls & set(fixed.POSITIONAL) or any("[" in (m.group("sheet") or "") for m in tokens):
        return None
    move = lambda a: re.sub(r"(\$?[A-Za-z]{1,3}\$?)(\d+)|^(\$?)(\d+)$", lambda m: (m[1] or m[3] or "") + str(2 * int(m[2] or m[4]) - 1), a)
    out = []
    for m in tokens:
        kind = m.lastgroup
        if kind in ("area", "cell", "rows"):
            if any(2 * int(n) - 1 > MAX_ROW for n in re.findall(r"\d+", m.group(kind))):
                return None
            out.append((m.group("sheet") or "") + ":".join(move(p) for p in m.group(kind).split(":")))
        else:
            out.append(m.group())
    return "".join(out)


def shift(formula: str | None, cols: int, rows: int) -> str | None:
    """A shared formula as it reads at a follower: relative parts of its addresses move by cols and rows."""
    if formula is None:
        return None

    def letters(n: int) -> str:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(65 + r) + s
        return s

    def one(a: str) -> str:
        m = re.fullmatch(r"(\$?)([A-Za-z]{1,3})(\$?)(\d+)", a)
        return a if not m else m[1] + (m[2] if m[1] else letters(_col(m[2]) + cols)) + m[3] + (m[4] if m[3] else str(int(m[4]) + rows))

    return "".join((m.group("sheet") or "") + ":".join(map(one, m.group(m.lastgroup).split(":"))) if m.lastgroup in ("area", "cell") else m.group() for m in _TOKEN.finditer(formula))


def references_column(formula: Column, sheet: Column) -> Column:
    """references() of a column."""

    @F.pandas_udf("array<struct<kind:string,sheet:string,c0:int,r0:int,c1:int,r1:int,text:string>>")
    def run(formulas: pd.Series, sheets: pd.Series) -> pd.Series:
        return pd.Series([references(f, s) for f, s in zip(formulas, sheets, strict=True)])

    return run(formula, sheet)


def mapped_column(formula: Column) -> Column:
    """map_rows() of a column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(map_rows)

    return run(formula)


def renamed_column(formula: Column, names: dict[str, str]) -> Column:
    """rename() of a column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda f: rename(f, names))

    return run(formula)
